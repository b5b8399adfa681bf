"""Token counts by a linear longest-match automaton.

Greedy word pieces: a word (a run of other than ASCII white space, with the word mark before it) is cut from the left into
the longest pieces of the vocabulary; a character that no piece starts with counts as its UTF-8 bytes.  The automaton is
the trie of the pieces with failure links: where the next character does not continue the trie, the link leads to the state
after the longest pieces at the front have been popped, and the link carries how many tokens these were.  Counts add up
along the links, so no piece is built and no character is read twice.

One map over whole texts, no shuffle; a bounded table remembers counts of short words.  The vocabulary (one file, a fixed size) is
broadcast.  NULL and empty texts have 0 tokens; repeated rows each give a row; a NULL id is kept; empty tables
stay empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .pieces import MODEL, SPACE, load

CACHE = 150_000


class Automaton:
    """Arrays by state: next (a dict per state), link and popped (tokens that following the link pops)."""

    def __init__(self, pieces):
        self.next: list[dict[str, int]] = [{}]
        token = [0]                                  # tokens that the state's own string is, 0: no piece
        for p in sorted(set(pieces), key=lambda p: (len(p), p)):
            state = 0
            for c in p:
                to = self.next[state].get(c)
                if to is None:
                    to = self.next[state][c] = len(self.next)
                    self.next.append({})
                    token.append(0)
                state = to
            token[state] = 1
        for c, s in self.next[0].items():            # a character that is no piece stands for its bytes
            token[s] = token[s] or len(c.encode("utf-8", "replace"))
        for p in {c for n in self.next for c in n} - set(self.next[0]):
            self.next[0][p] = len(self.next)
            self.next.append({})
            token.append(len(p.encode("utf-8", "replace")))
        self.link, self.popped = [0] * len(self.next), [0] * len(self.next)
        queue = list(self.next[0].values())
        for s in queue:
            self.popped[s] = token[s]
        while queue:
            later = []
            for u in queue:
                for c, v in self.next[u].items():
                    if token[v]:
                        self.link[v], self.popped[v] = 0, token[v]
                    else:
                        z, n = self.link[u], self.popped[u]
                        while c not in self.next[z]:         # the root goes on with any character of the pieces
                            n += self.popped[z]
                            z = self.link[z]
                        self.link[v], self.popped[v] = self.next[z][c], n
                    later.append(v)
            queue = later

    def count(self, word: str) -> int:
        """Tokens of a word, reading each character once."""
        nxt, link, popped, state, n = self.next, self.link, self.popped, 0, 0
        for c in word:
            to = nxt[state].get(c)
            while to is None and state:
                n += popped[state]
                state = link[state]
                to = nxt[state].get(c)
            if to is None:
                n += len(c.encode("utf-8", "replace"))
            else:
                state = to
        while state:
            n += popped[state]
            state = link[state]
        return n


def counts_table(pieces) -> dict:
    """word (bytes) -> tokens; remembers short words up to a bound."""
    automaton = Automaton(pieces)

    class Table(dict):
        def __missing__(self, word: bytes) -> int:
            n = automaton.count(SPACE + word.decode("utf-8", "replace"))
            if len(word) <= 64:
                if len(self) >= CACHE:
                    self.clear()
                self[word] = n
            return n

    return Table()


_KEPT: dict[str, dict] = {}


def token_counts(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(load(model).ids))
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _KEPT:
            _KEPT[model] = counts_table(shared.value)
        table = _KEPT[model]
        for b in batches:
            words = [t.encode("utf-8", "replace").split() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array([len(w) for w in words], np.int64)),
                 pa.array(np.array([sum(map(table.__getitem__, w)) for w in words], np.int64))],
                names=["doc_id", "n_words", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_tokens bigint")

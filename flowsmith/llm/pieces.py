"""SentencePiece encoding and decoding by a max-plus parallel scan.

The vocabulary file is a BPE model, so the best path is the one whose neighbouring pieces are all compatible: two pieces are
compatible if encoding their concatenation gives back these two.  Merges away from a border do not depend on what
lies beyond it, so a segmentation whose neighbours are all compatible is the
encoding, and there is exactly one.  In the max-plus semiring a compatible step weighs 0 and any other -inf.

A document longer than ``CHUNK`` characters is cut into chunks that separate tasks work on:

1. *Transfer.*  A border state is the piece that starts before the border and ends on or after it.  One pass over a chunk gives
   its matrix from the states at its left border to those at its right border.
2. *Combine.*  Matrices are multiplied in the max-plus semiring from both ends; the one state
   that is finite from both sides is the border's state.
3. *Backtrace.*  Every chunk walks its own path between its two known states.

Matrices are combined in two levels: groups of ``GROUP`` neighbouring chunks are multiplied by separate tasks, the products of
a document's groups give the states at the groups' borders, and each group then finds the states within.

No piece spans the place where a run of word characters meets the next space mark, so there all states meet in one.
Between such places the path is that of each word by itself.  The different words of a part of the batch are encoded together: numpy
merges the best-scored neighbours of all of them step by step, which is the path whose steps all weigh 0.  Words beyond ``WORD``
characters are walked by the scan; text without spaces goes through the matrices alone.
Shorter documents are one chunk whose two states are known and need no shuffle.

Characters outside of the vocabulary become their UTF-8 bytes' pieces.  NULL and empty texts encode to no pieces.  Decoding
turns pieces into text again and drops the space that encoding puts first; only the space mark U+2581 itself
comes back as a space.  Repeated rows each give a row; a NULL id is kept; empty tables stay empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, whole_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 65_536
SPACE = "▁"
PAIRS = 500_000
WORD = 64                    # longer words are not merged in step with the others
PART = 1_000_000             # characters whose words are encoded together
GROUP = 64                   # chunks whose matrices one task multiplies
NONE = np.int32(2**31 - 1)   # rank of neighbours that do not merge
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
FREE = -np.inf


@dataclass(frozen=True)
class Vocabulary:
    ids: dict[str, int]          # ordinary pieces
    scores: dict[str, float]
    byte_ids: tuple[int, ...]    # by byte value
    size: int

    @property
    def longest(self) -> int:
        return max(map(len, self.ids))


def load(path: str = MODEL) -> Vocabulary:
    """The pieces of a SentencePiece BPE file with byte fallback and without text normalisation."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    names = {sp.id_to_piece(i): i for i in plain}
    return Vocabulary(names, {p: sp.get_score(i) for p, i in names.items()},
                      tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)), sp.get_piece_size())


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        return i


class Merger:
    """The pairs of pieces whose concatenation is a piece, in an open-addressed table, and the merging of many words at once."""

    def __init__(self, v: Vocabulary):
        rank = {x: i for i, x in enumerate(sorted(set(v.scores.values()), reverse=True))}
        rows = [(v.ids[p[:k]] * v.size + v.ids[p[k:]], i, rank[v.scores[p]])
                for p, i in v.ids.items() for k in range(1, len(p)) if p[:k] in v.ids and p[k:] in v.ids]
        self.size, self.bits = v.size, max(4, (8 * len(rows)).bit_length())
        self.key, self.piece, self.rank = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), np.full(1 << self.bits, NONE)
        todo, step = np.arange(len(rows)), 0
        cols = [np.array([r[c] for r in rows], np.int64) for c in range(3)]
        while len(todo):                                             # who finds a free slot takes it, the others try the next one
            at = self._slot(cols[0][todo], step)
            free = self.key[at] < 0
            self.key[at[free]] = cols[0][todo[free]]
            won = free & (self.key[at] == cols[0][todo])
            self.piece[at[won]], self.rank[at[won]] = cols[1][todo[won]], cols[2][todo[won]]
            todo, step = todo[~won], step + 1
        self.char = -1 - np.arange(0x110000, dtype=np.int32)         # id of each character; -1 - code: none
        for p, i in v.ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i

    def _slot(self, key: np.ndarray, step: int) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)
        return (mixed.astype(np.int64) + step) & ((1 << self.bits) - 1)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, or an empty one (rank NONE) where it merges to no piece."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, 0)
        at = self._slot(key, 0)
        todo = np.flatnonzero((self.key[at] != key) & (self.key[at] >= 0))
        step = 1
        while len(todo):
            at[todo] = self._slot(key[todo], step)
            todo = todo[(self.key[at[todo]] != key[todo]) & (self.key[at[todo]] >= 0)]
            step += 1
        return at

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that each pair merges to, NONE where it merges to none."""
        return np.where((left >= 0) & (right >= 0), self.rank[self._find(left, right)], NONE)

    def merge(self, words: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the word, id) of all pieces, each word's in order: in every step each word merges its best pair, the leftmost of
        equals; -1 - code stands for a character outside of the vocabulary."""
        of = np.repeat(np.arange(len(words)), size)
        sym = self.char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        rank = np.full(len(of), NONE)                                # of the pair that starts here
        inner = np.flatnonzero(of[1:] == of[:-1])
        rank[inner] = self._ranks(sym[inner], sym[inner + 1])
        done_of, done_sym = [of[:0]], [sym[:0]]
        while len(of):
            start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            best = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(of))))
            live = best != NONE
            if not live.all():                                       # finished words leave
                done_of.append(of[~live])
                done_sym.append(sym[~live])
                of, sym, rank, best = of[live], sym[live], rank[live], best[live]
                if not len(of):
                    break
            at = np.flatnonzero(rank == best)
            at = at[np.concatenate(([True], of[at][1:] != of[at][:-1]))]
            sym[at] = self.piece[self._find(sym[at], sym[at + 1])]
            stay = np.ones(len(of), bool)
            stay[at + 1] = False
            at -= np.arange(len(at))                                 # one symbol less for each word before
            of, sym, rank = of[stay], sym[stay], rank[stay]
            rank[at] = NONE
            right = at[at + 1 < len(of)]
            right = right[of[right] == of[right + 1]]
            rank[right] = self._ranks(sym[right], sym[right + 1])
            left = at[at > 0] - 1
            left = left[of[left] == of[left + 1]]
            rank[left] = self._ranks(sym[left], sym[left + 1])
        return np.concatenate(done_of), np.concatenate(done_sym)


class Encoder:
    """The scan over one chunk; all its tables are bounded."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.longest = vocabulary, vocabulary.longest
        self.pairs: dict[int, bool] = {}     # by first id * size + second id
        self.names = {i: p for p, i in vocabulary.ids.items()}
        self.starts: dict = {}               # trie of the pieces; None marks a piece
        self.shorter: dict = {}              # longest piece that a piece starts with; -1: its first character is none; None: it is one
        self.widths = {i: len(p) for p, i in vocabulary.ids.items()}
        for piece, i in vocabulary.ids.items():
            node = self.starts
            for c in piece:
                node = node.setdefault(c, {})
            node[None] = i
            self.shorter[i] = next((vocabulary.ids[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in vocabulary.ids),
                                   -1 if len(piece) > 1 else None)
        self.merger, self.table = Merger(vocabulary), decode_table(vocabulary)

    # -- pieces ---------------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best-scored neighbours, leftmost first."""
        scores, parts = self.v.scores, list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: str, b: str) -> bool:
        """Weight 0 (True) or -inf (False) of the step from piece a to piece b."""
        i, j = self.v.ids.get(a), self.v.ids.get(b)
        # a character outside of the vocabulary merges with nothing
        return True if i is None or j is None else self.fits_ids(i, j)

    def fits_ids(self, i: int, j: int) -> bool:
        key = i * self.v.size + j
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self._stay_apart(self.names[i], self.names[j])
        return got

    def _stay_apart(self, a: str, b: str) -> bool:
        """Whether merging a + b as one text never joins anything across the border."""
        get, parts, border = self.v.scores.get, [*a, *b], len(a)
        scores = [get(parts[i] + parts[i + 1], FREE) for i in range(len(parts) - 1)]
        while scores:
            best = max(scores)
            if best == FREE:
                break
            at = scores.index(best)
            if at == border - 1:
                return False
            border -= at < border - 1
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], FREE)
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], FREE)
        return parts == [a, b]

    def ids_of(self, parts: list[str]) -> np.ndarray:
        ids, raw = self.v.ids, self.v.byte_ids
        out: list[int] = []
        for p in parts:
            i = ids.get(p)
            if i is None:
                out += [raw[b] for b in p.encode("utf-8", "replace")]
            else:
                out.append(i)
        return np.array(out, np.int32)

    def ends(self, text: str, s: int, stop: int) -> list[int]:
        """Ends of the pieces that start at s (a single character always counts)."""
        ids = self.v.ids
        return [s + 1] + [e for e in range(s + 2, min(stop, s + self.longest) + 1) if text[s:e] in ids]

    # -- from a known start ----------------------------------------------------------------

    def scan(self, text: str) -> list[tuple[int, int]]:
        """(id, end) of the pieces of a text that starts and ends at places no piece spans, first one first; id -1: a character
        outside of the vocabulary.  Each prefix has one path whose steps all weigh 0, so a place that leads no further is dead for
        good: the path goes on with the longest piece that fits, and steps back where none does."""
        n, starts, shorter, widths = len(text), self.starts, self.shorter, self.widths
        pair, fits, size = self.pairs.get, self.fits_ids, self.v.size
        out: list[tuple[int, int]] = []
        dead: set[int] = set()
        at, before, p, e, fresh = 0, -1, -1, 0, True
        while at < n:
            if fresh:                                # the longest piece that starts here
                node, p, e = starts, -1, at + 1
                for k in range(at, n):
                    node = node.get(text[k])
                    if node is None:
                        break
                    if None in node:
                        p, e = node[None], k + 1
            while True:
                if e not in dead:
                    if before < 0 or p < 0:
                        break
                    fit = pair(before * size + p)
                    if fit is None:
                        fit = fits(before, p)
                    if fit:
                        break
                p = shorter[p] if p >= 0 else None
                if p is None:
                    break
                e = at + (widths[p] if p >= 0 else 1)
            if p is not None:
                out.append((p, e))
                at, before, fresh = e, p, True
                continue
            dead.add(at)                             # the piece before was too long: its next shorter one
            q, at = out.pop()[0], out[-1][1] if out else 0
            before, fresh = out[-1][0] if out else -1, False
            p = shorter[q] if q >= 0 else None
            while p is None:                         # it has none either
                dead.add(at)
                q, at = out.pop()[0], out[-1][1] if out else 0
                before = out[-1][0] if out else -1
                p = shorter[q] if q >= 0 else None
            e = at + (widths[p] if p >= 0 else 1)
        return out

    def word_ids(self, word: str) -> list[int]:
        """The ids of one word by the scan."""
        out = []
        for i, e in self.scan(word):
            out += [i] if i >= 0 else [self.v.byte_ids[b] for b in word[e - 1].encode("utf-8", "replace")]
        return out

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of marked texts (see ``marked``) that start and end at places no piece spans."""
        numbers, found = Numbers(), []
        for t in texts:
            # without two space marks together each mark starts a word
            words = WORDS.findall(t) if SPACE * 2 in t or t[:1] != SPACE else t.replace(SPACE, f" {SPACE}")[1:].split(" ")
            found.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        sizes = np.array([len(f) for f in found])
        word = np.concatenate([np.empty(0, np.int64), *found])
        ids, first, count = self._words(list(numbers))
        n = count[word]
        flat = ids[np.repeat(first[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        ends = np.concatenate(([0], np.cumsum(n)))
        return flat, ends[np.concatenate(([0], np.cumsum(sizes)))]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, the words' first places, their numbers of ids)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero(size <= WORD)
        of, ids = self.merger.merge(words if len(short) == len(words) else [words[k] for k in short], size[short])
        of = short[of]
        unknown = np.flatnonzero(ids < 0)                # characters outside of the vocabulary become their bytes
        if len(unknown):
            chars, which = np.unique(-1 - ids[unknown], return_inverse=True)
            raw = [[self.v.byte_ids[b] for b in chr(c).encode("utf-8", "replace")] for c in chars.tolist()]
            n = np.ones(len(ids), np.int64)
            n[unknown] = np.array([len(r) for r in raw])[which]
            first = (np.cumsum(n) - n)[unknown]
            of, ids = np.repeat(of, n), np.repeat(ids, n)
            for k, r in enumerate(raw):
                for j, b in enumerate(r):
                    ids[first[which == k] + j] = b
        long = np.flatnonzero(size > WORD).tolist()
        if long:
            more = [self.word_ids(words[k]) for k in long]
            of = np.concatenate([of, np.repeat(long, [len(m) for m in more])])
            ids = np.concatenate([ids, *[np.array(m, np.int32) for m in more]])
        order = np.argsort(of, kind="stable")
        count = np.bincount(of, minlength=len(words))
        return ids[order].astype(np.int32), np.cumsum(count) - count, count

    def encode(self, text: str) -> np.ndarray:
        """Ids of one such text."""
        return self.encode_all([text])[0]

    # -- one chunk of a giant document -----------------------------------------------------

    def states(self, text: str, border: int) -> list[tuple[int, int]]:
        """Pieces (start, end) that start before the border and end on or after it; at the text's start the empty piece."""
        if border == 0:
            return [(0, 0)]
        return [(s, e) for s in range(max(0, border - self.longest), border) for e in self.ends(text, s, len(text)) if e >= border]

    def forward(self, text: str, begin: list[tuple[int, int]], a: int, b: int) -> dict[int, list[tuple[int, int]]]:
        """From the states ``begin`` at border a to border b: {end: [(start, mask)]}; bit i of the mask: state i leads there."""
        at: dict[int, list[tuple[int, int]]] = {}
        for i, (s, e) in enumerate(begin):
            at.setdefault(e, []).append((s, 1 << i))
        for p in range(a, b):
            here = at.get(p)
            if not here:
                continue
            before = [(text[s:p], m) for s, m in here]
            for e in self.ends(text, p, len(text)):
                piece, mask = text[p:e], 0
                for q, m in before:
                    if m & ~mask and (not q or self.fits(q, piece)):
                        mask |= m
                if mask:
                    at.setdefault(e, []).append((p, mask))
        return at

    def meetings(self, text: str, a: int, b: int) -> tuple[int, int] | None:
        """First and last place strictly within (a, b) that no piece spans."""
        found = [p for p in (text.find(SPACE, a + 1, b),) if p > 0]
        while found and text[found[0] - 1] == SPACE:
            p = text.find(SPACE, found[0] + 1, b)
            found = [p] if p > 0 else []
        if not found:
            return None
        last = text.rfind(SPACE, a + 1, b)
        while text[last - 1] == SPACE:
            last = text.rfind(SPACE, a + 1, last)
        return found[0], last

    def transfer(self, text: str, a: int, b: int) -> tuple[list, list, np.ndarray]:
        """(states at a, states at b, max-plus matrix between them) of the chunk [a, b)."""
        begin, end = self.states(text, a), self.states(text, b)
        cut = self.meetings(text, a, b)
        matrix = np.full((len(begin), len(end)), FREE)
        if cut:
            reach = self.forward(text, begin, a, cut[0])
            ins = 0
            for _, m in reach.get(cut[0], []):
                ins |= m
            tail = self.forward(text, [(cut[1], cut[1])], cut[1], b)
        else:
            ins, tail = None, self.forward(text, begin, a, b)
        for j, (s, e) in enumerate(end):
            for s2, m in tail.get(e, []):
                if s2 == s:
                    m = (ins if m else 0) if cut else m
                    for i in range(len(begin)):
                        if m >> i & 1:
                            matrix[i, j] = 0.0
        return begin, end, matrix

    def walk(self, text: str, first: tuple[int, int], a: int, goal: tuple[int, int], b: int) -> list[str]:
        """The pieces after ``first`` up to and with ``goal``."""
        at = self.forward(text, [first], a, b)
        out, (s, e) = [], goal
        while s >= a and (s, e) != first:
            piece = text[s:e]
            out.append(piece)
            before = [q for q, _ in at.get(s, []) if q == s or self.fits(text[q:s], piece)]
            q = before[0]
            s, e = q, s
            if e == s:
                break
        return out[::-1]

    def backtrace(self, text: str, a: int, b: int, first: tuple[int, int], goal: tuple[int, int]) -> np.ndarray:
        """Ids of the pieces that start in the chunk [a, b), between its border states."""
        cut = self.meetings(text, a, b)
        if not cut:
            return self.ids_of(self.walk(text, first, a, goal, b))
        head = self.forward(text, [first], a, cut[0])
        s = head[cut[0]][0][0]
        begin = self.walk(text, first, a, (s, cut[0]), cut[0]) if (s, cut[0]) != first else []
        end = self.walk(text, (cut[1], cut[1]), cut[1], goal, b)
        return np.concatenate((self.ids_of(begin), self.encode(text[cut[0]:cut[1]]), self.ids_of(end)))


def marked(text: str) -> str:
    """The text as the vocabulary sees it: a space first, spaces as marks."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def combine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Max-plus product; associative, so matrices can be combined in any grouping."""
    return (x[:, :, None] + y[None, :, :]).max(axis=1)


def decode(ids, table: list[bytes]) -> str:
    """Text of the ids: pieces joined, byte pieces as bytes, without the first space."""
    raw = b"".join([table[i] for i in ids])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def decode_table(v: Vocabulary) -> list[bytes]:
    out = [b""] * v.size
    for p, i in v.ids.items():
        out[i] = p.replace(SPACE, " ").encode()
    for b, i in enumerate(v.byte_ids):
        out[i] = bytes([b])
    return out


# -- Spark ------------------------------------------------------------------------------

_KEPT: dict[str, Encoder] = {}


def _encoder(shared, key: str) -> Encoder:
    """One encoder for each Python worker: its word table serves all tasks of the worker."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Encoder(shared.value)
    return _KEPT[key]


def _id_lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *rows]), pa.int32()))


def encode_documents(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text",
                     chunk: int = CHUNK, decoded: bool = False) -> DataFrame:
    """One row per input row: doc_id, token_ids (array<int>) of the whole text; with ``decoded`` also ``text``, decoded from the ids by the
    same worker (``decode_documents`` after it would keep a second worker per task)."""
    spark, vocabulary = docs.sparkSession, load(model)
    shared = spark.sparkContext.broadcast(vocabulary)        # one file's pieces: a fixed size
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    giant = F.char_length("text") > chunk
    schema = f"doc_id {kind}, token_ids array<int>" + (", text string" if decoded else "")
    short = rows.filter(~giant).mapInArrow(_short(shared, model, decoded), schema)
    giants = _giants(spark, rows.filter(giant), shared, model, chunk, vocabulary.longest, kind)
    return short.unionByName(decode_documents(giants, model) if decoded else giants)


def _short(shared, key: str, decoded: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared, key)
        for b in batches:
            sizes = np.cumsum(pa.compute.utf8_length(b.column(1)).to_numpy(zero_copy_only=False))
            part = sizes // PART                          # bounds the words and ids held at once
            for at in np.flatnonzero(np.diff(part, prepend=-1)).tolist():
                n = int(np.searchsorted(part, part[at], side="right")) - at
                ids, ends = enc.encode_all([marked(t) for t in b.column(1).slice(at, n).to_pylist()])
                cols = [b.column(0).slice(at, n), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
                if decoded:
                    cols.append(pa.array([decode(ids[s:e].tolist(), enc.table) for s, e in zip(ends[:-1], ends[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "token_ids", "text"][:len(cols)])
    return run


def _cut(chunk: int, longest: int):
    """Chunks of each text, cut in one pass, with the characters that a border piece can reach to on both sides."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = marked(text.as_py())
                for k, at in enumerate(range(0, len(text), chunk)):
                    left = min(at, longest)
                    yield pa.RecordBatch.from_pydict(
                        {"rid": [rid], "k": [k], "a": [left], "b": [left + min(chunk, len(text) - at)], "text": [text[at - left:at + chunk + longest]]},
                        schema=pa.schema([("rid", pa.int64()), ("k", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("text", pa.string())]))
    return run


def _giants(spark: SparkSession, rows: DataFrame, shared, key: str, chunk: int, longest: int, kind: str) -> DataFrame:
    whole = materialize(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"))
    chunks = materialize(whole.select("rid", "text").mapInArrow(_cut(chunk, longest), "rid bigint, k int, a int, b int, text string")
                         .repartition("rid", "k"))
    matrices = materialize(chunks.mapInArrow(_transfers(shared, key), f"rid bigint, k int, {MATRIX}"))
    group = (F.col("k") / GROUP).cast("int").alias("g")
    grouped = matrices.select("rid", group, "k", "rows", "cols", "free")
    products = grouped.groupBy("rid", "g").applyInArrow(_product, f"rid bigint, k int, {MATRIX}")
    borders = products.groupBy("rid").applyInArrow(_states_between, "rid bigint, k int, i int, j int")     # a row per group of a document
    outer = borders.select("rid", F.col("k").alias("g"), F.col("i").alias("i0"), F.col("j").alias("j0"))
    states = grouped.join(outer, ["rid", "g"]).groupBy("rid", "g").applyInArrow(_states_between, "rid bigint, k int, i int, j int")
    paths = chunks.join(states, ["rid", "k"]).select("rid", "k", "a", "b", "i", "j", "text").mapInArrow(
        _backtraces(shared, key), "rid bigint, k int, ids array<int>")
    joined = paths.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))   # one document
    return joined.join(whole.select("rid", "doc_id"), "rid").select(
        "doc_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("token_ids"))


MATRIX = "rows int, cols int, free array<int>"


def _matrices(table: pa.Table) -> tuple[list[int], list[np.ndarray]]:
    """Numbers and matrices of the rows, in order of their numbers."""
    got = []
    for r in table.select(["k", "rows", "cols", "free"]).to_pylist():
        m = np.full(r["rows"] * r["cols"], FREE)
        m[r["free"]] = 0.0
        got.append((r["k"], m.reshape(r["rows"], r["cols"])))
    got.sort(key=lambda x: x[0])
    return [k for k, _ in got], [m for _, m in got]


def _product(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The matrix of a group of neighbouring chunks, numbered by the group."""
    m = reduce(combine, _matrices(table)[1])
    return pa.table({"rid": pa.array([key[0].as_py()], pa.int64()), "k": pa.array([key[1].as_py()], pa.int32()),
                     "rows": pa.array([m.shape[0]], pa.int32()), "cols": pa.array([m.shape[1]], pa.int32()),
                     "free": pa.array([np.flatnonzero(m.ravel() == 0).astype(np.int32)], pa.list_(pa.int32()))})


def _states_between(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The border states of each matrix of a sequence; with columns i0 and j0 the outer states are known."""
    numbers, matrices = _matrices(table)
    outer = (table.column("i0")[0].as_py(), table.column("j0")[0].as_py()) if "i0" in table.column_names else None
    pairs = border_states(matrices, outer)
    return pa.table({"rid": pa.array([key[0].as_py()] * len(numbers), pa.int64()), "k": pa.array(numbers, pa.int32()),
                     "i": pa.array([p[0] for p in pairs], pa.int32()), "j": pa.array([p[1] for p in pairs], pa.int32())})


def _transfers(shared, key: str):
    def run(batches):
        enc = _encoder(shared, key)
        for batch in batches:
            got = [enc.transfer(r["text"], r["a"], r["b"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(g[0]) for g in got], pa.int32()),
                 pa.array([len(g[1]) for g in got], pa.int32()),
                 pa.array([np.flatnonzero(g[2].ravel() == 0).astype(np.int32) for g in got], pa.list_(pa.int32()))],
                names=["rid", "k", "rows", "cols", "free"])
    return run


def border_states(matrices: list[np.ndarray], outer: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """(state at the left border, state at the right border) of each matrix: the states that are finite both from
    the start and from the end (``outer``: the states there, where they are known)."""
    ahead, back = [np.zeros((1, matrices[0].shape[0]))], [np.zeros((matrices[-1].shape[1], 1))]
    if outer:
        ahead[0][:], back[0][:] = FREE, FREE
        ahead[0][0, outer[0]] = back[0][outer[1], 0] = 0.0
    for m in matrices:
        ahead.append(combine(ahead[-1], m))
    for m in reversed(matrices):
        back.append(combine(m, back[-1]))
    states = [int(np.argmax(f[0] + b[:, 0])) for f, b in zip(ahead, reversed(back))]
    return list(zip(states, states[1:]))


def _backtraces(shared, key: str):
    def run(batches):
        enc = _encoder(shared, key)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                t, a, b = r["text"], r["a"], r["b"]
                out.append(enc.backtrace(t, a, b, enc.states(t, a)[r["i"]], enc.states(t, b)[r["j"]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _id_lists(out)], names=["rid", "k", "ids"])
    return run


def decode_documents(encoded: DataFrame, model: str = MODEL, ids_col: str = "token_ids") -> DataFrame:
    """The encoded rows with ``text`` decoded from the ids (NULL ids: NULL)."""
    table = encoded.sparkSession.sparkContext.broadcast(decode_table(load(model)))

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        ok = ids.is_valid().to_pylist()
        return pa.array([decode(flat[s:e].tolist(), table.value) if v else None
                         for s, e, v in zip(ends[:-1], ends[1:], ok)], pa.string())

    return encoded.withColumn("text", text(F.col(ids_col)))

"""Periodic runs of words: stretches that repeat with a smallest period q, at least max(24, 3 q) words long.

Documents of a batch lie one after the other in one array of word numbers (no number is shared by two documents, so nothing
matches across a border) and numpy works on all of them together.

* Periods below 8 x ``FIRST``: a direct scan of each lag q.  The words that equal the word q further on form a stretch of
  at least T = max(24, 3 q) - q in a run, so it is enough to look at every T-th word.
* Longer periods: for K = FIRST, 2 FIRST, ... the periods from 8 K to 16 K.  The minimizers are the positions whose K-word hash is
  the smallest of a window of K positions (all of them where several are smallest), so which are chosen follows from the words
  alone: inside a run they repeat at period distance.  Equal minimizers at most K/2 apart are one chain (a stretch of a far shorter
  period); only its head stays.  Heads with equal hash, 8 K to 16 K apart, seed an extension.  No run is missed: away from its
  ends by 3.5 K at most, heads repeat at period distance, that leaves 2 q - 3.5 K >= 1.5 q positions for the first of a pair, and a
  chain that spans as much would give the whole run a period of K/2 or less.  Any head has at most 32 partners.
* Seeds are held against prefix hashes first (a run covers T/2 words on one side of the seed; equal words have equal
  hashes, so this loses nothing), the rest are extended word by word.  Stretches found with multiples of a period have the
  same ends, so the smallest period of equal ends is the run's.

One map over whole texts, no shuffle; memory follows the longest text of a batch.  NULL and empty texts have no words and no
runs; repeated rows each give a row; a NULL id is kept; of equal ratios the earlier start, then the smaller period is the best; empty
tables stay empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

FIRST = 8                     # words of the smallest minimizer
SHORTEST, TIMES = 24, 3       # a run has at least so many words, and so many periods
BLOCK_WORDS = 1 << 18         # documents are taken together up to so many words

_BASE = 0x9E3779B97F4A7C15    # odd, so it has an inverse modulo 2**64
_BACK = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _sliding(a: np.ndarray, w: int, pick: np.ufunc) -> np.ndarray:
    """pick over every ``w`` neighbours, ``w`` a power of two."""
    step = 1
    while step < w:
        a = pick(a[:-step], a[step:])
        step *= 2
    return a


class _Block:
    """Runs of the word numbers ``v``; the documents are ordered by falling length."""

    def __init__(self, v: np.ndarray, lengths: np.ndarray, first: int):
        self.v, self.n, self.lengths, self.first = v, len(v), lengths, first
        self.power = _powers(_BASE, self.n + 1)
        self.prefix = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_mixed(v.astype(np.uint64) + np.uint64(1)) * self.power[:-1], out=self.prefix[1:], dtype=np.uint64)
        self.period = np.zeros(self.n, np.int64)          # of the run found last at a word, 0: none
        self.end = np.zeros(self.n, np.int64)
        self.found: dict[tuple[int, int], int] = {}

    def equal(self, at, lag, count) -> np.ndarray:
        """Whether ``count`` words from ``at`` may equal those ``lag`` further on (never false where they do)."""
        lag, count = np.broadcast_to(lag, at.shape), np.broadcast_to(count, at.shape)
        ok = (at >= 0) & (at + lag + count <= self.n)
        at, lag, count = at[ok], lag[ok], count[ok]
        p = self.prefix
        ok[ok] = (p[at + count] - p[at]) * self.power[lag] == p[at + lag + count] - p[at + lag]
        return ok

    def stretch(self, x: int, lag: int) -> tuple[int, int]:
        """The words around ``x`` that equal the word ``lag`` further on."""
        v, right, left, size = self.v, x, x, 64
        while right + lag < self.n:
            part = v[right:right + size][:self.n - lag - right] != v[right + lag:right + lag + size]
            k = int(part.argmax()) if part.any() else -1
            if k >= 0:
                right += k
                break
            right += len(part)
            size *= 2
        size = 64
        while left:
            low = max(0, left - size)
            part = (v[low:left] != v[low + lag:left + lag])[::-1]
            k = int(part.argmax()) if part.any() else -1
            if k >= 0:
                left -= k
                break
            left = low
            size *= 2
        return left, right

    def settle(self, at: np.ndarray, lag: np.ndarray, count) -> None:
        """Extends the seeds whose ``count`` words on one side are equal at their lag."""
        good = self.equal(at, lag, count) | self.equal(at - count, lag, count)
        at, lag = at[good], np.broadcast_to(lag, at.shape)[good]
        known = self.period[at]
        good = (known == 0) | (lag % np.maximum(known, 1) != 0) | (at + lag >= self.end[at])
        at, lag = at[good], lag[good]
        order = np.lexsort((at, lag))
        last, until = 0, -1
        for x, q in zip(at[order].tolist(), lag[order].tolist()):
            if q == last and x < until:
                continue
            p = int(self.period[x])
            if p and q % p == 0 and x + q < self.end[x]:       # this lag shows the same run again
                continue
            left, right = self.stretch(x, q)
            last, until = q, right
            if right + q - left >= max(SHORTEST, TIMES * q):
                span = (left, right + q)
                self.found[span] = min(q, self.found.get(span, q))
                self.period[left:right + q], self.end[left:right + q] = q, right + q

    def scan_lags(self) -> None:
        for q in range(1, 8 * self.first):
            n = int(self.lengths[self.lengths >= max(SHORTEST, TIMES * q)].sum())
            if not n:
                break
            step = max(SHORTEST, TIMES * q) - q
            at = np.flatnonzero(self.v[:n - q:step] == self.v[q:n:step]) * step
            if len(at):
                self.settle(at, np.int64(q), step // 2)

    def scan_minimizers(self) -> None:
        k = self.first
        back = None
        while (n := int(self.lengths[self.lengths >= TIMES * 8 * k].sum())):
            if back is None:
                back = _powers(_BACK, n)
            h = _mixed((self.prefix[k:n + 1] - self.prefix[:n - k + 1]) * back[:n - k + 1])
            edge = np.zeros(k - 1, np.uint64)
            least = _sliding(h, k, np.minimum)
            at = np.flatnonzero(h == _sliding(np.concatenate([edge, least, edge]), k, np.maximum))
            order = np.argsort(h[at], kind="stable")
            at = at[order]
            key = h[at]
            head = np.ones(len(at), bool)
            head[1:] = (key[1:] != key[:-1]) | (at[1:] - at[:-1] > k // 2)
            at, key = at[head], key[head]
            seeds, lags, t = [], [], 1
            while t < len(at):
                gap = at[t:] - at[:-t]
                near = (key[t:] == key[:-t]) & (gap < 16 * k)
                if not near.any():
                    break
                near &= gap >= 8 * k
                seeds.append(at[:-t][near])
                lags.append(gap[near])
                t += 1
            if seeds:
                at, lag = np.concatenate(seeds), np.concatenate(lags)
                self.settle(at, lag, lag)
            k *= 2

    def runs(self) -> list[tuple[int, int, int]]:
        self.scan_lags()
        self.scan_minimizers()
        return sorted((s, e - s, q) for (s, e), q in self.found.items())


def runs_of(documents: list[list[bytes]], first: int = FIRST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each document, by start, then period."""
    out: list[list] = [[] for _ in documents]
    order = sorted((k for k, d in enumerate(documents) if len(d) >= SHORTEST), key=lambda k: -len(documents[k]))
    if not order:
        return out
    numbers, used = [], 0
    for k in order:
        own: dict[bytes, int] = {}
        numbers.append(np.array([own.setdefault(w, len(own)) for w in documents[k]], np.int64) + used)
        used += len(own)
    lengths = np.array([len(x) for x in numbers], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    found = _Block(np.concatenate(numbers), lengths, first).runs()
    where = np.searchsorted(begin, [r[0] for r in found], side="right") - 1 if found else []
    for (s, length, q), d in zip(found, where):
        out[order[d]].append((s - int(begin[d]), length, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that stay when each run keeps its first period only, joined by spaces."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        change[s + q] += 1
        change[s + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def _blocks(rows) -> Iterator[list]:
    part, size = [], 0
    for row in rows:
        if part and size + len(row[1]) > BLOCK_WORDS:
            yield part
            part, size = [], 0
        part.append(row)
        size += len(row[1])
    if part:
        yield part


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[object, list], list] | None = None,
                  first: int = FIRST) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (by start, then period), best (a run or NULL), text (the collapsed text).

    ``edit(doc_id, words)`` may change the words (bytes) before runs are sought."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def records(runs):
        return [None if r is None else dict(zip(("start", "length", "period"), r)) for r in runs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def words(i, text):
            found = text.encode("utf-8", "surrogatepass").split()
            return edit(i, found) if edit else found

        for b in batches:
            texts = b.column(1)
            rows = ((k, words(b.column(0)[k].as_py(), texts[k].as_py())) for k in range(b.num_rows))
            for part in _blocks(rows):
                found = runs_of([w for _, w in part], first)
                low, high = part[0][0], part[-1][0] + 1
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(low, high - low), pa.array([len(w) for _, w in part], pa.int64()),
                     pa.array([records(r) for r in found], pa.list_(run_type)), pa.array(records(map(best_run, found)), run_type),
                     pa.array([collapsed(w, r).decode("utf-8", "replace") for (_, w), r in zip(part, found)], pa.string())],
                    names=["doc_id", "n_words", "runs", "best", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<{RUN}>, best {RUN}, text string")


def planted_words(doc_id, words: list[bytes]) -> list[bytes]:
    """The contract's test runs: every tenth document by checksum repeats its words from one position on."""
    import zlib

    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a:a + p]
    return words[:a] + (block * ((n - a) // p + 1))[:n - a]


def run_digests(runs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the best run and digests of all runs and of the collapsed text, from ``collapse_runs``."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                               r["period"].cast("string")), F.lit("\n")))
    best = F.col("best")
    return runs.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))

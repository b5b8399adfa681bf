"""Language-model scores from a hierarchical Pitman-Yor model.

Restaurants: the context of a word is the whole word before it (``START_WORD`` at the beginning of a text), however rare and
whatever the size of the corpus; its parent is the restaurant of that word's last byte.  The byte's parent is its class (letter, digit, sentence end, other punctuation,
above ASCII, start), whose parent is the root over all words with a uniform base over the V known words and one unknown.
P(w | u) = (c - d t + (theta + d T) P(w | parent)) / (theta + C) with c customers and t tables of w, C and T of the restaurant.

Seating: tables are sampled by Gibbs sweeps.  A sweep re-seats every dish of every restaurant, given its parent's
probabilities and the table totals of the sweep before; a dish's customers sit down one
by one, beyond ``EXACT`` customers in steps of a sixteenth of those seated, whose new tables are drawn together (their mean changes by under 1 %).  Random numbers are hashed from (word, context, sweep, customer),
so a retried task seats alike.  After ``BURN_IN`` sweeps, predictive probabilities are averaged over ``SAMPLES`` sweeps.

Scale.  One map cuts the corpus into blocks of at most ``BLOCK_TOKENS`` tokens; a block keeps its documents as
numbers of its different words and sends each word's key once, to one of P buckets of the word (P
follows the corpus, a bucket holds the words of about ``BUCKET_BYTES`` of text).  The bucket numbers its words, often used contexts first, and with these numbers
the block asks for each different (word, context) pair once, so that a pair costs some two bytes however many buckets there are.  The word's bucket adds up the blocks' counts.
A very common word is one entry of each block with at most as many pairs as the block has words, never a hot key of token rows.  A dish's seats in all its
restaurants are in its bucket.  A pair seen once always has one table, so buckets keep only the number of those; for the pairs seen more often each
sweep sends the customers without a table of their own, added up by context word, to that word's bucket, and takes the sums over all buckets
back.  Only the totals of the 264 lower restaurants go through the driver.  Answers go back by block and a document's score is a
sum over its words.  Arrays travel as compressed bytes (``pack``).  Nothing is capped or sampled, and what is gathered grows with the corpus.

Words are compared by their 64-bit XXH64.  A document is held out if crc32(doc_id as text) mod 7 is 2 (a NULL id counts as the empty
text: not held out).  NULL text is empty: one token, the end.  Repeated rows each give a row and count as often;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete_path, free_shuffles
from .common import materialize, scratch_path, whole_text

BLOCK_TOKENS = 1_500_000
BUCKET_BYTES = 8_000_000
ROW_WORDS = 65_536
EXACT = 32
BURN_IN, SAMPLES = 1, 2
DISCOUNT = (0.6, 0.7, 0.8, 0.8)     # root, class, byte, word
STRENGTH = (1.0, 1.0, 1.0, 1.0)
START = 256
CONTEXTS = 257
END_WORD = b" "                     # no word contains a space
START_WORD = b"\n"                  # nor a line end
LEAST_USES, WORD_BYTES = 0, 6       # a context occurs 0 x sqrt(bytes of text / 6) times at least: every word is one


def _classes() -> np.ndarray:
    """Class of each context: 0 letter, 1 digit, 2 sentence end, 3 other ASCII, 4 above ASCII, 5 start."""
    out = np.full(CONTEXTS, 3)
    out[97:123] = out[65:91] = 0
    out[48:58] = 1
    out[[ord(c) for c in ".!?"]] = 2
    out[128:256] = 4
    out[START] = 5
    return out


CLASS = _classes()
CLASSES = 6


def word_key(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, 0)
    return h - (1 << 64) if h >> 63 else h


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


# -- arrays as bytes ----------------------------------------------------------------------

def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as compressed bytes: whole numbers in the smallest type that holds them, or their differences where those are smaller,
    all first bytes before all second bytes and so on."""
    head, parts = [], []
    for name, v in arrays.items():
        v, kind, steps = np.ascontiguousarray(v), v.dtype.str, False
        if len(v) and v.dtype.kind in "iu":
            d = np.diff(v, prepend=v.dtype.type(0))                        # wraps around, and so does adding up again
            small = [next(t for t in ("i1", "i2", "i4", "i8") if np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max) for x in (v, d)]
            steps = small[1] < small[0]
            v = (d if steps else v).astype(small[steps])
        head.append((name, kind, v.dtype.str, steps, len(v)))
        parts.append(v.view(np.uint8).reshape(len(v), -1).T.tobytes() if len(v) else b"")
    start = json.dumps(head).encode()
    return len(start).to_bytes(4, "little") + start + zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def short(v: np.ndarray) -> np.ndarray:
    """Single precision with 16 significant bits: the last byte is 0 and costs nothing."""
    v = np.ascontiguousarray(v, np.float32)
    return ((v.view(np.uint32) + np.uint32(0x80)) & np.uint32(0xFFFFFF00)).view(np.float32)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    raw, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4 + n:]), np.uint8), {}, 0
    for name, kind, stored, steps, size in json.loads(data[4:4 + n]):
        width = np.dtype(stored).itemsize
        v = np.ascontiguousarray(raw[at:at + size * width].reshape(width, size).T).view(stored).ravel().astype(kind)
        out[name] = np.cumsum(v, dtype=kind) if steps else v
        at += size * width
    return out


class Packed:
    """The arrays of some rows with a column ``data``."""

    def __init__(self, table: pa.Table):
        self.rows = [unpack(x) for x in table.column("data").to_pylist()]

    def flat(self, name: str, kind=np.int64) -> np.ndarray:
        return np.concatenate([np.empty(0, kind), *[r[name] for r in self.rows]]).astype(kind, copy=False)

    def lengths(self, name: str) -> np.ndarray:
        return np.array([len(r[name]) for r in self.rows], np.int64)


# -- blocks -----------------------------------------------------------------------------

# A row without a bucket holds documents: their ids and, packed, word numbers, sizes and which are held out; the first row of a block also
# has the last byte of each of its words.  One with a bucket has that bucket's words of the block: keys, ids in the block, uses as a context.
BLOCK_SCHEMA = "block bigint, bucket int, doc_ids array<{kind}>, data binary"

# Numbers of a block's words in a bucket; the row without a block has all the bucket's words in the order of their numbers, with their uses.
NUMBER_SCHEMA = "block bigint, bucket int, data binary"

# What a block asks a bucket: words (number in the bucket, id in the block, number of pairs) and their pairs (the context's number in the corpus,
# which is its number in its bucket x buckets + its bucket, its last byte, and the count).
ASK_SCHEMA = "block bigint, bucket int, data binary"


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys.view(np.uint64) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i


class _Block:
    def __init__(self):
        self.ids, self.docs, self.held, self.words, self.size = _Ids({START_WORD: 0}), [], [], [], 0

    def add(self, doc_id, text: str) -> None:
        words = text.encode("utf-8", "replace").lower().split()
        words.append(END_WORD)
        self.words.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.docs.append(doc_id)
        self.held.append(held_out(doc_id))
        self.size += len(words)

    def rows(self, number: int, buckets: int) -> Iterator[dict]:
        sizes = np.array([len(w) for w in self.words])
        word, n_ids = np.concatenate(self.words), len(self.ids)
        keys = np.fromiter(map(word_key, self.ids), np.int64, n_ids)
        last = np.fromiter((w[-1] for w in self.ids), np.int64, n_ids)
        last[0] = START
        uses = np.bincount(_before(word, sizes), np.repeat(~np.array(self.held), sizes), n_ids).astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        for at in range(0, len(sizes), 2000):
            to = min(at + 2000, len(sizes))
            yield {"block": number, "bucket": None, "doc_ids": self.docs[at:to], "data": pack({
                "words": word[ends[at]:ends[to]], "sizes": sizes[at:to], "held": np.array(self.held[at:to], np.int8),
                "last": last[:0 if at else n_ids]})}
        bucket = _bucket(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for i in range(buckets):
            of = order[cut[i]:cut[i + 1]]
            if len(of):
                yield {"block": number, "bucket": i, "doc_ids": None, "data": pack({"words": keys[of], "ids": of, "uses": uses[of]})}


def _before(word: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The number of the word before each token."""
    before = np.empty(len(word), np.int64)
    before[1:] = word[:-1]
    before[np.cumsum(sizes) - sizes] = 0
    return before


def _blocks(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[tuple[_Block, pa.DataType]]:
    block = _Block()
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            block.add(doc_id, text)
            if block.size >= block_tokens:
                yield block, b.column(0).type
                block = _Block()
    if block.size:
        yield block, b.column(0).type


def _cut_blocks(buckets: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for made, (block, kind) in enumerate(_blocks(batches, block_tokens)):
            schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("doc_ids", pa.list_(kind)), ("data", pa.binary())])
            for row in block.rows((task << 24) + made, buckets):
                yield pa.RecordBatch.from_pylist([row], schema=schema)
    return run


# -- numbers and pairs ------------------------------------------------------------------

def _number(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Numbers one bucket's words, those most used as contexts first."""
    p = Packed(table)
    words, of = np.unique(p.flat("words"), return_inverse=True)
    uses = np.bincount(of, p.flat("uses"), len(words)).astype(np.int64)
    order = np.lexsort((words, -uses))
    number = np.empty(len(words), np.int64)
    number[order] = np.arange(len(words))
    off = np.concatenate(([0], np.cumsum(p.lengths("words"))))
    data = [pack({"ids": r["ids"], "numbers": number[of[i:j]]}) for r, i, j in zip(p.rows, off, off[1:])]
    return pa.table({"block": pa.array([*table.column("block").to_pylist(), None], pa.int64()),
                     "bucket": pa.array([key[0].as_py()] * (len(data) + 1), pa.int32()),
                     "data": pa.array([*data, pack({"words": words[order], "uses": uses[order]})], pa.binary())})


def _block_pairs(d: Packed, n_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of a block as (word x CONTEXTS + last byte before, number of the word before), in this order, and the pair of each token."""
    word, last = d.flat("words"), d.flat("last")
    before = _before(word, d.flat("sizes"))
    pair, at = np.unique((word * CONTEXTS + last[before]) * n_ids + before, return_inverse=True)
    return *np.divmod(pair, n_ids), at


def _entries(of: np.ndarray, each: np.ndarray) -> np.ndarray:
    """The places of all entries of the words ``of`` in a list that has ``each`` entries of every word, word by word."""
    n = each[of]
    return np.repeat((np.cumsum(each) - each)[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _ask(buckets: int):
    """The different pairs of a block, by the buckets of their words."""
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, numbers: pa.Table) -> pa.Table:
        d, q = Packed(docs), Packed(numbers)
        ids = q.flat("ids")
        bucket, number = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        bucket[ids] = np.repeat(numbers.column("bucket").to_numpy(), q.lengths("ids"))
        number[ids] = q.flat("numbers")
        lower, context, at = _block_pairs(d, len(ids))
        learned = np.repeat(d.flat("held") == 0, d.flat("sizes"))
        count = np.bincount(at, learned, len(lower)).astype(np.int64)
        n_pairs = np.bincount(lower // CONTEXTS, minlength=len(ids))
        end, context = lower % CONTEXTS, (number * buckets + bucket)[context]
        order = np.argsort(bucket, kind="stable")
        used, first = np.unique(bucket[order], return_index=True)
        data = []
        for i, j in zip(first, [*first[1:], len(order)]):
            of = order[i:j]
            p = _entries(of, n_pairs)
            data.append(pack({"words": number[of], "ids": of, "pairs": n_pairs[of], "contexts": context[p], "ends": end[p], "counts": count[p]}))
        return pa.table({"block": pa.array([key[0].as_py()] * len(data), pa.int64()), "bucket": pa.array(used, pa.int32()), "data": pa.array(data, pa.binary())})
    return run


# -- counts by bucket -------------------------------------------------------------------

# Rows of sweep USES hold all words in the order of their numbers, with their uses as a context.  A row without a sweep holds words with their counts: for each word its pairs with last
# bytes; for each of those the number of customers that need no seating (of pairs seen once) and of the pairs seen more often (the contexts' numbers
# in the corpus, counts).
# A row with a sweep holds sums over
# all buckets (customers without a table of their own, ``less``): of the bucket's own words (source NULL) or, in the order of their numbers, of
# the contexts that the bucket asked bucket ``source`` for (in the first sweep with their keys and uses).
USES = -1
MODEL_SCHEMA = "bucket int, sweep int, source int, data binary"
PART_SCHEMA = "bucket int, source int, data binary, totals array<double>"


def _model_row(bucket: int, sweep: int | None, source: int | None, **arrays: np.ndarray) -> dict:
    return {"bucket": bucket, "sweep": sweep, "source": source, "data": pack(arrays)}


def _model_table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("sweep", pa.int32()), ("source", pa.int32()), ("data", pa.binary())]))


class _Asked:
    """All blocks' pairs of one bucket.  ``of`` and ``place`` number the words of the rows and the rows of their
    pairs; the different pairs, by word, last byte and context, have their learned ``count``, and ``at`` are their numbers in the rows."""

    def __init__(self, table: pa.Table):
        p = self.rows = Packed(table)
        self.of = p.flat("words")
        self.place = np.repeat(np.arange(len(self.of)), p.flat("pairs"))
        self.end, context = p.flat("ends"), p.flat("contexts")
        width = int(context.max(initial=0)) + 1
        pair, self.at = np.unique((self.of[self.place] * CONTEXTS + self.end) * width + context, return_inverse=True)
        self.count = np.bincount(self.at, p.flat("counts"), len(pair)).astype(np.int64)
        self.lower, context = np.divmod(pair, width)
        self.heavy = np.flatnonzero(self.count > 1)
        self.heavy_contexts = context[self.heavy]


def _add_up(key: tuple[pa.Scalar, ...], asked: pa.Table, numbers: pa.Table) -> pa.Table:
    """All blocks' counts of one bucket, words in order of their numbers."""
    a, d = _Asked(asked), Packed(numbers)
    words, uses = d.flat("words"), d.flat("uses")
    lower = np.unique(a.lower[a.count > 0])
    ones = np.bincount(np.searchsorted(lower, a.lower[a.count == 1]), minlength=len(lower))
    heavies = np.bincount(np.searchsorted(lower, a.lower[a.heavy]), minlength=len(lower))
    n_pairs = np.bincount(lower // CONTEXTS, minlength=len(words))
    off = np.array([*range(0, len(words), ROW_WORDS), len(words)])
    by_word = np.concatenate(([0], np.cumsum(n_pairs)))[off]
    by_pair = np.concatenate(([0], np.cumsum(heavies)))[by_word]
    rows = [_model_row(key[0].as_py(), USES, None, words=words, uses=uses)]
    for w, v, p, q, h, g in zip(off, off[1:], by_word, by_word[1:], by_pair, by_pair[1:]):
        rows.append(_model_row(key[0].as_py(), None, None, first=np.array([w]), words=words[w:v], pairs=n_pairs[w:v], contexts=lower[p:q] % CONTEXTS,
                               ones=ones[p:q], heavies=heavies[p:q], above=a.heavy_contexts[h:g], counts=a.count[a.heavy][h:g]))
    return _model_table(rows)


# -- seating ----------------------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits (the SplitMix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(key: np.ndarray, i: int) -> np.ndarray:
    return (_mix(key + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def opened(n: np.ndarray, p: np.ndarray, key: np.ndarray, seated: int) -> np.ndarray:
    """How many of n customers open a table, each with probability p: the binomial distribution up to a mean of 4, beyond it the normal one,
    rounded at random."""
    u, mean = _uniform(key, seated), n * p
    term = np.where(mean < 4, (1 - p) ** n, 0.0)
    below, few = term.copy(), (u >= term).astype(np.float64)
    for k in range(1, 20):
        term = term * np.maximum(n - k + 1, 0) / k * p / (1 - p)
        below += term
        few += u >= below
    z = np.sqrt(-2 * np.log1p(-_uniform(key + np.uint64(1), seated))) * np.cos(2 * np.pi * _uniform(key + np.uint64(2), seated))
    many = np.floor(mean + z * np.sqrt(mean * (1 - p)) + u)
    return np.clip(np.where(mean < 4, few, many), 0, n)


def seat(customers: np.ndarray, base: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Tables of each dish after its customers sit down one by one; ``base`` is (theta + d T) P(dish | parent)."""
    tables = (customers > 0).astype(np.float64)
    todo, seated, step = np.flatnonzero(customers > 1), 1, 1
    while len(todo):
        step = 1 if seated < EXACT else seated // 16
        n = np.minimum(step, customers[todo] - seated)
        # of all customers of a step the one in the middle speaks for all
        p = base[todo] / (seated + (n - 1) / 2 - discount * tables[todo] + base[todo])
        tables[todo] += opened(n, p, key[todo], seated) if step > 1 else _uniform(key[todo], seated) < p
        seated += step
        todo = todo[customers[todo] > seated]
    return np.minimum(tables, customers)


class Restaurants:
    """The customers and tables of some words in all restaurants; levels 2 (byte), 1 (class), 0 (root)."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, contexts: np.ndarray, counts: np.ndarray):
        self.words = words
        self.of = np.repeat(np.arange(len(words)), pairs)
        self.context = contexts.astype(np.int64)
        self.pair = self.of * CONTEXTS + self.context
        self.group, self.at1 = np.unique(self.of * CLASSES + CLASS[self.context], return_inverse=True)
        self.cls, self.of1 = self.group % CLASSES, self.group // CLASSES
        self.c2 = counts.astype(np.float64)
        base = words.view(np.uint64)
        self.key2 = _mix(base[self.of] + self.context.astype(np.uint64) + np.uint64(1))
        self.key1 = _mix(base[self.of1] + self.cls.astype(np.uint64) + np.uint64(1001))
        self.key0 = _mix(base + np.uint64(2001))
        self._tables(np.ones(len(counts)), None, None)

    def _tables(self, t2, t1, t0) -> None:
        self.t2 = t2
        self.c1 = np.bincount(self.at1, t2, len(self.group))
        self.t1 = t1(self.c1) if t1 else np.minimum(self.c1, 1)
        self.c0 = np.bincount(self.of1, self.t1, len(self.words))
        self.t0 = t0(self.c0) if t0 else np.minimum(self.c0, 1)

    def totals(self) -> np.ndarray:
        """C and T of all restaurants, then N and V: sums over words add up over rows."""
        return np.concatenate((
            np.bincount(self.context, self.c2, CONTEXTS), np.bincount(self.context, self.t2, CONTEXTS),
            np.bincount(self.cls, self.c1, CLASSES), np.bincount(self.cls, self.t1, CLASSES),
            [self.c0.sum(), self.t0.sum(), self.c2.sum(), (self.c0 > 0).sum()]))

    def parents(self, t: "Totals") -> tuple[np.ndarray, np.ndarray]:
        """(P0 of each word, P1 of each (word, class))."""
        p0 = (np.maximum(self.c0 - DISCOUNT[0] * self.t0, 0) + t.open0 * t.uniform) / (STRENGTH[0] + t.c0)
        p1 = (self.c1 - DISCOUNT[1] * self.t1 + t.open1[self.cls] * p0[self.of1]) / (STRENGTH[1] + t.c1[self.cls])
        return p0, p1

    def sweep(self, t: "Totals", number: int) -> None:
        """Re-seats everyone, given the totals of the sweep before."""
        p0, p1 = self.parents(t)
        salt = np.uint64(number * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        t2 = seat(self.c2, t.open2[self.context] * p1[self.at1], DISCOUNT[2], self.key2 + salt)
        self._tables(t2, lambda c: seat(c, t.open1[self.cls] * p0[self.of1], DISCOUNT[1], self.key1 + salt),
                     lambda c: seat(c, np.full(len(c), t.open0 * t.uniform), DISCOUNT[0], self.key0 + salt))

    def probability(self, t: "Totals", of: np.ndarray, context: np.ndarray) -> np.ndarray:
        """P(word | context) of any (word number, context) pairs, seated there or not."""
        p0, p1 = self.parents(t)
        cls = CLASS[context]
        up = t.open1[cls] * p0[of] / (STRENGTH[1] + t.c1[cls])
        at, found = _find(self.group, of * CLASSES + cls)
        up[found] = p1[at[found]]
        own = np.zeros(len(of))
        at, found = _find(self.pair, of * CONTEXTS + context)
        own[found] = (self.c2 - DISCOUNT[2] * self.t2)[at[found]]
        return (own + t.open2[context] * up) / (STRENGTH[2] + t.c2[context])


def _find(among: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(among, what)
    at = np.minimum(at, max(len(among) - 1, 0))
    return at, (among[at] == what) if len(among) else np.zeros(len(what), bool)


class Totals:
    """C and T of the 264 restaurants and the corpus's N and V."""

    def __init__(self, v: np.ndarray):
        a, b = 2 * CONTEXTS, 2 * CONTEXTS + 2 * CLASSES
        self.c2, self.c1, self.c0 = v[:CONTEXTS], v[a:a + CLASSES], v[b]
        self.open2 = STRENGTH[2] + DISCOUNT[2] * v[CONTEXTS:a]
        self.open1 = STRENGTH[1] + DISCOUNT[1] * v[a + CLASSES:b]
        self.open0 = STRENGTH[0] + DISCOUNT[0] * v[b + 1]
        self.tokens, self.known = int(v[b + 2]), int(v[b + 3])
        self.uniform = 1.0 / (self.known + 1)


SLOTS = 2 * CONTEXTS + 2 * CLASSES + 4


def _seated(words, pairs, contexts, counts, history: list[np.ndarray]) -> Iterator[Restaurants]:
    """The state before the first sweep and after each sweep of the history."""
    r = Restaurants(words, pairs, contexts, counts)
    yield r
    for number, v in enumerate(history):
        r.sweep(Totals(v), number + 1)
        yield r


class WordRestaurants:
    """The restaurants of whole words above those of bytes.  Level 3 has the pairs seen more than once; a pair seen once has one table in
    every sweep and is only counted (``ones``) as a customer of its byte."""

    def __init__(self, words, pairs, contexts, ones, heavies, above, counts):
        self.ones, self.c3, self.t3 = ones.astype(np.float64), counts.astype(np.float64), np.ones(len(counts))
        self.at2 = np.repeat(np.arange(len(contexts)), heavies)
        self.low = Restaurants(words, pairs, contexts, ones + heavies)
        self.contexts, self.at = np.unique(above, return_inverse=True)

    def named(self, keys: np.ndarray) -> None:
        """Takes the keys of the context words."""
        self.key3 = _mix(self.low.words.view(np.uint64)[self.low.of[self.at2]] + _mix(keys.view(np.uint64) + np.uint64(3001))[self.at])

    def totals(self) -> np.ndarray:
        v = self.low.totals()
        v[-2] = self.ones.sum() + self.c3.sum()
        return v

    def less(self) -> np.ndarray:
        """Customers without a table of their own, by context word."""
        return np.bincount(self.at, self.c3 - self.t3, len(self.contexts)).astype(np.int64)

    def sweep(self, t: "Totals", tables: np.ndarray, number: int) -> None:
        """Re-seats everyone; ``tables`` has all tables of each context word in the sweep before."""
        r = self.low
        _, p1 = r.parents(t)
        p2 = (r.c2 - DISCOUNT[2] * r.t2 + t.open2[r.context] * p1[r.at1]) / (STRENGTH[2] + t.c2[r.context])
        salt = np.uint64(number * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        self.t3 = seat(self.c3, (STRENGTH[3] + DISCOUNT[3] * tables[self.at]) * p2[self.at2], DISCOUNT[3], self.key3 + salt)
        r.c2 = self.ones + np.bincount(self.at2, self.t3, len(self.ones))
        r.sweep(t, number)


def _states(table: pa.Table, buckets: int, history: list[np.ndarray]) -> Iterator[WordRestaurants]:
    """The state of a bucket before the first sweep and after each sweep of the history, from its rows of MODEL_SCHEMA."""
    sweep = table.column("sweep").to_pylist()
    model = Packed(table.take([i for i, k in enumerate(sweep) if k is None]))
    model.rows.sort(key=lambda r: r["first"][0])
    r = WordRestaurants(*(model.flat(c) for c in ("words", "pairs", "contexts", "ones", "heavies", "above", "counts")))
    yield r
    source = table.column("source").to_pylist()
    order, uses = np.argsort(r.contexts % buckets, kind="stable"), None
    for number, v in enumerate(history):
        rows = Packed(table.take(sorted((i for i, k in enumerate(sweep) if k == number and source[i] is not None), key=source.__getitem__)))
        if uses is None:
            uses, keys = np.zeros(len(order)), np.empty(len(order), np.int64)
            uses[order], keys[order] = rows.flat("uses"), rows.flat("keys")
            r.named(keys)
        less = np.zeros(len(order))
        less[order] = rows.flat("less")
        r.sweep(Totals(v), uses - less, number + 1)
        yield r


def _parts(buckets: int, history: list[np.ndarray]):
    """The totals of a bucket after the sweeps of the history, and what its context words lack in tables, by their buckets."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        for r in _states(table, buckets, history):
            pass
        to = r.contexts % buckets
        order = np.argsort(to, kind="stable")
        used, at = np.unique(to[order], return_index=True)
        off, less = [*at.tolist(), len(order)], r.less()
        parts = [pack({"numbers": r.contexts[order[i:j]] // buckets, "less": less[order[i:j]]}) for i, j in zip(off, off[1:])]
        return pa.table({
            "bucket": pa.array([*used.tolist(), None], pa.int32()), "source": pa.array([key[0].as_py()] * (len(used) + 1), pa.int32()),
            "data": pa.array([*parts, None], pa.binary()),
            "totals": pa.array([[]] * len(used) + [r.totals().tolist()], pa.list_(pa.float64()))})
    return run


def _sums(sweep: int):
    """Sums over the parts of one bucket's words: its own row, and an answer to each bucket that sent a part."""
    def run(key: tuple[pa.Scalar, ...], parts: pa.Table, model: pa.Table) -> pa.Table:
        if not parts.num_rows:
            return _model_table([])
        bucket, got = key[0].as_py(), Packed(parts)
        numbers, at = np.unique(got.flat("numbers"), return_inverse=True)
        less = np.bincount(at, got.flat("less"), len(numbers)).astype(np.int64)
        off = np.concatenate(([0], np.cumsum(got.lengths("numbers"))))
        rows = [_model_row(bucket, sweep, None, numbers=numbers, less=less)]
        m = Packed(model)                        # in the first sweep the row of sweep USES
        keys, uses = (m.flat(c)[numbers][at] if not sweep else None for c in ("words", "uses"))
        for i, j, source in zip(off, off[1:], parts.column("source").to_pylist()):
            rows.append(_model_row(source, sweep, bucket, less=less[at[i:j]], **({} if sweep else {"keys": keys[i:j], "uses": uses[i:j]})))
        return _model_table(rows)
    return run


ANSWER_SCHEMA = "block bigint, data binary"


def _answers(buckets: int, history: list[np.ndarray], burn_in: int):
    """For each word its count, its uses as a context and its tables there in each sample; for each of its pairs the mean of c - d t; for each
    last byte before it the bits of P(word | byte) in the first sample and how far they are off in the others."""
    def run(key: tuple[pa.Scalar, ...], asked: pa.Table, model: pa.Table) -> pa.Table:
        a = _Asked(asked)
        low = a.place * CONTEXTS + a.end                                     # in this order
        place, end = np.divmod(low[np.diff(low, prepend=-1) > 0], CONTEXTS)
        sweep, source = model.column("sweep").to_pylist(), model.column("source").to_pylist()
        all_uses = Packed(model.take([i for i, k in enumerate(sweep) if k == USES])).flat("uses")
        known = np.bincount(a.lower // CONTEXTS, a.count, len(all_uses)).astype(np.int64)
        kept = [k for k in range(len(history)) if k > burn_in or len(history) == 1]
        own, p2, tables = np.zeros(len(a.count)), [], []
        own[a.count == 1] = (1 - DISCOUNT[3]) * len(kept)
        for number, r in enumerate(_states(model, buckets, history[:-1])):
            if number in kept:
                own[a.heavy] += r.c3 - DISCOUNT[3] * r.t3
                p2.append(short(r.low.probability(Totals(history[number]), a.of[place], end)).view(np.uint32).astype(np.int64) >> 8)
                rows = Packed(model.take([i for i, k in enumerate(sweep) if k == number and source[i] is None]))
                less = np.zeros(len(all_uses), np.int64)
                less[rows.flat("numbers")] = rows.flat("less")
                tables.append((all_uses - less)[a.of])
        mean = (own / len(kept))[a.at]
        off = np.concatenate(([0], np.cumsum(a.rows.lengths("words"))))
        by_pair = np.concatenate(([0], np.cumsum(a.rows.lengths("contexts"))))
        by_lower = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=len(a.of)))))[off]
        out = []
        for k, r in enumerate(a.rows.rows):
            w, p, q = slice(off[k], off[k + 1]), slice(by_pair[k], by_pair[k + 1]), slice(by_lower[k], by_lower[k + 1])
            out.append(pack({"ids": r["ids"], "known": known[a.of[w]], "uses": all_uses[a.of[w]], "own": short(mean[p])}
                            | {f"tables{s}": t[w] for s, t in enumerate(tables)}
                            | {f"lower{s}": x[q] - p2[0][q] if s else x[q] for s, x in enumerate(p2)}))
        return pa.table({"block": asked.column("block"), "data": pa.array(out, pa.binary())})
    return run


def _scores(tokens_all: int, known_all: int, samples: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        a, d = Packed(answers), Packed(docs)
        ids = a.flat("ids")
        n_ids = len(ids)
        lower, context, number = _block_pairs(d, n_ids)
        own = np.empty(len(lower))
        own[_entries(ids, np.bincount(lower // CONTEXTS, minlength=n_ids))] = a.flat("own", np.float32)
        known, uses = (np.empty(n_ids, np.int64) for _ in range(2))
        known[ids], uses[ids] = a.flat("known"), a.flat("uses")
        new = np.diff(lower, prepend=-1) > 0
        place, at_lower = np.cumsum(new) - 1, _entries(ids, np.bincount(lower[new] // CONTEXTS, minlength=n_ids))
        up, p2 = np.zeros(len(lower)), np.empty(len(at_lower), np.float32)
        for s in range(samples):
            tables = np.empty(n_ids, np.int64)
            tables[ids] = a.flat(f"tables{s}")
            bits = a.flat("lower0") + (a.flat(f"lower{s}") if s else 0)
            p2[at_lower] = (bits << 8).astype(np.uint32).view(np.float32)
            up += (STRENGTH[3] + DISCOUNT[3] * tables[context]) * p2[place]
        word, sizes = d.flat("words"), d.flat("sizes")
        score = np.log10((own + up / samples) / (STRENGTH[3] + uses[context]))[number]
        base_score = np.log10((known + 1) / (tokens_all + 1 * (known_all + 1)))[word]
        at = np.cumsum(sizes) - sizes
        doc_ids = docs.column("doc_ids").combine_chunks()
        return pa.table({
            "doc_id": doc_ids.flatten(), "held_out": pa.array(d.flat("held").astype(bool)), "n_tokens": pa.array(sizes),
            "n_known": pa.array(np.add.reduceat((known > 0)[word].astype(np.int64), at)),
            "train_tokens": pa.array(np.full(len(sizes), tokens_all, np.int64)),
            "base_score": pa.array(np.add.reduceat(base_score, at)), "score": pa.array(np.add.reduceat(score, at))})
    return run


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", burn_in: int = BURN_IN, samples: int = SAMPLES,
                    block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score (both
    log10 probabilities of the whole text with its end)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    spark, schema = docs.sparkSession, BLOCK_SCHEMA.format(kind=kind)
    folder = scratch_path(spark, "scores")
    kept = lambda df, name: materialize(df, to=f"{folder}/{name}")

    def drop(*names: str) -> None:
        for name in names:
            delete_path(spark, f"{folder}/{name}")
        free_shuffles(spark)

    rows.mapInArrow(_cut_blocks(buckets, block_tokens), schema).withColumn("what", F.when(F.col("bucket").isNull(), "docs").otherwise("words")) \
        .write.partitionBy("what").parquet(f"{folder}/blocks")
    blocks = spark.read.schema(f"{schema}, what string").parquet(f"{folder}/blocks")
    own = blocks.filter("what = 'docs'").select("block", "doc_ids", "data")
    numbers = kept(blocks.filter("what = 'words'").select("block", "bucket", "data").groupBy("bucket").applyInArrow(_number, NUMBER_SCHEMA), "numbers")
    drop("blocks/what=words")
    asked = kept(own.select("block", "data").groupBy("block").cogroup(numbers.filter("block is not null").groupBy("block"))
                 .applyInArrow(_ask(buckets), ASK_SCHEMA), "asked")
    free_shuffles(spark)
    known = model = kept(asked.groupBy("bucket").cogroup(numbers.filter("block is null").groupBy("bucket")).applyInArrow(_add_up, MODEL_SCHEMA), "model")
    drop("numbers")
    history: list[np.ndarray] = []
    for number in range(burn_in + samples + 1):
        parts = kept(known.filter("sweep is null or source is not null").groupBy("bucket").applyInArrow(_parts(buckets, list(history)), PART_SCHEMA), "parts")
        sums = parts.filter("bucket is null").select(F.posexplode("totals").alias("slot", "value")).groupBy("slot").agg(F.sum("value").alias("value"))
        v = np.zeros(SLOTS)
        for r in sums.collect():           # 264 restaurants
            v[r["slot"]] = r["value"]
        history.append(v)
        words = model.filter(F.col("sweep") == USES) if not number else model.filter("false")
        known = known.unionByName(kept(
            parts.filter("bucket is not null").drop("totals").groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(_sums(number), MODEL_SCHEMA), f"sums{number}"))
        drop("parts")
    totals = Totals(history[0])
    answers = kept(asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_answers(buckets, history, burn_in), ANSWER_SCHEMA), "answers")
    drop("asked", "model", *[f"sums{number}" for number in range(len(history))])
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scores(totals.tokens, totals.known, max(len(history) - 1 - burn_in, 1)),
        f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity per token of held-out and other documents: held_out, n_tokens, perplexity, base_perplexity."""
    mean = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), mean("score").alias("perplexity"),
                                          mean("base_score").alias("base_perplexity"))

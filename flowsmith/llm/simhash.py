"""SimHash near-duplicates by an inverted index over positional bytes with count filtering.

Fingerprint: ASCII letters are lower-cased, words are runs of other than ASCII white space,
shingles are ``width`` space-joined words (repeats count; fewer words: all of
them as one shingle; none: fingerprint 0).  A bit is 1 if it is set in more than half of the shingles' XXH64 values.

Index.  Two fingerprints within 3 bits differ in at most 3 of their 8 bytes, so they share at
least 5 positional bytes: that is the guaranteed minimum.  Lists of single (position, byte) postings would hold
1/256 of all fingerprints each, so lists are kept intersected: a posting is the value at four positions, for the 14 position
sets of the Steiner system S(3,4,8): any 5 positions contain one of them.  Within a list the shared
positional bytes of each pair are tallied, pairs that reach the minimum are kept and verified bit by bit.

Scale.  Rows of one fingerprint are one class (map-side combine) before anything is paired.  A list of more than
``LIST_CAP`` classes is not worked on in one task; its members are posted again under one more shared byte (they must share
five), and, if that list is still long, under a sixth byte less one bit (three bits over three bytes leave a byte with at most
one): 47 fixed bits allow at most 2^17 fingerprints, whatever the input.  Nothing is dropped.  A list
returns its links as a spanning forest, at most one per member.

Nulls, ties, repeats: NULL text is empty text; empty texts share fingerprint 0 and link like any other;
a NULL doc_id belongs to its class but is never the component's id unless the component has no other
(then NULL).  Ids are whole numbers (cast to bigint; another text as id is an error).  Repeated rows each give a row.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import marked_hits, materialize, packed, unpacked, whole_text
from .components import components

WIDTH = 3
SEED = 42
MAX_BITS = 3
MIN_SHARED = 8 - MAX_BITS
LIST_CAP = 4096
ALL = (1 << 64) - 1
HASH_CHUNK = 1 << 16


def fingerprint(text: str, width: int = WIDTH) -> int:
    """The SimHash of a whole text as an unsigned 64-bit number; memory does not grow with repeats."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = (ends[width - 1:] if len(words) >= width else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, HASH_CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + HASH_CHUNK], stops[at:at + HASH_CHUNK])],
                     dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number, one row per input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, width) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


# -- position sets --------------------------------------------------------------------

def _byte_mask(positions) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def position_sets(take: int = 4, shared: int = MIN_SHARED) -> list[tuple[int, ...]]:
    """Sets of ``take`` of the 8 positions such that any ``shared`` positions contain one of them, picked
    greedily (a test checks the cover)."""
    sets, want = [], [set(w) for w in combinations(range(8), shared)]
    while want:
        best = max(combinations(range(8), take), key=lambda s: sum(set(s) <= w for w in want))
        sets.append(best)
        want = [w for w in want if not set(best) <= w]
    return sets


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def first_masks() -> list[int]:
    return [_byte_mask(s) for s in position_sets()]


def refined(mask: int) -> list[int]:
    """The masks under which members of a long list are posted again."""
    free = [p for p in range(8) if not mask >> (8 * p) & 0xFF]
    if len(free) == 4:
        return [mask | _byte_mask([p]) for p in free]
    if len(free) == 3:
        return [mask | (_byte_mask([p]) & ~(1 << (8 * p + j))) for p in free for j in range(8)]
    return []


# -- one list -------------------------------------------------------------------------

def _bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared positional bytes of each pair, from the fingerprints' bytes (rows of 8)."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for p in range(8):
        out += a[:, p, None] == b[None, :, p]
    return out


def list_links(fps: np.ndarray, block: int = 512) -> list[tuple[int, int]]:
    """A spanning forest of the links within one list of different fingerprints (uint64)."""
    n, byte = len(fps), fps.view(np.uint8).reshape(-1, 8)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for at in range(0, n, block):
        for bt in range(at, n, 8 * block):
            # count filter first: pairs that reach the guaranteed minimum are verified bit by bit
            close = np.argwhere(_tally(byte[at:at + block], byte[bt:bt + 8 * block]) >= MIN_SHARED)
            close = close[close[:, 0] + at < close[:, 1] + bt]
            close = close[_bit_count(fps[close[:, 0] + at] ^ fps[close[:, 1] + bt]) <= MAX_BITS]
            for i, j in close.tolist():
                a, b = find(i + at), find(j + bt)
                if a != b:
                    parent[b] = a
                    out.append((i + at, j + bt))
    return out


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The members of each list of two or more, from a partition sorted by (mask, value)."""
    held = [np.empty(0, np.int64)] * 3
    for b in batches:
        held = [np.concatenate((h, b.column(i).to_numpy())) for i, h in enumerate(held)]
        m, v, f = held
        if not len(m):
            continue
        cut = np.concatenate(([0], np.flatnonzero((m[1:] != m[:-1]) | (v[1:] != v[:-1])) + 1))
        sizes = np.diff(cut)
        for at in np.flatnonzero(sizes > 1):
            yield f[cut[at]:cut[at + 1]]
        held = [h[cut[-1]:] for h in held]       # the last list may go on in the next batch
    if len(held[0]) > 1:
        yield held[2]


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for fps in _lists(batches):
        for i, j in list_links(fps.view(np.uint64)):
            a.append(int(fps[i]))
            b.append(int(fps[j]))
        if len(a) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _posted(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(mask, value, fp): one posting per fingerprint and mask."""
    each = F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask")
    return fps.select("fp", each).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column fp, distinct) within MAX_BITS of each other."""
    posted, masks, found = _posted(classes.select("fp"), first_masks()), first_masks(), []
    while True:
        long_ = materialize(posted.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n"))
                            .filter(F.col("n") > LIST_CAP).select("mask", "value"))
        last = not any(refined(m) for m in masks)
        some = not last and not long_.isEmpty()
        short = posted.join(long_, ["mask", "value"], "left_anti") if some else posted
        found.append(short.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
                     .mapInArrow(_work, "a bigint, b bigint"))
        if not some:
            break
        again = posted.join(long_, ["mask", "value"], "left_semi")
        parts = [(_signed(m), [_signed(r) for r in refined(m)]) for m in masks]
        table = classes.sparkSession.createDataFrame(parts, "mask bigint, finer array<bigint>")
        posted = materialize(again.join(F.broadcast(table), "mask")
                             .select("fp", F.explode("finer").alias("mask"))
                             .select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp").distinct())
        masks = sorted({r for m in masks for r in refined(m)})
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row; (fp, root, component_id) of each class."""
    fps = materialize(fingerprints(docs, id_col, text_col, width))
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(classes))
    joined = materialize(classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps, joined.join(least, "root").select("fp", "root", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id
    reachable over links of at most 3 bits)."""
    fps, named = _grouped(docs, id_col, text_col, width)
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                        "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row of each group, with all its columns: the one whose id names the group.  Where several rows of a
    group have that id (or none of them has one), one of these stays."""
    fps, named = _grouped(docs, id_col, text_col, width)
    named = materialize(named)
    is_head = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # by id: how many of its rows name their group, how many do not
    ids = materialize(fps.join(named, "fp").groupBy("doc_id").agg(
        F.count_if(is_head).alias("heads"), F.count_if(~is_head).alias("others"))
        .filter("doc_id is null or heads <> 1 or others > 0"))
    rows = packed(docs, _id=F.col(id_col).cast("bigint"), _text=whole_text(text_col))
    # every row that is not looked up below is the one head of its group
    rows = marked_hits(rows, ["_id"], ids.select(F.col("doc_id").alias("_id")))
    alone = unpacked(rows.filter("not _hit"))
    rows, same = rows.filter("_hit").drop("_hit"), F.col("_id").eqNullSafe(F.col("head"))
    kept = alone.unionByName(unpacked(rows.drop("_text").join(ids.select(F.col("doc_id").alias("head")), same, "left_anti")))
    tied = ids.filter("heads > 0").select(F.col("doc_id").alias("head"))
    if tied.isEmpty():
        return kept
    digest = F.pandas_udf(lambda t: t.map(lambda x: _signed(fingerprint(x, width))), "bigint")
    some = rows.join(tied, same, "left_semi").withColumn("fp", digest("_text")).join(named, "fp")
    one = some.filter(F.col("_id").eqNullSafe(F.col("component_id"))).dropDuplicates(["root"])
    return kept.unionByName(unpacked(one))

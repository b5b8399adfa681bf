"""Exact duplicate removal over an extendible-hash index on shared files.

1. *Entries.*  One scan gives each row (key, SHA-256, code points): ``key`` is the
   64-bit hash of the text without ASCII white space.
2. *Index.*  Rows of one (key, SHA-256) are counted together with a map-side
   combine, so a group that holds a third of all rows is one entry.  The directory starts as
   one bucket and doubles: an overfull bucket splits on the next key bit until no
   bucket holds more than ``capacity`` entries; buckets of one key cannot split and
   chain.  The directory has about entries / capacity slots and only their
   counts reach the driver.  Entries are written bucket by bucket
   to the shared checkpoint folder, and every bucket is a range of keys.
3. *Owner tasks.*  Texts whose key occurs more than once are combined by (key, bytes), which compares the
   whole normalised texts, look their bucket up in the directory and go to its owner, which
   chains the different texts of each key in its ranges.  A
   (key, SHA-256) that stood for two texts stops the job instead of merging them.

Nulls, ties and repeats: a NULL text is the empty text; ids are whole numbers (cast to bigint; another text as id is an error); a NULL doc_id sorts after every
other id; rows that are equal in id and length are all reported, and exactly one of
them (the first one written) is kept.  An empty table gives an empty result.  Extra columns are ignored
by ``exact_groups`` and carried by ``drop_exact_duplicates``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import marked_hits, materialize, packed, unpacked, whole_text

CAPACITY = 65_536
SPACES = r"[\x20\x09-\x0D]+"
STEP = 4                     # key bits that one counting job looks ahead


def normalised(text: str | Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]."""
    return F.regexp_replace(whole_text(text), SPACES, "")


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, n, key, sha): one row per input row, written to the shared folder
    (the row number is fixed by the write, not recomputed)."""
    norm = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.char_length(whole_text(text_col)).cast("bigint").alias("n"),
                       normalised(text_col).alias("norm"))
    return materialize(norm.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "n",
                                   F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha")))


def _order(n: str, doc_id: str, rid: str) -> Column:
    """Largest first: most code points, smallest id (NULL last), first row."""
    return F.struct(F.col(n).alias("n"), F.col(doc_id).isNotNull().alias("has_id"), (-F.col(doc_id)).alias("neg_id"),
                    (-F.col(rid)).alias("neg_rid"))


def _slot(depth: int) -> Column:
    """The first ``depth`` bits of the key as an unsigned number."""
    return F.shiftrightunsigned(F.col("key"), 64 - depth) if depth else F.lit(0).cast("bigint")


def build_directory(index: DataFrame, capacity: int = CAPACITY) -> tuple[int, list[tuple[int, int]]]:
    """(global depth, [(slot, depth) of each bucket]) by doubling the directory until no
    bucket that can split holds more than ``capacity`` entries."""
    leaves: list[tuple[int, int]] = []
    open_, depth = [(0, 0)], 0
    while open_:
        fine = depth + STEP
        counted = index.groupBy(_slot(depth).alias("coarse"), _slot(fine).alias("slot")).agg(
            F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        if depth:            # only buckets that are still overfull are counted again
            some = index.sparkSession.createDataFrame([(s,) for s, _ in open_], "coarse bigint")
            counted = counted.join(F.broadcast(some), "coarse", "left_semi")
        counts = {r["slot"]: (r["n"], r["lo"], r["hi"]) for r in counted.collect()}
        todo, open_ = open_, []
        while todo:
            slot, d = todo.pop()
            below = [counts[s] for s in range(slot << (fine - d), (slot + 1) << (fine - d)) if s in counts]
            n, one_key = sum(x[0] for x in below), len({k for x in below for k in x[1:]}) <= 1
            if n <= capacity or one_key or d == 64:
                leaves.append((slot, d))
            elif d < fine:
                todo += [(2 * slot, d + 1), (2 * slot + 1, d + 1)]
            else:
                open_.append((slot, d))
        depth = fine
    return max(d for _, d in leaves), sorted(leaves, key=lambda x: x[0] << (64 - x[1]))


def with_bucket(df: DataFrame, directory: tuple[int, list[tuple[int, int]]]) -> DataFrame:
    """Adds ``bucket``, the directory entry that the key points to."""
    depth, leaves = directory
    if depth == 0:
        return df.withColumn("bucket", F.lit(0).cast("bigint"))
    slots = [(s, b) for b, (slot, d) in enumerate(leaves)
             for s in range(slot << (depth - d), (slot + 1) << (depth - d))]
    table = df.sparkSession.createDataFrame(slots, "slot bigint, bucket bigint")
    # 2 to the global depth rows: a few for each bucket of `capacity` entries
    side = F.broadcast(table) if len(slots) <= 1 << 20 else table
    return df.withColumn("slot", _slot(depth)).join(side, "slot").drop("slot")


def build_index(ent: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, tuple]:
    """The index on shared files: one row per (key, sha) with its size, the row that
    stays and its bucket; bucket by bucket, sorted by key."""
    groups = materialize(ent.groupBy("key", "sha").agg(
        F.count(F.lit(1)).alias("size"), F.max(_order("n", "doc_id", "rid")).alias("best")))
    directory = build_directory(groups, capacity)
    owned = with_bucket(groups, directory)
    return materialize(owned.repartition("bucket").sortWithinPartitions("bucket", "key")), directory


def compare_bytes(docs: DataFrame, index: DataFrame, directory: tuple, text_col: str = "text") -> DataFrame:
    """The owner tasks: each takes the buckets (ranges of keys) that are dealt to it and chains the different texts of each key
    that occurs more than once.  Copies of one text are combined where they are read, so an owner gets a text once per task at most.
    Returns (bucket, key, sha, texts, rows)."""
    again = materialize(index.groupBy("key").agg(F.sum("size").alias("rows")).filter("rows > 1").select("key"))
    texts = docs.select(normalised(text_col).alias("norm")).withColumn("key", F.xxhash64("norm"))
    some = marked_hits(texts, ["key"], again).filter("_hit").drop("_hit")
    once = some.groupBy("key", "norm").agg(F.count(F.lit(1)).alias("rows"))
    owned = with_bucket(once.join(again, "key", "left_semi"), directory).repartition("bucket")
    return owned.groupBy("bucket", "key", F.sha2("norm", 256).alias("sha")).agg(F.count(F.lit(1)).alias("texts"), F.sum("rows").alias("rows"))


def _verified(index: DataFrame, chains: DataFrame) -> DataFrame:
    """The index, each shared entry checked against its chain."""
    c = chains.select("bucket", "key", "sha", "texts", F.col("rows").alias("seen"))
    joined = index.join(c, ["bucket", "key", "sha"], "left")
    wrong = (F.col("size") > 1) & ((F.coalesce("texts", F.lit(0)) != 1) | (F.coalesce("seen", F.lit(0)) != F.col("size")))
    checked = F.when(wrong, F.raise_error(F.lit("one digest stands for different texts")).cast("bigint")).otherwise(F.col("size"))
    return joined.select("bucket", "key", "sha", checked.alias("size"), "best")


def _groups(docs: DataFrame, id_col: str, text_col: str, capacity: int) -> tuple[DataFrame, DataFrame]:
    ent = entries(docs, id_col, text_col)
    index, directory = build_index(ent, capacity)
    chains = compare_bytes(docs, index, directory, text_col)
    return ent, materialize(_verified(index, chains))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: doc_id, keep_id (id of the row that stays), group_size, kept,
    text_sha256 (of the normalised text), bucket."""
    ent, index = _groups(docs, id_col, text_col, capacity)
    return ent.join(index, ["key", "sha"]).select(
        "doc_id", (-F.col("best.neg_id")).alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("rid") == -F.col("best.neg_rid")).alias("kept"), F.col("sha").alias("text_sha256"), "bucket")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          capacity: int = CAPACITY) -> DataFrame:
    """The rows that stay, with all their columns."""
    ent, index = _groups(docs, id_col, text_col, capacity)
    rows = packed(docs, doc_id=F.col(id_col).cast("bigint"), n=F.char_length(whole_text(text_col)).cast("bigint"),
                  key=F.xxhash64(normalised(text_col)), sha=F.sha2(normalised(text_col), 256))
    shared = index.filter("size > 1").select("key", "sha", "size", F.col("best.n").alias("best_n"),
                                             (-F.col("best.neg_id")).alias("best_id"))
    best = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("n") == F.col("best_n"))
    marked = ent.join(shared, ["key", "sha"]).groupBy("key", "sha", "doc_id", "n").agg(
        F.count(F.lit(1)).alias("copies"), F.first(best).alias("best"))
    same = ((F.col("r.key") == F.col("d.key")) & (F.col("r.sha") == F.col("d.sha"))
            & (F.col("r.n") == F.col("d.n")) & F.col("r.doc_id").eqNullSafe(F.col("d.doc_id")))
    gone = materialize(marked)
    tied = gone.filter("best and copies > 1")
    rows = marked_hits(rows, ["key"], gone.filter("not best or copies > 1"))
    alone = unpacked(rows.filter("not _hit"))
    kept = rows.filter("_hit").alias("r").join(gone.filter("not best").alias("d"), same, "left_anti")
    if tied.isEmpty():
        return alone.unionByName(unpacked(kept))
    # rows equal in id, length and normalised text: one of each stays
    one = kept.alias("r").join(tied.alias("d"), same, "left_semi").dropDuplicates(["key", "sha"])
    rest = kept.alias("r").join(tied.alias("d"), same, "left_anti")
    return alone.unionByName(unpacked(rest)).unionByName(unpacked(one))


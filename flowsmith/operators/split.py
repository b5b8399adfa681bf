"""Seeded shuffle, exact-count splits and batch assignment.

The shuffle order is the hash uniform u(seed, id) (ties by id), so it is the
same on any cluster and under retries.  Global ranks come from a two-phase
rank over buckets floor(u * B): every bucket is ranked by its own window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.rand import uniform
from ..functions.rank import global_rank

ROWS_PER_BUCKET = 200_000
MOST_RANGES = 512           # ranges of ids for ranks in id order


def _check(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1.0) >= K.RATIO_TOLERANCE:
        raise ValueError(f"shares of {train}, {val} and {test} do not add up to one")


def shuffled(flows: DataFrame, id_col: str = "flow_id", seed: int = K.SPLIT_SEED,
             part_cols: list[str] | None = None) -> DataFrame:
    """Adds ``u`` and a 1-based ``rank`` in shuffled order (per part)."""
    n = flows.count()
    buckets = max(1, n // ROWS_PER_BUCKET)
    f = flows.withColumn("u", uniform(seed, F.col(id_col)))
    return global_rank(f, F.floor(F.col("u") * buckets), ["u", id_col], part_cols=part_cols)


def split_exact(flows: DataFrame, train: float = K.TRAIN_RATIO, val: float = K.VAL_RATIO,
                test: float = K.TEST_RATIO, seed: int = K.SPLIT_SEED, id_col: str = "flow_id") -> DataFrame:
    """n_train = int(n train), n_val = int(n val), the rest is test."""
    _check(train, val, test)
    n = flows.count()
    n_train, n_val = int(n * train), int(n * val)
    r = shuffled(flows, id_col, seed)
    split = (F.when(F.col("rank") <= n_train, "train")
             .when(F.col("rank") <= n_train + n_val, "val").otherwise("test"))
    return r.select(id_col, "app", "rank", split.alias("split"))


def split_stratified(flows: DataFrame, train: float = K.TRAIN_RATIO, val: float = K.VAL_RATIO,
                     test: float = K.TEST_RATIO, seed: int = K.SPLIT_SEED, id_col: str = "flow_id") -> DataFrame:
    """The same cut rule inside every label."""
    _check(train, val, test)
    r = shuffled(flows, id_col, seed, part_cols=["app"])
    sizes = flows.groupBy("app").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumnRenamed("app", "_app")            # one row per label, NULL included
    r = r.join(sizes, F.col("app").eqNullSafe(F.col("_app"))).drop("_app")
    n_train = F.floor(F.col("_n") * train)
    n_val = F.floor(F.col("_n") * val)
    split = (F.when(F.col("rank") <= n_train, "train")
             .when(F.col("rank") <= n_train + n_val, "val").otherwise("test"))
    return r.select(id_col, "app", "rank", split.alias("split"))


def _id_range(flows: DataFrame, id_col: str, ranges: int) -> Column:
    """Number of the id range, cut at approximate quantiles of the ids (a bounded summary); NULL ids are in the first."""
    probs = [i / ranges for i in range(1, ranges)]
    cuts = (flows.agg(F.percentile_approx(id_col, probs, 10 * ranges)).first()[0] if probs else None) or []
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(id_col)))


def assign_batches(flows: DataFrame, batch_size: int = K.BATCH_SIZE, shuffle: bool = True,
                   seed: int = K.SPLIT_SEED, id_col: str = "flow_id") -> DataFrame:
    """T5: batch_id = (rank - 1) div batch_size in shuffled (or id) order."""
    if shuffle:
        r = shuffled(flows, id_col, seed)
    else:
        n = flows.count()
        r = global_rank(flows, _id_range(flows, id_col, min(MOST_RANGES, max(1, n // ROWS_PER_BUCKET))), [id_col])
    return r.select(id_col, "app", "rank", ((F.col("rank") - 1) / batch_size).cast("bigint").alias("batch_id"))


def write_batches(flows: DataFrame, path: str, batches_per_file: int = 64, mode: str = "overwrite") -> None:
    """T5 write: ``flows`` (with batch_id) dealt by ranges of batches and sorted within the file, so a batch lies in one file and the
    files' statistics tell which."""
    most = flows.agg(F.max("batch_id")).first()[0]
    files = max(1, math.ceil(((most or 0) + 1) / batches_per_file))
    flows.repartitionByRange(files, "batch_id").sortWithinPartitions("batch_id").write.mode(mode).parquet(path)


def read_batches(spark: SparkSession, path: str, batches: list[int]) -> DataFrame:
    """T5 read of given batches: the filter reaches the scan, which skips row groups by their range of batches."""
    return spark.read.parquet(path).where(F.col("batch_id").isin(batches))

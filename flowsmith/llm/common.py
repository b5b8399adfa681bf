"""Helpers shared by the training-data operators."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize, scratch_path
from ..sources.tables import read_table

__all__ = ["ensure_checkpoint_dir", "materialize", "scratch_path", "read_table", "packed", "unpacked",
           "whole_text", "table", "prepare", "ship_package", "marked_hits"]


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package's sources to the executors once per application, as --py-files would."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        root = Path(__file__).resolve().parents[2]
        made = shutil.make_archive(f"{tempfile.mkdtemp()}/flowsmith", "zip", root, "flowsmith")
        spark.sparkContext.addPyFile(made)


BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def prepare(spark: SparkSession) -> None:
    """Sends the package, and bounds Arrow batches where the session has Spark's own 10,000 rows: a row is a whole text, and what a
    worker holds follows the batch."""
    ship_package(spark)
    if spark.conf.get(BATCH_KEY, "10000") == "10000":
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark's reader only (the path may be any URI)."""
    prepare(spark)
    return read_table(spark, sf_dir, name)


def packed(df: DataFrame, **cols: Column) -> DataFrame:
    """Every column of ``df`` inside one struct ``_row`` beside the named working
    columns, so that extra columns of the input can never clash with them."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"),
                     *[c.alias(n) for n, c in cols.items()])


def unpacked(df: DataFrame) -> DataFrame:
    """The original columns again."""
    return df.select("_row.*")


def whole_text(col: str | Column) -> Column:
    """The text itself, NULL counting as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


HIT_SLOTS = 1 << 20


def marked_hits(rows: DataFrame, cols: list[str], keys: DataFrame) -> DataFrame:
    """``rows`` with the column ``_hit``: False only if the row's ``cols`` equal no row of ``keys`` (columns of the same names).

    The keys are folded to at most ``HIT_SLOTS`` hash slots, which is the bound of what is broadcast, so rows without a hit need no
    join and their texts no shuffle; rows with one go on to the exact join.  With far more keys than slots every row has a hit."""
    slot = F.pmod(F.xxhash64(*cols), F.lit(HIT_SLOTS))
    slots = keys.select(slot.alias("_slot")).distinct().withColumn("_seen", F.lit(True))
    return (rows.withColumn("_slot", slot).join(F.broadcast(slots), "_slot", "left")
            .withColumn("_hit", F.col("_seen").isNotNull()).drop("_slot", "_seen"))

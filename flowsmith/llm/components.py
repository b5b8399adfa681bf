"""Connected components of a link table by alternating large-star and small-star steps.

Native joins and aggregates only.  Each round is written to the shared checkpoint
folder, so a lost executor re-reads files, and the number of rounds grows
with the logarithm of the longest chain.  A node's neighbours are never gathered:
both steps take a minimum with a map-side combine and join it back, so a node that a third of
all links touch is one row of the aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 100


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest node next to it (itself included)."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    moved = both.filter("b > a").join(least, F.col("a") == F.col("node"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m")
    moved = down.join(least, F.col("a") == F.col("node"))
    return (moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
            .filter("a > b").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); root is the smallest node of its component.
    Self-links and repeated links are allowed; no links give no rows."""
    now = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .filter("a > b").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        now = materialize(_small_star(_large_star(now)))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before is not None and tuple(seen) == before:
            break
        before = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)

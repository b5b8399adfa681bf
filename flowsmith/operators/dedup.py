"""Exact-duplicate check of generated flows against the source flows.

A flow's key is its label plus its 90 values rounded half-even to 6 places,
in (group, slot) order.  The source side is reduced to distinct keys before
the join (map-side), so a key shared by a third of all source flows becomes
one row; the join itself is an equi-join on (hash, label, key array) that AQE
may split when the generated side is skewed.  Flows come as arrays or as cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flowtable as FT


def flow_keys(flows: DataFrame, id_col: str) -> DataFrame:
    """(id, app, key, h): one row per flow.  Flows as arrays need no shuffle; cells are gathered first (at most 90 per flow)."""
    table = flows if FT.is_flow_table(flows) else FT.from_cells(flows, id_col)
    key = F.transform(FT.present_values(table), lambda v: F.bround(v, 6))
    return table.select(id_col, "app", key.alias("key")).withColumn("h", F.xxhash64(F.col("app"), F.col("key")))


def _source_keys(original_cells: DataFrame, id_col: str) -> DataFrame:
    return flow_keys(original_cells, id_col).select("h", "app", "key").distinct()


def _same_flow(source: DataFrame):
    """(source with renamed keys, null-safe condition): flows without a label can be equal too."""
    named = source.select(*[F.col(c).alias(f"_s_{c}") for c in ("h", "app", "key")])
    return named, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in ("h", "app", "key")]


def duplicate_rows(generated: DataFrame, original: DataFrame,
                   gen_id: str = "sample_id", orig_id: str = "flow_id") -> DataFrame:
    """Generated flows equal to some source flow -> (id, app)."""
    g = flow_keys(generated, gen_id)
    return g.join(*_same_flow(_source_keys(original, orig_id)), "left_semi").select(gen_id, "app")


def novel_rows(generated: DataFrame, original: DataFrame,
               gen_id: str = "sample_id", orig_id: str = "flow_id") -> DataFrame:
    """Generated flows equal to no source flow -> (id, app)."""
    g = flow_keys(generated, gen_id)
    return g.join(*_same_flow(_source_keys(original, orig_id)), "left_anti").select(gen_id, "app")


def duplicate_stats(generated: DataFrame, original: DataFrame,
                    gen_id: str = "sample_id", orig_id: str = "flow_id") -> DataFrame:
    """One row: num_duplicates, duplicate_percentage, total_generated,
    total_original.  Both sides are tagged and counted in one aggregate."""
    g = flow_keys(generated, gen_id)
    src = flow_keys(original, orig_id)
    named, same = _same_flow(src.select("h", "app", "key").distinct())
    marked = g.join(named.withColumn("_dup", F.lit(1)), same, "left")
    tagged = (marked.select(F.lit(1).alias("_gen"), F.col("_dup"))
              .unionByName(src.select(F.lit(0).alias("_gen"), F.lit(None).cast("int").alias("_dup"))))
    stats = tagged.agg(F.sum("_gen").alias("total_generated"), F.count("_dup").alias("num_duplicates"),
                       F.sum(1 - F.col("_gen")).alias("total_original"))
    return stats.select(F.col("num_duplicates").cast("bigint"),
                        F.round(F.col("num_duplicates") * 100.0 / F.col("total_generated"), 6)
                        .alias("duplicate_percentage"),
                        F.col("total_generated").cast("bigint"), F.col("total_original").cast("bigint"))

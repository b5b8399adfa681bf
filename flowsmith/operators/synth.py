"""Synthetic flows drawn from per-label, per-column value distributions.

Pipeline (all DataFrame operations):

  value counts -> weights per distinct value (band, high-frequency and
  preferred-pattern boosts) -> integer CDF per column -> guide table
  sample ids (spark.range) -> label by apportioning -> 90 cells per sample
  -> hash-uniform u per cell -> draw by guide-table join -> clean-up.

Exactness: weights are integers (count x each multiplier x 10), so the running
sums are exact and each CDF edge is one correctly rounded division; draws are
identical in any engine and under any partitioning.

Scale: the weight table has one row per distinct (label, column, value); the
draw is an equi-join on (app, grp, slot, bucket) plus the range predicate, so a
draw meets O(1) candidate rows and no (label, column) becomes a hot key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.joins import broadcast_if_small
from ..functions.rand import uniform
from ..functions.rank import join_null_safe
from ..functions.stats import running_sums
from ..session import materialize
from . import flowtable as FT
from . import profile as P

LEAST_BUCKETS = 16           # of a column's unit interval in the guide table; they spread the draws of a common label
STEPS_PER_BUCKET = 4         # distinct values of the column per bucket, about
LABEL_CHUNK = 4096           # sample ids per chunk of the label lookup table
BROADCAST_ROWS = 2_000_000   # largest guide table sent to every task


# --- G3 ---------------------------------------------------------------------

def pattern_score(grp: Column, v: Column, p: Column) -> Column:
    """Score of a (value, probability) in the preferred set, NULL if not preferred."""
    g0 = (F.when((p > 0.05) & (v >= 0.0001) & (v <= 1000.0), p * 2.0)
          .when(p > 0.08, p * 1.5))
    g1 = (F.when(v.isin(-1.0, 0.0, 1.0) & (p > 0.02), p * 5.0)
          .when((F.abs(v + 1.0) < 0.01) | (F.abs(v - 1.0) < 0.01), p * 3.0))
    g2 = (F.when((v >= 20) & (v <= 1500) & (p > 0.04), p * 3.0)
          .when((v > 1500) & (v <= 9000) & (p > 0.02), p * 2.0)
          .when(p > 0.08, p * 1.5))
    return F.when(grp == 0, g0).when(grp == 1, g1).when(grp == 2, g2)


def preferred_patterns(dist: DataFrame, by_app: bool = True) -> DataFrame:
    """One preferred set per (label, group), merged over its 30 columns; a
    value that qualifies in several columns keeps the score of the last one."""
    keys = (["app"] if by_app else []) + ["grp"]
    scored = dist.withColumn("score", pattern_score(F.col("grp"), F.col("v"), F.col("p")))
    return (scored.where(F.col("score").isNotNull())
            .groupBy(*keys, "v").agg(F.max_by("score", "slot").alias("score")))


# --- G4 / W2 ----------------------------------------------------------------

def band_multiplier(grp: Column, v: Column) -> Column:
    """Band boost x10 as an integer (first matching band wins)."""
    g0 = (F.when((v >= 0.001) & (v <= 100.0), 20)
          .when(((v >= 0.0001) & (v <= 0.001)) | ((v > 100.0) & (v <= 1000.0)), 13)
          .when(v > 10000.0, 3).otherwise(10))
    g1 = (F.when(F.abs(v + 1.0) < 0.001, 100).when(F.abs(v - 1.0) < 0.001, 100)
          .when(F.abs(v) < 0.001, 50).otherwise(1))
    g2 = (F.when((v >= 20) & (v <= 1500), 25).when((v > 1500) & (v <= 9000), 15)
          .when((v >= 1) & (v < 20), 12).when(v > 9000, 2).when(v == 0, 8).otherwise(10))
    return F.when(grp == 0, g0).when(grp == 1, g1).otherwise(g2).cast("bigint")


def enhanced_weights(counts: DataFrame) -> DataFrame:
    """(app, grp, slot, v, cnt, p, weight, w_norm): integer weight
    cnt x band x high-frequency x preferred (each x10) per distinct value."""
    dist = materialize(P.value_dist(counts=counts, by_app=True))       # several branches read it
    hf = P.high_freq_values(dist=dist).select("app", "grp", "slot", "v", F.lit(True).alias("_hf"))
    pref = preferred_patterns(dist).select("app", "grp", "v", F.lit(True).alias("_pref"))
    hf_boost = (F.when(F.col("_hf") & (F.col("grp") == 0), 15)
                .when(F.col("_hf") & (F.col("grp") == 2), 14).otherwise(10)).cast("bigint")
    pref_boost = F.when(F.col("_pref"), 15).otherwise(10).cast("bigint")
    weight = F.col("cnt") * band_multiplier(F.col("grp"), F.col("v")) * hf_boost * pref_boost
    marked = join_null_safe(join_null_safe(dist, hf, ["app", "grp", "slot", "v"], "left"), pref, ["app", "grp", "v"], "left")
    w = materialize(marked
                    .select("app", "grp", "slot", "v", "cnt", "p", weight.alias("weight")))
    keys = ["app", "grp", "slot"]
    totals = w.groupBy(*keys).agg(F.sum("weight").alias("_total"))
    return join_null_safe(w, totals, keys).select(*keys, "v", "cnt", "p", "weight",
                                                  (F.col("weight") / F.col("_total")).alias("w_norm"))


def value_cdf(weights: DataFrame) -> DataFrame:
    """(app, grp, slot, v, lo, hi): the draw u selects v when lo <= u < hi.
    Running sums are integers, so edges are exact and the last hi is 1.0."""
    keys = ["app", "grp", "slot"]
    steps = running_sums(weights.where(F.col("weight") > 0).select(*keys, "v", "weight"), keys, "v", "weight")
    total = F.col("_n").cast("double")
    return steps.select(*keys, "v", ((F.col("_cum") - F.col("weight")).cast("double") / total).alias("lo"),
                        (F.col("_cum").cast("double") / total).alias("hi"))


def column_buckets(weights: DataFrame) -> DataFrame:
    """(app, grp, slot, buckets): into how many buckets the guide table cuts the unit interval for each column, a power of two
    that follows the column's own number of values: a draw meets about ``STEPS_PER_BUCKET`` steps in any column."""
    per = weights.where(F.col("weight") > 0).groupBy("app", "grp", "slot").agg(F.count(F.lit(1)).alias("_n"))
    power = F.ceil(F.log2(F.greatest(F.col("_n") / STEPS_PER_BUCKET, F.lit(1.0))))
    return per.select("app", "grp", "slot", F.greatest(F.lit(float(LEAST_BUCKETS)), F.pow(F.lit(2.0), power)).cast("bigint").alias("buckets"))


def guide_table(cdf: DataFrame, buckets: DataFrame) -> DataFrame:
    """Every CDF step repeated for each bucket floor(u * buckets) it overlaps: steps + buckets of a column in all."""
    steps = join_null_safe(cdf, buckets, ["app", "grp", "slot"])
    first = F.floor(F.col("lo") * F.col("buckets")).cast("bigint")
    last = F.least(F.floor(F.col("hi") * F.col("buckets")).cast("bigint"), F.col("buckets") - 1)
    return steps.select("app", "grp", "slot", "v", "lo", "hi",
                        F.explode(F.sequence(first, last)).alias("b"))


# --- G1 / G2 / G5 -----------------------------------------------------------

def apportion(label_counts: DataFrame, n: int, original: bool = True) -> DataFrame:
    """(app, cnt, n_samples, start): samples per label.  Labels are ordered by
    count desc, then label.  Original proportions: floor(n cnt / total), the
    last label gets the remainder.  Equal: n div L, the first n mod L labels
    get one more.  Windows run over the per-label table only."""
    order = Window.orderBy(F.desc("cnt"), F.asc("app"))
    everything = Window.partitionBy()
    lc = (label_counts.withColumn("rn", F.row_number().over(order))
          .withColumn("labels", F.count(F.lit(1)).over(everything))
          .withColumn("total", F.sum("cnt").over(everything)))
    if original:
        # whole-number division: a decimal quotient would round at its last place before the floor
        share = F.expr(f"cast(cast({int(n)} as decimal(19,0)) * cast(cnt as decimal(19,0)) div cast(total as decimal(19,0)) as bigint)")
        lc = lc.withColumn("_share", share)
        others = F.sum(F.when(F.col("rn") < F.col("labels"), F.col("_share")).otherwise(0)).over(everything)
        k = F.when(F.col("rn") == F.col("labels"), F.lit(n) - others).otherwise(F.col("_share"))
    else:
        k = (F.lit(n) / F.col("labels")).cast("bigint") + F.when(F.col("rn") <= F.lit(n) % F.col("labels"), 1).otherwise(0)
    lc = lc.withColumn("n_samples", k.cast("bigint"))
    start = F.sum("n_samples").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_samples")
    return lc.select("app", F.col("cnt").cast("bigint").alias("cnt"), "rn", "n_samples",
                     start.cast("bigint").alias("start"))


def sample_skeleton(spark: SparkSession, plan: DataFrame, n: int,
                    num_partitions: int | None = None) -> DataFrame:
    """(sample_id, app) for ids 0..n-1.  The label of an id is found through a
    chunk table (one row per label and chunk of 4096 ids it overlaps): about
    n / 4096 + #labels rows, broadcast when a count proves it small."""
    parts = num_partitions or max(spark.sparkContext.defaultParallelism, math.ceil(n * 90 / 4_000_000))
    ids = spark.range(0, n, 1, parts).withColumnRenamed("id", "sample_id")
    end = F.col("start") + F.col("n_samples")
    chunks = (plan.where(F.col("n_samples") > 0)
              .select("app", "start", end.alias("end"),
                      F.explode(F.sequence((F.col("start") / LABEL_CHUNK).cast("bigint"),
                                           ((end - 1) / LABEL_CHUNK).cast("bigint"))).alias("chunk")))
    ids = ids.withColumn("chunk", (F.col("sample_id") / LABEL_CHUNK).cast("bigint"))
    return (ids.join(broadcast_if_small(chunks, BROADCAST_ROWS), "chunk")
            .where((F.col("sample_id") >= F.col("start")) & (F.col("sample_id") < F.col("end")))
            .select("sample_id", "app"))


def skeleton_cells(skeleton: DataFrame, buckets: DataFrame) -> DataFrame:
    """(sample_id, app, grp, slot, buckets): 90 cells per sample, a narrow explode.  ``buckets`` (one row per label and column)
    is folded to one row per label and joined once per sample."""
    k = F.col("grp") * K.N_SLOTS + F.col("slot")
    per = buckets.groupBy("app").agg(F.map_from_entries(F.collect_list(F.struct(k, "buckets"))).alias("_b"))   # at most 90 entries
    every = F.sequence(F.lit(0), F.lit(K.N_GROUPS * K.N_SLOTS - 1))
    per = per.select("app", F.transform(every, lambda i: F.element_at("_b", i)).alias("_b"))
    i = F.posexplode(F.coalesce(F.col("_b"), F.array_repeat(F.lit(None).cast("bigint"), K.N_GROUPS * K.N_SLOTS))).alias("i", "buckets")
    return (join_null_safe(skeleton, broadcast_if_small(per, BROADCAST_ROWS // (K.N_GROUPS * K.N_SLOTS)), ["app"], "left")
            .select("sample_id", "app", i)
            .select("sample_id", "app", (F.col("i") / K.N_SLOTS).cast("int").alias("grp"),
                    (F.col("i") % K.N_SLOTS).cast("int").alias("slot"), "buckets"))


# --- J5 / G6 ----------------------------------------------------------------

def draw(cells: DataFrame, guide: DataFrame, seed: int = K.DEFAULT_SEED, broadcast_guide: bool | None = None) -> DataFrame:
    """Raw draws: every cell (with its column's ``buckets``) gets u = uniform(seed, sample_id, grp, slot) and
    the value whose CDF step holds u.  Cells of a column without any value get
    0.0 (left join + coalesce)."""
    u = uniform(seed, F.col("sample_id"), F.col("grp"), F.col("slot"))
    c = cells.withColumn("u", u).withColumn("b", F.floor(F.col("u") * F.col("buckets")).cast("bigint"))
    g = guide.select(*[F.col(k).alias(f"g_{k}") for k in ("app", "grp", "slot", "b", "v", "lo", "hi")])
    if broadcast_guide:
        g = F.broadcast(g)
    cond = [F.col("app").eqNullSafe(F.col("g_app")), F.col("grp") == F.col("g_grp"), F.col("slot") == F.col("g_slot"),
            F.col("b") == F.col("g_b"), F.col("u") >= F.col("g_lo"), F.col("u") < F.col("g_hi")]
    j = c.join(g, cond, "left")
    return j.select("sample_id", "app", "grp", "slot", F.coalesce(F.col("g_v"), F.lit(0.0)).alias("v"))


def clean_timing(v: Column, u_gate: Column, u_jitter: Column) -> Column:
    """negative -> abs; a positive value gets +-2 % jitter with chance 0.1,
    floored at 0.0001."""
    a = F.abs(v)
    jittered = F.greatest(F.lit(K.JITTER_FLOOR), a + a * (u_jitter * (2 * K.JITTER_SPAN) - K.JITTER_SPAN))
    return F.when((a > 0) & (u_gate < K.JITTER_CHANCE), jittered).otherwise(a)


def clean_direction(v: Column) -> Column:
    """within 0.2 of -1 -> -1; within 0.2 of +1 -> +1; otherwise 0."""
    return (F.when(F.abs(v + 1.0) < K.DIRECTION_SNAP, F.lit(-1.0))
            .when(F.abs(v - 1.0) < K.DIRECTION_SNAP, F.lit(1.0)).otherwise(F.lit(0.0)))


def clean_size(v: Column) -> Column:
    """negative -> abs; half-even round to whole bytes; 0 < v < 20 -> 20."""
    r = F.rint(F.abs(v))
    return F.when((r > 0) & (r < K.MIN_PACKET), F.lit(K.MIN_PACKET)).otherwise(r)


def clean_cells(cells: DataFrame, seed: int = K.DEFAULT_SEED, id_col: str = "sample_id",
                out_col: str = "v") -> DataFrame:
    """F4-F6 on every cell; the result replaces ``v`` or goes to ``out_col``."""
    g, v = F.col("grp"), F.col("v")
    keys = (F.col(id_col), g, F.col("slot"))
    cleaned = (F.when(v.isNull(), v)
               .when(g == 0, clean_timing(v, uniform(seed, *keys, "gate"), uniform(seed, *keys, "jit")))
               .when(g == 1, clean_direction(v))
               .otherwise(clean_size(v)))
    return cells.withColumn(out_col, cleaned)


def raw_draws(spark: SparkSession, counts: DataFrame, n: int, seed: int, original_proportions: bool = True,
              labels: DataFrame | None = None) -> DataFrame:
    """(sample_id, app, grp, slot, v) as drawn.  ``counts`` should be materialized (it is read by several branches);
    ``labels`` is (app, cnt), the flows per label, where the caller has it."""
    plan = apportion(labels if labels is not None else P.label_counts_of(counts), n, original_proportions)
    weights = materialize(enhanced_weights(counts))
    buckets = materialize(column_buckets(weights))
    guide = materialize(guide_table(value_cdf(weights), buckets))
    # the guide table is written; its row count is a cheap metadata-sized job
    small = guide.count() <= BROADCAST_ROWS
    return draw(skeleton_cells(sample_skeleton(spark, plan, n), buckets), guide, seed, broadcast_guide=small)


def synthesize_cells(spark: SparkSession, counts: DataFrame, n: int = K.N_SAMPLES,
                     seed: int = K.DEFAULT_SEED, original_proportions: bool = True,
                     labels: DataFrame | None = None) -> DataFrame:
    """(sample_id, app, grp, slot, v) for n synthetic flows."""
    return clean_cells(raw_draws(spark, counts, n, seed, original_proportions, labels), seed)


def synthesize_flows(spark: SparkSession, counts: DataFrame, n: int = K.N_SAMPLES,
                     seed: int = K.DEFAULT_SEED, original_proportions: bool = True,
                     labels: DataFrame | None = None) -> DataFrame:
    """G6 as arrays (see ``flowtable``).  Sample ids are dealt in ranges and a small guide is broadcast, so a sample's cells lie together
    and are gathered without a shuffle; with a guide beyond the broadcast limit they are shuffled by sample."""
    return FT.from_cells(synthesize_cells(spark, counts, n, seed, original_proportions, labels), "sample_id")


def to_wide(cells: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """One row per flow with columns PPI_g_s (90 values), absent ones NULL.  Takes flows or cells."""
    return FT.to_wide(cells if FT.is_flow_table(cells) else FT.from_cells(cells, id_col), id_col)

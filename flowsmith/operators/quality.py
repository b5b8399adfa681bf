"""Quality and fidelity of a (generated) flow table.

V1-V4 are one conditional-aggregate pass over the cells.  Penalties follow the
absolute-count rule (so big tables score 0); rate columns are reported next to
them.  V6-V8 compare a generated table with the source by joining small
per-value / per-feature aggregates, never the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rank import join_null_safe
from ..functions.stats import r6
from . import profile as P


def _n(cond):
    return F.count_if(cond).cast("bigint")


def _counters():
    g, v = F.col("grp"), F.col("v")
    t, d, s = g == 0, g == 1, g == 2
    return [
        _n(t).alias("t_total"), _n(t & (v < 0)).alias("t_neg"), _n(t & (v == 0)).alias("t_zero"),
        _n(t & (v >= 0.0001) & (v <= 1000.0)).alias("t_real"), _n(t & (v > 10000.0)).alias("t_out"),
        _n(d).alias("d_total"), _n(d & (v == -1.0)).alias("d_m1"), _n(d & (v == 1.0)).alias("d_p1"),
        _n(d & (v == 0.0)).alias("d_zero"),
        _n(d & ((F.abs(v + 1) < 0.1) | (F.abs(v - 1) < 0.1) | (F.abs(v) < 0.1))).alias("d_near"),
        _n(s).alias("s_total"), _n(s & (v < 0)).alias("s_neg"), _n(s & (v == 0)).alias("s_zero"),
        _n(s & (v >= 20) & (v <= 9000)).alias("s_real"), _n(s & (v > 0) & (v < 20)).alias("s_tiny"),
        _n(s & (v > 9000)).alias("s_huge"), _n(s & (v == F.rint(v))).alias("s_int"),
    ]


COUNTERS = ("t_total", "t_neg", "t_zero", "t_real", "t_out", "d_total", "d_m1", "d_p1", "d_zero", "d_near",
            "s_total", "s_neg", "s_zero", "s_real", "s_tiny", "s_huge", "s_int")


def _sums():
    """Counters and flows over blocks of ids; 0 where there is no cell at all."""
    return [P.flows_in().alias("total_samples"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTERS]]


def quality_aggregates(cells: DataFrame) -> DataFrame:
    """All counters of V1-V3 in one pass (the id column is the first column)."""
    return P.flow_bitmaps(cells, *_counters(), id_col=cells.columns[0]).agg(*_sums())


def quality_aggregates_by(cells: DataFrame, key: str) -> DataFrame:
    """The same counters per value of ``key`` (id column ``_id``)."""
    return P.flow_bitmaps(cells, *_counters(), id_col="_id", keys=(key,)).groupBy(key).agg(*_sums())


def _timing_score():
    return F.greatest(F.lit(0.0), 100.0 - 10.0 * F.col("t_neg") - 5.0 * F.col("t_out"))


def _direction_score():
    return F.try_divide((F.col("d_m1") + F.col("d_p1") + F.col("d_zero")) * 100.0, F.col("d_total"))


def _size_score():
    return F.greatest(F.lit(0.0), 100.0 - 10.0 * F.col("s_neg") - 2.0 * F.col("s_tiny") - 5.0 * F.col("s_huge"))


def quality_timing(cells: DataFrame) -> DataFrame:
    """V1."""
    a = quality_aggregates(cells)
    return a.select(F.col("t_neg").alias("negative_values"), F.col("t_zero").alias("zero_values"),
                    F.col("t_real").alias("realistic_timing_values"), F.col("t_out").alias("extreme_outliers"),
                    r6(F.try_divide("t_neg", "t_total")).alias("negative_rate"),
                    r6(F.try_divide("t_out", "t_total")).alias("outlier_rate"),
                    _timing_score().alias("quality_score"))


def quality_direction(cells: DataFrame) -> DataFrame:
    """V2."""
    a = quality_aggregates(cells)
    return a.select(F.col("d_m1").alias("exact_minus_one"), F.col("d_p1").alias("exact_plus_one"),
                    F.col("d_zero").alias("exact_zero"), F.col("d_near").alias("near_binary_values"),
                    r6(F.try_divide(F.col("d_m1") + F.col("d_p1") + F.col("d_zero"), F.col("d_total"))).alias("exact_binary_ratio"),
                    r6(_direction_score()).alias("quality_score"))


def quality_size(cells: DataFrame) -> DataFrame:
    """V3."""
    a = quality_aggregates(cells)
    return a.select(F.col("s_neg").alias("negative_values"), F.col("s_zero").alias("zero_values"),
                    F.col("s_real").alias("realistic_packet_sizes"), F.col("s_tiny").alias("tiny_packets"),
                    F.col("s_huge").alias("huge_packets"), F.col("s_int").alias("integer_values"),
                    r6(F.try_divide(F.col("s_neg") + F.col("s_tiny") + F.col("s_huge"), F.col("s_total"))).alias("violation_rate"),
                    _size_score().alias("quality_score"))


def _score_rows(a: DataFrame) -> DataFrame:
    ts, ds, ss = _timing_score(), _direction_score(), _size_score()
    keep = [c for c in a.columns if c == "_t"]
    return a.select(*keep, "total_samples", r6(ts).alias("timing_score"), r6(ds).alias("direction_score"),
                    r6(ss).alias("size_score"), r6((ts + ds + ss) / 3.0).alias("overall_score"))


def quality_overall(cells: DataFrame) -> DataFrame:
    """V4: the three scores and their mean (one pass)."""
    return _score_rows(quality_aggregates(cells))


def quality_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """V5: overall scores of two tables and their difference (both tables
    are tagged, scored by one grouped aggregate, and folded into one row)."""
    cols = ["grp", "v"]
    idb, ida = before.columns[0], after.columns[0]
    both = (before.select(F.lit("before").alias("_t"), F.col(idb).alias("_id"), *cols)
            .unionByName(after.select(F.lit("after").alias("_t"), F.col(ida).alias("_id"), *cols)))
    per = _score_rows(quality_aggregates_by(both, "_t"))
    names = ("timing_score", "direction_score", "size_score", "overall_score")
    folded = per.agg(*[F.max(F.when(F.col("_t") == t, F.col(c))).alias(f"{t}_{c}")
                       for t in ("before", "after") for c in names])
    return folded.withColumn("improvement", r6(F.col("after_overall_score") - F.col("before_overall_score")))


def distribution_fidelity(original_counts: DataFrame, generated_counts: DataFrame) -> DataFrame:
    """V6: per (app, grp): 1 - mean over the 30 columns of the total variation
    distance 0.5 sum |p_orig - p_gen| (full outer join of the distinct values)."""
    keys = ["app", "grp", "slot", "v"]
    o = P.value_dist(counts=original_counts).select(*keys, F.col("p").alias("p1"))
    g = P.value_dist(counts=generated_counts).select(*keys, F.col("p").alias("p2"))
    j = join_null_safe(o, g, keys, "full_outer")
    tv = j.groupBy("app", "grp", "slot").agg(
        (0.5 * F.sum(F.abs(F.coalesce("p1", F.lit(0.0)) - F.coalesce("p2", F.lit(0.0))))).alias("tv"))
    return tv.groupBy("app", "grp").agg(r6(1.0 - F.avg("tv")).alias("fidelity"),
                                        r6(F.max("tv")).alias("worst_column_tv"))


def profile_correlation(original_counts: DataFrame, generated_counts: DataFrame) -> DataFrame:
    """V7: correlation of per-feature means, source vs generated: per app over
    all 90 features (grp = NULL) and per (app, grp) over the 30 slots."""
    def means(counts, name):
        m = counts.where(F.col("v").isNotNull()).groupBy("app", "grp", "slot").agg(
            (F.sum(F.col("v") * F.col("cnt")) / F.sum("cnt")).alias(name))
        return m
    j = join_null_safe(means(original_counts, "x"), means(generated_counts, "y"), ["app", "grp", "slot"])

    def corr_over(df, keys):
        w = Window.partitionBy(*keys)
        c = (df.withColumn("dx", F.col("x") - F.avg("x").over(w))
               .withColumn("dy", F.col("y") - F.avg("y").over(w)))
        agg = c.groupBy(*keys).agg(F.sum(F.col("dx") * F.col("dy")).alias("sxy"),
                                   F.sum(F.col("dx") * F.col("dx")).alias("sxx"),
                                   F.sum(F.col("dy") * F.col("dy")).alias("syy"),
                                   F.count(F.lit(1)).alias("n"))
        corr = F.when((F.col("sxx") > 1e-12) & (F.col("syy") > 1e-12),
                      F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")))
        return agg.select(*keys, F.col("n").cast("bigint").alias("n_features"), r6(corr).alias("correlation"))

    per_app = corr_over(j, ["app"]).select("app", F.lit(None).cast("int").alias("grp"), "n_features", "correlation")
    per_grp = corr_over(j, ["app", "grp"]).select("app", "grp", "n_features", "correlation")
    return per_app.unionByName(per_grp)


def label_fidelity(original_labels: DataFrame, generated_labels: DataFrame) -> DataFrame:
    """V8 + A9: per label the source share, the generated count and share, and
    the overall consistency 1 - 0.5 sum |share difference| on every row.
    Inputs are (app, cnt) tables (one row per label)."""
    o = original_labels.select("app", F.col("cnt").alias("original_count"))
    g = generated_labels.select("app", F.col("cnt").alias("generated_count"))
    j = join_null_safe(o, g, ["app"], "full_outer").fillna(0, ["original_count", "generated_count"])
    everything = Window.partitionBy()
    j = (j.withColumn("original_share", F.col("original_count") / F.sum("original_count").over(everything))
          .withColumn("generated_share", F.col("generated_count") / F.sum("generated_count").over(everything)))
    diff = F.abs(F.col("generated_share") - F.col("original_share"))
    return j.select("app", F.col("original_count").cast("bigint"), F.col("generated_count").cast("bigint"),
                    r6("original_share").alias("original_share"), r6("generated_share").alias("generated_share"),
                    r6(F.col("generated_share") - F.col("original_share")).alias("share_diff"),
                    r6(1.0 - 0.5 * F.sum(diff).over(everything)).alias("label_consistency"))

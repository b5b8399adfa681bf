"""Profiles of a flow table: per feature, per label, per (label, group),
adaptive thresholds and per-column value distributions.

Input is the long ``cells(flow_id, app, grp, slot, v)`` form.  The single
row-level shuffle is ``value_counts``: ``groupBy(app, grp, slot, v).count()``
with map-side partial aggregation, so its output is bounded by the number of
distinct values, not rows.  Every other profile is computed from that table.
Pass ``counts=`` to reuse one (cached or written) counts table across calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.rank import join_null_safe
from ..functions.stats import percentiles_from_counts, r6, weighted_moments

PCT_NAMES = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p98": 0.98}


def value_counts(cells: DataFrame) -> DataFrame:
    """(app, grp, slot, v, cnt) including v = NULL rows (missing cells)."""
    return cells.groupBy("app", "grp", "slot", "v").agg(F.count(F.lit(1)).alias("cnt"))


def _global(counts: DataFrame) -> DataFrame:
    return counts.groupBy("grp", "slot", "v").agg(F.sum("cnt").alias("cnt"))


def value_dist(cells: DataFrame | None = None, by_app: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """Per (app, grp, slot) every distinct non-NULL value with its count and
    probability cnt / non-NULL count of the column."""
    counts = counts if counts is not None else value_counts(cells)
    base = counts if by_app else _global(counts)
    keys = (["app"] if by_app else []) + ["grp", "slot"]
    base = base.where(F.col("v").isNotNull())
    totals = base.groupBy(*keys).agg(F.sum("cnt").alias("_total"))
    return join_null_safe(base, totals, keys).select(*keys, "v", F.col("cnt").cast("bigint").alias("cnt"),
                                                     (F.col("cnt") / F.col("_total")).alias("p"))


def group_profile(cells: DataFrame | None = None, by_app: bool = True,
                  counts: DataFrame | None = None, extra_pcts: bool = False,
                  rounded: bool = True) -> DataFrame:
    """Per (app, grp) or per grp: min, max, mean of the 30 column means,
    mean of the 30 column stds, p25..p95 over all values, zero ratio, non-zero
    count and sample count."""
    counts = counts if counts is not None else value_counts(cells)
    return _group_profile(counts if by_app else _global(counts), (["app"] if by_app else []) + ["grp"], counts, extra_pcts, rounded)


def group_profile_levels(counts: DataFrame, extra_pcts: bool = False, rounded: bool = True) -> DataFrame:
    """A5 and A6 together: the profiles per (app, grp) with level 'label' and those per grp with level 'all' (app is NULL)
    from one scan of the counts, by grouping sets."""
    sets = counts.groupingSets([["app", "grp", "slot", "v"], ["grp", "slot", "v"]], "app", "grp", "slot", "v").agg(
        F.sum("cnt").alias("cnt"), F.grouping("app").alias("_all"))
    base = sets.select(F.when(F.col("_all") == 1, "all").otherwise("label").alias("level"), "app", "grp", "slot", "v", "cnt")
    return _group_profile(base, ["level", "app", "grp"], counts, extra_pcts, rounded)


def _group_profile(base: DataFrame, gkeys: list[str], counts: DataFrame, extra_pcts: bool, rounded: bool) -> DataFrame:
    level2 = weighted_moments(base, gkeys + ["slot"], "v", "cnt").groupBy(*gkeys).agg(
        F.min("min").alias("min"), F.max("max").alias("max"),
        F.avg("mean").alias("mean"), F.avg("std").alias("std"),
        F.sum("zeros").alias("zeros"), F.coalesce(F.sum("n"), F.lit(0)).alias("non_null"),
        F.max("rows").alias("sample_count"))
    group_freq = base.groupBy(*gkeys, "v").agg(F.sum("cnt").alias("cnt"))
    pcts = dict(PCT_NAMES) if extra_pcts else {k: v for k, v in PCT_NAMES.items() if k != "p98"}
    pct = percentiles_from_counts(group_freq, gkeys, "v", "cnt", pcts, cuts_from=counts)
    out = join_null_safe(level2, pct, gkeys, "left")
    rnd = r6 if rounded else (lambda c: c if isinstance(c, Column) else F.col(c))
    cols = [*gkeys, "min", "max", rnd("mean").alias("mean"), rnd("std").alias("std")]
    cols += [rnd(k).alias(k) for k in pcts]
    cols += [rnd(F.when(F.col("non_null") > 0, F.col("zeros") / F.col("non_null")).otherwise(0.0)).alias("zero_ratio"),
             (F.col("non_null") - F.col("zeros")).cast("bigint").alias("non_zero_count"),
             F.col("sample_count").cast("bigint").alias("sample_count")]
    return out.select(*cols)


def thresholds(cells: DataFrame | None = None, by_app: bool = True,
               counts: DataFrame | None = None, profile: DataFrame | None = None) -> DataFrame:
    """Adaptive limits per (app, grp) or per grp.

    group 0: u = p98 > 0 ? min(p98, m + 3s) : m + 3s; upper = max(u, m + 2.5s); noise = 0.005 s
    group 2: u = p95 > 0 ? min(p95, m + 2.5s) : m + 2.5s; upper = max(u, m + 2s); noise = min(0.05 s, 10)
    group 1: constants (tolerance, symmetry chance).  ``least``/``greatest``
    skip NULL like Python's min/max with a NaN second argument.
    """
    prof = profile if profile is not None else group_profile(cells, by_app, counts, extra_pcts=True, rounded=False)
    keys = [k for k in ("level", "app") if k in prof.columns]
    m, s, g = F.col("mean"), F.col("std"), F.col("grp")

    def upper(p, k_up, k_floor):
        stats = m + F.lit(k_up) * s
        u = F.when(p > 0, F.least(p, stats)).otherwise(stats)
        return F.greatest(u, m + F.lit(k_floor) * s)

    up = (F.when(g == 0, upper(F.col("p98"), K.TIMING_K_UPPER, K.TIMING_K_FLOOR))
          .when(g == 2, upper(F.col("p95"), K.SIZE_K_UPPER, K.SIZE_K_FLOOR)))
    noise = (F.when(g == 0, s * K.TIMING_NOISE)
             .when((g == 2) & s.isNotNull(), F.least(s * K.SIZE_NOISE, F.lit(K.SIZE_NOISE_CAP))))
    return prof.select(
        *keys, "grp",
        F.when(g != 1, F.lit(0.0)).alias("lower_threshold"),
        r6(up).alias("upper_threshold"),
        r6(noise).alias("noise_std"),
        F.when(g == 1, F.lit(K.BINARY_TOLERANCE)).alias("binary_tolerance"),
        F.when(g == 1, F.lit(K.SYMMETRY_BREAK_CHANCE)).alias("symmetry_break_chance"),
    )


def feature_profile(cells: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """A1: per feature (grp, slot): mean, std, min, max, #zeros, #negatives."""
    counts = counts if counts is not None else value_counts(cells)
    mom = weighted_moments(_global(counts), ["grp", "slot"], "v", "cnt")
    return mom.select("grp", "slot", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max",
                      F.col("zeros").cast("bigint").alias("zeros"),
                      F.col("negatives").cast("bigint").alias("negatives"))


def label_counts(flows_or_cells: DataFrame, id_col: str = "flow_id") -> DataFrame:
    """(app, cnt): flows per label; accepts the flow or the cell form.  Cells are first reduced to one row per flow, so a flow
    counts whichever cells it has."""
    df = flows_or_cells
    if "slot" in df.columns:
        df = df.select(id_col, "app").distinct()
    return df.groupBy("app").agg(F.count(F.lit(1)).alias("cnt"))


def label_counts_of(counts: DataFrame) -> DataFrame:
    """(app, cnt) from the value counts alone: the rows of the fullest column of each label, which are its flows unless every
    column lacks in some flow."""
    columns = counts.groupBy("app", "grp", "slot").agg(F.sum("cnt").alias("cnt"))
    return columns.groupBy("app").agg(F.max("cnt").alias("cnt"))


def label_profile(cells: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """A2: per label its count, plus the number of labels and the most common
    label (count desc, then label asc) on every row.  The windows run over the
    per-label table (one row per label), not over flows; ``labels`` is that
    table where the caller has it."""
    lc = labels if labels is not None else label_counts(cells)
    everything = Window.partitionBy()
    ranked = Window.orderBy(F.desc("cnt"), F.asc("app")).rowsBetween(Window.unboundedPreceding,
                                                                     Window.unboundedFollowing)
    return lc.select("app", F.col("cnt").cast("bigint").alias("cnt"),
                     F.count(F.lit(1)).over(everything).cast("bigint").alias("unique_count"),
                     F.first("app").over(ranked).alias("most_common"))


def label_proportions(cells: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """A4: (app, cnt, proportion)."""
    lc = labels if labels is not None else label_counts(cells)
    return lc.select("app", F.col("cnt").cast("bigint").alias("cnt"),
                     (F.col("cnt") / F.sum("cnt").over(Window.partitionBy())).alias("proportion"))


def flow_bitmaps(cells: DataFrame, *aggs: Column, id_col: str = "flow_id", keys: tuple = ()) -> DataFrame:
    """``aggs`` per block of 32,768 ids, with ``_flows``, the bitmap of the ids in the block: ids are counted without a
    distinct aggregate (blocks are disjoint, so ``flows_in`` adds up over them)."""
    i = F.col(id_col).cast("bigint")
    return cells.groupBy(*keys, F.bitmap_bucket_number(i).alias("_block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(i)).alias("_flows"), *aggs)


def flows_in() -> Column:
    """Number of flows over rows of ``flow_bitmaps``."""
    return F.coalesce(F.sum(F.when(F.col("_block").isNotNull(), F.bitmap_count("_flows"))), F.lit(0)).cast("bigint")


def dataset_overview(cells: DataFrame) -> DataFrame:
    """A3: rows (flows), feature count, missing cells (NULL values + flows without a label).  Per block of ids: the bitmaps of
    its flows and of those without a label, its missing cells and, for each group, a bit for every slot it has."""
    groups = [f"_m{g}" for g in range(K.N_GROUPS)]
    bit = F.bitmap_bit_position(F.when(F.col("app").isNull(), F.col("flow_id").cast("bigint")))
    blocks = flow_bitmaps(
        cells, F.bitmap_construct_agg(bit).alias("_unlabelled"), F.count_if(F.col("v").isNull()).alias("_missing"),
        *[F.bit_or(F.when(F.col("grp") == g, F.expr("shiftleft(1L, slot)"))).alias(m) for g, m in enumerate(groups)])
    features = sum((F.coalesce(F.bit_count(F.bit_or(m)), F.lit(0)) for m in groups[1:]),
                   F.coalesce(F.bit_count(F.bit_or(groups[0])), F.lit(0)))
    missing = F.sum(F.col("_missing") + F.when(F.col("_block").isNotNull(), F.bitmap_count("_unlabelled")).otherwise(0))
    return blocks.agg(flows_in().alias("total_samples"), features.cast("bigint").alias("total_features"),
                      F.coalesce(missing, F.lit(0)).cast("bigint").alias("missing_values"))


def group_summary(cells: DataFrame) -> DataFrame:
    """A10: per group of a (generated) table: min, max, distinct values over
    the 30 columns together, non-zero count, total and non-zero percent."""
    dv = cells.groupBy("grp", "v").agg(F.count(F.lit(1)).alias("cnt"))
    return dv.groupBy("grp").agg(
        F.min("v").alias("min"), F.max("v").alias("max"),
        F.count("v").cast("bigint").alias("unique_values"),
        F.sum(F.when(F.col("v") != 0, F.col("cnt")).otherwise(0)).cast("bigint").alias("non_zero"),
        F.sum("cnt").cast("bigint").alias("total"),
    ).withColumn("non_zero_pct", r6(F.col("non_zero") * 100.0 / F.col("total")))


def group_distinct_values(cells: DataFrame) -> DataFrame:
    """The distinct values of each group over its 30 columns."""
    return cells.where(F.col("v").isNotNull()).select("grp", "v").distinct()


def high_freq_values(cells: DataFrame | None = None, counts: DataFrame | None = None,
                     dist: DataFrame | None = None) -> DataFrame:
    """Values whose probability is above the column's 75th (group 0) or
    70th (group 2) percentile of probabilities."""
    dist = dist if dist is not None else value_dist(cells, True, counts)
    keys = ["app", "grp", "slot"]
    d = dist.where(F.col("grp").isin(list(K.HIGH_FREQ_PCT)))
    pf = d.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("k"))
    cut_by_grp = {}
    for g, q in K.HIGH_FREQ_PCT.items():
        cut_by_grp[g] = percentiles_from_counts(pf.where(F.col("grp") == g), keys, "p", "k", {"cut": q})
    cuts = cut_by_grp[0].unionByName(cut_by_grp[2])
    return join_null_safe(d, cuts, keys).where(F.col("p") > F.col("cut")).select(*keys, "v", "p")

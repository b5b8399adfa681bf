"""Exact statistics computed from value -> count tables.

Every profile first collapses rows to ``(keys..., v, cnt)`` with a map-side
combined ``groupBy``; the statistics below then run over *distinct values*,
not rows, so a label holding a third of all rows costs no more than its
number of distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import global_rank, join_null_safe

RANGES = 1024                # value ranges of a running sum
BUCKETS = 256                # value ranges of a global running count; their offsets are literals
COARSE = 32                  # a value is first placed among the ends of 32 neighbouring ranges, then within them


def value_range(df: DataFrame, v_col: str, ranges: int = RANGES) -> Column:
    """Number of the value range of ``v_col``, never falling as the value grows: ranges are cut at approximate quantiles of
    the rows of ``df``, so each holds about its share of the rows wherever the values lie.  What reaches the driver is the
    ``ranges`` - 1 cuts; as literals they are the same in every branch of a plan and every retry."""
    probs = [i / ranges for i in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(v_col, probs, 20 * ranges)).first()[0] or []
    cuts = sorted({float(c) for c in cuts if c == c})            # NaN comes after every number
    if not cuts:
        return F.lit(0)

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: c < F.col(v_col)))

    parts = [cuts[i:i + COARSE] for i in range(0, len(cuts), COARSE)]
    if len(parts) == 1:
        return below(F.array(*map(F.lit, cuts)))
    fine = F.array(*[F.array(*map(F.lit, p)) for p in parts], F.array().cast("array<double>"))
    part = below(F.array(*[F.lit(p[-1]) for p in parts]))         # parts that lie below the value as a whole
    return part * COARSE + below(F.element_at(fine, part + 1))


def running_sums(freq: DataFrame, group_cols: list[str], v_col: str, w_col: str, cuts_from: DataFrame | None = None) -> DataFrame:
    """``freq`` (one row per group and distinct non-NULL value) with ``_cum``, the sum of ``w_col`` over the group's
    values up to this one, and ``_n``, the sum over the group.

    No window holds the values of a whole group: sums run within a value range (see ``value_range``; ``cuts_from`` is a
    table with the same values that is cheaper to read than ``freq``), and the range sums give each range its offset."""
    f = freq.withColumn("_range", value_range(freq if cuts_from is None else cuts_from, v_col))
    key = [*group_cols, "_range"]
    before = Window.partitionBy(*group_cols).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    sums = f.groupBy(*key).agg(F.sum(w_col).alias("_s"))
    offsets = sums.select(*key, (F.sum("_s").over(before) - F.col("_s")).alias("_off"),
                          F.sum("_s").over(Window.partitionBy(*group_cols)).alias("_n"))
    within = Window.partitionBy(*key).orderBy(v_col).rowsBetween(Window.unboundedPreceding, 0)
    out = join_null_safe(f.withColumn("_in", F.sum(w_col).over(within)), offsets, key)
    return out.withColumn("_cum", F.col("_off") + F.col("_in")).drop("_off", "_in", "_range")


def percentiles_from_counts(freq: DataFrame, group_cols: list[str], v_col: str, cnt_col: str,
                            probs: dict[str, float], cuts_from: DataFrame | None = None) -> DataFrame:
    """Linear-interpolation percentiles (numpy's default, DuckDB's
    ``quantile_cont``) per group from a frequency table.

    For p: pos = p (n - 1), lo = floor(pos); result = a[lo] + (pos - lo)(a[lo+1] - a[lo])
    where a is the sorted multiset.  a[r] is the smallest v whose running count
    exceeds r.  Returns one row per group with one column per entry of ``probs``.
    """
    f = running_sums(freq.where(F.col(v_col).isNotNull()), group_cols, v_col, cnt_col, cuts_from)
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1).cast("double")
        lo = F.floor(pos)
        f = f.withColumn(f"_pos_{name}", pos).withColumn(f"_lo_{name}", lo)
        aggs += [
            F.min(F.when(F.col("_cum") > F.col(f"_lo_{name}"), F.col(v_col))).alias(f"_a_{name}"),
            F.min(F.when(F.col("_cum") > F.col(f"_lo_{name}") + 1, F.col(v_col))).alias(f"_b_{name}"),
            F.first(F.col(f"_pos_{name}") - F.col(f"_lo_{name}")).alias(f"_t_{name}"),
        ]
    out = f.groupBy(*group_cols).agg(*aggs)
    cols = [F.col(c) for c in group_cols]
    for name in probs:
        a, b, t = F.col(f"_a_{name}"), F.coalesce(F.col(f"_b_{name}"), F.col(f"_a_{name}")), F.col(f"_t_{name}")
        cols.append((a + t * (b - a)).alias(name))
    return out.select(*cols)


def weighted_moments(freq: DataFrame, group_cols: list[str], v_col: str, cnt_col: str) -> DataFrame:
    """rows, n (rows with a value), mean, sample std, min, max, zero and negative counts per group from a
    frequency table (two-pass: the mean first, then squared deviations; both are aggregates that combine before
    the shuffle).  A group without any value has its rows and NULL moments."""
    v, some = F.col(v_col), F.when(F.col(v_col).isNotNull(), F.col(cnt_col))
    means = freq.groupBy(*group_cols).agg((F.sum(some * v) / F.sum(some)).alias("_mean"))
    f = join_null_safe(freq, means, group_cols)
    dev = some * (v - F.col("_mean")) * (v - F.col("_mean"))
    total = F.sum(some)
    return f.groupBy(*group_cols).agg(
        F.sum(cnt_col).alias("rows"),
        total.alias("n"),
        F.first("_mean").alias("mean"),
        F.when(total > 1, F.sqrt(F.sum(dev) / (total - 1))).alias("std"),
        F.min(v_col).alias("min"),
        F.max(v_col).alias("max"),
        F.sum(F.when(v == 0, F.col(cnt_col)).otherwise(0)).alias("zeros"),
        F.sum(F.when(v < 0, F.col(cnt_col)).otherwise(0)).alias("negatives"),
    )


def r6(c) -> Column:
    """Round to 6 places for reporting (both engines agree after rounding)."""
    return F.round(c if isinstance(c, Column) else F.col(c), 6)


def ranked_counts(df: DataFrame, v_col: str, buckets: int = BUCKETS):
    """Distinct values of ``v_col`` with their count and global running count.

    The running count needs a global order; instead of one window over all
    values, values are cut into ranges at approximate quantiles (see
    ``value_range``), each range gets its offset from a table of
    ``buckets`` rows, and the running count runs per range.  Returns
    (freq DataFrame with v, cnt, cum; total count n).
    """
    freq = df.where(F.col(v_col).isNotNull()).groupBy(v_col).agg(F.count(F.lit(1)).alias("cnt"))
    f = freq.withColumn("_b", value_range(freq, v_col, buckets))
    bt = f.groupBy("_b").agg(F.sum("cnt").alias("_bc"))
    bt = bt.withColumn("_off", F.sum("_bc").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
                       - F.col("_bc"))
    rows = bt.collect()  # at most ``buckets`` rows
    n = int(sum(r["_bc"] for r in rows))
    offsets = F.create_map(*[x for r in rows for x in (F.lit(int(r["_b"])), F.lit(int(r["_off"])))]) \
        if rows else F.create_map()
    run = Window.partitionBy("_b").orderBy(v_col).rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("cum", F.element_at(offsets, F.col("_b")) + F.sum("cnt").over(run)).drop("_b")
    return f, n


def global_percentiles(df: DataFrame, v_col: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation percentiles of one column over the whole
    frame without a single-partition sort (see ``ranked_counts``)."""
    f, n = ranked_counts(df, v_col)
    aggs = []
    for name, p in probs.items():
        pos = float(p) * (n - 1)
        lo = int(pos // 1)
        t = pos - lo
        a = F.min(F.when(F.col("cum") > lo, F.col(v_col)))
        b = F.coalesce(F.min(F.when(F.col("cum") > lo + 1, F.col(v_col))), a)
        aggs.append((a + F.lit(t) * (b - a)).alias(name))
    return f.agg(F.lit(n).cast("bigint").alias("n"), *aggs)


FEW = 10_000


def top_k(df: DataFrame, score_col: str, id_col: str, k: int) -> DataFrame:
    """The k rows with the largest score (ties by smaller id), exactly, without
    ordering all rows in one task: find the k-th largest score t from ranked
    distinct values, keep score > t, then rank only the rows tied at t by id
    in two phases (id ranges, then within range)."""
    if k <= 0:
        return df.limit(0)
    if k <= FEW:               # every task keeps its k best
        return df.where(F.col(score_col).isNotNull()).orderBy(F.desc(score_col), F.asc(id_col)).limit(k)
    f, n = ranked_counts(df, score_col)
    if k >= n:
        return df.where(F.col(score_col).isNotNull())
    r = n - k  # ascending 0-based rank of the k-th largest
    row = f.agg(F.min(F.when(F.col("cum") > r, F.col(score_col))).alias("t")).first()
    t = row["t"]
    above = df.where(F.col(score_col) > F.lit(t))
    m = f.where(F.col(score_col) > F.lit(t)).agg(F.sum("cnt")).first()[0] or 0
    need = k - int(m)
    tied = df.where(F.col(score_col) == F.lit(t))
    ranked = global_rank(tied, (F.col(id_col) / 65536).cast("bigint"), [id_col])
    return above.unionByName(ranked.where(F.col("rank") <= need).drop("rank"))


def exact_avg(c, window=None) -> Column:
    """Mean with the sum accumulated as decimal(38, 10): the result does not
    depend on the order in which partial sums are combined (so it is the same
    on any partitioning and in any engine).  Exact for values with at most 10
    decimal places."""
    col = c if isinstance(c, Column) else F.col(c)
    s = F.sum(col.cast("decimal(38,10)"))
    n = F.count(col)
    if window is not None:
        s, n = s.over(window), n.over(window)
    return s.cast("double") / n

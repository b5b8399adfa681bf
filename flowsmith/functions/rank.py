"""Ranking without a single-partition window.

``row_number() OVER (PARTITION BY key ORDER BY ...)`` sorts a whole key in one
task; a key holding a third of the rows makes that task the job.  The helpers
here rank in two phases where needed: rows of a hot key are split into
buckets that are contiguous in the sort order (a day, a hash range, a quantile
range of the score), a small table of bucket counts gives each bucket its
running offset, and the final ``row_number`` runs per bucket.  Results equal
the one-window form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000        # a key above this many rows is ranked in buckets
HOT_BROADCAST_ROWS = 100_000
NULL_BUCKET = -(1 << 62)    # NULL order values come first


def join_null_safe(rows: DataFrame, others: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Joins on ``key``, where a NULL equals a NULL (a flow without a label has a key too).  With ``how`` full_outer the key
    comes from whichever side has the row; otherwise the columns of ``others`` beside the key are added."""
    named = others.select(*[F.col(c).alias(f"_k_{c}") if c in key else F.col(c) for c in others.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key]
    if how == "full_outer":
        both = rows.withColumn("_left", F.lit(True)).join(named, same, how)
        merged = [F.when(F.col("_left"), F.col(c)).otherwise(F.col(f"_k_{c}")).alias(c) if c in key else F.col(c) for c in rows.columns]
        return both.select(*merged, *[c for c in others.columns if c not in key])
    return rows.join(named, same, how).drop(*[f"_k_{c}" for c in key])


def _hot_keys(df: DataFrame, part_cols: list[str], hot_rows: int):
    """Keys with more than ``hot_rows`` rows: at most rows / hot_rows of them."""
    counts = df.groupBy(*part_cols).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where(F.col("_n") > hot_rows).select(*part_cols, F.lit(True).alias("_hot"))
    n_hot = hot.count()
    return hot, n_hot


def ranked_within(df: DataFrame, part_cols: list[str], order_cols: list, fine_bucket: Column,
                  carry_col: str | None = None, rank_col: str = "rn",
                  hot_rows: int | None = None) -> DataFrame:
    """0-based rank of each row inside ``part_cols`` ordered by ``order_cols``.

    Adds ``rank_col``, ``part_total`` (rows of the part) and, when
    ``carry_col`` is given, ``prev_<carry_col>`` (that column on the previous
    row of the part, NULL on the first).  ``fine_bucket`` must be monotone in
    the order, and ``carry_col`` non-decreasing in it (a date, a minute).

    Keys with at most ``hot_rows`` rows are ranked by one window each; hot
    keys are ranked per ``fine_bucket`` plus a running offset of bucket counts.
    """
    hot, n_hot = _hot_keys(df, part_cols, hot_rows if hot_rows is not None else HOT_ROWS)
    if n_hot == 0:
        w = Window.partitionBy(*part_cols).orderBy(*order_cols)
        out = (df.withColumn(rank_col, (F.row_number().over(w) - 1).cast("bigint"))
                 .withColumn("part_total", F.count(F.lit(1)).over(Window.partitionBy(*part_cols))))
        if carry_col:
            out = out.withColumn(f"prev_{carry_col}", F.lag(carry_col).over(w))
        return out

    hot = F.broadcast(hot) if n_hot <= HOT_BROADCAST_ROWS else hot
    hot = hot.select(*[F.col(c).alias(f"_h_{c}") for c in part_cols], "_hot")
    same = [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in part_cols]
    # NULL order values sort first, so their bucket is the lowest
    fine = F.coalesce(fine_bucket.cast("bigint"), F.lit(NULL_BUCKET))
    b = df.join(hot, same, "left").withColumn(
        "_bk", F.when(F.col("_hot"), fine).otherwise(F.lit(0).cast("bigint"))).drop("_hot", *[f"_h_{c}" for c in part_cols])
    key = part_cols + ["_bk"]
    w_in = Window.partitionBy(*key).orderBy(*order_cols)
    ranked = b.withColumn("_rb", F.row_number().over(w_in) - 1)
    if carry_col:
        ranked = ranked.withColumn("_prev_in", F.lag(carry_col).over(w_in))
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    if carry_col:
        aggs.append(F.max(carry_col).alias("_last"))
    buckets = b.groupBy(*key).agg(*aggs)
    w_b = Window.partitionBy(*part_cols).orderBy("_bk")
    buckets = (buckets
               .withColumn("_off", F.sum("_cnt").over(w_b.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cnt"))
               .withColumn("part_total", F.sum("_cnt").over(Window.partitionBy(*part_cols))))
    sel = key + ["_off", "part_total"]
    if carry_col:
        buckets = buckets.withColumn("_prev_last", F.lag("_last").over(w_b))
        sel.append("_prev_last")
    out = join_null_safe(ranked, buckets.select(*sel), key)
    out = out.withColumn(rank_col, (F.col("_off") + F.col("_rb")).cast("bigint"))
    if carry_col:
        out = out.withColumn(f"prev_{carry_col}",
                             F.when(F.col("_rb") == 0, F.col("_prev_last")).otherwise(F.col("_prev_in")))
        out = out.drop("_prev_in", "_prev_last")
    return out.drop("_rb", "_off", "_bk")


def global_rank(df: DataFrame, bucket: Column, order_cols: list, part_cols: list[str] | None = None,
                rank_col: str = "rank") -> DataFrame:
    """1-based rank over the whole frame (or per ``part_cols``) ordered by
    (``bucket``, ``order_cols``) where ``bucket`` is an integer column monotone
    in the order (e.g. floor(u * B) for a hash-uniform u, or id // chunk).
    Every bucket is ranked by its own window; offsets come from a table of
    bucket counts (one row per bucket and part)."""
    part_cols = part_cols or []
    tmp = df.withColumn("_gb", F.coalesce(bucket.cast("bigint"), F.lit(NULL_BUCKET)))
    key = part_cols + ["_gb"]
    ranked = tmp.withColumn("_rb", F.row_number().over(Window.partitionBy(*key).orderBy(*order_cols)))
    counts = tmp.groupBy(*key).agg(F.count(F.lit(1)).alias("_cnt"))
    w_b = (Window.partitionBy(*part_cols) if part_cols else Window.partitionBy()).orderBy("_gb") \
        .rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_off", F.sum("_cnt").over(w_b) - F.col("_cnt")).drop("_cnt")
    out = join_null_safe(ranked, counts, key)
    return out.withColumn(rank_col, (F.col("_off") + F.col("_rb")).cast("bigint")).drop("_rb", "_off", "_gb")


def running_mean(df: DataFrame, part_cols: list[str], order_col: str, value_col: str,
                 bucket_size: int = 100_000) -> DataFrame:
    """Running mean of ``value_col`` inside ``part_cols`` ordered by the
    integer ``order_col``, computed in two phases so that a part with billions
    of rows is never one window: rows are cut into ranges of ``bucket_size``
    consecutive order values, range sums (exact decimals) and counts give each
    range its offset, and the running sum runs per range.  Returns ``df`` with
    the column ``running_mean`` added."""
    dec = F.col(value_col).cast("decimal(38,10)")
    b = df.withColumn("_rb", F.coalesce((F.col(order_col) / bucket_size).cast("bigint"), F.lit(NULL_BUCKET))).withColumn("_x", dec)
    key = part_cols + ["_rb"]
    sums = b.groupBy(*key).agg(F.sum("_x").alias("_s"), F.count("_x").alias("_c"))
    w_b = Window.partitionBy(*part_cols).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    sums = (sums.withColumn("_s0", F.coalesce(F.sum("_s").over(w_b), F.lit(0).cast("decimal(38,10)")))
                .withColumn("_c0", F.coalesce(F.sum("_c").over(w_b), F.lit(0))).drop("_s", "_c"))
    w_in = Window.partitionBy(*key).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    out = (b.withColumn("_sr", F.sum("_x").over(w_in)).withColumn("_cr", F.count("_x").over(w_in))
            )
    out = join_null_safe(out, sums, key)
    mean = (F.col("_s0") + F.col("_sr")).cast("double") / (F.col("_c0") + F.col("_cr"))
    return out.withColumn("running_mean", mean).drop("_rb", "_x", "_s0", "_c0", "_sr", "_cr")

"""Analytics over metric series of many runs.

Input: ``run_metrics(run_id, epoch, train_loss, val_loss, secs)`` with one row
per (run, epoch) - val_loss NULL on epochs without validation - and
``batch_losses(run_id, epoch, batch, loss)``.  Every operator is a window or a
group-by keyed by run, so all runs are analysed in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalar import hms
from ..functions.rank import running_mean
from ..functions.stats import exact_avg, r6


def long_series(metrics: DataFrame) -> DataFrame:
    """(run_id, series, epoch, loss): the train series and the validation
    series (evaluated epochs only)."""
    tr = metrics.select("run_id", F.lit("train").alias("series"), "epoch", F.col("train_loss").alias("loss"))
    va = metrics.where(F.col("val_loss").isNotNull()).select(
        "run_id", F.lit("val").alias("series"), "epoch", F.col("val_loss").alias("loss"))
    return tr.unionByName(va)


def moving_average(metrics: DataFrame) -> DataFrame:
    """Smoothed series, 'valid' part only.  Train window min(5, n div 3)
    when n > 5, validation window min(3, n div 2) when n > 3, otherwise the
    raw values.  The window width depends on the run, so the averages for
    every width up to 5 are computed and the run's width is picked."""
    s = long_series(metrics)
    key = ["run_id", "series"]
    order = Window.partitionBy(*key).orderBy("epoch")
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    width = (F.when((F.col("series") == "train") & (n > 5), F.least(F.lit(K.TRAIN_SMOOTH_MAX), (n / 3).cast("int")))
             .when((F.col("series") == "val") & (n > 3), F.least(F.lit(K.VAL_SMOOTH_MAX), (n / 2).cast("int")))
             .otherwise(F.lit(1)))
    s = s.withColumn("_w", width).withColumn("_i", F.row_number().over(order))
    for k in range(1, K.TRAIN_SMOOTH_MAX + 1):
        s = s.withColumn(f"_a{k}", exact_avg("loss", order.rowsBetween(-(k - 1), 0)))
    pick = F.col("_a1")
    for k in range(2, K.TRAIN_SMOOTH_MAX + 1):
        pick = F.when(F.col("_w") == k, F.col(f"_a{k}")).otherwise(pick)
    return (s.where(F.col("_i") >= F.col("_w"))
            .select("run_id", "series", "epoch", F.col("_w").cast("bigint").alias("window"),
                    r6(pick).alias("smoothed")))


def improvement(metrics: DataFrame) -> DataFrame:
    """R2: (first - x) / first x 100 per series."""
    s = long_series(metrics)
    w = Window.partitionBy("run_id", "series").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("loss").over(w)
    return s.select("run_id", "series", "epoch", r6((first - F.col("loss")) / first * 100.0).alias("improvement_pct"))


def best_epochs(metrics: DataFrame) -> DataFrame:
    """Running best of both series and whether the epoch set a new best
    validation value (strictly lower than every earlier one)."""
    w = Window.partitionBy("run_id").orderBy("epoch")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    prev_best = F.min("val_loss").over(before)
    return metrics.select(
        "run_id", "epoch", "train_loss", F.min("train_loss").over(upto).alias("best_train_so_far"),
        "val_loss", F.min("val_loss").over(upto).alias("best_val_so_far"),
        (F.col("val_loss").isNotNull() & (prev_best.isNull() | (F.col("val_loss") < prev_best))).alias("new_best"))


def early_stop(metrics: DataFrame, patience: int = K.EARLY_STOPPING_PATIENCE) -> DataFrame:
    """Per run, the first epoch whose no-improvement counter reaches
    ``patience`` (NULL: never; patience <= 0 disables), plus the best epoch.
    The counter counts evaluated epochs since the last improvement (gaps and
    islands over the evaluated epochs)."""
    ev = best_epochs(metrics).where(F.col("val_loss").isNotNull())
    w = Window.partitionBy("run_id").orderBy("epoch")
    ev = ev.withColumn("_k", F.row_number().over(w))
    last_impr = F.max(F.when(F.col("new_best"), F.col("_k"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ev = ev.withColumn("counter", F.col("_k") - last_impr)
    stop = (F.min(F.when(F.col("counter") >= patience, F.col("epoch"))) if patience > 0
            else F.lit(None).cast("int"))
    return ev.groupBy("run_id").agg(
        F.lit(patience).alias("patience"), stop.alias("stop_epoch"),
        F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"),
        F.min("val_loss").alias("best_val_loss"))


def trend(metrics: DataFrame) -> DataFrame:
    """Least-squares slope of the last 3 train values (equally spaced:
    (y3 - y1) / 2) and its reading."""
    w = Window.partitionBy("run_id").orderBy(F.desc("epoch"))
    last = metrics.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= K.TREND_POINTS)
    agg = last.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by("train_loss", "epoch").alias("_y3"), F.min_by("train_loss", "epoch").alias("_y1"))
    slope = (F.col("_y3") - F.col("_y1")) / 2.0
    reading = (F.when(F.abs(slope) < K.CONVERGED_SLOPE, "converged")
               .when(slope < 0, "improving").otherwise("difficulty"))
    return agg.where(F.col("_n") >= K.TREND_POINTS).select("run_id", r6(slope).alias("slope"), reading.alias("trend"))


def overfit(metrics: DataFrame) -> DataFrame:
    """Mean of the last 3 validation values vs the last 3 train values
    (needs more than 3 of each): > 1.2x overfit, < 1.1x good, else neutral."""
    s = long_series(metrics)
    w = Window.partitionBy("run_id", "series").orderBy(F.desc("epoch"))
    s = s.withColumn("_r", F.row_number().over(w)).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy("run_id", "series")))
    agg = s.groupBy("run_id").agg(
        exact_avg(F.when((F.col("series") == "train") & (F.col("_r") <= 3), F.col("loss"))).alias("recent_train"),
        exact_avg(F.when((F.col("series") == "val") & (F.col("_r") <= 3), F.col("loss"))).alias("recent_val"),
        F.max(F.when(F.col("series") == "train", F.col("_n"))).alias("n_train"),
        F.max(F.when(F.col("series") == "val", F.col("_n"))).alias("n_val"))
    enough = (F.col("n_train") > 3) & (F.col("n_val") > 3)
    flag = (F.when(~enough, "insufficient")
            .when(F.col("recent_val") > F.col("recent_train") * K.OVERFIT_RATIO, "overfit")
            .when(F.col("recent_val") < F.col("recent_train") * K.GOOD_RATIO, "good").otherwise("neutral"))
    return agg.select("run_id", r6("recent_train").alias("recent_train"), r6("recent_val").alias("recent_val"),
                      flag.alias("flag"))


def histogram(metrics: DataFrame) -> DataFrame:
    """Density histogram per run and series: 20 (train) / 15 (val) equal
    bins between min and max, last bin closed; a constant series uses
    [v - 0.5, v + 0.5].  Empty bins are listed with count 0."""
    s = long_series(metrics)
    key = ["run_id", "series"]
    bins = F.when(F.col("series") == "train", K.TRAIN_HIST_BINS).otherwise(K.VAL_HIST_BINS)
    st = s.groupBy(*key).agg(F.min("loss").alias("_mn"), F.max("loss").alias("_mx"),
                             F.count(F.lit(1)).alias("_n"))
    st = (st.withColumn("_bins", bins)
            .withColumn("_lo", F.when(F.col("_mx") > F.col("_mn"), F.col("_mn")).otherwise(F.col("_mn") - 0.5))
            .withColumn("_hi", F.when(F.col("_mx") > F.col("_mn"), F.col("_mx")).otherwise(F.col("_mx") + 0.5))
            .withColumn("_wd", (F.col("_hi") - F.col("_lo")) / F.col("_bins")))
    j = s.join(st, key)  # one stats row per (run, series)
    b = F.least(F.floor((F.col("loss") - F.col("_lo")) / F.col("_wd")).cast("int"), F.col("_bins") - 1)
    counts = j.groupBy(*key, b.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    grid = st.select(*key, "_n", "_lo", "_wd", F.explode(F.sequence(F.lit(0), F.col("_bins") - 1)).alias("bin"))
    out = grid.join(counts, key + ["bin"], "left")
    cnt = F.coalesce(F.col("cnt"), F.lit(0)).cast("bigint")
    return out.select(*key, F.col("bin").cast("bigint").alias("bin"),
                      r6(F.col("_lo") + F.col("bin") * F.col("_wd")).alias("bin_lo"),
                      r6(F.col("_lo") + (F.col("bin") + 1) * F.col("_wd")).alias("bin_hi"), cnt.alias("cnt"),
                      r6(cnt / (F.col("_n") * F.col("_wd"))).alias("density"))


def epoch_loss(batches: DataFrame) -> DataFrame:
    """Mean batch loss per (run, epoch)."""
    return batches.groupBy("run_id", "epoch").agg(F.count(F.lit(1)).alias("n_batches"),
                                                  r6(exact_avg("loss")).alias("epoch_loss"))


def running_loss(batches: DataFrame, bucket_size: int = 100_000) -> DataFrame:
    """Running mean of the batch loss inside each epoch.  Sums are exact
    decimals, so the result does not depend on how partial sums combine; an
    epoch with many batches is processed in ranges of ``bucket_size``."""
    out = running_mean(batches, ["run_id", "epoch"], "batch", "loss", bucket_size)
    return out.select("run_id", "epoch", "batch", r6("running_mean").alias("running_loss"))


def run_summary(metrics: DataFrame) -> DataFrame:
    """S8 + R8: per run: epochs, final / best train, last evaluated and best
    validation value, best validation epoch, total seconds as 'Hh Mm Ss' and
    improvement of the train series from the first epoch."""
    val = F.when(F.col("val_loss").isNotNull(), F.struct("epoch", "val_loss"))
    agg = metrics.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("epochs"),
        F.max_by("train_loss", "epoch").alias("final_train_loss"),
        F.min("train_loss").alias("best_train_loss"),
        F.min_by("train_loss", "epoch").alias("_first"),
        F.max(val).alias("_lastval"),
        F.min("val_loss").alias("best_val_loss"),
        F.min_by("epoch", F.when(F.col("val_loss").isNotNull(), F.struct("val_loss", "epoch"))).alias("best_val_epoch"),
        F.sum("secs").alias("total_secs"))
    return agg.select(
        "run_id", F.col("epochs").cast("bigint"), "final_train_loss", "best_train_loss",
        F.col("_lastval.val_loss").alias("final_val_loss"), "best_val_loss", "best_val_epoch", "total_secs",
        hms(F.col("total_secs")).alias("elapsed"),
        F.when(F.col("epochs") > 1, r6((F.col("_first") - F.col("final_train_loss")) / F.col("_first") * 100.0))
         .alias("improvement_pct"))

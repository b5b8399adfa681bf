"""Alias tables: a weighted draw by two uniform numbers and one equal join.

A column of n values with whole weights (W in all) becomes n cells of equal size: cell i keeps its own value with probability
``keep`` and gives ``other`` otherwise.  Scaled by n, values below W are light and the rest heavy; in order of the values each heavy one fills
up the light ones and hands over to the next heavy one when its own excess is used up.  Who fills whom follows from the running sums of
the light values' gaps and the heavy values' excesses, so the table is built with ordered sums instead of a loop, exactly
(whole numbers as decimals).

Scale: as many rows as distinct values, no bucket count, no range predicate; sums run within value ranges with offsets from a table
of ranges (see ``stats.running_sums``), and the hand-over is found the same way, so no window holds a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.rand import uniform
from ..functions.rank import join_null_safe
from ..functions.stats import running_sums, value_range
from ..session import materialize

KEYS = ["app", "grp", "slot"]
WHOLE = "decimal(38,0)"


def alias_table(weights: DataFrame) -> DataFrame:
    """(app, grp, slot, cells, idx, v, keep, other) from (app, grp, slot, v, weight): ``cells`` rows per column, idx from 0."""
    some = weights.where(F.col("weight") > 0).select(*KEYS, "v", F.col("weight").cast(WHOLE).alias("w"))
    total = some.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("cells"), F.sum("w").cast(WHOLE).alias("total"))
    items = join_null_safe(some, total, KEYS).select(*KEYS, "v", "cells", "total", (F.col("w") * F.col("cells")).cast(WHOLE).alias("s"))
    items = materialize(running_sums(items.withColumn("one", F.lit(1)), KEYS, "v", "one", cuts_from=some)
                        .withColumn("idx", (F.col("_cum") - 1).cast("bigint")).drop("one", "_cum", "_n"))
    light = items.where("s < total").withColumn("gap", (F.col("total") - F.col("s")).cast(WHOLE))
    heavy = items.where("s >= total").withColumn("gap", (F.col("s") - F.col("total")).cast(WHOLE))
    # place: the gaps filled before a light value, the excess used when a heavy one is through; light values come after heavy ones of equal place
    light = running_sums(light, KEYS, "v", "gap", cuts_from=some).withColumn("place", F.col("_cum") - F.col("gap")).withColumn("is_light", F.lit(1))
    heavy = running_sums(heavy, KEYS, "v", "gap", cuts_from=some).withColumn("place", F.col("_cum")).withColumn("is_light", F.lit(0))
    both = materialize(light.unionByName(heavy).withColumn("place", F.col("place").cast(WHOLE)).drop("_n"))
    both = both.withColumn("_p", F.col("place").cast("double"))
    both = both.withColumn("_range", value_range(both, "_p"))
    part = [*KEYS, "_range"]
    order = ["place", "is_light", "v"]
    ahead = Window.partitionBy(*part).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    heavy_v = F.when(F.col("is_light") == 0, F.col("v"))
    filled = F.when(F.col("is_light") == 1, F.col("_cum"))
    inner = both.withColumn("_next", F.last(heavy_v, ignorenulls=True).over(ahead)).withColumn("_filled", F.max(filled).over(behind))
    # over the table of ranges: the first heavy value of a later range, the gaps filled in earlier ones
    ranges = both.groupBy(*part).agg(F.min(F.when(F.col("is_light") == 0, F.struct("place", "v"))).alias("_h"), F.max(filled).alias("_f"))
    later = Window.partitionBy(*KEYS).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*KEYS).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_later", F.last(F.col("_h.v"), ignorenulls=True).over(later)).withColumn("_earlier", F.max("_f").over(earlier))
    got = join_null_safe(inner, ranges.drop("_h", "_f"), part)
    done = F.coalesce("_filled", "_earlier", F.lit(0).cast(WHOLE))
    kept = F.when(F.col("is_light") == 1, F.col("s")).otherwise(F.col("total") + F.col("place") - done)
    return got.select(*KEYS, "cells", "idx", "v", (kept.cast("double") / F.col("total").cast("double")).alias("keep"),
                      F.coalesce("_next", "_later", "v").alias("other"))


def cell_counts(table: DataFrame) -> DataFrame:
    """(app, grp, slot, buckets): cells of each column, in the form that ``synth.skeleton_cells`` takes."""
    return table.groupBy(*KEYS).agg(F.max("cells").alias("buckets"))


def alias_draw(cells: DataFrame, table: DataFrame, seed: int = K.DEFAULT_SEED, broadcast_table: bool = False) -> DataFrame:
    """(sample_id, app, grp, slot, v): the first number picks the cell, the second one of its two values; a column without
    values gives 0.0.  ``cells`` come from ``synth.skeleton_cells``."""
    at = (F.col("sample_id"), F.col("grp"), F.col("slot"))
    c = cells.withColumn("idx", F.floor(uniform(seed, *at, "cell") * F.col("buckets")).cast("bigint")).withColumn("u", uniform(seed, *at, "side"))
    t = table.select(*[F.col(x).alias(f"t_{x}") for x in (*KEYS, "idx", "v", "keep", "other")])
    t = F.broadcast(t) if broadcast_table else t
    same = [F.col("app").eqNullSafe(F.col("t_app")), *[F.col(x) == F.col(f"t_{x}") for x in ("grp", "slot", "idx")]]
    v = F.when(F.col("u") < F.col("t_keep"), F.col("t_v")).otherwise(F.col("t_other"))
    return c.join(t, same, "left").select("sample_id", "app", "grp", "slot", F.coalesce(v, F.lit(0.0)).alias("v"))

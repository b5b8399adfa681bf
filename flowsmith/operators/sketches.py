"""Approximate profiles from mergeable sketches, the opt-in form of the exact profiles.

Per stored part (a label and a day, say) a KLL sketch of the values and a HyperLogLog sketch of the distinct ones, a few KB each
whatever the rows.  Parts are written once; any span of parts is merged at query time without reading rows again.
Quantiles have a rank error of about 1.8 / ``KLL_K`` at 99 %, distinct counts a relative error of about 1.04 / sqrt(2^``HLL_BITS``).
NULL labels are a label of their own; NULL values are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import broadcast_if_small
from ..functions.rank import join_null_safe

KLL_K = 800
HLL_BITS = 12
QUANTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}


def value_sketches(values: DataFrame, keys: list[str], v_col: str = "v") -> DataFrame:
    """(keys, n, min, max, quantiles, distincts): one row per part, combined in the map."""
    some = values.where(F.col(v_col).isNotNull())
    return some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(v_col).alias("min"), F.max(v_col).alias("max"),
                                   F.kll_sketch_agg_double(v_col, KLL_K).alias("quantiles"),
                                   F.hll_sketch_agg(F.col(v_col).cast("string"), HLL_BITS).alias("distincts"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of each ``keys`` as one."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"),
                                       F.kll_merge_agg_double("quantiles", KLL_K).alias("quantiles"),
                                       F.hll_union_agg("distincts").alias("distincts"))


def approx_profile(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, min, max, distinct_values, p25 ... p95) from merged sketches: n, min and max are exact."""
    quantiles = [F.kll_sketch_get_quantile_double("quantiles", F.lit(p)).alias(name) for name, p in QUANTILES.items()]
    return merged(sketches, keys).select(*keys, "n", "min", "max", F.hll_sketch_estimate("distincts").alias("distinct_values"), *quantiles)


def profile_errors(profile: DataFrame, values: DataFrame, keys: list[str], v_col: str = "v") -> DataFrame:
    """(keys, distinct_error, p25_error ... p95_error): how far each estimate is off, against the rows: the relative error
    of the distinct count, and by how much of the rows an estimated quantile misses its rank."""
    counts = values.where(F.col(v_col).isNotNull()).groupBy(*keys, v_col).agg(F.count(F.lit(1)).alias("_c"))
    j = join_null_safe(counts, broadcast_if_small(profile), keys)
    below = [F.sum(F.when(F.col(v_col) < F.col(q), F.col("_c")).otherwise(0)).alias(f"_below_{q}") for q in QUANTILES]
    up_to = [F.sum(F.when(F.col(v_col) <= F.col(q), F.col("_c")).otherwise(0)).alias(f"_upto_{q}") for q in QUANTILES]
    got = j.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_distinct"), F.first("distinct_values").alias("_estimate"), *below, *up_to)
    rank = [F.greatest(F.lit(0.0), F.col(f"_below_{q}") / F.col("_n") - p, p - F.col(f"_upto_{q}") / F.col("_n")).alias(f"{q}_error")
            for q, p in QUANTILES.items()]
    return got.select(*keys, F.abs(F.col("_estimate") / F.col("_distinct") - 1).alias("distinct_error"), *rank)

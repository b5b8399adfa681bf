"""Quality counters (V1-V4) over generated flows that arrive as files.

The same conditional aggregates as ``operators.quality``, maintained by a
Structured Streaming aggregation: every new file of generated cells updates
the running counts and scores.  (Distinct-flow counting is left out: it is
not supported in a streaming aggregation; cells / 90 gives the flow count.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = T.StructType([
    T.StructField("sample_id", T.LongType()), T.StructField("app", T.StringType()),
    T.StructField("grp", T.IntegerType()), T.StructField("slot", T.IntegerType()),
    T.StructField("v", T.DoubleType()),
])


def quality_counters(cells: DataFrame) -> DataFrame:
    """Streaming-safe form of the V1-V4 aggregates and scores."""
    g, v = F.col("grp"), F.col("v")
    n = lambda c: F.count(F.when(c, 1))
    agg = cells.agg(
        F.count(F.lit(1)).alias("cells"),
        n((g == 0) & (v < 0)).alias("t_neg"), n((g == 0) & (v > 10000.0)).alias("t_out"),
        n(g == 1).alias("d_total"),
        n((g == 1) & ((v == -1.0) | (v == 1.0) | (v == 0.0))).alias("d_exact"),
        n((g == 2) & (v < 0)).alias("s_neg"), n((g == 2) & (v > 0) & (v < 20)).alias("s_tiny"),
        n((g == 2) & (v > 9000)).alias("s_huge"))
    ts = F.greatest(F.lit(0.0), 100.0 - 10.0 * F.col("t_neg") - 5.0 * F.col("t_out"))
    ds = F.col("d_exact") * 100.0 / F.col("d_total")
    ss = F.greatest(F.lit(0.0), 100.0 - 10.0 * F.col("s_neg") - 2.0 * F.col("s_tiny") - 5.0 * F.col("s_huge"))
    return agg.select((F.col("cells") / 90).cast("bigint").alias("samples"), ts.alias("timing_score"),
                      ds.alias("direction_score"), ss.alias("size_score"),
                      ((ts + ds + ss) / 3.0).alias("overall_score"))


def stream_quality(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Streaming DataFrame of the running scores over the files under ``path``."""
    src = spark.readStream.schema(CELLS).format(fmt).load(path)
    return quality_counters(src)

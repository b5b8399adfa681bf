"""Exact statistics helpers against numpy."""

import numpy as np
from pyspark.sql import functions as F

from flowsmith.functions.stats import global_percentiles, percentiles_from_counts, running_sums, top_k, value_range, weighted_moments


def test_percentiles_from_counts_match_numpy(spark):
    vals = [0.0, 1.0, 1.0, 13.0, 2.0, 5.5, 5.5, 5.5, 100.0, 7.0]
    df = spark.createDataFrame([("a", v) for v in vals], "g string, v double")
    freq = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    probs = {"p25": .25, "p50": .5, "p90": .9, "p98": .98}
    row = percentiles_from_counts(freq, ["g"], "v", "c", probs).first()
    for name, p in probs.items():
        assert abs(row[name] - np.percentile(vals, p * 100)) < 1e-9


def test_survey_probe_values(spark):
    vals = [0.0, 1.0, 1.0, 13.0, 2.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    row = global_percentiles(df, "v", {"a": .25, "b": .5, "c": .75, "d": .9, "e": .98}).first()
    assert [round(row[k], 6) for k in "abcde"] == [1.0, 1.0, 2.0, 8.6, 12.12]


def test_global_percentiles_large(spark):
    rng = np.random.default_rng(1)
    vals = np.round(rng.gamma(2.0, 3.0, 20000), 3)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    row = global_percentiles(df, "v", {"m": .5, "q": .95}).first()
    assert abs(row["m"] - np.percentile(vals, 50)) < 1e-9
    assert abs(row["q"] - np.percentile(vals, 95)) < 1e-9


def test_top_k_with_ties(spark):
    data = [(i, float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(data, "id long, s double")
    got = sorted(r["id"] for r in top_k(df, "s", "id", 40).collect())
    want = sorted(sorted(data, key=lambda r: (-r[1], r[0]))[:40])
    assert got == sorted(i for i, _ in want)


def test_many_distinct_values_in_one_group(spark):
    """A million distinct values of both signs and all magnitudes; no value range holds a large part of them."""
    n = 1_000_000
    df = spark.range(n).select(F.lit(None).cast("string").alias("g"), (F.sin("id") * F.exp(F.col("id") % 20 - 6)).alias("v"), F.lit(1).alias("c"))
    vals = df.select("v").toPandas()["v"].to_numpy()
    probs = {"p25": .25, "p50": .5, "p90": .9, "p98": .98}
    freq = df.groupBy("g", "v").agg(F.sum("c").alias("c"))
    row = percentiles_from_counts(freq, ["g"], "v", "c", probs).first()
    for name, p in probs.items():
        assert abs(row[name] - np.percentile(vals, p * 100)) <= 1e-9 * abs(row[name])
    m = weighted_moments(freq, ["g"], "v", "c").first()
    assert m["n"] == n and abs(m["mean"] - vals.mean()) < 1e-6 and abs(m["std"] / vals.std(ddof=1) - 1) < 1e-9
    assert df.groupBy(value_range(df, "v").alias("r")).count().agg(F.max("count")).first()[0] < n / 500


def test_value_range_keeps_the_order(spark):
    vals = [float("-inf"), -1e308, -2.0, -1.0, -5e-324, 0.0, 5e-324, 1e-6, 1.0, 1.0000001, 2.0, 1e308, float("inf"), float("nan")]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vals)], "i int, v double, c int").withColumn("g", F.lit("a"))
    ranges = [r[0] for r in df.orderBy("i").select(value_range(df, "v")).collect()]
    assert ranges == sorted(ranges)
    got = running_sums(df, ["g"], "v", "c").orderBy("i").collect()
    assert [r["_cum"] for r in got] == list(range(1, len(vals) + 1)) and {r["_n"] for r in got} == {len(vals)}


def test_values_close_together_are_cut_into_ranges(spark):
    """A million distinct values within 0.1 % of each other, in two groups of which one is small."""
    n = 1_000_000
    df = spark.range(n).select(F.when(F.col("id") % 1000 == 0, "few").otherwise("most").alias("g"),
                               (F.lit(1.7e9) + F.col("id") * 1.5).alias("v"), (F.col("id") % 3 + 1).alias("c"))
    probs = {"p25": .25, "p50": .5, "p98": .98}
    ids = np.arange(n)
    for row in percentiles_from_counts(df, ["g"], "v", "c", probs).collect():
        mine = (ids % 1000 == 0) == (row["g"] == "few")
        vals = np.repeat(1.7e9 + ids[mine] * 1.5, ids[mine] % 3 + 1)
        for name, p in probs.items():
            assert abs(row[name] - np.percentile(vals, p * 100)) < 1e-6
    assert df.groupBy(value_range(df, "v").alias("r")).count().agg(F.max("count")).first()[0] < n / 100

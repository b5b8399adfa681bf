"""Boundary tables of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from flowsmith.functions.scalar import dequantize, quantize, snap_direction
from flowsmith.operators.synth import clean_direction, clean_size


def _one(spark, expr, v):
    return spark.createDataFrame([(v,)], "v double").select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("v,tok", [(-1.0, "<VAL_NEG>"), (0.0, "<VAL_ZERO>"), (0.5, "<VAL_1>"), (1.0, "<VAL_1>"),
                                   (64.0, "<VAL_64>"), (65535.0, "<VAL_62000>"), (65536.0, "<VAL_65536>"),
                                   (20.0, "<VAL_19>"), (19.0, "<VAL_18>")])
def test_quantize(spark, v, tok):
    assert _one(spark, quantize, v) == tok


def test_quantize_all_integers_match_python(spark):
    import math

    def ref(v):
        b = max(0, min(199, int(math.log2(max(1, v)) * 200 / math.log2(65536))))
        return f"<VAL_{int(math.pow(2, b * math.log2(65536) / 200))}>"
    df = spark.range(1, 65536).select(F.col("id").cast("double").alias("v"))
    got = [r["t"] for r in df.select(quantize(F.col("v")).alias("t")).collect()]
    assert got == [ref(v) for v in range(1, 65536)]


@pytest.mark.parametrize("tok,v", [("<VAL_ZERO>", 0.0), ("<VAL_NEG>", -1.0), ("<UNK_VAL>", 0.0),
                                   ("<VAL_62000>", 62000.0), ("<SEP>", 0.0)])
def test_dequantize(spark, tok, v):
    df = spark.createDataFrame([(tok,)], "t string")
    assert df.select(dequantize(F.col("t")).alias("r")).first()["r"] == v


@pytest.mark.parametrize("v,want", [(0.8, 1.0), (0.79, 0.0), (-0.8, -1.0), (-0.79, 0.0), (0.0, 0.0)])
def test_clean_direction(spark, v, want):
    assert _one(spark, clean_direction, v) == want


@pytest.mark.parametrize("v,want", [(2.5, 20.0), (20.5, 20.0), (21.5, 22.0), (-30.0, 30.0), (0.4, 0.0), (0.6, 20.0)])
def test_clean_size(spark, v, want):
    assert _one(spark, clean_size, v) == want


@pytest.mark.parametrize("v,want", [(0.5, 1.0), (-0.5, -1.0), (0.96, 1.0), (0.94, 1.0), (0.3, 0.0),
                                    (0.04, 0.0), (1.7, 1.0), (-0.97, -1.0)])
def test_snap_direction(spark, v, want):
    assert _one(spark, lambda c: snap_direction(c, F.lit(0.05)), v) == want

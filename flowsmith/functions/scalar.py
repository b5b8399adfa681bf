"""Scalar column functions of the flow model (all built-in expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

# bins: b = clamp(int(log2(max(1, v)) * 200 / 16), 0, 199); label int(2 ** (b * 16 / 200))
_LOG2_MAX = 16  # log2(TOKEN_MAX_VALUE)


def value_bin(v: Column) -> Column:
    b = F.floor(F.log2(F.greatest(F.lit(1.0), v)) * K.TOKEN_BINS / _LOG2_MAX)
    return F.least(F.lit(K.TOKEN_BINS - 1), F.greatest(F.lit(0), b)).cast("int")


def bin_label(b: Column) -> Column:
    """Integer label of bin b: int(2 ** (b * 16 / 200))."""
    return F.floor(F.pow(F.lit(2.0), b * _LOG2_MAX / float(K.TOKEN_BINS))).cast("bigint")


def quantize(v: Column) -> Column:
    """value -> token text.  v >= 65536 gives a label outside the
    vocabulary (encoded as UNK later)."""
    return (F.when(v < 0, F.lit(K.NEG_TOKEN))
            .when(v == 0, F.lit(K.ZERO_TOKEN))
            .when(v >= K.TOKEN_MAX_VALUE, F.lit(f"<VAL_{K.TOKEN_MAX_VALUE}>"))
            .otherwise(F.concat(F.lit("<VAL_"), bin_label(value_bin(v)).cast("string"), F.lit(">"))))


def dequantize(token: Column) -> Column:
    """token text -> value (ZERO 0, NEG -1, UNK 0, VAL_x x, other 0)."""
    num = F.regexp_extract(token, r"^<VAL_([0-9]+)>$", 1)
    return (F.when(token == K.ZERO_TOKEN, F.lit(0.0))
            .when(token == K.NEG_TOKEN, F.lit(-1.0))
            .when(token == K.UNK_TOKEN, F.lit(0.0))
            .when(num != "", num.cast("double"))
            .otherwise(F.lit(0.0)))


def value_band(grp: Column, v: Column) -> Column:
    """Range class of a value, per group."""
    g0 = (F.when(v < 0, "negative")
          .when((v >= 0.001) & (v <= 100.0), "realistic")
          .when(((v >= 0.0001) & (v <= 0.001)) | ((v > 100.0) & (v <= 1000.0)), "extended")
          .when(v > 10000.0, "unrealistic").otherwise("other"))
    g1 = (F.when((F.abs(v + 1.0) < 0.001) | (F.abs(v - 1.0) < 0.001) | (F.abs(v) < 0.001), "exact")
          .when((F.abs(v + 1.0) < 0.1) | (F.abs(v - 1.0) < 0.1) | (F.abs(v) < 0.1), "near")
          .otherwise("non_binary"))
    g2 = (F.when(v < 0, "negative").when(v == 0, "zero")
          .when((v >= 20) & (v <= 1500), "ethernet").when((v > 1500) & (v <= 9000), "jumbo")
          .when((v >= 1) & (v < 20), "tiny").when(v > 9000, "huge").otherwise("other"))
    return (F.when(v.isNull(), "null").when(grp == 0, g0).when(grp == 1, g1).otherwise(g2))


def snap_direction(v: Column, tol: Column) -> Column:
    """M6 group 1: snap to -1 / +1 / 0 when within ``tol``; otherwise to the
    nearest of (-1, +1, 0), ties resolved in that order."""
    dm, dp, dz = F.abs(v + 1.0), F.abs(v - 1.0), F.abs(v)
    nearest = (F.when((dm <= dp) & (dm <= dz), F.lit(-1.0))
               .when(dp <= dz, F.lit(1.0)).otherwise(F.lit(0.0)))
    return (F.when(~((dm <= tol) | (dp <= tol) | (dz <= tol)), nearest)
            .when(dm <= tol, F.lit(-1.0)).when(dp <= tol, F.lit(1.0)).otherwise(F.lit(0.0)))


def hms(seconds: Column) -> Column:
    """seconds -> 'Hh Mm Ss'."""
    s = F.floor(seconds).cast("bigint")
    return F.format_string("%dh %dm %ds", (s / 3600).cast("bigint"), ((s % 3600) / 60).cast("bigint"), s % 60)

"""Deterministic, partition-independent randomness as column expressions.

``uniform(seed, *keys)`` hashes the keys with MD5, takes 48 bits and divides by
2**48: a value in [0, 1) that depends only on the keys.  A retried or
re-partitioned task draws exactly the same numbers, and the same text in DuckDB
(``('0x' || substr(md5(k), 1, 12))::bigint / 2^48``) gives bit-equal values.
Only integer / string keys are used so both engines format them identically.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_48 = 281474976710656.0


def _key(seed, keys) -> Column:
    parts = [F.lit(str(seed))] + [k if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def uniform(seed, *keys) -> Column:
    """u in [0, 1) from md5(seed|k1|k2|...)."""
    h = F.conv(F.substring(F.md5(_key(seed, keys)), 1, 12), 16, 10).cast("bigint")
    return h.cast("double") / F.lit(TWO_48)


def normal(seed, *keys) -> Column:
    """Standard normal draw by Box-Muller on two independent uniforms."""
    u1 = uniform(seed, *keys, "bm1")
    u2 = uniform(seed, *keys, "bm2")
    # 1 - u1 lies in (0, 1], so the log is finite
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def sql_uniform(seed, *keys: str) -> str:
    """DuckDB text of ``uniform`` for oracle queries (keys are SQL expressions)."""
    inner = " || '|' || ".join([f"'{seed}'"] + [f"cast({k} as varchar)" for k in keys])
    return f"(('0x' || substr(md5({inner}), 1, 12))::bigint / 281474976710656.0e0)"

"""Run an oracle SQL text on DuckDB over the driver tables and compare a Spark
result with it as a multiset (used by tests and by ``python -m
flowsmith.plans.check``)."""

from __future__ import annotations

import math
import os

from ..sources.tables import TABLES


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def run_oracle(con, sql: str):
    return con.execute(sql).df()


def _norm(x):
    if x is None:
        return None
    try:
        import pandas as pd
        if x is pd.NA or x is pd.NaT:
            return None
    except ImportError:
        pass
    if isinstance(x, float):
        if math.isnan(x):
            return None
        return float(f"{x:.9g}") if x != 0 else 0.0
    if hasattr(x, "item"):
        return _norm(x.item())
    return x


def compare_frames(spark_pdf, oracle_pdf) -> tuple[bool, str]:
    """Order-insensitive comparison after sorting columns by name."""
    a_cols = sorted(spark_pdf.columns)
    b_cols = sorted(oracle_pdf.columns)
    if a_cols != b_cols:
        return False, f"columns differ: {a_cols} vs {b_cols}"
    if len(spark_pdf) != len(oracle_pdf):
        return False, f"row count {len(spark_pdf)} vs {len(oracle_pdf)}"
    def rows(pdf):
        out = []
        for rec in pdf[a_cols].itertuples(index=False, name=None):
            out.append(tuple(_norm(v) for v in rec))
        return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))
    ra, rb = rows(spark_pdf), rows(oracle_pdf)
    for i, (x, y) in enumerate(zip(ra, rb)):
        if x != y:
            return False, f"first diff at sorted row {i}: {x} vs {y}"
    return True, "ok"

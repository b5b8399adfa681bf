"""Run registered queries against their DuckDB oracle.

    python -m flowsmith.plans.check [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time

from .catalog import load_all
from .oracle import compare_frames, duckdb_connection, run_oracle


def main(argv=None) -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args(argv)
    from ..session import get_spark
    spark = get_spark("local[8]")
    queries = load_all()
    con = duckdb_connection(args.sf)
    bad = 0
    for name, (fn, sql) in queries.items():
        if args.names and name not in args.names:
            continue
        t0 = time.time()
        try:
            pdf = fn(spark, args.sf).toPandas()
        except Exception as e:  # report and go on
            print(f"{name:28s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}", flush=True)
            bad += 1
            continue
        t1 = time.time()
        if sql is None:
            print(f"{name:28s} rows={len(pdf):8d} (no oracle) {t1 - t0:6.2f}s", flush=True)
            continue
        try:
            odf = run_oracle(con, sql)
        except Exception as e:
            print(f"{name:28s} ORACLE ERROR {type(e).__name__}: {str(e)[:300]}", flush=True)
            bad += 1
            continue
        ok, msg = compare_frames(pdf, odf)
        bad += 0 if ok else 1
        print(f"{name:28s} rows={len(pdf):8d} {'OK ' if ok else 'BAD'} {t1 - t0:6.2f}s {'' if ok else msg}",
              flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

"""Plan audit of the registered queries.

    python -m flowsmith.plans.explain [--sf DIR] [--full] [name ...]

For every query the physical plan is built and summarized: shuffles
(Exchange), broadcasts, scans with their read schema and pushed filters, and
any Cartesian product or nested-loop join (there should be none).
"""

from __future__ import annotations

import argparse
import re
import sys

from .catalog import load_all

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin")


def physical_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def summarize(plan: str) -> dict:
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?ReadSchema: (struct<[^>]*>?)", plan)
    return {
        "exchanges": len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "sort_merge_joins": plan.count("SortMergeJoin"),
        "broadcast_hash_joins": plan.count("BroadcastHashJoin"),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "scans": len(scans),
        "bad": [b for b in BAD if b in plan],
    }


def main(argv=None) -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.001")
    ap.add_argument("--full", action="store_true", help="print the formatted plans")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args(argv)
    from ..session import get_spark
    spark = get_spark("local[8]")
    bad = 0
    for name, (fn, _) in load_all().items():
        if args.names and name not in args.names:
            continue
        df = fn(spark, args.sf)
        s = summarize(physical_plan(df))
        bad += bool(s["bad"])
        print(f"{name:28s} exchanges={s['exchanges']:2d} broadcasts={s['broadcasts']:2d} "
              f"smj={s['sort_merge_joins']:2d} bhj={s['broadcast_hash_joins']:2d} windows={s['windows']:2d} "
              f"scans={s['scans']:2d} {'BAD ' + ','.join(s['bad']) if s['bad'] else ''}", flush=True)
        if args.full:
            df.explain("formatted")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

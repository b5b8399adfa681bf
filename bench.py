"""Benchmark of the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query runs to completion through the ``noop`` sink (the full plan is
executed, nothing is collected).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowsmith.operators import synth as S  # noqa: E402
from flowsmith.plans.catalog import load_all  # noqa: E402
from flowsmith.plans.q_synth import synth_flows_df  # noqa: E402
from flowsmith.session import get_spark  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
SYNTH_N = int(os.environ.get("BENCH_SYNTH_N", "100000"))

HEADLINE = ["group_profile_by_app", "value_dist_by_app", "thresholds_by_app", "duplicate_rows",
            "encode_flows", "quality_overall", "row_perplexity"]


def synthesize_flows_n(spark, sf):
    """G7 with n = BENCH_SYNTH_N generated flows."""
    return S.to_wide(synth_flows_df(spark, sf, SYNTH_N))


def run(spark, fn, sf) -> float:
    t0 = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    spark = get_spark(f"local[{CPUS}]", shuffle_partitions=max(8, 2 * CPUS), app_name="flowsmith-bench")
    q = load_all()
    sf = SF_DIR.rstrip("/")
    # Each query is first run once on the smallest data set: the plan shape is
    # the same, so JVM class loading and whole-stage code generation (a fixed
    # cost that does not grow with data) are paid before the timed run.
    warm = os.path.join(os.path.dirname(sf), "sf0.001")
    do_warm = os.path.isdir(warm) and os.environ.get("BENCH_WARMUP", "1") == "1"
    jobs = [(name, q[name][0]) for name in HEADLINE] + [("synthesize_flows", synthesize_flows_n)]
    times = {}
    for name, fn in jobs:
        if do_warm:
            run(spark, fn, warm)
        times[name] = round(run(spark, fn, sf), 3)
    total = round(sum(times.values()), 3)
    out = {
        "metric": "headline_queries_total",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf).replace("sf", ""),
        "cpus": CPUS,
        "shuffle_partitions": max(8, 2 * CPUS),
        "synth_flows": SYNTH_N,
        "synth_flows_per_sec": round(SYNTH_N / times["synthesize_flows"], 1),
        "warmup": "each query once on sf0.001 before the timed run" if do_warm else "none",
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()

"""Every registered query against its DuckDB oracle (the correctness gate).

By default a representative set runs on sf0.001; FLOWSMITH_FULL_ORACLE=1
runs every query (use FLOWSMITH_ORACLE_SF to pick the scale).
"""

import os

import pytest

from flowsmith.plans.catalog import load_all
from flowsmith.plans.oracle import compare_frames, duckdb_connection, run_oracle

from paths import SF_SMALL

QUERIES = load_all()
QUICK = ["thresholds_by_app", "group_profile_global", "value_dist_by_app", "high_freq_values", "value_cdf",
         "synthesize_flows", "duplicate_rows", "novel_rows", "quality_overall", "encode_flows", "decode_flows",
         "row_perplexity", "repair_accept", "split_exact", "loss_moving_avg", "early_stop_point",
         "running_loss", "flow_scan", "schema_completion", "metric_history_unnest", "augment_noise"]
FULL = os.environ.get("FLOWSMITH_FULL_ORACLE") == "1"
NAMES = [n for n, (_, sql) in QUERIES.items() if sql and (FULL or n in QUICK)]
SF = os.environ.get("FLOWSMITH_ORACLE_SF", SF_SMALL)


@pytest.fixture(scope="module")
def duck():
    return duckdb_connection(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    fn, sql = QUERIES[name]
    got = fn(spark, SF).toPandas()
    want = run_oracle(duck, sql)
    ok, msg = compare_frames(got, want)
    assert ok, f"{name}: {msg}"


def test_every_query_has_oracle_or_reason():
    missing = [n for n, (_, sql) in QUERIES.items() if not sql]
    assert missing == [], missing


def test_entry_contract(spark):
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
    df = E.entry(spark)
    assert df.count() >= 0
    assert "sample_id" in df.columns and "PPI_2_29" in df.columns


PLAN_CHECK = sorted(set(QUICK) | {"duplicate_stats", "quality_delta", "generation_report", "label_profile"})


@pytest.mark.parametrize("name", [n for n in QUERIES if FULL or n in PLAN_CHECK])
def test_no_cartesian_or_nested_loop_join(spark, name):
    from flowsmith.plans.explain import physical_plan, summarize
    s = summarize(physical_plan(QUERIES[name][0](spark, SF)))
    assert s["bad"] == [], f"{name}: {s['bad']}"

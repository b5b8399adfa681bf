"""A 5-row wide flow file, one flow per label, built by a rule; numpy gives the expected figures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsmith.functions import constants as K
from flowsmith.operators import profile as P
from flowsmith.sources import flowfiles as FF

LABELS = ["dns", "mail", "stream", "voice", "web"]


def rule() -> np.ndarray:
    """(5 flows, 3 groups, 30 slots): gaps with a long tail, alternating directions, sizes up to 1460; zero padding."""
    v = np.zeros((5, 3, 30))
    for f in range(5):
        for s in range(18 + 3 * f):
            v[f, 0, s] = 0 if s == 0 else (s * s * (f + 1)) % 97 / 4 + (900 if s == 11 + f else 0)
            v[f, 1, s] = -1 if (s + f) % 3 == 0 else 1
            v[f, 2, s] = (137 * s + 311 * f) % 1461
    return v


@pytest.fixture(scope="module")
def sample(tmp_path_factory):
    path = tmp_path_factory.mktemp("native") / "flows.csv"
    names = [K.feature_name(g, s) for g in range(3) for s in range(30)]
    lines = [",".join([*names, "APP"])]
    lines += [",".join([*map(str, flow.ravel()), app]) for flow, app in zip(rule(), LABELS)]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def sample_cells(spark, sample):
    wide = FF.read_flows(spark, sample).withColumn("flow_id", F.monotonically_increasing_id())
    return FF.wide_to_cells(FF.complete_schema(wide), "flow_id")


def test_scan_shape(spark, sample):
    df = FF.read_flows(spark, sample)
    assert df.count() == 5 and len(df.columns) == 91
    assert df.select("APP").distinct().count() == 5


def test_global_group_profile(sample_cells):
    rows = {r["grp"]: r for r in P.group_profile(sample_cells, by_app=False, extra_pcts=True).collect()}
    for g in range(3):
        v = rule()[:, g, :]
        want = {"min": v.min(), "max": v.max(), "mean": v.mean(axis=0).mean(), "std": v.std(axis=0, ddof=1).mean(),
                "zero_ratio": (v == 0).mean(), "non_zero_count": (v != 0).sum(), "sample_count": 5}
        want |= {f"p{q}": np.percentile(v, q) for q in (25, 50, 75, 90, 95, 98)}
        for name, value in want.items():
            assert rows[g][name] == pytest.approx(value, abs=1e-6), (g, name)


def test_single_row_labels_have_null_std_and_p98_threshold(sample_cells):
    prof = P.group_profile(sample_cells, by_app=True, extra_pcts=True, rounded=False)
    assert prof.where(F.col("std").isNotNull()).count() == 0
    thr = {r["app"]: r for r in P.thresholds(sample_cells, by_app=True).where("grp = 0").collect()}
    assert set(thr) == set(LABELS)
    for f, app in enumerate(LABELS):   # std NULL: least/greatest skip it, upper = p98 (like min/max with NaN)
        assert thr[app]["upper_threshold"] == pytest.approx(np.percentile(rule()[f, 0], 98), abs=1e-6)
    noise = P.thresholds(sample_cells, by_app=True).where("grp = 2").select("noise_std").collect()
    assert all(r["noise_std"] is None for r in noise)


def test_schema_variants(spark, sample, tmp_path):
    df = FF.read_flows(spark, sample).drop("PPI_2_29", "APP")
    p = str(tmp_path / "variant")
    df.write.option("header", True).csv(p)
    raw = spark.read.option("header", True).csv(p)
    audit = FF.schema_audit(spark, raw).first()
    assert audit["missing_features"] == "PPI_2_29" and audit["has_label"] is False
    done = FF.complete_schema(raw)
    assert done.select("APP").distinct().first()["APP"] == "Unknown"
    assert done.agg(F.max("PPI_2_29")).first()[0] == 0.0

"""NULL keys, NULL order values and inputs at the edges of the rules."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowsmith.functions import rank as R
from flowsmith.operators import dedup, quality, repair, split, synth, tokens
from flowsmith.operators import flowtable as FT
from flowsmith.operators import profile as P
from flowsmith.session import materialize, scratch_path
from flowsmith.sources import adapters as A
from flowsmith.sources import flowfiles as FF

from paths import SF_SMALL


@pytest.fixture(scope="module")
def keyed(spark):
    rows = [(k, o, i) for i, (k, o) in enumerate([(1, 5), (1, None), (1, 7), (None, 3), (None, None), (None, 3), (2, 1)] * 4)]
    return spark.createDataFrame(rows, "k int, o int, i int")


@pytest.mark.parametrize("hot_rows", [2, 10, 1_000_000])
def test_ranks_keep_null_keys_and_order_values(keyed, hot_rows):
    got = R.ranked_within(keyed, ["k"], ["o", "i"], fine_bucket=F.col("o"), carry_col="o", hot_rows=hot_rows)
    w = Window.partitionBy("k").orderBy("o", "i")
    want = keyed.withColumn("rn", F.row_number().over(w) - 1).withColumn("prev_o", F.lag("o").over(w))
    cols = ["k", "o", "i", "rn", "prev_o"]
    key = lambda r: r["i"]
    assert sorted(map(tuple, got.select(cols).collect()), key=repr) == sorted(map(tuple, want.select(cols).collect()), key=repr)
    assert sorted(got.collect(), key=key)[0]["part_total"] == 12


def test_global_rank_and_running_mean_keep_null_keys(keyed):
    assert R.global_rank(keyed, F.col("o"), ["o", "i"], part_cols=["k"]).count() == keyed.count()
    means = R.running_mean(keyed.withColumn("x", F.lit(2.0)), ["k"], "i", "x", bucket_size=3)
    assert means.count() == keyed.count() and means.filter("running_mean = 2").count() == keyed.count()


def test_stratified_split_keeps_unlabelled_flows(spark):
    flows = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(20)], "flow_id bigint, app string")
    got = split.split_stratified(flows)
    assert got.count() == 20 and got.filter("app is null").count() == 10


def test_equal_flows_without_label_are_duplicates(spark):
    one = spark.createDataFrame([(1, None, 0, 0, 1.0), (1, None, 0, 1, 2.0)], "flow_id bigint, app string, grp int, slot int, v double")
    gen = one.withColumnRenamed("flow_id", "sample_id")
    assert dedup.duplicate_rows(gen, one).count() == 1
    assert dedup.novel_rows(gen, one).count() == 0
    assert dedup.duplicate_stats(gen, one).first()["num_duplicates"] == 1


def test_apportion_is_exact(spark):
    counts = spark.createDataFrame([("a", 3_999_999), ("b", 1)], "app string, cnt bigint")
    assert {r["app"]: r["n_samples"] for r in synth.apportion(counts, 1).collect()} == {"a": 0, "b": 1}


def test_candidates_use_the_exact_threshold(spark):
    scores = spark.createDataFrame([(i, 30.0) for i in range(9)] + [(9, 30.0 + 1e-7)], "sample_id bigint, ppl double")
    pol = repair.policy(scores).first()
    assert repair.candidates(scores, pol).count() == min(pol["n_above"], pol["budget"])


def test_csv_columns_are_found_by_name(spark):
    from flowsmith.functions import constants as K
    path = scratch_path(spark, "by-name")
    cols = [c for c in reversed(K.FEATURES) if c != "PPI_0_0"]
    wide = spark.createDataFrame([("web", *[float(i) for i in range(len(cols))])], ["APP", *cols])
    wide.write.option("header", True).csv(path)
    row = FF.read_flows(spark, path).first()
    assert row["PPI_0_0"] is None and row["APP"] == "web" and row["PPI_2_29"] == 0.0 and row["PPI_0_1"] == float(len(cols) - 1)
    unlabelled = FF.complete_schema(FF.read_flows(spark, path).withColumn("APP", F.lit(None).cast("string")))
    assert unlabelled.first()["APP"] == K.UNKNOWN_LABEL


def test_flow_ids_of_large_keys_do_not_meet():
    assert A.FLOW_KEY_BASE * 30 > 60_000_000_000


# ---- half of the labels are NULL

@pytest.fixture(scope="module")
def half(spark):
    """Flows of two labels and as many without one, with the same values as their labelled twins."""
    flows = FT.from_cells(A.cells_dirty(spark, SF_SMALL)).where("pmod(flow_id, 3) < 2")
    twins = flows.withColumn("app", F.lit(None).cast("string")).withColumn("flow_id", F.col("flow_id") + 1_000_000_007)
    return materialize(flows.withColumn("app", F.lit("same")).unionByName(twins).unionByName(
        flows.limit(5).withColumn("app", F.lit("few")).withColumn("flow_id", F.col("flow_id") + 2_000_000_011)))


@pytest.fixture(scope="module")
def half_counts(half):
    return materialize(P.value_counts(FT.to_cells(half)))


def _per_label(df, *drop):
    cols = [c for c in df.columns if c not in ("app", *drop)]
    out = {}
    for r in df.collect():
        out.setdefault(r["app"], []).append(str([r[c] for c in cols]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("operator", [
    lambda c: P.group_profile(counts=c), lambda c: P.thresholds(counts=c), lambda c: P.value_dist(counts=c), lambda c: P.high_freq_values(counts=c),
    lambda c: synth.preferred_patterns(P.value_dist(counts=c)), synth.enhanced_weights, lambda c: synth.value_cdf(synth.enhanced_weights(c)),
    lambda c: synth.column_buckets(synth.enhanced_weights(c)), lambda c: P.group_profile_levels(c).where("level = 'label'"),
])
def test_unlabelled_flows_have_the_profile_of_their_twins(half_counts, operator):
    per = _per_label(operator(half_counts))
    assert set(per) == {None, "same", "few"} and per[None] == per["same"] and "None, None, None, None, None" not in str(per[None][:1])


def test_profile_of_unlabelled_flows_against_numpy(half, half_counts):
    import numpy as np
    rows = {(r["app"], r["grp"]): r for r in P.group_profile(counts=half_counts, rounded=False).collect()}
    every = {r["grp"]: r for r in P.group_profile_levels(half_counts, rounded=False).where("level = 'all'").collect()}
    for g, name in enumerate(FT.GROUPS):
        for r, part in ((rows[None, g], half.where("app is null")), (every[g], half)):
            v = np.array([[np.nan if x is None else x for x in f[0]] for f in part.select(name).collect()])
            assert r["min"] == np.nanmin(v) and r["max"] == np.nanmax(v) and r["sample_count"] == len(v)
            assert r["mean"] == pytest.approx(np.nanmean(np.nanmean(v, axis=0))) and r["std"] == pytest.approx(np.nanmean(np.nanstd(v, axis=0, ddof=1)))
            for q in (25, 50, 75, 90, 95):
                assert r[f"p{q}"] == pytest.approx(np.nanpercentile(v, q))
            assert r["zero_ratio"] == pytest.approx((v == 0).sum() / (~np.isnan(v)).sum())


def test_a_table_equals_itself_without_labels(half, half_counts):
    fidelity = quality.distribution_fidelity(half_counts, half_counts).collect()
    assert len(fidelity) == 9 and {r["fidelity"] for r in fidelity} == {1.0}
    corr = quality.profile_correlation(half_counts, half_counts).collect()
    assert len(corr) == 12 and {r["correlation"] for r in corr} == {1.0} and {r["app"] for r in corr} == {None, "same", "few"}
    labels = P.label_counts(half)
    own = quality.label_fidelity(labels, labels).collect()
    assert len(own) == 3 and {r["label_consistency"] for r in own} == {1.0}
    gone = quality.label_fidelity(labels, labels.where("app = 'few'")).collect()
    assert {r["app"]: r["generated_count"] for r in gone} == {None: 0, "same": 0, "few": 5}
    assert sorted(map(str, P.label_counts_of(half_counts).collect())) == sorted(map(str, labels.collect()))


def test_draws_limits_scores_and_repair_of_unlabelled_flows(spark, half, half_counts):
    drawn = synth.synthesize_cells(spark, half_counts, 400)
    support = half_counts.where("grp = 2 and app is null").select("slot", F.rint(F.abs("v")).alias("v"))
    none = drawn.where("app is null and grp = 2")
    assert none.select("sample_id").distinct().count() > 100 and none.where("v > 20").count() > 1000
    assert none.where("v > 20").join(support, ["slot", "v"], "left_anti").count() == 0
    limits = repair.resolve_thresholds(half, P.thresholds(counts=half_counts), P.thresholds(counts=half_counts, by_app=False))
    per = _per_label(limits)
    assert per[None] == per["same"] and {r["source"] for r in limits.collect()} == {"app"}
    fixed = repair.repaired_cells(repair.repair(half, limits), "flow_id")
    per = _per_label(fixed, "flow_id")
    assert per[None] == per["same"] and fixed.where("v_new is distinct from v").count() > 0
    voc = tokens.vocab(spark)
    scores = _per_label(repair.score(half, repair.fit_bigram(half, voc), voc, "flow_id"), "flow_id")
    assert scores[None] == scores["same"]


def test_flows_without_the_first_cell_count(spark, half):
    cells = FT.to_cells(half).where("not (grp = 0 and slot = 0) or pmod(flow_id, 2) = 0")
    assert _per_label(P.label_counts(cells)) == _per_label(P.label_counts(half))
    n = half.count()
    got = P.dataset_overview(cells).first()
    assert got["total_samples"] == n and got["total_features"] == 90
    missing = cells.where("v is null").count() + half.where("app is null").count()
    assert got["missing_values"] == missing
    assert quality.quality_overall(cells).first()["total_samples"] == n
    ids = spark.createDataFrame([(i, "a", 0, 0, 1.0) for i in (-1, 0, 32768, -32769, 2 ** 62, -2 ** 62, 5, 5, None)],
                                "flow_id bigint, app string, grp int, slot int, v double")
    assert quality.quality_overall(ids).first()["total_samples"] == 7
    plans = [P.dataset_overview(cells), quality.quality_overall(cells)]
    assert not any("Expand" in p._jdf.queryExecution().executedPlan().toString() for p in plans)


# ---- files

def test_files_of_different_headers(spark, tmp_path):
    from flowsmith.functions import constants as K
    a, b = tmp_path / "in" / "a b%20[1]", tmp_path / "in" / "c"
    a.mkdir(parents=True)
    b.mkdir()
    (a / "x.csv").write_text(",".join([*K.FEATURES, "APP"]) + "\n" + ",".join([*map(str, range(90)), "web"]) + "\n")
    (a / "copy.csv").write_text("\ufeff" + ",".join([*K.FEATURES, "APP"]) + "\r\n" + ",".join([*["1.5"] * 90, '"a, b"']) + "\r\n")
    turned = ["note", "APP", "PPI_0_1", "PPI_0_1", *reversed([c for c in K.FEATURES if c not in ("PPI_0_1", "PPI_2_0")])]
    (b / "y.csv").write_text(",".join(turned) + "\n" + ",".join(["n", "", "7", "8", *["x"] * 2, *["3"] * 86]) + "\n")
    (b / "only-header.csv").write_text("APP\n")
    (b / "empty.csv").write_text("")
    for source in (str(tmp_path / "in"), str(b)):
        got = FF.read_flows(spark, source)
        assert got.columns == [*K.FEATURES, "APP"] and got.count() == (3 if source.endswith("in") else 1)
    rows = {r["APP"]: r for r in FF.read_flows(spark, str(tmp_path / "in")).collect()}
    assert set(rows) == {"web", "a, b", None} and list(rows["web"])[:90] == [float(i) for i in range(90)] and rows["a, b"]["PPI_2_29"] == 1.5
    odd = rows[None]
    assert odd["PPI_0_1"] == 7.0 and odd["PPI_2_0"] is None and odd["PPI_2_29"] is None and odd["PPI_2_28"] is None and odd["PPI_0_0"] == 3.0
    assert FF.read_flows(spark, str(b / "empty.csv")).count() == 0


def test_parquet_of_different_types(spark, tmp_path):
    from flowsmith.functions import constants as K
    path = str(tmp_path / "p")
    for i, kind in enumerate(["bigint", "double", "float", "int", "double", "bigint"]):
        df = spark.range(i, i + 1).select(*[F.col("id").cast(kind).alias(c) for c in (reversed(K.FEATURES) if i % 2 else K.FEATURES[:-1])],
                                          F.lit(f"l{i}").alias("APP"))
        df.write.parquet(f"{path}/{i}")
    rows = {r["APP"]: r for r in FF.read_flows(spark, path, "parquet").collect()}
    assert {k: (r["PPI_0_0"], r["PPI_2_29"]) for k, r in rows.items()} == {f"l{i}": (float(i), float(i) if i % 2 else None) for i in range(6)}


def test_history_files_of_training_runs(spark, tmp_path):
    import json
    runs = {"run a": [3.0, 2.0, 1.5], "b+c%20": [1.0]}
    for name, train in runs.items():
        (tmp_path / name).mkdir()
        text = json.dumps({"train_losses": train, "val_losses": [None] * len(train), "learning_rates": [0.1] * len(train), "epoch_times": [1.0]}, indent=2)
        (tmp_path / name / "metrics.json").write_text(text)
    got = FF.read_history_files(spark, str(tmp_path)).orderBy("run_id", "epoch").collect()
    assert [(r["run_id"], r["epoch"], r["train_loss"], r["secs"]) for r in got] == [
        ("b+c%20", 1, 1.0, 1.0), ("run a", 1, 3.0, 1.0), ("run a", 2, 2.0, None), ("run a", 3, 1.5, None)]

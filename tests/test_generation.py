"""Properties of the generation chain."""

import hashlib

from pyspark.sql import functions as F

from flowsmith.operators import profile as P
from flowsmith.operators import synth as S
from flowsmith.session import materialize
from flowsmith.sources import adapters as A

from paths import SF_SMALL


def _counts(spark):
    return materialize(P.value_counts(A.cells(spark, SF_SMALL)))


def test_probabilities_and_cdf(spark):
    counts = _counts(spark)
    dist = P.value_dist(counts=counts)
    sums = dist.groupBy("app", "grp", "slot").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r["s"] - 1.0) < 1e-9 for r in sums)
    cdf = S.value_cdf(S.enhanced_weights(counts)).toPandas().sort_values(["app", "grp", "slot", "v"])
    for _, g in cdf.groupby(["app", "grp", "slot"]):
        assert g["lo"].iloc[0] == 0.0 and g["hi"].iloc[-1] == 1.0
        assert (g["lo"].values[1:] == g["hi"].values[:-1]).all()


def test_apportion_sums_to_n(spark):
    lc = P.label_counts(A.cells(spark, SF_SMALL))
    for n in (1, 7, 10000, 12345):
        for orig in (True, False):
            assert S.apportion(lc, n, orig).agg(F.sum("n_samples")).first()[0] == n


def _guide(counts):
    weights = materialize(S.enhanced_weights(counts))
    buckets = materialize(S.column_buckets(weights))
    return buckets, materialize(S.guide_table(S.value_cdf(weights), buckets))


def test_draws_are_in_support_and_partition_independent(spark):
    counts = _counts(spark)
    buckets, guide = _guide(counts)
    plan = S.apportion(P.label_counts_of(counts), 3000, True)
    outs = []
    for parts in (1, 4, 13):
        sk = S.sample_skeleton(spark, plan, 3000, num_partitions=parts)
        d = S.draw(S.skeleton_cells(sk, buckets), guide, 42)
        outs.append(d.orderBy("sample_id", "grp", "slot").toPandas())
    assert outs[0].equals(outs[1]) and outs[0].equals(outs[2])
    support = counts.where(F.col("v").isNotNull()).select("app", "grp", "slot", "v").distinct()
    d = spark.createDataFrame(outs[0])
    assert d.join(support, ["app", "grp", "slot", "v"], "left_anti").count() == 0


def test_guide_table_equals_plain_range_join(spark):
    counts = _counts(spark)
    buckets, guide = _guide(counts)
    cells = S.skeleton_cells(S.sample_skeleton(spark, S.apportion(P.label_counts_of(counts), 2000, True), 2000), buckets)
    a = S.draw(cells, guide, 7).orderBy("sample_id", "grp", "slot").toPandas()
    u = cells.withColumn("u", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("7"), "sample_id", "grp", "slot")),
                                                1, 12), 16, 10).cast("bigint") / 281474976710656.0)
    c = S.value_cdf(S.enhanced_weights(counts))
    c = c.select(*[F.col(x).alias(f"c_{x}") for x in c.columns])
    b = (u.join(c, (u.app == c.c_app) & (u.grp == c.c_grp) & (u.slot == c.c_slot) & (u.u >= c.c_lo) & (u.u < c.c_hi))
         .select("sample_id", "app", "grp", "slot", F.col("c_v").alias("v"))
         .orderBy("sample_id", "grp", "slot").toPandas())
    assert a.equals(b)


def test_synthesized_flows_are_clean(spark):
    syn = S.synthesize_cells(spark, _counts(spark), 500)
    assert syn.count() == 500 * 90
    assert syn.where("grp = 1 and v not in (-1.0, 0.0, 1.0)").count() == 0
    assert syn.where("grp = 2 and (v < 0 or (v > 0 and v < 20) or v <> rint(v))").count() == 0
    assert syn.where("grp = 0 and v < 0").count() == 0


def test_to_wide_leaves_absent_cells_null(spark):
    cells = A.cells(spark, SF_SMALL)
    some = cells.select("flow_id").distinct().limit(3)
    partial = cells.join(some, "flow_id", "left_semi").where("not (grp = 1 and slot = 7)")
    wide = S.to_wide(partial, "flow_id").collect()
    full = {r["flow_id"]: r for r in S.to_wide(cells.join(some, "flow_id", "left_semi"), "flow_id").collect()}
    for r in wide:
        assert r["PPI_1_7"] is None
        assert r["PPI_2_29"] == full[r["flow_id"]]["PPI_2_29"]
        assert r["PPI_0_0"] == full[r["flow_id"]]["PPI_0_0"]


def test_labels_and_flows_without_ranking_equal_those_of_the_cells(spark):
    first = A.cells(spark, SF_SMALL).where("grp = 0 and slot = 0").select("flow_id", "app")
    assert sorted(map(tuple, A.flows(spark, SF_SMALL).collect())) == sorted(map(tuple, first.collect()))
    assert sorted(map(tuple, A.label_counts(spark, SF_SMALL).collect())) == sorted(map(tuple, first.groupBy("app").count().collect()))


def test_guide_follows_each_column(spark):
    """A column of 50,000 values beside one of three: as many guide rows as steps and buckets of each, and the same draws as by hand."""
    n = 50_000
    many = spark.range(n).select(F.lit(0).alias("slot"), (F.rand(3) * 5).alias("v"), F.lit(1).cast("bigint").alias("cnt"))
    few = spark.range(3).select(F.lit(1).alias("slot"), F.col("id").cast("double").alias("v"), F.lit(7).cast("bigint").alias("cnt"))
    counts = materialize(many.unionByName(few).select(F.lit(None).cast("string").alias("app"), F.lit(0).alias("grp"), "slot", "v", "cnt"))
    buckets, guide = _guide(counts)
    assert {r["slot"]: r["buckets"] for r in buckets.collect()} == {0: 16384, 1: 16}
    assert {r["slot"]: r["count"] <= {0: n + 16384, 1: 3 + 16}[r["slot"]] for r in guide.groupBy("slot").count().collect()} == {0: True, 1: True}
    skeleton = spark.range(300).select(F.col("id").alias("sample_id"), F.lit(None).cast("string").alias("app"))
    drawn = S.draw(S.skeleton_cells(skeleton, buckets), guide, 7).where("slot < 2 and grp = 0").collect()
    steps = {}
    for r in S.value_cdf(S.enhanced_weights(counts)).collect():
        steps.setdefault(r["slot"], []).append((r["lo"], r["hi"], r["v"]))
    for r in drawn:
        u = int(hashlib.md5(f"7|{r['sample_id']}|0|{r['slot']}".encode()).hexdigest()[:12], 16) / 2 ** 48
        assert r["v"] == next(v for lo, hi, v in steps[r["slot"]] if lo <= u < hi)
    assert len(drawn) == 600


def test_arrays_and_cells_are_the_same_flows(spark):
    """Adapters, round trips, absent cells, NULL values and labels; synthesis as arrays equals synthesis as cells."""
    from flowsmith.operators import flowtable as FT
    key = lambda df, i="flow_id": sorted(map(tuple, df.select(i, "app", "grp", "slot", "v").collect()), key=repr)
    cells = key(A.cells(spark, SF_SMALL))
    flows = A.flow_arrays(spark, SF_SMALL)
    assert key(FT.to_cells(flows)) == cells and key(FT.to_cells(FT.from_cells(A.cells(spark, SF_SMALL)))) == cells
    assert key(FT.to_cells(FT.from_wide(FT.to_wide(flows)))) == cells
    assert key(FT.to_cells(A.flow_arrays_events(spark, SF_SMALL))) == key(A.cells_events(spark, SF_SMALL))
    assert key(FT.to_cells(A.perturb(flows))) == key(A.cells_dirty(spark, SF_SMALL))
    assert key(FT.to_cells(A.candidate_of(flows))) == key(A.cells_candidate(spark, SF_SMALL))
    partial = A.cells_dirty(spark, SF_SMALL).where("(flow_id + slot) % 7 <> 0 or grp = 1").withColumn(
        "app", F.when(F.col("flow_id") % 2 == 0, F.col("app")))
    assert key(FT.to_cells(FT.from_cells(partial))) == key(partial)
    counts = _counts(spark)
    assert key(FT.to_cells(S.synthesize_flows(spark, counts, 300), "sample_id"), "sample_id") == key(S.synthesize_cells(spark, counts, 300), "sample_id")


def test_flow_arrays_are_not_shuffled_by_flow(spark):
    """Encoding, duplicate keys and the model's counts add no exchange of cells or by flow to the ranking's own."""
    from flowsmith.operators import dedup, repair, tokens

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(flow_id")

    flows = materialize(A.flow_arrays(spark, SF_SMALL))
    voc = materialize(tokens.vocab(spark))
    assert exchanges(A.flow_arrays(spark, SF_SMALL)) == 0
    assert exchanges(tokens.encode(flows, voc, materialize(tokens.label_vocab(flows, 99)))) == 0
    assert exchanges(dedup.flow_keys(flows, "flow_id")) == 0
    assert exchanges(repair._steps(flows, voc, "flow_id")) == 0


def test_batches_in_id_order(spark):
    from flowsmith.operators import split as T
    ids = [((i * 7919) % 1000) << 31 for i in range(1000)]
    df = spark.createDataFrame([(i, "a") for i in ids], "flow_id long, app string")
    want = {i: (k, (k - 1) // 8) for k, i in enumerate(sorted(ids), 1)}
    rows, T.ROWS_PER_BUCKET = T.ROWS_PER_BUCKET, 50
    try:
        got = T.assign_batches(df, 8, shuffle=False).collect()
    finally:
        T.ROWS_PER_BUCKET = rows
    assert {r["flow_id"]: (r["rank"], r["batch_id"]) for r in got} == want


def test_steps_of_complete_and_partial_flows(spark):
    """Each cell with the token before it in its group; a complete flow's tokens are found after the explode, not value by value in lambdas."""
    from flowsmith.operators import flowtable as FT, repair, tokens

    cells = A.cells_dirty(spark, SF_SMALL).where("flow_id % 3 <> 0 or (flow_id + slot) % 7 <> 0 or grp = 1 and slot < 3")
    flows, voc = FT.from_cells(cells), materialize(tokens.vocab(spark))
    token = {tuple(r)[:3]: r["token_id"] for r in tokens.value_tokens(cells, voc).select("flow_id", "grp", "slot", "token_id").collect()}
    want, last = [], {}
    for flow, grp, slot in sorted(token):
        want.append((flow, grp * 30 + slot, last.get((flow, grp), repair.START), token[flow, grp, slot]))
        last[flow, grp] = token[flow, grp, slot]
    steps = repair._steps(flows, voc, "flow_id")
    assert sorted(map(tuple, steps.select("flow_id", "cell", "prev", "token").collect())) == want
    plan = repair._steps(materialize(flows), voc, "flow_id")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "log2(" in plan and not any("log2(" in line for line in plan.splitlines() if "generate" in line)

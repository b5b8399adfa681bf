"""End-to-end generation run, and the streaming quality monitor."""

from pyspark.sql import functions as F

from flowsmith.operators import flowtable as FT
from flowsmith.operators import quality as Q
from flowsmith.operators import split
from flowsmith.plans.generation_run import StagedRun, generate_run
from flowsmith.session import delete_path
from flowsmith.sources import adapters as A
from flowsmith.sources import flowfiles as FF
from flowsmith.streaming.quality_stream import quality_counters, stream_quality

from paths import SF_SMALL


def _rows(flows):
    return sorted(map(str, flows.collect()))


def test_generation_run_writes_outputs(spark, tmp_path):
    res = generate_run(spark, A.cells(spark, SF_SMALL), out_dir=str(tmp_path / "run"), n=300)
    assert res.flows.count() == 300
    back = FF.read_flows(spark, res.paths["flows"])
    assert back.count() == 300 and back.columns[:2] == ["PPI_0_0", "PPI_0_1"]
    assert spark.read.json(res.paths["thresholds"]).count() == 3
    assert res.quality_after.first()["overall_score"] >= 0


def test_run_from_csv_goes_on_after_its_last_complete_stage(spark, tmp_path):
    source, folder = str(tmp_path / "csv"), str(tmp_path / "run")
    FF.write_flows(FT.to_wide(A.flow_arrays(spark, SF_SMALL)), source)
    whole = generate_run(spark, source, n=60, run_dir=folder)
    stages, want = list(whole.run.built), _rows(whole.flows)
    assert stages[0] == "source" and stages[-1] == "duplicates" and "repaired" in stages
    delete_path(spark, f"{folder}/scores")                       # the table is gone, its manifest line is not
    resumed = generate_run(spark, source, n=60, run_dir=folder)
    assert resumed.run.built == stages[stages.index("scores"):] and _rows(resumed.flows) == want
    resumed.run.finish(keep=("final",))
    assert {p.name for p in (tmp_path / "run").iterdir()} == {"final", "manifest"} and resumed.flows.count() == 60


def test_stages_are_built_again_where_they_must(spark, tmp_path):
    folder = str(tmp_path)

    def go(settings="a"):
        run = StagedRun(spark, folder, settings)
        for i, name in enumerate("xyz"):
            run.stage(name, lambda i=i: spark.range(i + 1))
        return run.built

    assert go() == ["x", "y", "z"] and go() == []
    spark.range(1).write.mode("append").parquet(f"{folder}/y")   # one row too many
    assert go() == ["y", "z"] and go() == []
    delete_path(spark, f"{folder}/manifest/z")                   # written, but not marked as done
    assert go() == ["z"]
    assert go("b") == ["x", "y", "z"]                            # other settings: nothing of the old run counts


def test_batches_and_labels_are_pruned(spark, tmp_path):
    flows = A.flow_arrays(spark, SF_SMALL)
    batched = flows.join(split.assign_batches(flows.select("flow_id", "app")).select("flow_id", "batch_id"), "flow_id")
    path = str(tmp_path / "batches")
    split.write_batches(batched, path, batches_per_file=2)
    got = split.read_batches(spark, path, [1, 4])
    assert "PushedFilters: [In(batch_id, [1,4])]" in got._jdf.queryExecution().toString()
    assert sorted(r[0] for r in got.select("flow_id").collect()) == sorted(r[0] for r in batched.where("batch_id in (1, 4)").select("flow_id").collect())
    per_file = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("batch_id").alias("a"), F.max("batch_id").alias("b")).orderBy("a").collect()
    assert len(per_file) > 1 and all(x["b"] < y["a"] for x, y in zip(per_file, per_file[1:]))

    by_label = str(tmp_path / "labels")
    wide = FT.to_wide(flows).withColumn("app", F.when(F.col("flow_id") % 5 != 0, F.col("app")))
    FF.write_flows(wide, by_label, "parquet", partition_by_label=True)
    for labels in (["ASIA", None], ["EUROPE"], [None]):
        some = FF.read_flows_of(spark, by_label, labels)
        assert "PartitionFilters: []" not in some._jdf.queryExecution().executedPlan().toString()
        want = wide.where(F.coalesce(F.col("app"), F.lit("none")).isin([x or "none" for x in labels])).count()
        assert some.count() == want > 0
    few = spark.createDataFrame([("ASIA", 1), ("AFRICA", 2), ("ASIA", 3)], "APP string, k int").where("k < 3")
    some = FF.read_flows_of(spark, by_label, few)
    assert some.count() == wide.where("app in ('ASIA', 'AFRICA')").count()
    assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString().lower()


def test_streaming_quality_matches_batch(spark, tmp_path):
    from flowsmith.operators import synth as S
    from flowsmith.operators import profile as P
    syn = S.synthesize_cells(spark, P.value_counts(A.cells(spark, SF_SMALL)), 200)
    src = str(tmp_path / "in")
    syn.select("sample_id", "app", "grp", "slot", "v").write.parquet(src)
    q = (stream_quality(spark, src).writeStream.outputMode("complete").format("memory")
         .queryName("flow_quality").option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from flow_quality").first()
    want = Q.quality_overall(syn).first()
    assert got["samples"] == 200
    assert abs(got["overall_score"] - want["overall_score"]) < 1e-6

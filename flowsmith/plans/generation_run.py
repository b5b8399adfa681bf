"""A whole generation run: read the source flows, profile them, generate, check quality, score and repair, check again, write.

Every stage is a Spark job that writes one table into the run's folder and then a line in the run's manifest (rows written, done).
A run that was cut off goes on after its last complete stage: a stage counts as complete only if its manifest line is there and its
table reads back with as many rows.  A stage that has to be built again makes the later ones be built again too.  ``finish`` deletes the
tables that nothing needs any more.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import dedup as D
from ..operators import flowtable as FT
from ..operators import profile as P
from ..operators import quality as Q
from ..operators import repair as R
from ..operators import synth as S
from ..operators import tokens as T
from ..session import delete_path, path_exists, scratch_path
from ..sources import flowfiles as FF

MANIFEST = "stage string, rows bigint, settings string"


class StagedRun:
    """Tables of a run by stage name under ``folder``, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str, settings: str = ""):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings
        self.built: list[str] = []                # stages that this call had to build
        self._open: dict[str, DataFrame] = {}

    def _line(self, name: str) -> str:
        return f"{self.folder}/manifest/{name}"

    def _complete(self, name: str) -> DataFrame | None:
        if self.built or not path_exists(self.spark, f"{self._line(name)}/_SUCCESS"):
            return None
        line = self.spark.read.schema(MANIFEST).json(self._line(name)).first()
        if line is None or line["settings"] != self.settings or not path_exists(self.spark, f"{self.folder}/{name}/_SUCCESS"):
            return None
        table = self.spark.read.parquet(f"{self.folder}/{name}")
        return table if table.count() == line["rows"] else None

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table, from an earlier attempt if that completed it."""
        if name not in self._open:
            table = self._complete(name)
            if table is None:
                delete_path(self.spark, self._line(name))
                made = build()
                made.write.mode("overwrite").parquet(f"{self.folder}/{name}")
                table = self.spark.read.schema(made.schema).parquet(f"{self.folder}/{name}")
                line = self.spark.createDataFrame([(name, table.count(), self.settings)], MANIFEST)
                line.coalesce(1).write.mode("overwrite").json(self._line(name))
                self.built.append(name)
            self._open[name] = table
        return self._open[name]

    def finish(self, keep: tuple[str, ...] = ()) -> None:
        """Deletes the tables of all stages but ``keep``, each after its manifest line."""
        for name in [n for n in self._open if n not in keep]:
            delete_path(self.spark, self._line(name))
            delete_path(self.spark, f"{self.folder}/{name}")
            del self._open[name]


@dataclass
class RunResult:
    flows: DataFrame            # final flows (sample_id, app, arrays)
    quality_before: DataFrame
    quality_after: DataFrame
    repair: DataFrame | None    # per candidate: old / new score, changed, accepted
    duplicates: DataFrame       # one row
    paths: dict = field(default_factory=dict)
    run: StagedRun | None = None


def source_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Flows of a folder of wide CSV files: columns by name, absent features 0.0, no label 'Unknown'."""
    wide = FF.complete_schema(FF.read_flows(spark, path)).withColumn("flow_id", F.monotonically_increasing_id())
    return FT.from_wide(wide)


def generate_run(spark: SparkSession, source: DataFrame | str, out_dir: str | None = None,
                 n: int = K.N_SAMPLES, seed: int = K.DEFAULT_SEED,
                 original_proportions: bool = K.USE_ORIGINAL_PROPORTIONS,
                 guidance: bool = True, id_col: str = "flow_id", run_dir: str | None = None) -> RunResult:
    """E1.  ``source``: a folder of wide CSV files, or the real flows as arrays or cells.  With the same ``run_dir`` a run that
    was cut off is taken up again (give each run a folder of its own)."""
    settings = f"n={n} seed={seed} proportions={original_proportions} source={source if isinstance(source, str) else 'table'}"
    run = StagedRun(spark, run_dir or scratch_path(spark, "run"), settings)

    def read() -> DataFrame:
        if isinstance(source, str):
            return source_from_csv(spark, source)
        flows = source if FT.is_flow_table(source) else FT.from_cells(source, id_col)
        return flows.withColumnRenamed(id_col, "flow_id").withColumn("app", F.coalesce(F.col("app"), F.lit(K.UNKNOWN_LABEL)))

    src = run.stage("source", read)
    counts = run.stage("counts", lambda: P.value_counts(FT.to_cells(src)))
    labels = run.stage("labels", lambda: P.label_counts(src))
    syn = run.stage("generated", lambda: S.synthesize_flows(spark, counts, n, seed, original_proportions, labels))
    q_before = run.stage("quality_before", lambda: Q.quality_overall(FT.to_cells(syn, "sample_id")))
    final, accepted = syn, None
    if guidance:
        voc = run.stage("vocabulary", lambda: T.vocab(spark))
        model = None

        def scored(flows: DataFrame) -> DataFrame:
            nonlocal model
            model = model or R.fit_bigram(src, voc)
            return R.score(flows, model, voc)

        scores = run.stage("scores", lambda: scored(syn))
        policy = run.stage("policy", lambda: R.policy(scores))
        cands = run.stage("candidates", lambda: R.candidates(scores, policy.first()))

        def repair() -> DataFrame:
            limits = R.resolve_thresholds(labels, P.thresholds(counts=counts, by_app=True), P.thresholds(counts=counts, by_app=False))
            return R.repair(syn.join(cands.select("sample_id"), "sample_id", "left_semi"), limits)

        repaired = run.stage("repaired", repair)
        accepted = run.stage("accepted", lambda: R.accept(cands, scored(repaired), repaired.select("sample_id", "changed")))

        def merged() -> DataFrame:
            keep = accepted.where("accepted").select("sample_id")
            fixed = repaired.join(keep, "sample_id", "left_semi").select(*syn.columns)
            return syn.join(keep, "sample_id", "left_anti").unionByName(fixed)

        final = run.stage("final", merged)
    q_after = run.stage("quality_after", lambda: Q.quality_overall(FT.to_cells(final, "sample_id")))
    dups = run.stage("duplicates", lambda: D.duplicate_stats(final, src, gen_id="sample_id"))
    paths = {}
    if out_dir:
        base = out_dir.rstrip("/")
        FF.write_flows(S.to_wide(final), f"{base}/flows", "csv")
        paths["flows"] = f"{base}/flows"
        paths.update(FF.write_profile({
            "group_profile": P.group_profile(counts=counts, by_app=True),
            "thresholds": P.thresholds(counts=counts, by_app=False),
            "thresholds_by_app": P.thresholds(counts=counts, by_app=True),
            "value_distributions": P.value_dist(counts=counts, by_app=True),
            "label_proportions": P.label_proportions(labels=labels),
            "group_summary": P.group_summary(FT.to_cells(final, "sample_id")),
            "duplicates": dups,
        }, f"{base}/analysis"))
    return RunResult(final, q_before, q_after, accepted, dups, paths, run)

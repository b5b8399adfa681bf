"""Source / sink queries (S1-S3, S5-S7): flows and histories written to the
shared checkpoint folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import dedup as D
from ..operators import flowtable as FT
from ..operators import profile as P
from ..operators import synth as S
from ..session import materialize, scratch_path
from ..sources import adapters as A
from ..sources import flowfiles as FF
from .catalog import QUERIES, register
from .q_synth import synth_ctes
from .q_profile import thresholds_sql

DROPPED = ["PPI_0_29", "PPI_2_29"]


def _wide_cols(exclude=(), app_expr="app", label="APP", const=None):
    const = const or {}
    cols = []
    for g in range(3):
        for s in range(30):
            name = f"PPI_{g}_{s}"
            if name in exclude:
                continue
            cols.append(f"{const[name]} as {name}" if name in const else
                        f"max(case when grp = {g} and slot = {s} then v end) as {name}")
    return ", ".join(cols) + f", {app_expr} as {label}"


def _written_wide(spark, sf, drop=(), drop_label=False):
    wide = S.to_wide(A.cells(spark, sf), "flow_id").withColumnRenamed("app", K.LABEL_COL)
    keep = [c for c in K.FEATURES if c not in drop] + ([] if drop_label else [K.LABEL_COL])
    path = scratch_path(spark, "flows-csv")
    wide.select(*keep).write.mode("overwrite").option("header", True).csv(path)
    return path


@register("flow_scan", A.with_views(f"select {_wide_cols()} from cells group by flow_id, app", "cells"))
def flow_scan(spark, sf):
    """Flows written as wide CSV and read back with the fixed schema."""
    path = scratch_path(spark, "flows-csv")
    FF.write_flows(S.to_wide(A.cells(spark, sf), "flow_id"), path, "csv")
    return FF.read_flows(spark, path, "csv")


@register("flow_scan_mixed", A.with_views(
    f"select {_wide_cols()}".replace("max(case when grp = 2 and slot = 29 then v end) as PPI_2_29",
                                     "max(case when grp = 2 and slot = 29 and flow_id % 3 <> 1 then v end) as PPI_2_29")
    + " from cells group by flow_id, app", "cells"))
def flow_scan_mixed(spark, sf):
    """S1 over files that differ: CSV files of two headers (one in reverse order, without PPI_2_29 and with a column of its own)
    in one folder, Parquet files of whole numbers and of doubles in another."""
    flows = materialize(A.flow_arrays(spark, sf))
    wide = FT.to_wide(flows).withColumnRenamed("app", K.LABEL_COL)
    part, features = F.pmod("flow_id", F.lit(3)), [F.col(c) for c in K.FEATURES]
    csv_at, parquet_at = scratch_path(spark, "flows-csv"), scratch_path(spark, "flows-parquet")
    FF.write_flows(wide.where(part == 0), f"{csv_at}/a")
    turned = [K.LABEL_COL, *[c for c in reversed(K.FEATURES) if c != "PPI_2_29"]]
    wide.where(part == 1).select(F.lit("x, y").alias("note"), *turned).write.option("header", True).csv(f"{csv_at}/b")
    rest, whole = wide.where(part == 2), [c.cast("bigint").alias(n) for c, n in zip(features, K.FEATURES)]
    rest.where("flow_id % 2 = 0").select(*whole, K.LABEL_COL).write.parquet(f"{parquet_at}/a")
    rest.where("flow_id % 2 = 1").select(K.LABEL_COL, *K.FEATURES).write.parquet(f"{parquet_at}/b")
    return FF.read_flows(spark, csv_at).unionByName(FF.read_flows(spark, parquet_at, "parquet"))


@register("schema_audit", A.with_views(f"""
select count(*) as total_rows, cast(88 as bigint) as feature_columns, '{",".join(DROPPED)}' as missing_features,
       true as has_label, count(distinct app) as distinct_labels
from cells where grp = 0 and slot = 0""", "cells"))
def schema_audit(spark, sf):
    """A CSV without two feature columns is audited from its header."""
    path = _written_wide(spark, sf, drop=DROPPED)
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return FF.schema_audit(spark, df)


@register("schema_completion", A.with_views(
    f"select {_wide_cols(const={d: '0.0e0' for d in DROPPED}, app_expr=repr('Unknown'))} "
    "from cells group by flow_id, app", "cells"))
def schema_completion(spark, sf):
    """S3: the CSV lacks two features and the label; completion adds 0.0 and 'Unknown'."""
    path = _written_wide(spark, sf, drop=DROPPED, drop_label=True)
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return FF.complete_schema(df)


@register("metric_history_unnest", A.with_views("""
select run_id, cast(row_number() over (partition by run_id order by epoch) as integer) as epoch,
       train_loss, val_loss, 5.0e-5 / epoch as lr, secs
from run_metrics""", "run_metrics"))
def metric_history_unnest(spark, sf):
    """Histories written as one JSON object per run and read back; the rate falls as 1 / epoch."""
    path = scratch_path(spark, "history-json")
    FF.write_history(A.run_metrics(spark, sf).withColumn("lr", F.lit(5.0e-5) / F.col("epoch")), path)
    return FF.read_history(spark, path).withColumn("epoch", F.col("epoch").cast("int"))


@register("metric_history_files", A.with_views("""
select run_id, cast(row_number() over (partition by run_id order by epoch) as integer) as epoch,
       train_loss, val_loss, 5.0e-5 / epoch as lr, secs
from run_metrics""", "run_metrics"))
def metric_history_files(spark, sf):
    """S7 in the form that training runs save: one indented object per file, without a run id, which comes from the folder."""
    path = scratch_path(spark, "history-files")
    FF.write_history_files(A.run_metrics(spark, sf).withColumn("lr", F.lit(5.0e-5) / F.col("epoch")), path)
    return FF.read_history_files(spark, path, r"/run=([^/]*)/[^/]*$").withColumn("epoch", F.col("epoch").cast("int"))


@register("profile_files", QUERIES["group_profile_by_app"][1])
def profile_files(spark, sf):
    """The (label, group) profile written as JSON and read back."""
    profile = QUERIES["group_profile_by_app"][0](spark, sf)
    paths = FF.write_profile({"group_profile": profile}, scratch_path(spark, "profile"))
    return spark.read.schema(profile.schema).json(paths["group_profile"])


@register("generation_report", A.with_views("""
select s.grp, (select count(*) from syn where grp = 0 and slot = 0) as n_generated,
       (select count(*) from cells where grp = 0 and slot = 0) as n_original,
       t.upper_threshold, t.noise_std, t.binary_tolerance, t.symmetry_break_chance,
       d.num_duplicates, round(d.num_duplicates * 100.0e0 / (select count(*) from syn where grp = 0 and slot = 0), 6)
         as duplicate_percentage,
       s.min, s.max, s.unique_values, s.non_zero, s.total, s.non_zero_pct
from (select grp, min(v) as min, max(v) as max, count(distinct v) as unique_values, count_if(v <> 0) as non_zero,
             count(*) as total, round(count_if(v <> 0) * 100.0e0 / count(*), 6) as non_zero_pct
      from syn group by grp) s
join tg t on t.grp = s.grp,
(select count(*) as num_duplicates from gk where exists (select 1 from ok where ok.app = gk.app and ok.k = gk.k)) d""",
    "cells", extra={**synth_ctes(), "tg": thresholds_sql("cells", False),
                    "ok": "select flow_id, app, list(round_even(v, 6) order by grp, slot) as k from cells group by flow_id, app",
                    "gk": "select sample_id, app, list(round_even(v, 6) order by grp, slot) as k from syn group by sample_id, app"}))
def generation_report(spark, sf):
    """Per group of a generation run: sizes, global limits, duplicates
    against the source, and the value summary of the generated flows."""
    flows = materialize(A.flow_arrays(spark, sf))        # read by the counts, the labels and the duplicate check
    counts = materialize(P.value_counts(FT.to_cells(flows)))
    syn = materialize(S.synthesize_flows(spark, counts, labels=P.label_counts(flows)))
    dup = D.duplicate_stats(syn, flows, gen_id="sample_id")
    summary = P.group_summary(FT.to_cells(syn, "sample_id"))
    thr = P.thresholds(counts=counts, by_app=False)
    n_orig = flows.count()
    d = dup.first()  # a one-row summary: its four numbers become literals
    return (summary.join(thr, "grp")
            .select("grp", F.lit(d["total_generated"]).cast("bigint").alias("n_generated"),
                    F.lit(n_orig).cast("bigint").alias("n_original"), "upper_threshold", "noise_std",
                    "binary_tolerance", "symmetry_break_chance",
                    F.lit(d["num_duplicates"]).cast("bigint").alias("num_duplicates"),
                    F.lit(d["duplicate_percentage"]).cast("double").alias("duplicate_percentage"),
                    "min", "max", "unique_values", "non_zero", "total", "non_zero_pct"))

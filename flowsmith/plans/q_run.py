"""The whole run from wide CSV files (E1), batches and labels read back from laid-out files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.rand import sql_uniform
from ..operators import flowtable as FT
from ..operators import split
from ..session import materialize, scratch_path
from ..sources import adapters as A
from ..sources import flowfiles as FF
from .catalog import register
from .generation_run import generate_run
from .q_score import score_ctes
from .q_synth import wide_sql


@register("generation_run", A.with_views(wide_sql("fin", "sample_id"), "cells",
                                         extra={**score_ctes(), "ds": "select sample_id, app, grp, slot, v from syn"}))
def generation_run(spark, sf):
    """The source flows as wide CSV files, then profile, generation, scores, repair and quality in stages; the final flows."""
    path = scratch_path(spark, "source-csv")
    FF.write_flows(FT.to_wide(A.flow_arrays(spark, sf)), path)
    result = generate_run(spark, path)
    result.run.finish(keep=("final",))
    return FT.to_wide(result.flows, "sample_id")


BATCHES = [0, 3, 17, 40]


@register("batch_read", A.with_views(f"""
select f.batch_id, f.flow_id, f.app, c.grp, c.slot, c.v
from (select flow_id, app, (row_number() over (order by {sql_uniform(K.SPLIT_SEED, "flow_id")}, flow_id) - 1) // {K.BATCH_SIZE} as batch_id
      from (select distinct flow_id, app from cells) d) f join cells c on c.flow_id = f.flow_id
where f.batch_id in ({", ".join(map(str, BATCHES))})""", "cells"))
def batch_read(spark, sf):
    """T5: flows written in batch order, ranges of batches per file, and some batches read back from the files that hold them."""
    flows = materialize(A.flow_arrays(spark, sf))
    batches = split.assign_batches(flows).select("flow_id", "batch_id")
    path = scratch_path(spark, "batches")
    split.write_batches(flows.join(batches, "flow_id"), path)
    got = split.read_batches(spark, path, BATCHES)
    return got.join(FT.to_cells(got).select("flow_id", "grp", "slot", "v"), "flow_id").select("batch_id", "flow_id", "app", "grp", "slot", "v")


@register("flows_of_labels", A.with_views("""
select app as APP, count(*) as flows, sum(s) as bytes from (select flow_id, app, sum(v) as s from cells where grp = 2 group by flow_id, app) t
where app in ('AFRICA', 'EUROPE') or app = (select min(app) from cells) group by app""", "cells"))
def flows_of_labels(spark, sf):
    """Flows laid out by label, read back for two labels given as a list (static pruning) and those of a small table
    (dynamic pruning)."""
    path = scratch_path(spark, "flows-by-label")
    FF.write_flows(FT.to_wide(A.flow_arrays(spark, sf)), path, "parquet", partition_by_label=True)
    first = A.label_counts(spark, sf).agg(F.min("app").alias("APP"))
    both = FF.read_flows_of(spark, path, ["AFRICA", "EUROPE"]).unionByName(
        FF.read_flows_of(spark, path, first).where(~F.col("APP").isin("AFRICA", "EUROPE")))
    size = sum((F.col(K.feature_name(2, s)) for s in range(1, K.N_SLOTS)), F.col(K.feature_name(2, 0)))
    return both.groupBy("APP").agg(F.count(F.lit(1)).alias("flows"), F.sum(size).alias("bytes"))

"""Quality (V1-V8), output summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import quality as Q
from ..session import materialize
from ..sources import adapters as A
from .catalog import register
from .common import cell_counts
from .q_profile import value_dist_sql
from .q_synth import synth_cells_df, synth_ctes, synth_flows_df


def q_agg_sql(src: str, id_col: str = "flow_id") -> str:
    return f"""select count(distinct {id_col}) as total_samples,
  count_if(grp = 0) as t_total, count_if(grp = 0 and v < 0) as t_neg, count_if(grp = 0 and v = 0) as t_zero,
  count_if(grp = 0 and v >= 0.0001e0 and v <= 1000.0e0) as t_real, count_if(grp = 0 and v > 10000.0e0) as t_out,
  count_if(grp = 1) as d_total, count_if(grp = 1 and v = -1.0e0) as d_m1, count_if(grp = 1 and v = 1.0e0) as d_p1,
  count_if(grp = 1 and v = 0.0e0) as d_zero,
  count_if(grp = 1 and (abs(v + 1) < 0.1e0 or abs(v - 1) < 0.1e0 or abs(v) < 0.1e0)) as d_near,
  count_if(grp = 2) as s_total, count_if(grp = 2 and v < 0) as s_neg, count_if(grp = 2 and v = 0) as s_zero,
  count_if(grp = 2 and v >= 20 and v <= 9000) as s_real, count_if(grp = 2 and v > 0 and v < 20) as s_tiny,
  count_if(grp = 2 and v > 9000) as s_huge, count_if(grp = 2 and v = round_even(v, 0)) as s_int
from {src}"""


TS = "greatest(0.0e0, 100.0e0 - 10.0e0 * t_neg - 5.0e0 * t_out)"
DS = "(d_m1 + d_p1 + d_zero) * 100.0e0 / d_total"
SS = "greatest(0.0e0, 100.0e0 - 10.0e0 * s_neg - 2.0e0 * s_tiny - 5.0e0 * s_huge)"
OVERALL_SEL = (f"select total_samples, round({TS}, 6) as timing_score, round({DS}, 6) as direction_score, "
               f"round({SS}, 6) as size_score, round(({TS} + {DS} + {SS}) / 3.0e0, 6) as overall_score from qa")


def synth(spark, sf):
    return materialize(synth_cells_df(spark, sf))


@register("quality_timing", A.with_views("""
select t_neg as negative_values, t_zero as zero_values, t_real as realistic_timing_values,
       t_out as extreme_outliers, round(t_neg / t_total, 6) as negative_rate, round(t_out / t_total, 6) as outlier_rate,
       """ + TS + " as quality_score from qa", "cells_dirty", extra={"qa": q_agg_sql("cells_dirty")}))
def quality_timing(spark, sf):
    return Q.quality_timing(A.cells_dirty(spark, sf))


@register("quality_direction", A.with_views("""
select d_m1 as exact_minus_one, d_p1 as exact_plus_one, d_zero as exact_zero, d_near as near_binary_values,
       round((d_m1 + d_p1 + d_zero) / d_total, 6) as exact_binary_ratio, round(""" + DS + ", 6) as quality_score from qa",
                                         "cells_dirty", extra={"qa": q_agg_sql("cells_dirty")}))
def quality_direction(spark, sf):
    return Q.quality_direction(A.cells_dirty(spark, sf))


@register("quality_size", A.with_views("""
select s_neg as negative_values, s_zero as zero_values, s_real as realistic_packet_sizes, s_tiny as tiny_packets,
       s_huge as huge_packets, s_int as integer_values, round((s_neg + s_tiny + s_huge) / s_total, 6) as violation_rate,
       """ + SS + " as quality_score from qa", "cells_dirty", extra={"qa": q_agg_sql("cells_dirty")}))
def quality_size(spark, sf):
    return Q.quality_size(A.cells_dirty(spark, sf))


@register("quality_overall", A.with_views(OVERALL_SEL, "cells_dirty", extra={"qa": q_agg_sql("cells_dirty")}))
def quality_overall(spark, sf):
    return Q.quality_overall(A.cells_dirty(spark, sf))


@register("quality_generated", A.with_views(OVERALL_SEL, "cells",
                                            extra={**synth_ctes(), "qa": q_agg_sql("syn", "sample_id")}))
def quality_generated(spark, sf):
    """V4 on freshly generated flows (before repair)."""
    return Q.quality_overall(synth_cells_df(spark, sf))


@register("group_summary", A.with_views("""
select grp, min(v) as min, max(v) as max, count(distinct v) as unique_values, count_if(v <> 0) as non_zero,
       count(*) as total, round(count_if(v <> 0) * 100.0e0 / count(*), 6) as non_zero_pct
from syn group by grp""", "cells", extra=synth_ctes()))
def group_summary(spark, sf):
    return P.group_summary(synth_cells_df(spark, sf))


LABELS_SQL = {
    "o": "select app, count(*) as cnt from cells where grp = 0 and slot = 0 group by app",
    "g": "select app, count(*) as cnt from syn where grp = 0 and slot = 0 group by app",
    "j": """select coalesce(o.app, g.app) as app, coalesce(o.cnt, 0) as original_count, coalesce(g.cnt, 0) as generated_count
            from o full outer join g on o.app = g.app""",
    "s": """select *, original_count / sum(original_count) over () as original_share,
                   generated_count / sum(generated_count) over () as generated_share from j""",
}


def _label_tables(spark, sf):
    return A.label_counts(spark, sf), P.label_counts(synth_flows_df(spark, sf))


@register("label_fidelity", A.with_views("""
select app, original_count, generated_count, round(original_share, 6) as original_share,
       round(generated_share, 6) as generated_share, round(generated_share - original_share, 6) as share_diff,
       round(1.0e0 - 0.5e0 * sum(abs(generated_share - original_share)) over (), 6) as label_consistency
from s""", "cells", extra={**synth_ctes(), **LABELS_SQL}))
def label_fidelity(spark, sf):
    o, g = _label_tables(spark, sf)
    return Q.label_fidelity(o, g)


@register("generated_label_check", A.with_views("""
select app, generated_count, round(generated_share, 6) as generated_share, round(original_share, 6) as target_share
from s""", "cells", extra={**synth_ctes(), **LABELS_SQL}))
def generated_label_check(spark, sf):
    o, g = _label_tables(spark, sf)
    return Q.label_fidelity(o, g).select("app", "generated_count", "generated_share",
                                         F.col("original_share").alias("target_share"))


@register("distribution_fidelity", A.with_views("""
select app, grp, round(1.0e0 - avg(tv), 6) as fidelity, round(max(tv), 6) as worst_column_tv
from (select app, grp, slot, 0.5e0 * sum(abs(p1 - p2)) as tv
      from (select coalesce(o.app, g.app) as app, coalesce(o.grp, g.grp) as grp, coalesce(o.slot, g.slot) as slot,
                   coalesce(o.p, 0.0e0) as p1, coalesce(g.p, 0.0e0) as p2
            from vo o full outer join vg g on o.app = g.app and o.grp = g.grp and o.slot = g.slot and o.v = g.v) j
      group by app, grp, slot) t
group by app, grp""", "cells", extra={**synth_ctes(), "vo": value_dist_sql("cells", True),
                                      "vg": value_dist_sql("syn", True)}))
def distribution_fidelity(spark, sf):
    gen_counts = materialize(P.value_counts(synth_cells_df(spark, sf)))
    return Q.distribution_fidelity(cell_counts(spark, sf), gen_counts)


def _corr_sql(keys: str, grp_expr: str) -> str:
    return f"""select {keys.split(',')[0]} as app, {grp_expr} as grp, count(*) as n_features,
       round(case when sum(dx * dx) > 1e-12 and sum(dy * dy) > 1e-12
                  then sum(dx * dy) / sqrt(sum(dx * dx) * sum(dy * dy)) end, 6) as correlation
from (select *, x - avg(x) over (partition by {keys}) as dx, y - avg(y) over (partition by {keys}) as dy from mj) t
group by {keys}"""


@register("profile_correlation", A.with_views(
    _corr_sql("app", "cast(null as integer)") + "\nunion all\n" + _corr_sql("app, grp", "grp"), "cells", extra={
        **synth_ctes(),
        "mo": "select app, grp, slot, avg(v) as x from cells where v is not null group by app, grp, slot",
        "mg": "select app, grp, slot, avg(v) as y from syn where v is not null group by app, grp, slot",
        "mj": "select * from mo join mg using (app, grp, slot)"}))
def profile_correlation(spark, sf):
    gen_counts = materialize(P.value_counts(synth_cells_df(spark, sf)))
    return Q.profile_correlation(cell_counts(spark, sf), gen_counts)

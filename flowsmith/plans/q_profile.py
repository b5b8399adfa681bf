"""Profile queries (A1-A8, A10, U1, W1) on the ``cells`` adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rank import join_null_safe
from ..operators import profile as P
from ..operators import sketches as SK
from ..session import materialize
from ..sources import adapters as A
from .catalog import register
from .common import cell_counts

# --- oracle building blocks --------------------------------------------------

def prof_sql(src: str, by_app: bool, rounded: bool = True, p98: bool = False) -> str:
    """DuckDB text of the (label, group) profile over view ``src``."""
    k = "app, grp" if by_app else "grp"
    rnd = (lambda e: f"round({e}, 6)") if rounded else (lambda e: e)
    pcts = [("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95)] + ([("p98", 0.98)] if p98 else [])
    q_cols = ", ".join(f"quantile_cont(v, {p}) as {n}" for n, p in pcts)
    out_pcts = ", ".join(f"{rnd('q.' + n)} as {n}" for n, _ in pcts)
    using = "(app, grp)" if by_app else "(grp)"
    sel_k = "a.app, a.grp" if by_app else "a.grp"
    return f"""(
  with s as (select {k}, slot, avg(v) as m, stddev_samp(v) as sd, min(v) as mn, max(v) as mx,
                    count(v) as nn, count(*) as nrows, count_if(v = 0) as z
             from {src} group by {k}, slot),
       a as (select {k}, min(mn) as min, max(mx) as max, avg(m) as mean, avg(sd) as std,
                    sum(z) as z, sum(nn) as nn, max(nrows) as sample_count from s group by {k}),
       q as (select {k}, {q_cols} from {src} where v is not null group by {k})
  select {sel_k}, a.min, a.max, {rnd('a.mean')} as mean, {rnd('a.std')} as std, {out_pcts},
         {rnd('case when a.nn > 0 then a.z / a.nn else 0.0e0 end')} as zero_ratio,
         cast(coalesce(a.nn, 0) - coalesce(a.z, 0) as bigint) as non_zero_count,
         cast(a.sample_count as bigint) as sample_count
  from a left join q using {using})"""


def thresholds_sql(src: str, by_app: bool) -> str:
    k = "app, " if by_app else ""
    return f"""
select {k}grp,
  case when grp <> 1 then 0.0e0 end as lower_threshold,
  round(case when grp = 0 then greatest(case when p98 > 0 then least(p98, mean + 3.0e0 * std) else mean + 3.0e0 * std end,
                                        mean + 2.5e0 * std)
             when grp = 2 then greatest(case when p95 > 0 then least(p95, mean + 2.5e0 * std) else mean + 2.5e0 * std end,
                                        mean + 2.0e0 * std) end, 6) as upper_threshold,
  round(case when grp = 0 then std * 0.005e0
             when grp = 2 and std is not null then least(std * 0.05e0, 10.0e0) end, 6) as noise_std,
  case when grp = 1 then 0.05e0 end as binary_tolerance,
  case when grp = 1 then 0.05e0 end as symmetry_break_chance
from {prof_sql(src, by_app, rounded=False, p98=True)} t"""


def value_dist_sql(src: str, by_app: bool) -> str:
    k = "app, grp, slot" if by_app else "grp, slot"
    return f"""
select {k}, v, count(*) as cnt, count(*) / sum(count(*)) over (partition by {k}) as p
from {src} where v is not null group by {k}, v"""


# --- registered queries ------------------------------------------------------

@register("feature_profile", A.with_views("""
select grp, slot, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, min(v) as min, max(v) as max,
       count_if(v = 0) as zeros, count_if(v < 0) as negatives
from cells group by grp, slot""", "cells"))
def feature_profile(spark, sf):
    return P.feature_profile(counts=cell_counts(spark, sf))


@register("label_profile", A.with_views("""
select app, cnt, (select count(*) from lc) as unique_count,
       (select app from lc order by cnt desc, app asc limit 1) as most_common
from lc""", "cells", extra={"lc": "select app, count(*) as cnt from cells where grp = 0 and slot = 0 group by app"}))
def label_profile(spark, sf):
    return P.label_profile(labels=A.label_counts(spark, sf))


@register("dataset_overview", A.with_views("""
select count(distinct flow_id) as total_samples,
       (select count(*) from (select distinct grp, slot from cells_dirty)) as total_features,
       count_if(v is null) + count_if(app is null and grp = 0 and slot = 0) as missing_values
from cells_dirty""", "cells_dirty"))
def dataset_overview(spark, sf):
    return P.dataset_overview(A.cells_dirty(spark, sf))


@register("label_proportions", A.with_views("""
select app, count(*) as cnt, count(*) / sum(count(*)) over () as proportion
from cells where grp = 0 and slot = 0 group by app""", "cells"))
def label_proportions(spark, sf):
    return P.label_proportions(labels=A.label_counts(spark, sf))


@register("group_profile_by_app", A.with_views("select * from " + prof_sql("cells", True) + " t", "cells"))
def group_profile_by_app(spark, sf):
    return P.group_profile(counts=cell_counts(spark, sf), by_app=True)


@register("group_profile_global", A.with_views("select * from " + prof_sql("cells", False) + " t", "cells"))
def group_profile_global(spark, sf):
    return P.group_profile(counts=cell_counts(spark, sf), by_app=False)


@register("group_profile_levels", A.with_views("select 'label' as level, t.* from " + prof_sql("cells", True) + """ t union all
select 'all' as level, cast(null as varchar) as app, t.* from """ + prof_sql("cells", False) + " t", "cells"))
def group_profile_levels(spark, sf):
    """A5 and A6 from one scan of the counts (grouping sets)."""
    return P.group_profile_levels(cell_counts(spark, sf))


@register("group_profile_events", A.with_views("select * from " + prof_sql("cells_events", True) + " t",
                                               "cells_events"))
def group_profile_events(spark, sf):
    """A5 on the second data shape (per user event sequences)."""
    return P.group_profile(counts=cell_counts(spark, sf, "cells_events"), by_app=True)


@register("thresholds_by_app", A.with_views(thresholds_sql("cells", True), "cells"))
def thresholds_by_app(spark, sf):
    return P.thresholds(counts=cell_counts(spark, sf), by_app=True)


@register("thresholds_global", A.with_views(thresholds_sql("cells", False), "cells"))
def thresholds_global(spark, sf):
    return P.thresholds(counts=cell_counts(spark, sf), by_app=False)


@register("value_dist_by_app", A.with_views(value_dist_sql("cells", True), "cells"))
def value_dist_by_app(spark, sf):
    return P.value_dist(A.cells(spark, sf), by_app=True)


@register("value_dist_global", A.with_views(value_dist_sql("cells", False), "cells"))
def value_dist_global(spark, sf):
    return P.value_dist(A.cells(spark, sf), by_app=False)


@register("value_dist_events", A.with_views(value_dist_sql("cells_events", True), "cells_events"))
def value_dist_events(spark, sf):
    return P.value_dist(A.cells_events(spark, sf), by_app=True)


@register("group_distinct_values", A.with_views("select distinct grp, v from cells where v is not null", "cells"))
def group_distinct_values(spark, sf):
    return P.group_distinct_values(A.cells(spark, sf))


@register("high_freq_values", A.with_views("""
select d.app, d.grp, d.slot, d.v, d.p from d join c using (app, grp, slot) where d.p > c.cut""", "cells", extra={
    "d": value_dist_sql("cells", True),
    "c": """select app, grp, slot, quantile_cont(p, 0.75) as cut from d where grp = 0 group by app, grp, slot
            union all
            select app, grp, slot, quantile_cont(p, 0.70) as cut from d where grp = 2 group by app, grp, slot"""}))
def high_freq_values(spark, sf):
    return P.high_freq_values(counts=cell_counts(spark, sf))


RANK_BOUND, DISTINCT_BOUND = 0.01, 0.06       # four times the stated errors, about


@register("sketch_profile", A.with_views("""
select app, grp, count(*) as n, min(v) as min, max(v) as max, true as distinct_ok, """ + ", ".join(f"true as {q}_ok" for q in SK.QUANTILES) + """
from (select app, 0 as grp, ipt as v from packets union all select app, 1, dir from packets union all select app, 2, size from packets) t
group by app, grp""", "packets"))
def sketch_profile(spark, sf):
    """A5 / A10 by sketches: stored per label and day, merged per label; n, min and max, and whether each estimate is within its bound of
    the exact figure."""
    values = materialize(A.packet_values(spark, sf))
    stored = materialize(SK.value_sketches(values, ["app", "day", "grp"]))
    profile = SK.approx_profile(stored, ["app", "grp"])
    errors = SK.profile_errors(profile, values, ["app", "grp"])
    ok = [(F.col(f"{q}_error") <= RANK_BOUND).alias(f"{q}_ok") for q in SK.QUANTILES]
    return join_null_safe(profile.select("app", "grp", "n", "min", "max"), errors, ["app", "grp"]).select(
        "app", "grp", "n", "min", "max", (F.col("distinct_error") <= DISTINCT_BOUND).alias("distinct_ok"), *ok)

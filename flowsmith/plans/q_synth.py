"""Generation queries (G1-G7, J3-J5, W2) on the ``cells`` adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.rand import sql_uniform
from ..operators import alias as AL
from ..operators import profile as P
from ..operators import synth as S
from ..session import materialize
from ..sources import adapters as A
from .catalog import register
from .common import cell_counts
from .q_profile import value_dist_sql

N = K.N_SAMPLES
SEED = K.DEFAULT_SEED

# --- oracle text -------------------------------------------------------------

SCORE_SQL = """case
  when grp = 0 then case when p > 0.05e0 and v >= 0.0001e0 and v <= 1000.0e0 then p * 2.0e0
                         when p > 0.08e0 then p * 1.5e0 end
  when grp = 1 then case when v in (-1.0e0, 0.0e0, 1.0e0) and p > 0.02e0 then p * 5.0e0
                         when abs(v + 1.0e0) < 0.01e0 or abs(v - 1.0e0) < 0.01e0 then p * 3.0e0 end
  when grp = 2 then case when v >= 20 and v <= 1500 and p > 0.04e0 then p * 3.0e0
                         when v > 1500 and v <= 9000 and p > 0.02e0 then p * 2.0e0
                         when p > 0.08e0 then p * 1.5e0 end end"""

BAND_SQL = """case
  when grp = 0 then case when v >= 0.001e0 and v <= 100.0e0 then 20
                         when (v >= 0.0001e0 and v <= 0.001e0) or (v > 100.0e0 and v <= 1000.0e0) then 13
                         when v > 10000.0e0 then 3 else 10 end
  when grp = 1 then case when abs(v + 1.0e0) < 0.001e0 then 100 when abs(v - 1.0e0) < 0.001e0 then 100
                         when abs(v) < 0.001e0 then 50 else 1 end
  else case when v >= 20 and v <= 1500 then 25 when v > 1500 and v <= 9000 then 15
            when v >= 1 and v < 20 then 12 when v > 9000 then 2 when v = 0 then 8 else 10 end end"""


def pref_sql(dist: str, by_app: bool = True) -> str:
    k = "app, grp" if by_app else "grp"
    return f"""
select {k}, v, arg_max(score, slot) as score
from (select *, {SCORE_SQL} as score from {dist}) t
where score is not null group by {k}, v"""


def weights_ctes(src: str = "cells") -> dict[str, str]:
    return {
        "vd": value_dist_sql(src, True),
        "cut": """select app, grp, slot, quantile_cont(p, 0.75) as cut from vd where grp = 0 group by app, grp, slot
                  union all
                  select app, grp, slot, quantile_cont(p, 0.70) as cut from vd where grp = 2 group by app, grp, slot""",
        "hf": "select vd.app, vd.grp, vd.slot, vd.v, true as is_hf from vd join cut using (app, grp, slot) where vd.p > cut.cut",
        "pref": f"select app, grp, v, true as is_pref from ({pref_sql('vd')}) t",
        "w": f"""select app, grp, slot, v, cnt, p,
                   cnt * ({BAND_SQL})
                   * (case when is_hf and grp = 0 then 15 when is_hf and grp = 2 then 14 else 10 end)
                   * (case when is_pref then 15 else 10 end) as weight
                 from (select vd.*, coalesce(hf.is_hf, false) as is_hf, coalesce(pref.is_pref, false) as is_pref
                       from vd left join hf on vd.app = hf.app and vd.grp = hf.grp and vd.slot = hf.slot and vd.v = hf.v
                       left join pref on vd.app = pref.app and vd.grp = pref.grp and vd.v = pref.v) t""",
        "cdf": """select app, grp, slot, v,
                   cast(sum(weight) over (partition by app, grp, slot order by v rows between unbounded preceding and current row)
                        - weight as double) / cast(sum(weight) over (partition by app, grp, slot) as double) as lo,
                   cast(sum(weight) over (partition by app, grp, slot order by v rows between unbounded preceding and current row)
                        as double) / cast(sum(weight) over (partition by app, grp, slot) as double) as hi
                 from w where weight > 0""",
    }


def apportion_ctes(n: int, original: bool = True, src: str = "cells") -> dict[str, str]:
    if original:
        k = f"case when rn = labels then {n} - sum(case when rn < labels then share else 0 end) over () else share end"
    else:
        k = f"cast({n} // labels + case when rn <= {n} % labels then 1 else 0 end as bigint)"
    return {
        "lc": f"select app, count(*) as cnt from {src} where grp = 0 and slot = 0 group by app",
        "ap0": f"""select app, cnt, rn, cast({k} as bigint) as n_samples from (
                   select app, cnt, row_number() over (order by cnt desc, app asc) as rn,
                          count(*) over () as labels, ({n} * cnt) // sum(cnt) over () as share from lc) t""",
        "ap": """select app, cnt, rn, n_samples,
                  cast(sum(n_samples) over (order by rn rows between unbounded preceding and current row) - n_samples
                       as bigint) as start from ap0""",
    }


def draw_ctes(n: int, seed: int = SEED, src: str = "cells") -> dict[str, str]:
    u = sql_uniform(seed, "sample_id", "grp", "slot")
    ctes = dict(weights_ctes(src))
    ctes.update(apportion_ctes(n, True, src))
    ctes.update({
        "sk": f"select r.range as sample_id, ap.app from range(0, {n}) r join ap "
              "on r.range >= ap.start and r.range < ap.start + ap.n_samples",
        "sc": """select sample_id, app, cast(k // 30 as integer) as grp, cast(k % 30 as integer) as slot
                 from (select sample_id, app, unnest(range(0, 90)) as k from sk) t""",
        "su": f"select sample_id, app, grp, slot, {u} as u from sc",
        "raw": """select su.sample_id, su.app, su.grp, su.slot, coalesce(cdf.v, 0.0e0) as v
                  from su left join cdf on su.app = cdf.app and su.grp = cdf.grp and su.slot = cdf.slot
                   and su.u >= cdf.lo and su.u < cdf.hi""",
    })
    return ctes


def clean_sql(id_col: str, seed: int = SEED) -> str:
    ug = sql_uniform(seed, id_col, "grp", "slot", "'gate'")
    uj = sql_uniform(seed, id_col, "grp", "slot", "'jit'")
    return f"""case when v is null then v
  when grp = 0 then case when abs(v) > 0 and {ug} < 0.1e0
                         then greatest(0.0001e0, abs(v) + abs(v) * ({uj} * 0.04e0 - 0.02e0)) else abs(v) end
  when grp = 1 then case when abs(v + 1.0e0) < 0.2e0 then -1.0e0 when abs(v - 1.0e0) < 0.2e0 then 1.0e0 else 0.0e0 end
  else case when round_even(abs(v), 0) > 0 and round_even(abs(v), 0) < 20 then 20.0e0
            else round_even(abs(v), 0) end end"""


def synth_ctes(n: int = N, seed: int = SEED, src: str = "cells") -> dict[str, str]:
    ctes = draw_ctes(n, seed, src)
    ctes["syn"] = f"select sample_id, app, grp, slot, {clean_sql('sample_id', seed)} as v from raw"
    return ctes


def wide_sql(src: str, id_col: str) -> str:
    cols = ",\n  ".join(f"max(case when grp = {g} and slot = {s} then v end) as PPI_{g}_{s}"
                        for g in range(3) for s in range(30))
    return f"select {id_col}, app,\n  {cols}\nfrom {src} group by {id_col}, app"


# --- Spark side -------------------------------------------------------------

def _weights(spark, sf):
    return S.enhanced_weights(cell_counts(spark, sf))


def _labels(spark, sf, source: str = "cells"):
    return A.label_counts(spark, sf) if source == "cells" else A.flow_arrays_events(spark, sf).groupBy("app").agg(F.count(F.lit(1)).alias("cnt"))


def synth_cells_df(spark, sf, n: int = N, seed: int = SEED, source: str = "cells"):
    return S.synthesize_cells(spark, cell_counts(spark, sf, source), n, seed, labels=_labels(spark, sf, source))


def synth_flows_df(spark, sf, n: int = N, seed: int = SEED):
    return S.synthesize_flows(spark, cell_counts(spark, sf), n, seed, labels=_labels(spark, sf))


@register("apportion_original", A.with_views("select app, cnt, rn, n_samples, start from ap", "cells",
                                             extra=apportion_ctes(N, True)))
def apportion_original(spark, sf):
    lc = A.label_counts(spark, sf)
    return S.apportion(lc, N, True).withColumn("rn", F.col("rn").cast("bigint"))


@register("apportion_equal", A.with_views("select app, cnt, rn, n_samples, start from ap", "cells",
                                          extra=apportion_ctes(N, False)))
def apportion_equal(spark, sf):
    lc = A.label_counts(spark, sf)
    return S.apportion(lc, N, False).withColumn("rn", F.col("rn").cast("bigint"))


@register("preferred_patterns", A.with_views(pref_sql("vd"), "cells", extra={"vd": value_dist_sql("cells", True)}))
def preferred_patterns(spark, sf):
    return S.preferred_patterns(P.value_dist(counts=cell_counts(spark, sf)))


@register("preferred_patterns_global", A.with_views(pref_sql("vd", False), "cells",
                                                    extra={"vd": value_dist_sql("cells", False)}))
def preferred_patterns_global(spark, sf):
    return S.preferred_patterns(P.value_dist(counts=cell_counts(spark, sf), by_app=False), by_app=False)


@register("enhanced_weights", A.with_views(
    "select app, grp, slot, v, cnt, p, weight, weight / sum(weight) over (partition by app, grp, slot) as w_norm from w",
    "cells", extra=weights_ctes()))
def enhanced_weights(spark, sf):
    return _weights(spark, sf)


@register("value_cdf", A.with_views("select * from cdf", "cells", extra=weights_ctes()))
def value_cdf(spark, sf):
    return S.value_cdf(_weights(spark, sf))


@register("sample_skeleton", A.with_views("select * from sk", "cells", extra=draw_ctes(N)))
def sample_skeleton(spark, sf):
    lc = A.label_counts(spark, sf)
    return S.sample_skeleton(spark, S.apportion(lc, N, True), N)


@register("weighted_draw", A.with_views("select * from raw", "cells", extra=draw_ctes(N)))
def weighted_draw(spark, sf):
    return S.raw_draws(spark, cell_counts(spark, sf), N, SEED, labels=_labels(spark, sf))


@register("synthesize_cells", A.with_views("select * from syn", "cells", extra=synth_ctes()))
def synthesize_cells(spark, sf):
    return synth_cells_df(spark, sf)


@register("synthesize_flows", A.with_views(wide_sql("syn", "sample_id"), "cells", extra=synth_ctes()))
def synthesize_flows(spark, sf):
    return S.to_wide(synth_flows_df(spark, sf))


@register("synthesize_events", A.with_views("select * from syn", "cells_events",
                                            extra=synth_ctes(src="cells_events")))
def synthesize_events(spark, sf):
    """G6 on the second data shape."""
    return synth_cells_df(spark, sf, source="cells_events")


@register("preferred_pattern_counts", A.with_views(
    "select app, grp, count(*) as n_patterns from (" + pref_sql("vd") + ") t group by app, grp", "cells",
    extra={"vd": value_dist_sql("cells", True)}))
def preferred_pattern_counts(spark, sf):
    """Number of preferred values per (label, group)."""
    pp = S.preferred_patterns(P.value_dist(counts=cell_counts(spark, sf)))
    return pp.groupBy("app", "grp").agg(F.count(F.lit(1)).alias("n_patterns"))


K3 = "app, grp, slot"
ALIAS_CTES = {
    "al0": f"""select {K3}, v, weight::hugeint * count(*) over (partition by {K3}) as s, sum(weight) over (partition by {K3})::hugeint as total,
                      count(*) over (partition by {K3}) as cells, row_number() over (partition by {K3} order by v) - 1 as idx
               from w where weight > 0""",
    "al1": f"""select *, s < total as light, sum(abs(s - total)) over (partition by {K3}, s < total order by v rows between unbounded preceding and current row)
                      ::hugeint as cum from al0""",
    "al2": "select *, case when light then cum - (total - s) else cum end as place, case when light then 1 else 0 end as late from al1",
    "al3": f"""select *, first_value(case when not light then v end ignore nulls) over (partition by {K3} order by place, late, v
                           rows between 1 following and unbounded following) as next_v,
                      max(case when light then cum end) over (partition by {K3} order by place, late, v rows between unbounded preceding and 1 preceding) as filled
               from al2""",
    "al": f"""select {K3}, cells, idx, v, (case when light then s else total + place - coalesce(filled, 0) end)::double / total::double as keep,
                     coalesce(next_v, v) as other from al3""",
}


def _alias(spark, sf):
    return materialize(AL.alias_table(_weights(spark, sf)))


@register("alias_table", A.with_views("select * from al", "cells", extra={**weights_ctes(), **ALIAS_CTES}))
def alias_table(spark, sf):
    """J5 by alias tables: one cell per distinct value of each (label, column)."""
    return _alias(spark, sf)


@register("alias_draw", A.with_views(f"""
select c.sample_id, c.app, c.grp, c.slot, coalesce(case when c.u < al.keep then al.v else al.other end, 0.0e0) as v
from (select sc.*, {sql_uniform(SEED, "sample_id", "sc.grp", "sc.slot", "'side'")} as u,
             cast(floor({sql_uniform(SEED, "sample_id", "sc.grp", "sc.slot", "'cell'")} * n.cells) as bigint) as idx
      from sc left join (select distinct {K3}, cells from al) n on n.app = sc.app and n.grp = sc.grp and n.slot = sc.slot) c
left join al on al.app = c.app and al.grp = c.grp and al.slot = c.slot and al.idx = c.idx""", "cells", extra={**draw_ctes(N), **ALIAS_CTES}))
def alias_draw(spark, sf):
    """G6's draws by alias tables: two uniform numbers and one equal join per cell."""
    table = _alias(spark, sf)
    skeleton = S.sample_skeleton(spark, S.apportion(_labels(spark, sf), N, True), N)
    return AL.alias_draw(S.skeleton_cells(skeleton, AL.cell_counts(table)), table, SEED, table.count() <= S.BROADCAST_ROWS)

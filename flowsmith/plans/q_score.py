"""Surprise score, repair policy and repair.

Input: 10,000 generated flows (G6) with the planted-violation perturbation
applied by sample id, scored by the bigram model counted on ``cells``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.stats import top_k
from ..operators import flowtable as FT
from ..operators import profile as P
from ..operators import quality as Q
from ..operators import repair as R
from ..operators import synth as S
from ..operators import tokens as T
from ..session import materialize
from ..sources import adapters as A
from .catalog import register
from .common import cell_counts
from .q_profile import thresholds_sql
from .q_quality import OVERALL_SEL, q_agg_sql
from .q_synth import synth_cells_df, synth_ctes
from .q_tokens import corpus_ctes, quant_sql

WORST_K = 100


class Run:
    """The stages of one scoring / repair run; each stage is built on first
    use and written once, so a query pays only for the stages it needs.
    ``corpus``: the source flows themselves are scored and repaired, not 10,000 generated ones."""

    def __init__(self, spark, sf, corpus: bool = False):
        self.spark, self.sf, self.corpus = spark, sf, corpus
        self._cache = {}

    def _get(self, name, build):
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    @property
    def flows(self):
        """The source flows, written once: read by the counts and the model."""
        return self._get("flows", lambda: materialize(A.flow_arrays(self.spark, self.sf)))

    @property
    def labels(self):
        return self._get("labels", lambda: materialize(P.label_counts(self.flows)))

    @property
    def counts(self):
        return self._get("counts", lambda: materialize(P.value_counts(FT.to_cells(self.flows))))

    @property
    def voc(self):
        return self._get("voc", lambda: materialize(T.vocab(self.spark)))

    @property
    def dirty(self):
        """The flows to be scored, with planted violations (sample_id, app, arrays)."""
        def build():
            if self.corpus:
                return A.perturb(self.flows).withColumnRenamed("flow_id", "sample_id")
            return A.perturb(S.synthesize_flows(self.spark, self.counts, K.N_SAMPLES, K.DEFAULT_SEED, labels=self.labels), "sample_id")
        return self._get("dirty", lambda: materialize(build()))

    @property
    def model(self):
        return self._get("model", lambda: R.fit_bigram(self.flows, self.voc))

    @property
    def scores(self):
        return self._get("scores", lambda: materialize(R.score(self.dirty, self.model, self.voc)))

    @property
    def policy(self):
        return self._get("policy", lambda: materialize(R.policy(self.scores)))

    @property
    def cands(self):
        return self._get("cands", lambda: materialize(R.candidates(self.scores, self.policy.first())))

    @property
    def repaired(self):
        def build():
            limits = R.resolve_thresholds(self.labels, P.thresholds(counts=self.counts, by_app=True),
                                          P.thresholds(counts=self.counts, by_app=False))
            chosen = self.dirty.join(self.cands.select("sample_id"), "sample_id", "left_semi")
            return materialize(R.repair(chosen, limits))
        return self._get("repaired", build)

    @property
    def accepted(self):
        new_scores = R.score(self.repaired, self.model, self.voc)
        return self._get("accepted", lambda: materialize(
            R.accept(self.cands, new_scores, self.repaired.select("sample_id", "changed"))))

    def final(self):
        keep = self.accepted.where("accepted").select("sample_id")
        fixed = self.repaired.join(keep, "sample_id", "left_semi").select(*self.dirty.columns)
        return self.dirty.join(keep, "sample_id", "left_anti").unionByName(fixed)


# --- oracle text ---------------------------------------------------------------

def score_ctes(corpus: bool = False) -> dict[str, str]:
    source = {"syn": "select flow_id as sample_id, app, grp, slot, v from cells"} if corpus else synth_ctes()
    ctes = {**source, **corpus_ctes()}
    dirty = """select sample_id, app, grp, slot,
  case when (sample_id + slot) % 101 = 0 then null
       when grp = 0 and (sample_id + slot) % 97 = 0 then -v - 1
       when grp = 0 and (sample_id + slot) % 89 = 0 then v * 1000 + 20000
       when grp = 1 and (sample_id + slot) % 53 = 0 then 0.4e0
       when grp = 1 and (sample_id + slot) % 59 = 0 then -0.97e0
       when grp = 1 and (sample_id + slot) % 61 = 0 then 1.5e0
       when grp = 2 and (sample_id + slot) % 71 = 0 then -v
       when grp = 2 and (sample_id + slot) % 73 = 0 then 12.5e0
       when grp = 2 and (sample_id + slot) % 79 = 0 then 30000.0e0
       else v end as v
from syn"""
    unk = "(select token_id from voc where token = '<UNK_VAL>')"
    ncls = "(select count(*) from voc where token like '<VAL_%' or token = '<UNK_VAL>')"

    def scored(src: str) -> str:
        return f"""select sample_id, app,
       case when count(*) < 90 then 1000.0e0
            else round(exp(avg(-ln((coalesce(bg.c, 0) + 1) / (coalesce(cx.nctx, 0) + {ncls})))), 6) end as ppl
from (select *, coalesce(lag(tok) over (partition by sample_id, grp order by slot), -1) as prev
      from (select s.sample_id, s.app, s.grp, s.slot, s.v, coalesce(voc.token_id, {unk}) as tok
            from {src} s left join voc on voc.token = {quant_sql('s.v')}) t) x
left join bg using (grp, slot, prev, tok) left join cx using (grp, slot, prev)
group by sample_id, app"""

    ctes.update({
        "ds": dirty,
        "ovp": """select grp, slot, coalesce(lag(value_id) over (partition by id, grp order by slot), -1) as prev,
                         value_id as tok from ct""",
        "bg": "select grp, slot, prev, tok, count(*) as c from ovp group by grp, slot, prev, tok",
        "cx": "select grp, slot, prev, sum(c) as nctx from bg group by grp, slot, prev",
        "pscore": scored("ds"),
        "pol0": """select count(*) as n, quantile_cont(ppl, 0.5) as median, quantile_cont(ppl, 0.75) as p75,
                          quantile_cont(ppl, 0.9) as p90, quantile_cont(ppl, 0.95) as p95,
                          count_if(ppl = 1000.0e0) as failures from pscore""",
        "pol": """select *, case when median < 50 then p95 else greatest(p90, 8.0e0) end as threshold,
                         case when median < 50 then 0.05e0 else 0.10e0 end as max_rate,
                         cast(floor(n * case when median < 50 then 0.05e0 else 0.10e0 end) as bigint) as budget
                  from pol0""",
        "ab": "select pscore.* from pscore, pol where pscore.ppl > pol.threshold",
        "cand": """select sample_id, app, ppl from (
                     select ab.*, row_number() over (order by ppl desc, sample_id asc) as rk from ab) t
                   where rk <= (select budget from pol)""",
        "ta": thresholds_sql("cells", True),
        "tg": thresholds_sql("cells", False),
        "lim": """select l.app, tg.grp, case when ta.app is not null then ta.upper_threshold else tg.upper_threshold end as upper_threshold,
                         case when ta.app is not null then ta.binary_tolerance else tg.binary_tolerance end as binary_tolerance
                  from (select distinct app from cells) l, tg left join ta on ta.app = l.app and ta.grp = tg.grp""",
        "rep": """select d.sample_id, d.app, d.grp, d.slot, d.v,
  case when d.v is null then d.v
       when d.grp = 0 then case when d.v < 0 then abs(d.v) when d.v > lim.upper_threshold * 3.0e0
                                then least(10000.0e0, d.v * 0.5e0) else d.v end
       when d.grp = 1 then case
            when not (abs(d.v + 1.0e0) <= lim.binary_tolerance or abs(d.v - 1.0e0) <= lim.binary_tolerance
                      or abs(d.v) <= lim.binary_tolerance)
            then case when abs(d.v + 1.0e0) <= abs(d.v - 1.0e0) and abs(d.v + 1.0e0) <= abs(d.v) then -1.0e0
                      when abs(d.v - 1.0e0) <= abs(d.v) then 1.0e0 else 0.0e0 end
            when abs(d.v + 1.0e0) <= lim.binary_tolerance then -1.0e0
            when abs(d.v - 1.0e0) <= lim.binary_tolerance then 1.0e0 else 0.0e0 end
       else case when d.v < 0 then abs(d.v) when d.v > lim.upper_threshold * 2.0e0 then least(9000.0e0, d.v * 0.6e0)
                 when d.v > 0 and d.v < 20 then 20.0e0 else d.v end end as v_new
from ds d join cand c on d.sample_id = c.sample_id left join lim on lim.app = d.app and lim.grp = d.grp""",
        "rep_v": "select sample_id, app, grp, slot, v_new as v from rep",
        "nsc": scored("rep_v"),
        "chg": "select sample_id, bool_or(v_new is distinct from v) as changed from rep group by sample_id",
        "acc": """select c.sample_id, c.app, c.ppl as old_ppl, n.ppl as new_ppl, g.changed,
                         g.changed and n.ppl < c.ppl * 0.95e0 as accepted
                  from cand c join nsc n on c.sample_id = n.sample_id join chg g on g.sample_id = c.sample_id""",
        "fin": """select d.sample_id, d.app, d.grp, d.slot, coalesce(r.v_new, d.v) as v from ds d
                  left join (select rep.* from rep join acc on acc.sample_id = rep.sample_id where acc.accepted) r
                  on r.sample_id = d.sample_id and r.grp = d.grp and r.slot = d.slot""",
    })
    return ctes


# --- registered queries ----------------------------------------------------------

@register("row_perplexity", A.with_views("select * from pscore", "cells", extra=score_ctes()))
def row_perplexity(spark, sf):
    return Run(spark, sf).scores


@register("perplexity_policy", A.with_views("""
select n as n_samples, round(median, 6) as median, round(p75, 6) as p75, round(p90, 6) as p90, round(p95, 6) as p95,
       round(threshold, 6) as threshold, max_rate, budget, (select count(*) from ab) as n_above,
       least((select count(*) from ab), budget) as n_selected, failures as encoding_failures
from pol""", "cells", extra=score_ctes()))
def perplexity_policy(spark, sf):
    return Run(spark, sf).policy.drop("raw_threshold")


@register("repair_candidates", A.with_views("select * from cand", "cells", extra=score_ctes()))
def repair_candidates(spark, sf):
    return Run(spark, sf).cands


@register("worst_k", A.with_views(f"""
select sample_id, app, ppl from (select *, row_number() over (order by ppl desc, sample_id asc) as rk from pscore) t
where rk <= {WORST_K}""", "cells", extra=score_ctes()))
def worst_k(spark, sf):
    """The k most surprising generated flows (k = 100, ties by id)."""
    return top_k(Run(spark, sf).scores, "ppl", "sample_id", WORST_K)


@register("repair_rules", A.with_views("select * from rep where v_new is distinct from v", "cells",
                                       extra=score_ctes()))
def repair_rules(spark, sf):
    r = R.repaired_cells(Run(spark, sf).repaired)
    return r.where(~F.col("v_new").eqNullSafe(F.col("v")))


@register("repair_accept", A.with_views("select * from acc", "cells", extra=score_ctes()))
def repair_accept(spark, sf):
    return Run(spark, sf).accepted


STATS_SQL = """
select (select count(*) from pscore) as n_samples, count(*) as n_candidates,
       count(*) filter (where changed) as n_changed, count(*) filter (where accepted) as n_accepted,
       round(100.0e0 * count(*) filter (where accepted) / greatest(1, count(*)), 6) as success_rate
from acc"""


def _stats(run):
    n = run.scores.count()
    return run.accepted.agg(
        F.lit(n).cast("bigint").alias("n_samples"), F.count(F.lit(1)).alias("n_candidates"),
        F.count(F.when(F.col("changed"), 1)).alias("n_changed"),
        F.count(F.when(F.col("accepted"), 1)).alias("n_accepted"),
        F.round(100.0 * F.count(F.when(F.col("accepted"), 1)) / F.greatest(F.lit(1), F.count(F.lit(1))), 6)
         .alias("success_rate"))


@register("repair_stats", A.with_views(STATS_SQL, "cells", extra=score_ctes()))
def repair_stats(spark, sf):
    return _stats(Run(spark, sf))


@register("corpus_perplexity", A.with_views("select * from pscore", "cells", extra=score_ctes(corpus=True)))
def corpus_perplexity(spark, sf):
    """M3 over all source flows (with planted violations)."""
    return Run(spark, sf, corpus=True).scores


@register("corpus_repair", A.with_views("select * from acc", "cells", extra=score_ctes(corpus=True)))
def corpus_repair(spark, sf):
    """M4-M7 over all source flows: policy, candidates, repair and its acceptance."""
    return Run(spark, sf, corpus=True).accepted


@register("corpus_repair_stats", A.with_views(STATS_SQL, "cells", extra=score_ctes(corpus=True)))
def corpus_repair_stats(spark, sf):
    return _stats(Run(spark, sf, corpus=True))


def _delta_sql() -> str:
    b = q_agg_sql("ds", "sample_id")
    a = q_agg_sql("fin", "sample_id")
    cols = ("timing_score", "direction_score", "size_score", "overall_score")
    return f"""select {', '.join(f'b.{c} as before_{c}' for c in cols)}, {', '.join(f'a.{c} as after_{c}' for c in cols)},
       round(a.overall_score - b.overall_score, 6) as improvement
from ({OVERALL_SEL.replace('from qa', f'from ({b}) qa')}) b, ({OVERALL_SEL.replace('from qa', f'from ({a}) qa')}) a"""


@register("quality_delta", A.with_views(_delta_sql(), "cells", extra=score_ctes()))
def quality_delta(spark, sf):
    run = Run(spark, sf)
    return Q.quality_delta(FT.to_cells(run.dirty, "sample_id"), FT.to_cells(run.final(), "sample_id"))


@register("thresholds_resolved", A.with_views("""
select l.app, tg.grp,
       case when ta.app is not null then ta.upper_threshold else tg.upper_threshold end as upper_threshold,
       case when ta.app is not null then ta.noise_std else tg.noise_std end as noise_std,
       case when ta.app is not null then ta.binary_tolerance else tg.binary_tolerance end as binary_tolerance,
       case when ta.app is not null then 'app' else 'global' end as source
from (select distinct app from cells union select distinct app from cells_events) l, tg
left join ta on ta.app = l.app and ta.grp = tg.grp""", "cells", "cells_events", extra={
    "ta": thresholds_sql("cells", True), "tg": thresholds_sql("cells", False)}))
def thresholds_resolved(spark, sf):
    """Limits for the labels of both shapes; labels without a profile of
    their own (the event segments) fall back to the global limits."""
    counts = cell_counts(spark, sf)
    labels = counts.select("app").unionByName(A.flow_arrays_events(spark, sf).select("app"))
    return R.resolve_thresholds(labels, P.thresholds(counts=counts, by_app=True),
                                P.thresholds(counts=counts, by_app=False))

"""Surprise score of generated flows, and rule repair of the worst ones.

Score (M3): a bigram model of value tokens counted on the source corpus -
P(token | group, slot, previous value token of the same group, or START),
add-one smoothed over the value classes.  A flow's score is
exp(mean negative log-likelihood) over its 90 value tokens.  A missing value
quantizes like the source codec does (max(1, NaN) -> the first bin); a flow
with absent cells (fewer than 90 value tokens) cannot be encoded and scores
1000.  The count table is bounded
by the vocabulary (90 x 168 x 167 rows) whatever the corpus size.

Policy (M4-M7): percentiles of the scores pick a threshold and a budget; the
worst flows above the threshold (at most the budget) get the rule repair;
a repair is kept only when it lowers the score by more than 5 %.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.rank import join_null_safe
from ..functions.scalar import snap_direction
from ..functions.stats import global_percentiles, top_k
from ..session import materialize
from . import flowtable as FT
from . import tokens as T

START = -1
BIGRAM_BROADCAST_ROWS = 3_000_000   # 90 x 168 x 167 = 2.5M: the largest possible table
SHIFT = 1 << 16                     # token ids are below


def _table(flows: DataFrame, id_col: str) -> DataFrame:
    return flows if FT.is_flow_table(flows) else FT.from_cells(flows, id_col)


def _steps(flows: DataFrame, voc: DataFrame, id_col: str) -> DataFrame:
    """(id, app, cell, prev, token): one row per cell, with the token before it in its group (START for the first), as
    numbers.  A complete flow's values are laid beside the values before them as whole arrays; tokens are found after the explode."""
    ids = T.token_ids(voc)

    def cell(g: int):
        return lambda v, s: F.struct((s + g * K.N_SLOTS).alias("cell"), v.alias("v"))

    entries = {f"_e{g}": FT.unless_absent(F.transform(name, cell(g)), lambda e: e["cell"]) for g, name in enumerate(FT.GROUPS)}
    none, groups, shifted = F.array(F.lit(None).cast("double")), [], []
    for g, name in enumerate(FT.GROUPS):
        e = entries[f"_e{g}"]
        before = F.concat(none, F.slice(e["v"], F.lit(1), F.greatest(F.size(e) - 1, F.lit(0))))
        groups.append(F.transform(F.arrays_zip(e.alias("e"), before.alias("before")), lambda z, k: F.struct(
            z["e"]["cell"].alias("cell"), (k == 0).alias("first"), z["before"].alias("before"), z["e"]["v"].alias("v"))))
        shifted += [none, F.slice(name, 1, K.N_SLOTS - 1)]
    cells = F.array(*[F.lit(k) for k in range(FT.N_CELLS)])
    first = F.array(*[F.lit(k % K.N_SLOTS == 0) for k in range(FT.N_CELLS)])
    complete = F.arrays_zip(cells.alias("cell"), first.alias("first"), F.concat(*shifted).alias("before"), FT.values(flows).alias("v"))
    partly = F.filter(F.concat(*groups), lambda x: x["cell"].isNotNull())     # a group without cells leaves its START alone
    s = F.explode(F.when(F.size("absent") == 0, complete).otherwise(partly)).alias("s")
    return flows.select(id_col, "app", s).select(
        id_col, "app", "s.cell", F.when(F.col("s.first"), F.lit(START)).otherwise(T.value_id(F.col("s.before"), ids)).alias("prev"),
        T.value_id(F.col("s.v"), ids).alias("token"))


def _context() -> Column:
    """(cell, previous token) as one number."""
    return F.col("cell").cast("bigint") * SHIFT + F.col("prev") + 1


def fit_bigram(flows: DataFrame, voc: DataFrame, id_col: str = "flow_id") -> tuple[DataFrame, DataFrame, int]:
    """(bigram counts by context and token, context counts, number of value classes); both count
    tables are written once (they are read by every scoring pass).  Takes flows or cells; flows are not shuffled, only counts are."""
    steps = _steps(_table(flows, id_col), voc, id_col).select(_context().alias("ctx"), "token")
    bigram = materialize(steps.groupBy("ctx", "token").agg(F.count(F.lit(1)).alias("c")))
    contexts = materialize(bigram.groupBy("ctx").agg(F.sum("c").alias("nctx")))
    classes = voc.where(F.col("kind").isin("value", "special_value", "unknown")).count()
    return bigram, contexts, classes


def score(flows: DataFrame, model: tuple[DataFrame, DataFrame, int], voc: DataFrame,
          id_col: str = "sample_id") -> DataFrame:
    """M3: (id, app, ppl) rounded to 6 places.  Takes flows or cells.  Cells are looked up in the broadcast counts where their
    flow lies and added up there, so one row per flow and task is shuffled at most."""
    bigram, contexts, classes = model
    steps = _steps(_table(flows, id_col), voc, id_col).select(id_col, "app", _context().alias("ctx"), "token")
    b = bigram.select((F.col("ctx") * SHIFT + F.col("token")).alias("pair"), "c")
    if bigram.count() <= BIGRAM_BROADCAST_ROWS:   # bounded by the vocabulary: always true
        b = F.broadcast(b)
    j = (steps.withColumn("pair", F.col("ctx") * SHIFT + F.col("token")).join(b, "pair", "left")
         .join(F.broadcast(contexts), "ctx", "left"))
    p = (F.coalesce(F.col("c"), F.lit(0)) + 1) / (F.coalesce(F.col("nctx"), F.lit(0)) + classes)
    agg = j.groupBy(id_col, "app").agg(F.count(F.lit(1)).alias("_n"), F.avg(-F.log(p)).alias("_nll"))
    return agg.select(id_col, "app", F.when(F.col("_n") < T.N_CELLS, F.lit(K.PERPLEXITY_FAILURE))
                      .otherwise(F.round(F.exp("_nll"), 6)).alias("ppl"))


def policy(scores: DataFrame) -> DataFrame:
    """M4: one row - percentiles, threshold, rate, budget, how many are above
    the threshold, how many get selected, encoding failures."""
    pct = global_percentiles(scores, "ppl", {"median": 0.5, "p75": 0.75, "p90": 0.90, "p95": 0.95})
    narrow = F.col("median") < K.MEDIAN_CUTOFF
    pol = pct.select("n", "median", "p75", "p90", "p95",
                     F.when(narrow, F.col("p95")).otherwise(F.greatest(F.col("p90"), F.lit(K.PERPLEXITY_THRESHOLD))).alias("threshold"),
                     F.when(narrow, F.lit(K.REPAIR_RATE_NARROW)).otherwise(F.lit(K.REPAIR_RATE_WIDE)).alias("max_rate"))
    pol = pol.withColumn("budget", F.floor(F.col("n") * F.col("max_rate")).cast("bigint"))
    row = pol.first()
    above = scores.where(F.col("ppl") > F.lit(row["threshold"])).count()
    failures = scores.where(F.col("ppl") == K.PERPLEXITY_FAILURE).count()
    return pol.select(F.col("n").alias("n_samples"),
                      *[F.round(c, 6).alias(c) for c in ("median", "p75", "p90", "p95", "threshold")],
                      F.col("threshold").alias("raw_threshold"), "max_rate", "budget", F.lit(above).cast("bigint").alias("n_above"),
                      F.least(F.lit(above), F.col("budget")).cast("bigint").alias("n_selected"),
                      F.lit(failures).cast("bigint").alias("encoding_failures"))


def candidates(scores: DataFrame, pol_row, id_col: str = "sample_id") -> DataFrame:
    """M5: scores above the threshold; beyond the budget the worst ``budget``
    (score desc, then id).  A budget of 0 selects none."""
    above = scores.where(F.col("ppl") > F.lit(pol_row["raw_threshold"]))
    if pol_row["n_above"] <= pol_row["budget"]:
        return above
    return top_k(above, "ppl", id_col, int(pol_row["budget"]))


def resolve_thresholds(labels: DataFrame, by_app: DataFrame, glob: DataFrame) -> DataFrame:
    """Per (label, group) the label's limits, or the global ones when the
    label has none.  ``labels`` has one row per label; the global table has 3."""
    g = glob.select("grp", F.col("upper_threshold").alias("g_upper"), F.col("binary_tolerance").alias("g_tol"),
                    F.col("noise_std").alias("g_noise"))
    apps = labels.select("app").distinct()
    # every label x the 3 groups: the group list is fixed, so this is a narrow explode
    per = apps.select("app", F.explode(F.array(*[F.lit(i) for i in range(K.N_GROUPS)])).alias("grp"))
    a = by_app.select("app", "grp", F.col("upper_threshold").alias("a_upper"),
                      F.col("binary_tolerance").alias("a_tol"), F.col("noise_std").alias("a_noise"),
                      F.lit(True).alias("_has"))
    j = join_null_safe(per, a, ["app", "grp"], "left").join(F.broadcast(g), "grp", "left")
    has = F.coalesce(F.col("_has"), F.lit(False))
    return j.select("app", "grp",
                    F.when(has, F.col("a_upper")).otherwise(F.col("g_upper")).alias("upper_threshold"),
                    F.when(has, F.col("a_noise")).otherwise(F.col("g_noise")).alias("noise_std"),
                    F.when(has, F.col("a_tol")).otherwise(F.col("g_tol")).alias("binary_tolerance"),
                    F.when(has, F.lit("app")).otherwise(F.lit("global")).alias("source"))


def repair_value(grp: Column, v: Column, upper: Column, tol: Column) -> Column:
    """M6 on one cell."""
    g0 = (F.when(v < 0, F.abs(v))
          .when(v > upper * K.TIMING_OUTLIER_FACTOR, F.least(F.lit(K.TIMING_CAP), v * K.TIMING_SHRINK))
          .otherwise(v))
    g2 = (F.when(v < 0, F.abs(v))
          .when(v > upper * K.SIZE_OUTLIER_FACTOR, F.least(F.lit(K.SIZE_CAP), v * K.SIZE_SHRINK))
          .when((v > 0) & (v < K.MIN_PACKET), F.lit(K.MIN_PACKET))
          .otherwise(v))
    return (F.when(v.isNull(), v).when(grp == 0, g0)
            .when(grp == 1, snap_direction(v, tol)).otherwise(g2))


def repair(flows: DataFrame, limits: DataFrame) -> DataFrame:
    """M6: the candidates (as flows) with ``changed`` and the repaired values in place; the old ones are in ``old_`` columns.
    ``limits`` from ``resolve_thresholds`` become one row per label, joined once per flow; the rules work within the row."""
    per = limits.groupBy("app").agg(*[F.max(F.when(F.col("grp") == g, F.col(c))).alias(f"_{c}{g}")
                                      for g in range(K.N_GROUPS) for c in ("upper_threshold", "binary_tolerance")])
    if per.count() <= T.LABEL_BROADCAST_ROWS:
        per = F.broadcast(per)
    j = join_null_safe(flows, per, ["app"], "left")
    for name in FT.GROUPS:
        j = j.withColumn(f"old_{name}", F.col(name))
    fixed = FT.map_values(j, lambda g, slot, v: repair_value(F.lit(g), v, F.col(f"_upper_threshold{g}"), F.col(f"_binary_tolerance{g}")))
    same = F.lit(True)
    for name in FT.GROUPS:
        same = same & F.col(name).eqNullSafe(F.col(f"old_{name}"))
    return fixed.withColumn("changed", ~same).select(*flows.columns, *[f"old_{n}" for n in FT.GROUPS], "changed")


def repaired_cells(repaired: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """(id, app, grp, slot, v, v_new) of the repaired flows, a narrow explode."""
    both = [F.arrays_zip(F.col(f"old_{n}").alias("v"), F.col(n).alias("v_new")) for n in FT.GROUPS]
    entries = F.transform(F.concat(*both), lambda e, k: F.struct(
        (k / K.N_SLOTS).cast("int").alias("grp"), (k % K.N_SLOTS).cast("int").alias("slot"), e["v"].alias("v"), e["v_new"].alias("v_new")))
    entries = FT.unless_absent(entries, lambda e: e["grp"] * K.N_SLOTS + e["slot"])
    return repaired.select(id_col, "app", F.explode(entries).alias("c")).select(id_col, "app", "c.grp", "c.slot", "c.v", "c.v_new")


def accept(old_scores: DataFrame, new_scores: DataFrame, changed: DataFrame,
           id_col: str = "sample_id") -> DataFrame:
    """M7: per candidate: old and new score, whether any cell changed and
    whether the repair is kept (changed and new < 0.95 old)."""
    j = (old_scores.select(id_col, "app", F.col("ppl").alias("old_ppl"))
         .join(new_scores.select(id_col, F.col("ppl").alias("new_ppl")), id_col)
         .join(changed, id_col))
    return j.withColumn("accepted", F.col("changed") & (F.col("new_ppl") < F.col("old_ppl") * K.ACCEPT_FACTOR))

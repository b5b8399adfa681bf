"""Reshape (P2, P3) and per-cell clean-up / augmentation (F4-F7) queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.rand import normal, sql_uniform, uniform
from ..functions.stats import r6
from ..operators import synth as S
from ..sources import adapters as A
from ..sources import flowfiles as FF
from .catalog import register
from .q_synth import clean_sql, wide_sql


@register("flow_pivot", A.with_views(wide_sql("cells", "flow_id"), "cells"))
def flow_pivot(spark, sf):
    """Cells -> one row per flow with 90 feature columns."""
    return S.to_wide(A.cells(spark, sf), "flow_id")


@register("flow_unpivot", A.with_views("select flow_id, app, grp, slot, v from cells", "cells"))
def flow_unpivot(spark, sf):
    """The wide form back to cells (round trip of P3)."""
    return FF.wide_to_cells(S.to_wide(A.cells(spark, sf), "flow_id"), "flow_id")


def _clean_query(g: int):
    def run(spark, sf):
        c = A.cells_dirty(spark, sf).where(F.col("grp") == g)
        return S.clean_cells(c, K.DEFAULT_SEED, id_col="flow_id", out_col="v_clean").select(
            "flow_id", "app", "slot", "v", "v_clean")
    return run


def _clean_sql(g: int) -> str:
    return A.with_views(f"""
select flow_id, app, slot, v, {clean_sql('flow_id')} as v_clean from cells_dirty where grp = {g}""", "cells_dirty")


register("clean_timing", _clean_sql(0))(_clean_query(0))
register("clean_direction", _clean_sql(1))(_clean_query(1))
register("clean_size", _clean_sql(2))(_clean_query(2))


def augment(cells, seed: int = K.DEFAULT_SEED, id_col: str = "flow_id", include_direction: bool = False):
    """with chance 0.3 per flow, every feature value gets Gaussian noise
    N(0, 0.05 |v|), floored at 0.  Direction is left alone unless
    ``include_direction`` (the floor at 0 would erase -1)."""
    gate = uniform(seed, F.col(id_col), "aug") < K.AUGMENT_CHANCE
    noisy = F.greatest(F.lit(0.0), F.col("v") + normal(seed, F.col(id_col), F.col("grp"), F.col("slot"))
                       * (F.abs(F.col("v")) * K.AUGMENT_SCALE))
    touch = gate if include_direction else gate & (F.col("grp") != 1)
    return cells.withColumn("v_aug", F.when(touch, noisy).otherwise(F.col("v")))


_BM = (f"sqrt(-2.0e0 * ln(1.0e0 - {sql_uniform(42, 'flow_id', 'grp', 'slot', repr('bm1'))}))"
       f" * cos({2.0 * math.pi!r}e0 * {sql_uniform(42, 'flow_id', 'grp', 'slot', repr('bm2'))})")


@register("augment_noise", A.with_views(f"""
select flow_id, app, grp, slot, v,
       round(case when {sql_uniform(42, 'flow_id', repr('aug'))} < 0.3e0 and grp <> 1
                  then greatest(0.0e0, v + {_BM} * (abs(v) * 0.05e0)) else v end, 6) as v_aug
from cells""", "cells"))
def augment_noise(spark, sf):
    out = augment(A.cells(spark, sf))
    return out.withColumn("v_aug", r6("v_aug"))

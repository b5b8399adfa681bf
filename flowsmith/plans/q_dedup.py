"""Duplicate checks (J1, J2): ``cells_candidate`` against ``cells``."""

from __future__ import annotations

from ..operators import dedup as D
from ..sources import adapters as A
from ..session import materialize
from .catalog import register


def _sides(spark, sf):
    flows = materialize(A.flow_arrays(spark, sf))  # read by both sides of the check
    return A.candidate_of(flows), flows

KEYS = {
    "ok": "select flow_id, app, list(round_even(v, 6) order by grp, slot) as k from cells group by flow_id, app",
    "ck": "select flow_id, app, list(round_even(v, 6) order by grp, slot) as k from cells_candidate group by flow_id, app",
}


@register("duplicate_rows", A.with_views("""
select flow_id, app from ck where exists (select 1 from ok where ok.app = ck.app and ok.k = ck.k)""",
                                         "cells_candidate", extra=KEYS))
def duplicate_rows(spark, sf):
    cand, cells = _sides(spark, sf)
    return D.duplicate_rows(cand, cells, gen_id="flow_id")


@register("novel_rows", A.with_views("""
select flow_id, app from ck where not exists (select 1 from ok where ok.app = ck.app and ok.k = ck.k)""",
                                     "cells_candidate", extra=KEYS))
def novel_rows(spark, sf):
    cand, cells = _sides(spark, sf)
    return D.novel_rows(cand, cells, gen_id="flow_id")


@register("duplicate_stats", A.with_views("""
select count(*) filter (where exists (select 1 from ok where ok.app = ck.app and ok.k = ck.k)) as num_duplicates,
       round(count(*) filter (where exists (select 1 from ok where ok.app = ck.app and ok.k = ck.k)) * 100.0e0
             / count(*), 6) as duplicate_percentage,
       count(*) as total_generated, (select count(*) from ok) as total_original
from ck""", "cells_candidate", extra=KEYS))
def duplicate_stats(spark, sf):
    cand, cells = _sides(spark, sf)
    return D.duplicate_stats(cand, cells, gen_id="flow_id")

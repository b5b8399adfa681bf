"""Split and batch queries (T1-T5) on the flows of ``cells``."""

from __future__ import annotations

from ..functions.rand import sql_uniform
from ..operators import split as T
from ..session import materialize
from ..sources import adapters as A
from .catalog import register

FLOWS = {"fl": "select flow_id, app from cells where grp = 0 and slot = 0"}
U = sql_uniform(42, "flow_id")


def _flows(spark, sf):
    """One row per flow, written once (the split counts it and ranks it)."""
    return materialize(A.flows(spark, sf))


@register("split_exact", A.with_views(f"""
select flow_id, app, rank,
       case when rank <= cast(floor(n * 0.8e0) as bigint) then 'train'
            when rank <= cast(floor(n * 0.8e0) as bigint) + cast(floor(n * 0.1e0) as bigint) then 'val'
            else 'test' end as split
from (select flow_id, app, row_number() over (order by {U}, flow_id) as rank, count(*) over () as n from fl) t""",
                                      "cells", extra=FLOWS))
def split_exact(spark, sf):
    return T.split_exact(_flows(spark, sf))


@register("split_stratified", A.with_views(f"""
select flow_id, app, rank,
       case when rank <= floor(n * 0.8e0) then 'train'
            when rank <= floor(n * 0.8e0) + floor(n * 0.1e0) then 'val' else 'test' end as split
from (select flow_id, app, row_number() over (partition by app order by {U}, flow_id) as rank,
             count(*) over (partition by app) as n from fl) t""", "cells", extra=FLOWS))
def split_stratified(spark, sf):
    return T.split_stratified(_flows(spark, sf))


@register("batch_assign", A.with_views(f"""
select flow_id, app, rank, (rank - 1) // 8 as batch_id
from (select flow_id, app, row_number() over (order by {U}, flow_id) as rank from fl) t""", "cells", extra=FLOWS))
def batch_assign(spark, sf):
    return T.assign_batches(_flows(spark, sf))

"""Helpers shared by the registered plans."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import profile as P
from ..session import materialize
from ..sources import adapters as A


def cell_counts(spark, sf: str, source: str = "cells") -> DataFrame:
    """The (app, grp, slot, v, cnt) table of an adapter, materialized."""
    cells = getattr(A, source)(spark, sf)
    return materialize(P.value_counts(cells))

"""Registered queries: one Spark plan per operator plus, where SQL can say
the same thing, the DuckDB oracle text.

Every query reads the driver tables through ``sources.adapters`` so its work
grows with them.  ``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, sql|None)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict:
    """Import the modules that register queries (order = catalog order)."""
    from . import q_profile  # noqa: F401
    from . import q_reshape  # noqa: F401
    from . import q_quality  # noqa: F401
    from . import q_tokens  # noqa: F401
    from . import q_synth  # noqa: F401
    from . import q_dedup  # noqa: F401
    from . import q_split  # noqa: F401
    from . import q_score  # noqa: F401
    from . import q_metrics  # noqa: F401
    from . import q_io  # noqa: F401
    from . import q_run  # noqa: F401
    return QUERIES

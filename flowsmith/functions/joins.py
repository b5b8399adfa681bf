"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 5_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when a count proves it has at most ``max_rows``
    rows; otherwise return it unchanged so Spark plans a shuffle join.

    Spark's own choice uses file-size estimates, which at small scale can pick
    the *large* side of a join as the build side; the count settles it."""
    return F.broadcast(df) if df.count() <= max_rows else df

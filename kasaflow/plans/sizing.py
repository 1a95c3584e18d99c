"""Size checks in front of broadcast joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` has at most ``max_rows`` rows (reads at most max_rows + 1)."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if(df: DataFrame, bounded: bool) -> DataFrame:
    """Broadcast hint when a size bound was established for ``df``."""
    return F.broadcast(df) if bounded else df

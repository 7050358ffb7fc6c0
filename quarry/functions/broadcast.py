"""Broadcast behind a size check.

``F.broadcast`` forces a side into every executor's memory whatever its size. These
helpers only do so when the row count is proven below a limit (a bounded
``limit(n+1).count()`` that stops early); beyond the limit the plan is left to the
optimizer, which chooses a shuffle join (and AQE may still demote it at runtime).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default row limit for sides we broadcast on purpose (questions, per-domain stats).
DEFAULT_MAX_ROWS = 2_000_000


def fits(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (reads at most max_rows+1)."""
    return df.limit(max_rows + 1).count() <= max_rows


def sized_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """Hint a broadcast only if ``df`` is proven small; otherwise return it unchanged."""
    return F.broadcast(df) if fits(df, max_rows) else df


def dim_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a dimension whose size is bounded by construction (one row per
    domain of the catalog, one row per partition of a scan). Callers use this only
    for such tables; data-derived sides go through :func:`sized_broadcast`."""
    return F.broadcast(df)

"""Bounded side tables: class counts, fitted statistics, dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 20_000


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Fit a side table once and mark it for broadcast if it has proved small.

    At most ``max_rows + 1`` rows reach the driver. A larger table comes back as
    it was: the join is then shuffled, and adaptive execution splits its hot keys.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def bounded_rows(df: DataFrame, max_rows: int = SMALL_ROWS):
    """Collect a table that must be small, such as one row per class."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"expected at most {max_rows} rows, e.g. one per class")
    return rows

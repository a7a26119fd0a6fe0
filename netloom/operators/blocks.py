"""Rows dealt out for training: as many tasks as there are cores, and few large blocks instead of many small batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 8_192                # rows that tasks handle together
LEAST_ROWS, MOST_ROWS = 8_192, 4_000_000      # rows of a task: small tables make fewer tasks, large ones more than the cores


def n_tasks(df: DataFrame, n_rows: int, least: int = LEAST_ROWS, most: int = MOST_ROWS) -> int:
    """Whole rounds of all cores, however the input is split into files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(cores * -(-n_rows // (cores * most)), n_rows // least))


def spread(df: DataFrame) -> DataFrame:
    """The same rows dealt over all cores by a hash of all values, for work that costs far more than reading; ``df`` is read twice."""
    n_rows = df.count()
    return df.repartition(n_tasks(df, n_rows), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))


def in_blocks(frames: Iterator[pd.DataFrame], size: int = BLOCK_ROWS) -> Iterator[pd.DataFrame]:
    """The rows of many batches in frames of ``size`` rows or a little more; no empty ones."""
    kept, n = [], 0
    for frame in frames:
        if len(frame):
            kept.append(frame)
            n += len(frame)
        if n >= size:
            yield pd.concat(kept, ignore_index=True)
            kept, n = [], 0
    if kept:
        yield pd.concat(kept, ignore_index=True)

"""Ranking and exact sampling inside classes that may hold most of the table.

``row_number() over (partition by class)`` would sort a 72 % class in one task.
Here the order key is a uniform hash, so its leading hex digits cut every class
into bins of even size; bins are ranked in parallel and offset by the running
count of the bins before them. The result is the same row number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.columns import seeded_key
from netloom.operators.small import small_side
from netloom.session import materialise

ROWS_PER_BIN = 50_000


def bin_digits(n_rows: int, rows_per_bin: int = ROWS_PER_BIN) -> int:
    digits = 1
    while n_rows > rows_per_bin * 16 ** digits and digits < 6:
        digits += 1
    return digits


def _binned(df: DataFrame, ids, seed: int, digits: int) -> DataFrame:
    return (df.withColumn("_key", seeded_key(ids, seed))
              .withColumn("_bin", F.substring("_key", 1, digits)))


def _bins_before(binned: DataFrame, group: str) -> DataFrame:
    """Rows per (class, bin) and the rows of the class in earlier bins."""
    earlier = W.partitionBy(group).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    return (binned.groupBy(group, "_bin").agg(F.count(F.lit(1)).alias("_n"))
                  .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))))


def hashed_rank(df: DataFrame, group: str, ids, n_rows: int, seed: int = 42,
                rank_col: str = "rank") -> DataFrame:
    """1-based rank of every row in its class, ordered by the seeded key."""
    binned = _binned(df, ids, seed, bin_digits(n_rows))
    in_bin = W.partitionBy(group, "_bin").orderBy("_key", *ids)
    return (binned.join(_bins_before(binned, group).drop("_n"), [group, "_bin"])
                  .withColumn(rank_col, F.col("_before") + F.row_number().over(in_bin))
                  .drop("_key", "_bin", "_before"))


def take_per_class(df: DataFrame, quotas: DataFrame, group: str, ids, n_rows: int,
                   seed: int = 42) -> DataFrame:
    """Exactly ``quota`` rows of each class, picked by the seeded key.

    ``quotas`` has (group, quota). Bin counts show which bin straddles a class's
    quota; ranking that one bin gives the last key that is still in. The draw
    itself is then a filter against one row per class, without any shuffle.
    """
    binned = _binned(df, ids, seed, bin_digits(n_rows))
    cuts = (_bins_before(binned, group).join(quotas.select(group, "quota"), group)
            .filter(F.col("_before") < F.col("quota"))
            .groupBy(group)
            .agg(F.max("_bin").alias("_cut"),
                 F.max_by(F.col("quota") - F.col("_before"), F.col("_bin")).alias("_left")))
    key = F.struct("_key", *ids)
    at_cut = W.partitionBy(group).orderBy(key)
    last = (binned.join(small_side(cuts), group).filter(F.col("_bin") == F.col("_cut"))
            .withColumn("_rn", F.row_number().over(at_cut)).filter(F.col("_rn") <= F.col("_left"))
            .groupBy(group).agg(F.max(key).alias("_last")))
    return binned.join(small_side(last), group).filter(key <= F.col("_last")).select(*df.columns)


def take_rows(df: DataFrame, ids, n: int, n_rows: int, seed: int = 42) -> DataFrame:
    """A seeded random sample of exactly ``n`` rows of the whole table."""
    one = df.withColumn("_all", F.lit(0))
    quota = df.sparkSession.createDataFrame([(0, n)], "_all int, quota long")
    return take_per_class(one, quota, "_all", ids, n_rows, seed).drop("_all")


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A unique long per row, written once so that every later scan sees the same ids."""
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), "row-ids")


def with_shuffle_key(df: DataFrame, ids, seed: int = 42) -> DataFrame:
    """Seeded shuffle order as a column; write with repartitionByRange on it."""
    return df.withColumn("shuffle_key", seeded_key(ids, seed))

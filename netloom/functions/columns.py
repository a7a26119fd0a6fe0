"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(name: str) -> Column:
    """Reference a column whose name may hold blanks or dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def is_infinite(c: Column) -> Column:
    return F.abs(c) == F.lit(INF)


def ratio(num: Column, den: Column) -> Column:
    """num / den in double, 0 where the denominator is 0."""
    return F.coalesce(F.when(den != 0, num.cast("double") / den.cast("double")), F.lit(0.0))


def percent(num: Column, den: Column) -> Column:
    return ratio(num.cast("double") * 100, den)


def seeded_key(ids, seed: int) -> Column:
    """A reproducible pseudo-random text key for a row."""
    return F.md5(F.concat_ws(":", *[F.col(i).cast("string") for i in ids], F.lit(str(seed))))


def as_vector(names) -> Column:
    return F.array(*[col(n).cast("double") for n in names])

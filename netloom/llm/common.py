"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.session import materialise

# The white space that separates words in every contract here, as a character class and as text.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    name, i = base, 0
    while name.lower() in taken:
        i += 1
        name = f"{base}_{i}"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, bound as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column) -> Column:
    """The runs of non-space characters of a text; an empty array where there are none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def ranked(rows: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """The rows plus their place in their group, from 0; no group is gathered in one task.

    Rows are dealt over ranges of (group, order) and numbered where they lie; runs of one group in one range are offset by the
    runs before them, a table of one row per range and group. An order that tells all rows apart lets a hot group spread over many ranges.
    """
    pos, part, first, before = (fresh(rows, c) for c in ("_pos", "_part", "_first", "_before"))
    keys = [*(F.col(c).asc_nulls_first() for c in group), *order]
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    lying = materialise(spread.withColumn(pos, F.monotonically_increasing_id()), "ranked")
    lying = lying.withColumn(part, F.shiftright(pos, 33))
    runs = lying.groupBy(part, *group).agg(F.min(pos).alias(first), F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    names = {c: fresh(rows, f"_g{i}") for i, c in enumerate(group)}
    runs = runs.select(F.col(part).alias("_p"), first, F.coalesce(so_far, F.lit(0)).alias(before), *(F.col(c).alias(n) for c, n in names.items()))
    on = F.col(part) == F.col("_p")
    for c, n in names.items():
        on = on & F.col(c).eqNullSafe(F.col(n))
    return lying.join(runs, on).select(*rows.columns, (F.col(pos) - F.col(first) + F.col(before)).alias(name))

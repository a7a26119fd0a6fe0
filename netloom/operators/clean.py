"""Cleaning of wide numeric tables: missing, infinite, duplicate, unknown labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions.columns import col, is_infinite, is_missing
from netloom.operators.small import small_side
from netloom.taxonomy import taxonomy


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def floating_columns(df: DataFrame, features) -> list[str]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [f for f in features if isinstance(kinds[f], (T.DoubleType, T.FloatType))]


def _replace(df: DataFrame, changed: dict) -> DataFrame:
    return df.select(*[changed[c].alias(c) if c in changed else col(c) for c in df.columns])


def fill_missing(df: DataFrame, features) -> DataFrame:
    """NULL and NaN become 0."""
    floats = set(floating_columns(df, features))
    zeroed = {}
    for f in features:
        present = F.when(~F.isnan(col(f)), col(f)) if f in floats else col(f)
        zeroed[f] = F.coalesce(present, F.lit(0).cast(df.schema[f].dataType))
    return _replace(df, zeroed)


def finite_maxima(df: DataFrame, features, by=()) -> DataFrame:
    """Largest finite value of each feature, per split when ``by`` is given."""
    tops = [F.max(F.when(~is_infinite(col(f)), col(f))).alias(f"max_{f}") for f in features]
    return df.groupBy(*by).agg(*tops)


def replace_infinite(df: DataFrame, features, by=(), maxima: DataFrame | None = None) -> DataFrame:
    """Both infinities become the largest finite value of the column.

    The maxima are one row per split, so they are fitted once and applied as a
    broadcast (or literals); a column that holds nothing finite becomes NULL.
    """
    features = floating_columns(df, features)
    stats = maxima if maxima is not None else finite_maxima(df, features, by)
    if by:
        joined = df.join(small_side(stats), list(by), "left")
        tops = {f: col(f"max_{f}") for f in features}
    else:
        row = stats.first()
        joined = df
        tops = {f: F.lit(row[f"max_{f}"]).cast("double") for f in features}
    fixed = {f: F.when(is_infinite(col(f)), tops[f]).otherwise(col(f)) for f in features}
    return _replace(joined, fixed).select(*df.columns)


def drop_repeats(df: DataFrame, columns=None) -> DataFrame:
    """Whole-table duplicate removal; copies collapse map-side before the shuffle."""
    return df.select(*[col(c) for c in columns]).distinct() if columns else df.distinct()


def clean(df: DataFrame, features, label: str = "label", by=()) -> DataFrame:
    filled = fill_missing(df.select(*[col(c) for c in [*features, label, *by]]), features)
    return drop_repeats(replace_infinite(filled, features, by))


def unknown_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Labels outside the taxonomy with their row counts."""
    known = F.broadcast(taxonomy(df.sparkSession).select(F.col("label").alias(label)))
    return (df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
              .join(known, label, "left_anti"))


def known_only(df: DataFrame, label: str = "label") -> DataFrame:
    known = F.broadcast(taxonomy(df.sparkSession).select(F.col("label").alias(label)))
    return df.join(known, label, "left_semi")


def cleaning_counters(df: DataFrame, features) -> DataFrame:
    """feature, missing cells, infinite cells: one scan, then a small unpivot."""
    floats = set(floating_columns(df, features))
    aggs = []
    for i, f in enumerate(features):
        missing = is_missing(col(f)) if f in floats else col(f).isNull()
        infinite = is_infinite(col(f)) if f in floats else F.lit(False)
        aggs += [F.count_if(missing).alias(f"m{i}"), F.count_if(infinite).alias(f"i{i}")]
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("n_missing"),
                              F.col(f"i{i}").alias("n_infinite"))
                     for i, f in enumerate(features)])
    return df.agg(*aggs).select(F.inline(rows))


def removed_rows(df: DataFrame, columns) -> DataFrame:
    """rows before, rows after and rows dropped by duplicate removal."""
    copies = df.groupBy(*[col(c) for c in columns]).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(F.sum("_n").alias("n_before"), F.count(F.lit(1)).alias("n_after"),
                      (F.sum("_n") - F.count(F.lit(1))).alias("n_removed"))

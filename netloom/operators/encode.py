"""Label dictionaries, standardisation and output projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.columns import col
from netloom.operators.cells import cells, feature_name
from netloom.operators.small import small_side
from netloom.taxonomy import BENIGN_LABEL, taxonomy

MACRO_COL = "y_macro_encoded"
SPECIFIC_COL = "y_specific"
LABEL_COLS = (MACRO_COL, SPECIFIC_COL)


def label_dictionary(train: DataFrame, label: str = "label") -> DataFrame:
    """label -> rank among the labels seen in train (unknown labels included)."""
    return _dictionary(train.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label)


def _dictionary(counts: DataFrame, label: str) -> DataFrame:
    seen = counts.filter(F.col(label).isNotNull())
    ordered = W.partitionBy(F.lit(0)).orderBy(label)   # one row per label
    return seen.select(label, "n", (F.row_number().over(ordered) - 1).cast("int").alias("idx"))


def with_macro(df: DataFrame, label: str = "label") -> DataFrame:
    dim = taxonomy(df.sparkSession).withColumnRenamed("label", label)
    return df.join(F.broadcast(dim), label, "left")


def encode_labels(df: DataFrame, dictionary: DataFrame, label: str = "label") -> DataFrame:
    """Add both codes; a label missing from its dictionary gets -1."""
    codes = small_side(dictionary.select(label, "idx"))
    out = with_macro(df, label).join(codes, label, "left")
    return (out.withColumn(MACRO_COL, F.coalesce("macro_code", F.lit(-1)).cast("int"))
               .withColumn(SPECIFIC_COL, F.coalesce("idx", F.lit(-1)).cast("int"))
               .drop("macro", "macro_code", "idx"))


def decode_labels(df: DataFrame, dictionary: DataFrame, code: str, name: str,
                  label: str = "label") -> DataFrame:
    """Code back to name; ``Class_<i>`` for a code that is not in the dictionary."""
    dim = small_side(dictionary.select(F.col("idx").alias(code), F.col(label).alias("_name")))
    return (df.join(dim, code, "left")
              .withColumn(name, F.coalesce("_name", F.concat(F.lit("Class_"), F.col(code).cast("string"))))
              .drop("_name"))


def binary_label(df: DataFrame, label: str = "label", out: str = "binary_label") -> DataFrame:
    return df.withColumn(out, F.when(F.col(label) == BENIGN_LABEL, 0).otherwise(1))


def scaler_frame(train: DataFrame, features) -> DataFrame:
    """feature, mean, scale (population deviation; 0 counts as 1), one scan."""
    stats = cells(train, features).groupBy("i").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return stats.select(feature_name(features).alias("feature"), "mean",
                        F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")).alias("scale"))


def fit_scaler(train: DataFrame, features) -> dict[str, tuple[float, float]]:
    """Two numbers per feature; the only values that reach the driver."""
    return {r["feature"]: (r["mean"], r["scale"]) for r in scaler_frame(train, features).collect()}


def fit_train(train: DataFrame, features, label: str = "label"):
    """Label dictionary and scaler from one scan of train.

    The scan keeps count, mean and variance per label; both results are put
    together from that small table (one row per label).
    """
    per_label = small_side(cells(train, features, [label]).groupBy(label, "i").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("c"), F.avg("value").alias("m"),
        F.var_pop("value").alias("v")))
    feature = W.partitionBy("i")                            # one row per label and feature
    centre = F.sum(F.col("c") * F.col("m")).over(feature) / F.sum("c").over(feature)
    off = (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))
    stats = per_label.withColumn("mean", centre).groupBy("i").agg(
        F.first("mean").alias("mean"), F.sqrt(F.sum(F.col("c") * (F.col("v") + off)) / F.sum("c")).alias("sd"))
    scaler = {r["feature"]: (r["mean"], r["sd"] or 1.0)
              for r in stats.select(feature_name(features).alias("feature"), "mean", "sd").collect()}
    return _dictionary(per_label.filter("i = 0").select(label, "n"), label), scaler


def standardise(df: DataFrame, scaler, dtype: str = "double") -> DataFrame:
    """(x - mean) / scale, bound by column name and computed in double."""
    out = []
    for c in df.columns:
        if c in scaler:
            mean, scale = scaler[c]
            out.append(((col(c).cast("double") - F.lit(mean)) / F.lit(scale)).cast(dtype).alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


def narrow(df: DataFrame, features) -> DataFrame:
    chosen = set(features)
    return df.select(*[col(c).cast("float").alias(c) if c in chosen else col(c) for c in df.columns])


def model_columns(df: DataFrame, features) -> DataFrame:
    """The stored shape: features, then the two label codes."""
    return df.select(*[col(f) for f in features], *LABEL_COLS)


def feature_names(df: DataFrame, exclude=LABEL_COLS) -> list[str]:
    return [c for c in df.columns if c not in set(exclude)]

"""Preparation flow: clean, learn from train, encode and scale every split, store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import clean, encode, profile
from netloom.session import materialise
from netloom.sources import writers


@dataclass
class Prepared:
    """Model-ready rows of all splits and what was learned from train."""

    rows: DataFrame
    dictionary: DataFrame
    scaler: dict[str, tuple[float, float]]
    features: list[str]


def prepare(df: DataFrame, features, label: str = "label", split: str = "split") -> Prepared:
    """The cleaned rows are written once: the duplicate removal is the only wide
    shuffle, and the learning scan and the final pass read its result."""
    rows = materialise(clean.clean(df, features, label, by=[split]), "cleaned")
    train = rows.filter(F.col(split) == "train")
    dictionary, scaler = encode.fit_train(train, features, label)
    coded = encode.encode_labels(rows, dictionary, label)
    scaled = encode.standardise(coded, scaler).select(
        *[encode.col(f) for f in features], *encode.LABEL_COLS, split)
    return Prepared(scaled, dictionary, scaler, list(features))


UNKNOWN = ("raise", "drop", "keep")


def store(prepared: Prepared, root: str, split: str = "split", label: str = "label", unknown: str = "raise") -> None:
    """float32 features partitioned by variant and split, artifacts beside them.

    Rows are checked in full before anything appears under ``root``. Labels outside the dictionary or taxonomy have
    code -1: they end the job, are left out, or are kept, as ``unknown`` says.
    """
    if unknown not in UNKNOWN:
        raise ValueError(f"unknown must be one of {UNKNOWN}")
    rows = encode.narrow(prepared.rows, prepared.features).withColumn("variant", F.lit("original"))
    if unknown == "drop":
        rows = known_rows(rows)
    rows = materialise(rows, "to-store")
    if unknown != "keep":
        profile.assert_valid(profile.split_check(rows, prepared.dictionary.count(), split=split))
    writers.write_table(rows, f"{root}/table", ["variant", split])
    spark = rows.sparkSession
    scaler = spark.createDataFrame([(f, m, s) for f, (m, s) in prepared.scaler.items()],
                                   "feature string, mean double, scale double")
    scaler.coalesce(1).write.mode("overwrite").parquet(f"{root}/scaler")
    total = prepared.dictionary.agg(F.sum("n")).first()[0]
    writers.write_json(writers.mapping_info(prepared.dictionary, total, label), f"{root}/mapping_info")


def known_rows(rows: DataFrame) -> DataFrame:
    """Rows whose labels both have a code."""
    return rows.filter(" AND ".join(f"`{c}` >= 0" for c in encode.LABEL_COLS))


def load_scaler(spark, root: str) -> dict[str, tuple[float, float]]:
    return {r["feature"]: (r["mean"], r["scale"]) for r in spark.read.parquet(f"{root}/scaler").collect()}

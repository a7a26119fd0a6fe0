"""The whole training flow: prepare, rebalance train, store by variant, fit, evaluate on the original test rows, compare."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import encode, metrics, models, ranking
from netloom.plans.augment import augment_all
from netloom.plans.prepare import prepare, store
from netloom.session import release
from netloom.sources import readers, writers

METHODS = ("smote", "borderline", "adasyn", "conditional")


def store_variants(df: DataFrame, features, root: str, methods=METHODS, unknown: str = "drop", **options) -> DataFrame:
    """Prepare ``df`` and store the original and one rebalanced train set per method under ``root``.

    Returns the accounting: method, phase (original, sample, augmented, final), class, n, which is also written as JSON.
    """
    store(prepare(df, features), root, unknown=unknown)
    spark = df.sparkSession
    release(spark)
    train = ranking.with_row_id(readers.load_splits(spark, f"{root}/table")["train"])

    def folder(method: str) -> str:
        # straight into its own folder of the partitioned table: methods write at the same time, and two jobs cannot share one output folder
        return f"{root}/table/variant={method}/split=train"

    def keep(method: str, made: dict[str, DataFrame]) -> DataFrame:
        # the synthetic rows are there already
        writers.write_table(made["original"].select(*[encode.col(f) for f in features], *encode.LABEL_COLS), folder(method), mode="append")
        phases = {name: made[name] for name in ("original", "sample", "augmented", "final")}
        writers.write_augmentation_info(f"{root}/info_{method}", method, encode.MACRO_COL, phases)
        # counted once: the record is what was written
        return spark.read.schema("method string, phase string, class string, n long").json(f"{root}/info_{method}")

    record = augment_all(train, methods, "row_id", features, then=keep, folder=folder, **options)
    return reduce(DataFrame.unionByName, record.values())


def train_compare(spark, root: str, features, pipelines: dict[str, Pipeline], variants=("original", *METHODS),
                  on_predictions: Callable[[DataFrame], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Metrics of every algorithm and variant on the same test rows, and the log of fits.

    ``on_predictions`` gets the tagged predictions, for instance to write them down.
    """
    splits = {v: readers.load_splits(spark, f"{root}/table", v) for v in variants}
    fitted, log = models.train_grid(spark, {v: s["train"] for v, s in splits.items()}, pipelines)
    tagged = models.tagged_predictions(fitted, splits["original"]["test"])
    if on_predictions:
        on_predictions(tagged)
    return metrics.weighted_metrics(tagged, models.LABEL, "prediction", ["algorithm", "dataset"]), log

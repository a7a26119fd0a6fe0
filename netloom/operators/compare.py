"""Model comparison tables: grid, leaderboards, deltas, pivots, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.operators.metrics import METRICS

# Names of the known algorithms and dataset variants.
VARIANTS = ("original", "smote", "borderline", "adasyn", "ctgan")
ALGORITHMS = ("Decision Tree", "Random Forest", "XGBoost", "MLP", "k-NN", "SVM")


def model_grid(spark: SparkSession, algorithms=ALGORITHMS, variants=VARIANTS) -> DataFrame:
    rows = [(a, v) for a in algorithms for v in variants]
    return spark.createDataFrame(rows, "algorithm string, dataset string")


def grid_with_models(grid: DataFrame, models: DataFrame) -> DataFrame:
    """Every grid cell; ``available`` tells whether a model exists for it."""
    found = models.select("algorithm", "dataset").distinct().withColumn("_hit", F.lit(True))
    return (grid.join(found, ["algorithm", "dataset"], "left")
                .withColumn("available", F.coalesce("_hit", F.lit(False))).drop("_hit"))


def model_label() -> Column:
    return F.concat(F.col("algorithm"), F.lit(" ("), F.col("dataset"), F.lit(")"))


def with_mean_score(metrics: DataFrame) -> DataFrame:
    total = F.col("accuracy") + F.col("precision") + F.col("recall") + F.col("f1")
    return metrics.withColumn("mean_score", total / 4)


def leaderboard(metrics: DataFrame, by: str = "accuracy") -> DataFrame:
    order = W.partitionBy(F.lit(0)).orderBy(F.desc(by), "algorithm", "dataset")  # one row per model
    return metrics.withColumn("position", F.row_number().over(order))


def best_per_metric(metrics: DataFrame, names=METRICS) -> DataFrame:
    """metric, algorithm, dataset, value of the best model; ties go to the first name."""
    long = metrics.select("algorithm", "dataset", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])))
    top = long.groupBy("metric").agg(F.max("value").alias("value"))
    return (long.join(top, ["metric", "value"])
                .groupBy("metric", "value").agg(F.min(F.struct("algorithm", "dataset")).alias("_m"))
                .select("metric", "_m.algorithm", "_m.dataset", "value"))


def compare_variants(metrics: DataFrame, base: str = "original", variant: str = "smote") -> DataFrame:
    """Base against variant per algorithm that has both, with the change per metric."""
    left = metrics.filter(F.col("dataset") == base).select(
        "algorithm", *[F.col(m).alias(f"{m}_base") for m in METRICS])
    right = metrics.filter(F.col("dataset") == variant).select(
        "algorithm", *[F.col(m).alias(f"{m}_variant") for m in METRICS])
    return left.join(right, "algorithm").withColumns(
        {f"{m}_delta": F.col(f"{m}_variant") - F.col(f"{m}_base") for m in METRICS})


def accuracy_pivot(metrics: DataFrame, variants=VARIANTS) -> DataFrame:
    return metrics.groupBy("algorithm").pivot("dataset", list(variants)).agg(F.avg("accuracy"))


def report_row(metrics: DataFrame) -> DataFrame:
    """One record: totals, names present, all results, best model per metric."""
    record = F.struct("algorithm", "dataset", *METRICS)
    best = best_per_metric(metrics).agg(
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct("metric", F.struct("algorithm", "dataset", "value"))))).alias("best"))
    totals = metrics.agg(F.count(F.lit(1)).alias("total_models"),
                         F.sort_array(F.collect_set("algorithm")).alias("algorithms"),
                         F.sort_array(F.collect_set("dataset")).alias("datasets"),
                         F.sort_array(F.collect_list(record)).alias("results"))
    return (totals.withColumn("_k", F.lit(1)).join(best.withColumn("_k", F.lit(1)), "_k").drop("_k")
            .withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")))

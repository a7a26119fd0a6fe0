"""Classification metrics, all derived from one confusion aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.columns import ratio
from netloom.operators.small import small_side

METRICS = ("accuracy", "precision", "recall", "f1")


def class_weights(df: DataFrame, cls: str) -> DataFrame:
    """Balanced weights n / (k * n_c)."""
    every = W.partitionBy(F.lit(0))                     # one row per class
    return (df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("weight", F.sum("n").over(every).cast("double")
                        / (F.count(F.lit(1)).over(every) * F.col("n"))))


def with_class_weight(df: DataFrame, cls: str, out: str = "weight") -> DataFrame:
    """df with the weight of its class; rows without a class are a class of their own, as in the counts."""
    weights = small_side(class_weights(df, cls).select(F.col(cls).alias("_cls"), F.col("weight").alias(out)))
    return df.join(weights, F.col(cls).eqNullSafe(F.col("_cls")), "left").drop("_cls")


def confusion_cells(df: DataFrame, truth: str, pred: str, by=()) -> DataFrame:
    """Occupied cells; the only pass over the rows."""
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def _support(cells: DataFrame, by) -> DataFrame:
    """truth/pred/hit counts for every label seen on either side."""
    sides = cells.select(*by, F.inline(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")))))
    return sides.groupBy(*by, "label").agg(F.sum("support").alias("support"),
                                           F.sum("predicted").alias("predicted"),
                                           F.sum("hits").alias("hits"))


def confusion_matrix(df: DataFrame, truth: str, pred: str, by=()) -> DataFrame:
    """Every (truth, pred) cell over the union of labels, zero cells kept, and row shares."""
    cells = confusion_cells(df, truth, pred, by)
    labels = _support(cells, by).groupBy(*by).agg(F.collect_set("label").alias("_labels"))
    grid = (labels.select(*by, F.explode("_labels").alias("truth"), "_labels")
                  .select(*by, "truth", F.explode("_labels").alias("pred")))
    row = W.partitionBy(*by, "truth")
    return (grid.join(cells, [*by, "truth", "pred"], "left")
                .withColumn("n", F.coalesce("n", F.lit(0)))
                .withColumn("row_share", ratio(F.col("n"), F.sum("n").over(row))))


def confusion_pivot(df: DataFrame, truth: str, pred: str, labels) -> DataFrame:
    return (df.groupBy(F.col(truth).alias("truth")).pivot(pred, list(labels))
              .agg(F.count(F.lit(1))).na.fill(0))


def per_class(df: DataFrame, truth: str, pred: str, by=()) -> DataFrame:
    """precision, recall, f1, support per class; a zero denominator gives 0."""
    s = _support(confusion_cells(df, truth, pred, by), by)
    p, r = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    f1 = ratio(F.col("hits") * 2, F.col("predicted") + F.col("support"))
    return s.select(*by, "label", p.alias("precision"), r.alias("recall"), f1.alias("f1"),
                    "support", "hits")


def _weighted(name: str):
    return ratio(F.sum(F.col(name) * F.col("support")), F.sum("support")).alias(name)


def weighted_metrics(df: DataFrame, truth: str, pred: str, by=()) -> DataFrame:
    """accuracy and support-weighted precision, recall, f1 per group (model, split)."""
    return (per_class(df, truth, pred, by).groupBy(*by)
            .agg(ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
                 *[_weighted(m) for m in ("precision", "recall", "f1")],
                 F.sum("support").alias("n_rows")))


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Rows: each class, then accuracy, macro avg and weighted avg."""
    classes = per_class(df, truth, pred)
    names = ("precision", "recall", "f1")
    body = classes.select(F.col("label").cast("string").alias("row"), *names, "support")
    accuracy = ratio(F.sum("hits"), F.sum("support"))
    wide = classes.agg(accuracy.alias("acc"), *[F.avg(m).alias(f"m_{m}") for m in names],
                       *[_weighted(m).alias(f"w_{m}") for m in names], F.sum("support").alias("n"))
    tail = wide.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("row"), *[F.col("acc").alias(m) for m in names], F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("row"), *[F.col(f"m_{m}").alias(m) for m in names], F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("row"), *[F.col(f"w_{m}").alias(m) for m in names], F.col("n").alias("support")))))
    return body.unionByName(tail)


def requirement_gate(metrics: DataFrame, accuracy: float = 0.95, precision: float = 0.90,
                     recall: float = 0.95) -> DataFrame:
    return metrics.withColumn("meets_target", (F.col("accuracy") >= accuracy)
                              & (F.col("precision") >= precision) & (F.col("recall") >= recall))


def overfit_check(metrics: DataFrame, by=(), split: str = "split", gap: float = 0.05) -> DataFrame:
    """Train minus test accuracy, flagged above the allowed gap."""
    of = lambda name: F.max(F.when(F.col(split) == name, F.col("accuracy")))
    return (metrics.groupBy(*by).agg(of("train").alias("train_accuracy"), of("test").alias("test_accuracy"))
            .withColumn("gap", F.col("train_accuracy") - F.col("test_accuracy"))
            .withColumn("overfit", F.col("gap") > gap))

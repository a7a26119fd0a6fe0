"""Rebalancing by several methods at once, and work spread over tasks however few blocks it comes in."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import conditional, knn, models, synth
from netloom.plans import augment
from netloom.session import together


def rows_of(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    y = np.r_[np.zeros(n, int), np.ones(n // 5, int), np.full(n // 20, 2)]
    x = rng.normal(size=(len(y), 3)) + y[:, None] * 0.7
    rows = [(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y_macro_encoded int")


def points_of(spark, **sizes):
    return synth.to_points(rows_of(spark, **sizes), "id", "y_macro_encoded", ["a", "b", "c"])


def n_tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def listed(df):
    return sorted(map(str, df.collect()))


def test_methods_together_make_the_rows_each_makes_alone(spark):
    train, names = rows_of(spark), ["a", "b", "c"]
    methods = ("smote", "borderline", "adasyn", "conditional")
    found = augment.augment_all(train, methods, "id", names, then=lambda method, made: (method, listed(made["final"])))
    for method in methods:
        assert found[method] == (method, listed(augment.augment(train, method, "id", names)["final"]))


def test_shared_neighbours_are_searched_once(spark, monkeypatch):
    calls, search = [], knn.nearest
    monkeypatch.setattr(synth, "nearest", lambda *a, **k: calls.append(1) or search(*a, **k))
    made = augment.augment_all(rows_of(spark), ("smote", "borderline", "adasyn"), "id", ["a", "b", "c"])
    assert len(calls) == 2 and made["adasyn"]["synthetic"].count() > 0


def test_rows_searched_among_themselves(spark, tmp_path):
    """One table on both sides, and two tables with the same rows; every third row has copies."""
    base = points_of(spark, n=600).select(F.col("id"), F.col("cls"), F.transform("vec", lambda v: F.round(v, 1)).alias("vec"))
    base = base.unionByName(base.where("id % 3 = 0").withColumn("id", F.col("id") + 10_000))
    base.write.parquet(f"{tmp_path}/points")
    p, again = spark.read.parquet(f"{tmp_path}/points"), spark.read.parquet(f"{tmp_path}/points")
    for within in (None, "cls"):
        options = {"within": within, "block_rows": 64, "query_rows": 50, "n_pivots": 8}
        assert listed(knn.nearest(p, p, 4, **options)) == listed(knn.nearest(p, again, 4, **options))


def test_few_points_emit_from_several_tasks(spark):
    few = spark.createDataFrame([(i, 1, [float(i), 2.0]) for i in range(4)], "id long, cls int, vec array<double>")
    many = spark.range(60_000).select((F.col("id") + 10).alias("id"), F.lit(0).alias("cls"), F.array(F.rand(1), F.rand(2)).alias("vec"))
    made = synth.smote(few.unionByName(many))
    assert made.count() == 59_996 and n_tasks(made) > 1


def test_conditional_rows_are_drawn_in_several_tasks(spark):
    fitted = {c: (np.zeros(2), np.eye(2)) for c in range(4)}
    made = conditional.generate(spark, fitted, {c: 50_000 for c in range(4)}, ["a", "b"])
    assert made.count() == 200_000 and n_tasks(made) > 1


def test_fits_run_side_by_side(spark, monkeypatch):
    both = threading.Barrier(2, timeout=20)
    monkeypatch.setattr(models, "fit", lambda pipeline, train, label: (both.wait(), pipeline)[1])
    fitted, log = models.train_grid(spark, {"original": None}, {"A": "a", "B": "b"})
    assert fitted == {("A", "original"): "a", ("B", "original"): "b"} and log.filter("success").count() == 2


def test_first_failure_of_jobs_is_raised(spark):
    def fails():
        raise ValueError("no")
    assert together(spark, [lambda: 1, lambda: 2]) == [1, 2]
    with pytest.raises(ValueError):
        together(spark, [lambda: 1, fails])

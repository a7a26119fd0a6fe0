"""The decision tree against sums over plain rows, and its way over all cells against the one in a single task."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from netloom.operators import models, trees


def rows_of(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    y = (x[:, 0] > 0.3).astype(int) + 2 * ((x[:, 1] * x[:, 2] > 0.2) ^ (rng.random(n) < 0.1))
    return spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y)], "a double, b double, c double, y int").repartition(5)


def test_equal_cells_are_added(spark):
    bins, y = np.array([[1, 2], [1, 2], [0, 2], [1, 2]], np.uint8), np.array([1, 1, 1, 0], np.int32)
    b, c, n, w = trees.added_up(bins, y, np.array([1, 2, 3, 4]), np.array([0.5, 1.0, 2.0, 4.0]), 3, 2)
    assert sorted(zip(map(tuple, b.tolist()), c.tolist(), n.tolist(), w.tolist())) == [((0, 2), 1, 3, 2.0), ((1, 2), 0, 4, 4.0), ((1, 2), 1, 3, 1.5)]
    wide = np.zeros((3, 40), np.uint8)                                   # bins that do not fit one number stay as they are
    assert len(trees.added_up(wide, y[:3], np.ones(3, np.int64), np.ones(3), 32, 2)[1]) == 3


def test_copies_of_rows_become_one_cell_per_task(spark):
    rows = spark.range(10_000).coalesce(1).select(F.array((F.col("id") % 4).cast("double")).alias("x"), (F.col("id") % 2).cast("int").alias("y"),
                                                  F.lit(2.0).alias("weight"))
    found = [part for part in trees.read_cells(trees.cells(rows, [np.array([0.5, 1.5, 2.5])], 4, 2).toPandas(), 4, 1)]
    assert len(found) == 1 and found[0][2].tolist() == [2500] * 4 and found[0][3].tolist() == [5000.0] * 4


@pytest.mark.parametrize("min_rows", [1, 10])
def test_best_split_equals_trying_every_cut(min_rows):
    rng = np.random.default_rng(min_rows)
    bins, y, w = rng.integers(0, 6, (80, 2)).astype(np.uint8), rng.integers(0, 3, 80).astype(np.int32), rng.uniform(0.5, 2, 80)
    gain, feature, cut, left = trees.best_splits(trees.histograms(bins, y, np.ones(80), w, np.zeros(80, int), 1, 6, 3), min_rows)

    def gini(m):
        p = np.bincount(y[m], w[m], 3) / w[m].sum()
        return 1 - (p * p).sum()
    best = max((gini(y >= 0) - (gini(m) * w[m].sum() + gini(~m) * w[~m].sum()) / w.sum(), -f, -c)
               for f in range(2) for c in range(5) for m in [bins[:, f] <= c] if min(m.sum(), (~m).sum()) >= min_rows)
    assert (feature[0], cut[0]) == (-best[1], -best[2]) and gain[0] == pytest.approx(best[0])
    assert left[0] == pytest.approx(np.bincount(y[bins[:, feature[0]] <= cut[0]], w[bins[:, feature[0]] <= cut[0]], 3))


def test_large_nodes_are_split_over_all_cells(spark, monkeypatch):
    rows = rows_of(spark)
    fitted = {}
    for local in (trees.LOCAL_CELLS, 150):
        monkeypatch.setattr(trees, "LOCAL_CELLS", local)
        tree = models.fit(models.decision_tree(["a", "b", "c"], "y"), rows, "y").stages[-1].nodes()
        at = np.argsort(tree.depths(), kind="stable")
        fitted[local] = sorted((int(tree.feature[i]), int(tree.cut[i]), *np.round(tree.stats[i], 6)) for i in at)
    a, b = fitted.values()
    assert len(a) > 20 and a == b


def test_tree_keeps_depth_and_rows_per_leaf_and_agrees_with_mllib(spark):
    rows = rows_of(spark)
    model = models.fit(models.decision_tree(["a", "b", "c"], "y", max_depth=6), rows, "y")
    tree = model.stages[-1].nodes()
    assert tree.depths().max() <= 6 and models.tree_shape(spark, model).first()["n_nodes"] == len(tree.feature)
    x = np.array([r[:3] for r in rows.collect()])
    at = tree.placed(np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(model.stages[-1]._cuts())], axis=1))
    assert np.bincount(at, minlength=len(tree.feature))[tree.feature < 0].min() >= 10
    wide = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows)
    other = DecisionTreeClassifier(labelCol="y", maxDepth=6, minInstancesPerNode=10).fit(wide)
    hits = models.score(model, rows, names=False).where("prediction = y").count()
    assert abs(hits - other.transform(wide).where("prediction = y").count()) < 0.03 * 3000


def test_tree_of_one_class_is_a_leaf(spark):
    rows = spark.range(100).selectExpr("CAST(id AS DOUBLE) AS a", "2 AS y")
    model = models.fit(models.decision_tree(["a"], "y"), rows, "y")
    assert models.root_split(spark, model).count() == 0 and models.score(model, rows, names=False).where("prediction = 2").count() == 100

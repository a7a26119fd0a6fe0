"""The network and the boosted trees against small computations of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import boosting, models, network


def learnable(spark, n, noise=False):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 3, n)
    y = rng.integers(0, 3, n) if noise else np.floor(x).astype(int)
    return spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, rng.uniform(0, 1, n), y)], "a double, b double, y int")


def test_gradient_equals_finite_differences():
    rng, layers = np.random.default_rng(0), [3, 5, 4, 3]
    w, x, y, weight = network.first_weights(layers, 1), rng.normal(size=(20, 3)), rng.integers(0, 3, 20), rng.uniform(0.5, 2, 20)
    _, g = network.gradient(w, layers, x, y, weight, 0.1)
    step = 1e-6
    near = [(network.gradient(w + step * e, layers, x, y, weight, 0.1)[0] - network.gradient(w - step * e, layers, x, y, weight, 0.1)[0]) / (2 * step)
            for e in np.eye(len(w))]
    assert np.abs(np.array(near) - g).max() < 1e-7


def test_network_learns_and_survives_saving(spark, tmp_path):
    rows = learnable(spark, 600)
    model = models.fit(models.neural_network(["a", "b"], 3, "y", hidden=(16,), max_iter=30, batch=32, learning_rate=0.02), rows, "y", balanced=False)
    scored = models.score(model, rows, names=False)
    assert scored.where("prediction = y").count() > 570
    again = models.load_model(models.save_model(model, str(tmp_path), "MLP", "one"))
    assert models.score(again, rows, names=False).select("prediction").collect() == scored.select("prediction").collect()
    curve = models.loss_curve(spark, model).collect()
    best = min(curve, key=lambda r: r["held_out_loss"])
    assert [r["epoch"] for r in curve] == list(range(len(curve))) and best["is_best"]


def test_network_stops_on_noise(spark):
    rows = learnable(spark, 300, noise=True)
    model = models.fit(models.neural_network(["a", "b"], 3, "y", hidden=(64,), max_iter=60, batch=16, patience=3, learning_rate=0.05), rows, "y", balanced=False)
    history = model.stages[-1].history()
    assert len(history) < 61 and model.stages[-1].getOrDefault("bestEpoch") <= len(history) - 4


def test_partial_sums_meet_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(network, "FAN_IN", 2)
    parts = spark.createDataFrame([(i, 1.0, bytearray(np.array([float(i), 1.0]).tobytes())) for i in range(9)], network.PART_SCHEMA)
    assert network.tree_sum(parts, 9).tolist() == [36.0, 9.0]


def test_network_needs_rows(spark):
    with pytest.raises(ValueError):
        models.fit(models.neural_network(["a", "b"], 3, "y"), learnable(spark, 4).where("a < 0"), "y", balanced=False)


def brute_split(x, g, h, l1, l2):
    best = None
    for cut in sorted(set(x))[:-1]:
        left = x <= cut
        score = lambda m: float(boosting.node_score(g[m].sum(), h[m].sum(), l1, l2, 1.0))
        gain = score(left) + score(~left) - score(np.ones(len(x), bool))
        if h[left].sum() >= 1 and h[~left].sum() >= 1 and (best is None or gain > best[0] + 1e-9):
            best = gain, cut
    return best


def test_second_level_splits_equal_brute_force(spark):
    """The root and both of its children of the first round, found by trying every value."""
    rows = learnable(spark, 120).withColumn("a", F.round("a", 1))
    model = models.fit(models.boosted_trees(["a"], "y", n_classes=3, n_estimators=1, max_depth=2, subsample=1.0, columns=1.0), rows, "y", balanced=False)
    nodes = {(c, n): (f, t) for _, c, n, f, t, _ in model.stages[-1].splits()}
    data = rows.collect()
    x, y = np.array([r["a"] for r in data]), np.array([r["y"] for r in data])
    for c in range(3):
        g, h = 1 / 3 - (y == c), np.full(len(y), 2 * (1 / 3) * (2 / 3))
        gain, cut = brute_split(x, g, h, 0.1, 1.0)
        assert gain > 0.1 and nodes[c, 0] == (0, cut)
        for node, side in ((1, x <= cut), (2, x > cut)):
            found = brute_split(x[side], g[side], h[side], 0.1, 1.0)
            assert nodes[c, node] == ((0, found[1]) if found and found[0] > 0.1 else (-1, None))


def test_boosting_learns_over_many_tasks_and_survives_saving(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(boosting, "ADD_TOGETHER", 2)
    monkeypatch.setattr(boosting, "KEEP_EVERY", 3)
    rows = learnable(spark, 600).repartition(5)
    model = models.fit(models.boosted_trees(["a", "b"], "y", n_estimators=8, max_depth=3, learning_rate=0.5), rows, "y", balanced=False)
    scored = models.score(model, rows, names=False)
    assert scored.where("prediction = y").count() > 585
    again = models.load_model(models.save_model(model, str(tmp_path), "XGBoost", "one"))
    assert models.score(again, rows, names=False).agg(F.sum("prediction")).first() == scored.agg(F.sum("prediction")).first()


def test_samples_are_the_same_wherever_a_row_lies():
    ids = np.arange(100_000)
    first = boosting.drawn(ids, 7)
    assert (boosting.drawn(ids[::-1], 7)[::-1] == first).all() and abs((first < 0.8).mean() - 0.8) < 0.01
    assert boosting.columns_of(10, 0.8, 42, 3).sum() == 8 and boosting.columns_of(1, 0.1, 42, 3).sum() == 1


def random_tree(rng, node=0, depth=0, deepest=6):
    if depth == deepest or rng.random() < 0.2:
        return {node: (-1, 0, float(rng.normal()))}
    return {node: (int(rng.integers(0, 3)), int(rng.integers(0, 9)), 0.0), **random_tree(rng, 2 * node + 1, depth + 1, deepest),
            **random_tree(rng, 2 * node + 2, depth + 1, deepest)}


@pytest.mark.parametrize("deepest", [0, 1, 6, 8])
def test_masks_find_the_leaf_that_walking_finds(deepest):
    rng = np.random.default_rng(deepest)
    bins = rng.integers(0, 10, (500, 3)).astype(np.uint16)
    for _ in range(10):
        tree = random_tree(rng, deepest=deepest)
        assert (boosting.router(tree, 10)(bins) == boosting.placed(tree, bins)).all()


def test_boosting_uses_all_cores_whatever_the_files(spark, monkeypatch):
    seen, level_splits = [], boosting.level_splits
    monkeypatch.setattr(boosting, "level_splits", lambda rows, n_parts, *rest: seen.append(n_parts) or level_splits(rows, n_parts, *rest))
    rows = spark.range(70_000).coalesce(1).selectExpr("CAST(id % 50 AS DOUBLE) AS a", "CAST(id % 50 DIV 25 AS INT) AS y")
    model = models.fit(models.boosted_trees(["a"], "y", n_estimators=1, max_depth=1, columns=1.0), rows, "y", balanced=False)
    assert seen == [8] and [(f, t) for _, _, n, f, t, _ in model.stages[-1].splits() if n == 0] == [(0, 24.0)] * 2


def test_network_blocks_equal_plain_rows(spark):
    layers = [2, 4, 3]
    rows = learnable(spark, 900).select(F.monotonically_increasing_id().alias("id"), F.array("a", "b").alias("x"), F.col("y").cast("long").alias("y"),
                                        (F.col("b") + 1).alias("weight"))
    blocks, w = network.packed(rows, [1.0, 0.5], [2.0, 1.0]), network.first_weights(layers, 3)
    plain = rows.withColumn("x", F.array((F.col("x")[0] - 1) / 2, F.col("x")[1] - 0.5))
    assert network.mean_loss(blocks, 8, w, layers) == pytest.approx(network.mean_loss(plain, 8, w, layers), abs=1e-12)
    frame = blocks.toPandas()
    parts = [np.concatenate([y for _, y, _ in network.arrays(frame, (5, part, 3))]) for part in range(3)]
    assert sorted(np.concatenate(parts)) == sorted(r["y"] for r in rows.collect()) and min(map(len, parts)) > 200


def test_network_deals_large_tables_to_all_cores_evenly(spark):
    rows = spark.range(8 * network.SMALL_TASK).coalesce(1)
    shares = [r["count"] for r in network.NetworkClassifier().dealt(rows, 8 * network.SMALL_TASK).groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) == 8 and max(shares) < 1.05 * network.SMALL_TASK


def test_rows_for_training_are_spread_over_all_cores(spark):
    from netloom.operators.blocks import spread
    rows = spark.range(70_000).coalesce(1).selectExpr("id", "CAST(NULL AS DOUBLE) AS `a.b`")
    out = spread(rows)
    assert out.rdd.getNumPartitions() == 8 and out.agg(F.count("*"), F.sum("id"), F.count_distinct("id")).first() == (70_000, 2449965000, 70_000)


def test_learnable_rows_are_written_by_all_cores(spark, tmp_path):
    from netloom.plans import q_models
    spark.range(70_000).selectExpr("id AS event_id", "TIMESTAMP_MICROS(id * 1000000) AS ts", "CAST(id % 500 AS DOUBLE) AS value", "'view' AS event_type"
                                   ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert len(q_models.learnable(spark, str(tmp_path)).inputFiles()) == 8

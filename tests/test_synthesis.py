"""Neighbours against brute force; invariants of the synthetic rows; models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import conditional, knn, models, quotas, synth
from netloom.plans import augment

SCHEMA = "id long, cls int, vec array<double>"


def frame(spark, x, y):
    return spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))], SCHEMA).repartition(4)


def brute(x, y, k, same, self_too=False):
    out = {}
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        ok = [j for j in range(len(x)) if (self_too or j != i) and (not same or y[j] == y[i])]
        out[i] = sorted(ok, key=lambda j: (d[j], j))[:k]
    return out


def neighbours(df):
    return {r["id"]: [n["nn_id"] for n in r["nn"]] for r in df.select("id", "nn").collect()}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(7)
    centres = rng.normal(scale=20, size=(6, 5))
    y = rng.choice(6, size=600, p=[0.5, 0.2, 0.1, 0.1, 0.06, 0.04])
    x = np.round(centres[y] + rng.normal(size=(600, 5)), 2)
    x[100:300] = x[100]                                  # a third of all rows are copies of one point
    return x, y


@pytest.mark.parametrize("options", [{}, {"block_rows": 40, "query_rows": 30, "n_pivots": 1},
                                     {"block_rows": 50, "query_rows": 30, "n_pivots": 12},
                                     {"block_rows": 50, "query_rows": 30, "n_pivots": 60, "two_levels": True}])
@pytest.mark.parametrize("same", [False, True])
def test_knn_is_exact(spark, clustered, same, options, monkeypatch):
    x, y = clustered
    options = dict(options)
    if options.pop("two_levels", False):
        monkeypatch.setattr(knn, "LIST_PIVOTS", 6)
        monkeypatch.setattr(knn, "AREA_ROWS", 40)            # areas are cut into parts
    got = knn.nearest(frame(spark, x, y), frame(spark, x, y), 4, within="cls" if same else None, **options)
    assert neighbours(got) == brute(x, y, 4, same)


def test_knn_prunes_far_cells(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(loc=c, size=(100, 3)) for c in (0, 1000, 2000, 3000)])
    y = np.zeros(len(x))
    pivots = np.array([[0.0] * 3, [1000.0] * 3, [2000.0] * 3, [3000.0] * 3])
    df = frame(spark, x, y).select(F.col("id").alias("qid"), "vec", F.lit(0).alias("_scope"))
    placed = knn._assign(df, pivots).withColumn("_bound", F.lit(5.0))
    radius = [(0, c, 10.0) for c in range(4)]
    assert knn._candidate_cells(placed, pivots, radius).count() == 0
    wide = placed.withColumn("_bound", F.lit(float("inf")))
    assert knn._candidate_cells(wide, pivots, radius).count() == 3 * len(x)


def test_knn_between_two_tables(spark, clustered):
    x, y = clustered
    train, asked = frame(spark, x, y), frame(spark, x[:50] + 0.001, y[:50])
    got = neighbours(knn.nearest(asked, train, 3, exclude_self=False))
    for i in range(50):
        d = ((x - (x[i] + 0.001)) ** 2).sum(axis=1)
        assert got[i] == sorted(range(len(x)), key=lambda j: (d[j], j))[:3]


def test_classifier_votes(spark):
    x = np.array([[0.0], [0.1], [0.2], [10.0], [10.1]])
    train = frame(spark, x, [1, 1, 2, 2, 2])
    rows = knn.classify(frame(spark, np.array([[0.05], [10.05]]), [0, 0]), train, 3).collect()
    assert {r["id"]: r["predicted"] for r in rows} == {0: 1, 1: 2}
    tie = knn.classify(frame(spark, np.array([[0.16]]), [0]), train, 2).first()
    assert (tie["predicted"], tie["confidence"]) == (2, 0.5)      # equal votes: the nearest decides


@pytest.fixture(scope="module")
def imbalanced():
    rng = np.random.default_rng(5)
    y = np.repeat([0, 1, 2], [120, 30, 4])
    x = rng.normal(size=(154, 4)) + 0.8 * y[:, None]
    return x, y


def on_segment(row, x, reach=1.0):
    a, b, v = x[row["base_id"]], x[row["nn_id"]], np.array(row["vec"])
    assert 0 <= row["u"] <= reach
    assert np.allclose(v, a + row["u"] * (b - a))


def test_smote_reaches_the_target_on_segments(spark, imbalanced):
    x, y = imbalanced
    made = synth.smote(frame(spark, x, y)).collect()
    assert sorted(c for c in (r["cls"] for r in made)).count(1) == 90 and len(made) == 90 + 116
    near = brute(x, y, 3, True)                          # smallest class has 4 rows: k becomes 3
    for r in made:
        on_segment(r, x)
        assert y[r["base_id"]] == r["cls"] == y[r["nn_id"]] and r["nn_id"] in near[r["base_id"]]
    assert len({(r["base_id"], r["draw"]) for r in made}) == len(made)


def test_smote_is_repeatable_and_seeded(spark, imbalanced):
    x, y = imbalanced
    run = lambda seed: {(r["base_id"], r["draw"], r["u"]) for r in synth.smote(frame(spark, x, y), seed=seed).collect()}
    assert run(1) == run(1) != run(2)


def test_large_draws_leave_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(synth, "DRAWS_PER_BLOCK", 7)
    y = np.repeat([0, 1], [200, 3])
    x = np.arange(203.0)[:, None]
    made = synth.smote(frame(spark, x, y))
    assert made.count() == 197 and made.select("base_id", "draw").distinct().count() == 197


def test_strategies():
    sizes = {0: 100, 1: 40, 2: 10}
    assert synth.class_deficits(sizes) == {1: 60, 2: 90}
    assert synth.class_deficits(sizes, "minority") == {2: 90}
    assert synth.class_deficits(sizes, "not minority") == {1: 60}
    assert synth.class_deficits(sizes, {1: 50, 2: 5}) == {1: 10}
    with pytest.raises(ValueError):
        synth.class_deficits(sizes, "other")
    assert [synth.fitting_k(n, 5) for n in (1, 2, 5, 6)] == [1, 1, 4, 5]


def test_single_row_class_generates_nothing(spark):
    df = frame(spark, np.arange(6.0)[:, None], [0, 0, 0, 0, 0, 1])
    assert synth.smote(df).count() == synth.adasyn(df).count() == synth.borderline_smote(df).count() == 0


def test_adasyn_follows_the_density(spark, imbalanced):
    x, y = imbalanced
    near = brute(x, y, 3, False)
    rows = {r["id"]: r for r in synth.adasyn_counts(frame(spark, x, y)).collect()}
    for c, deficit in ((1, 90), (2, 116)):
        hard = {i: sum(y[j] != c for j in near[i]) for i in np.nonzero(y == c)[0]}
        for i, h in hard.items():
            assert rows[i]["n_foreign"] == h
            assert rows[i]["n_draws"] == int(np.rint(h * deficit / sum(hard.values())))
    made = synth.adasyn(frame(spark, x, y)).collect()
    assert len(made) == sum(r["n_draws"] for r in rows.values())
    for r in made:
        on_segment(r, x)


def test_adasyn_without_foreign_neighbours_changes_nothing(spark):
    x = np.concatenate([np.arange(20.0), 1000 + np.arange(8.0)])[:, None]
    assert synth.adasyn(frame(spark, x, np.repeat([0, 1], [20, 8])), k=3).count() == 0


def test_borderline_seeds_are_danger_points(spark, imbalanced):
    x, y = imbalanced
    points = frame(spark, x, y)
    near = brute(x, y, 3, False)
    foreign = {i: sum(y[j] != y[i] for j in near[i]) for i in range(len(x)) if y[i] > 0}
    want = {i: "noise" if f == 3 else "danger" if f * 2 >= 3 else "safe" for i, f in foreign.items()}
    assert {r["id"]: r["status"] for r in synth.border_status(points).collect()} == want
    one = synth.borderline_smote(points).collect()
    assert {r["base_id"] for r in one} <= {i for i, s in want.items() if s == "danger"}
    two = synth.borderline_smote(points, kind="borderline-2").collect()
    assert len(two) == len(one) and any(y[r["nn_id"]] != r["cls"] for r in two)
    for r in two:
        on_segment(r, x, 1.0 if y[r["nn_id"]] == r["cls"] else 0.5)
    with pytest.raises(ValueError):
        synth.borderline_smote(points, kind="other")


@pytest.mark.parametrize("method", ["smote", "adasyn", "borderline"])
def test_augmentation_keeps_the_original(spark, imbalanced, method):
    x, y = imbalanced
    rows = [(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))]
    train = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y_macro_encoded int")
    out = augment.augment(train, method, "id", ["a", "b", "c", "d"], target=100, min_minority=20)
    synth.assert_sizes(out["original"], out["synthetic"], out["final"])
    assert out["final"].filter("NOT is_synthetic").count() == len(x)
    assert out["synthetic"].filter("y_specific <> y_macro_encoded").count() == 0
    acc = {r["y_macro_encoded"]: r for r in quotas.accounting(
        "y_macro_encoded", out["original"], out["sample"], out["sample"].unionByName(out["synthetic"].select("y_macro_encoded")), out["final"]).collect()}
    assert acc[0]["original"] == 120 and acc[0]["generated"] == 0 and acc[2]["sample"] == 4


def test_conditional_rows_follow_the_class(spark):
    rng = np.random.default_rng(0)
    a = rng.multivariate_normal([5, -3], [[2, 1.5], [1.5, 2]], 4000)
    b = rng.normal([100, 0], [1, 0], (500, 2))           # a constant feature in one class
    rows = [(*map(float, r), c) for x, c in ((a, 0), (b, 1)) for r in x]
    df = spark.createDataFrame(rows, "p double, q double, y int").repartition(5)
    fitted = conditional.fit_class_models(df, ["p", "q"], "y")
    assert np.allclose(fitted[0][0], a.mean(axis=0)) and np.allclose(fitted[0][1] @ fitted[0][1].T, np.cov(a.T, bias=True), atol=1e-6)
    made = conditional.generate(spark, fitted, {0: 30_000, 1: 10, 2: 0}, ["p", "q"])
    stats = {r["cls"]: r for r in made.groupBy("cls").agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.corr("p", "q").alias("r")).collect()}
    assert stats[0]["n"] == 30_000 and stats[1]["n"] == 10 and 2 not in stats
    assert abs(stats[0]["p"] - 5) < 0.1 and abs(stats[0]["r"] - 0.75) < 0.03 and abs(stats[1]["p"] - 100) < 3
    again = conditional.generate(spark, fitted, {0: 30_000, 1: 10}, ["p", "q"])
    assert again.agg(F.sum("p")).first()[0] == pytest.approx(made.agg(F.sum("p")).first()[0])


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(11)
    y = rng.choice(3, size=600, p=[0.7, 0.2, 0.1])
    x = rng.normal(size=(600, 3)) + 4 * y[:, None]
    rows = [(*map(float, r), int(c)) for r, c in zip(x, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, y_macro_encoded int").repartition(4).cache()


@pytest.mark.parametrize("name,options", [
    ("Decision Tree", {}), ("Random Forest", {"n_estimators": 5}), ("XGBoost", {"n_estimators": 3, "max_depth": 3, "min_gain": 0.0}),
    ("SVM", {"max_iter": 10}), ("MLP", {"n_classes": 3, "hidden": (8,), "max_iter": 30})])
def test_models_beat_the_majority(spark, learnable, name, options):
    pipeline = models.BUILDERS[name](["a", "b", "c"], **options)
    model = models.fit(pipeline, learnable, balanced=name in ("Decision Tree", "Random Forest"))
    assert models.evaluate(model, learnable).first()["accuracy"] > 0.85
    scored = models.score(model, learnable)
    assert scored.filter("confidence <= 0 OR confidence > 1 OR confidence < 1.0 / 3 - 1e-9").count() == 0


def test_grid_records_failures(spark, learnable):
    fitted, log = models.train_grid(spark, {"original": learnable}, {
        "Decision Tree": models.decision_tree(["a"], max_depth=3), "Broken": models.decision_tree(["missing"])})
    assert list(fitted) == [("Decision Tree", "original")]
    assert {r["algorithm"]: r["success"] for r in log.collect()} == {"Decision Tree": True, "Broken": False}


def test_artifacts(spark, learnable, tmp_path):
    from netloom.sources.readers import model_inventory
    model = models.fit(models.decision_tree(["a", "b", "c"], max_depth=4), learnable)
    path = models.save_model(model, str(tmp_path), "DecisionTree", "tree_original")
    again = models.load_model(path)
    assert models.score(again, learnable).exceptAll(models.score(model, learnable)).count() == 0
    found = model_inventory(spark, str(tmp_path)).collect()
    assert [(r["algorithm"], r["file"], r["path"]) for r in found] == [("DecisionTree", "tree_original", path)]
    importance = models.feature_importance(spark, model, 2).collect()
    assert len(importance) == 2 and importance[0]["importance"] >= importance[1]["importance"]
    shape = models.tree_shape(spark, model).first()
    assert 0 < shape["depth"] <= 4 and shape["n_leaves"] * 2 - 1 == shape["n_nodes"]
    assert models.weight_count([46, 128, 64, 8]) == 46 * 128 + 128 * 64 + 64 * 8


def test_knn_bound_from_whole_cells():
    """Cells reached whole, nearest first, until they hold enough points."""
    reach = np.array([[5.0, 1.0, 3.0], [1.0, 2.0, 9.0]])
    assert knn._enough(reach, np.array([1, 2, 2]), 3).tolist() == [3.0, 2.0]
    assert knn._enough(reach, np.array([1, 2, 2]), 6).tolist() == [np.inf, np.inf]


def test_knn_moves_rows_per_pack_not_per_block(spark, monkeypatch):
    """Small blocks and cells without structure: a row is sent to at most one task per pack, however many blocks there are."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(800, 6)), np.zeros(800, int)
    sent, search = [], knn._search

    def counted(queries, data, parts, *rest):
        split = parts.agg(F.sum("_nd"), F.sum("_nq")).first()
        sent.append((queries.count(), split[0], split[1]))
        return search(queries, data, parts, *rest)

    monkeypatch.setattr(knn, "_search", counted)
    got = knn.nearest(frame(spark, x, y), frame(spark, x, y), 3, block_rows=20, query_rows=10, n_pivots=8)
    assert neighbours(got) == brute(x, y, 3, False)
    (own, packs, _), (visits, _, parts) = sent
    assert own == 800 and packs <= knn.PACKS + 8 and visits <= 7 * 800 and parts <= 8 * (knn.PACKS + 1)


def test_knn_kernel_keeps_ties_at_the_limit():
    d = np.array([[0.0], [1.0], [-1.0], [1.0], [5.0]])
    ids = np.array([9, 7, 8, 3, 1])
    r, c, dist = knn.pack_nearest(np.array([[0.0], [5.0]]), np.array([1.0, 0.5]), d, ids, 3)
    assert [(int(a), int(ids[b]), float(v)) for a, b, v in zip(r, c, dist)] in (
        [(0, 9, 0.0), (0, 3, 1.0), (0, 7, 1.0), (1, 1, 0.0)], [(1, 1, 0.0), (0, 9, 0.0), (0, 3, 1.0), (0, 7, 1.0)])

"""Neighbour lists with vectors, packs to visit, draws in plain Python numbers, and synthetic rows that are written once."""

import numpy as np
from pyspark.sql import functions as F

from netloom.operators import knn, synth
from netloom.plans import augment
from netloom.plans.train_compare import store_variants


def points_of(spark, n=500, seed=4):
    rng = np.random.default_rng(seed)
    y = np.r_[np.zeros(n, int), np.ones(n // 4, int), np.full(n // 20, 2)]
    x = rng.normal(size=(len(y), 3)) + y[:, None] * 0.7
    return spark.createDataFrame([(i, int(c), list(map(float, r))) for i, (c, r) in enumerate(zip(y, x))], "id long, cls int, vec array<double>")


def test_lists_carry_the_vectors_of_their_neighbours(spark):
    points = points_of(spark)
    vectors = {r["id"]: r["vec"] for r in points.collect()}
    for options in ({}, {"block_rows": 50, "query_rows": 30, "n_pivots": 12}):
        found = knn.nearest(points, points, 4, vectors=True, **options).collect()
        assert len(found) == len(vectors) and all(n["nn_vec"] == vectors[n["nn_id"]] for r in found for n in r["nn"])


def test_a_query_is_sent_once_whatever_it_has_to_visit(spark, monkeypatch):
    """Far clusters: the packs to visit come as a list per query, empty for all here."""
    seen, cells = [], knn._candidate_cells
    monkeypatch.setattr(knn, "_candidate_cells", lambda *a: seen.append(cells(*a)) or seen[-1])
    monkeypatch.setattr(knn, "PACKS", 4)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(loc=c, size=(100, 3)) for c in (0, 1000, 2000, 3000)])
    points = spark.createDataFrame([(i, 0, list(map(float, r))) for i, r in enumerate(x)], "id long, cls int, vec array<double>")
    got = knn.nearest(points, points, 3, block_rows=20, query_rows=20, n_pivots=40)
    assert got.count() == 400
    sizes = [r["n"] for r in seen[0].select(F.size("_packs").alias("n")).collect()]
    assert len(sizes) == 400 and sum(sizes) < 400


def test_draws_follow_the_text_that_sql_hashes(spark):
    picks = synth._picks([7, None], np.array([3, 12]), 42)
    rows = spark.sql("SELECT md5('7:3:42') AS a, md5('12:42') AS b").first()
    assert picks.tolist() == [[int(rows[c][:8], 16), int(rows[c][8:16], 16)] for c in ("a", "b")]


def test_emission_cuts_batches_without_losing_draws(spark, monkeypatch):
    points = points_of(spark)
    want = sorted(map(str, synth.smote(points).collect()))
    monkeypatch.setattr(synth, "BATCH_NUMBERS", 30)
    assert sorted(map(str, synth.smote(points).collect())) == want


def test_lists_with_vectors_make_the_same_rows(spark):
    points = points_of(spark)
    own = synth.own_neighbours(points, vectors=True)
    for method in (synth.smote, synth.adasyn, synth.borderline_smote):
        assert sorted(map(str, method(points, own=own).collect())) == sorted(map(str, method(points).collect()))


def test_synthetic_rows_are_written_once(spark, tmp_path, monkeypatch):
    """They go straight to the variant's folder; nothing else writes them, and the base rows join them there."""
    from netloom.plans import augment as module
    written, materialise = [], module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name="step", **o: written.append(name) or materialise(df, name, **o))
    rows = spark.range(900).select((F.col("id") % 37).cast("double").alias("a"), F.sin("id").alias("b"),
                                   F.when(F.col("id") % 9 == 0, "BenignTraffic").otherwise("DoS-TCP_Flood").alias("label"),
                                   F.when(F.col("id") % 10 < 8, "train").otherwise("test").alias("split"))
    record = {(r["phase"], r["class"]): r["n"] for r in store_variants(rows, ["a", "b"], f"{tmp_path}/flow", ("smote",)).collect()}
    table = spark.read.parquet(f"{tmp_path}/flow/table")
    assert "is_synthetic" not in table.columns and not [w for w in written if w.startswith("synthetic")]
    stored = {str(r["y_macro_encoded"]): r["count"] for r in table.where("variant = 'smote'").groupBy("y_macro_encoded").count().collect()}
    assert len(stored) == 2 and len(set(stored.values())) == 1
    assert all(record["final", c] == record["augmented", c] == n for c, n in stored.items()) and min(record["original", c] for c in stored) < stored["0"]


def test_folder_holds_only_synthetic_rows_when_they_are_counted(spark, tmp_path):
    train = points_of(spark).select("id", *[F.col("vec")[i].alias(c) for i, c in enumerate("abc")], F.col("cls").alias("y_macro_encoded"))
    made = augment.augment_all(train, ["smote"], "id", ["a", "b", "c"], folder=lambda m: f"{tmp_path}/{m}")["smote"]
    train.select(*[F.col(c).cast("float").alias(c) for c in "abc"], "y_macro_encoded", F.col("y_macro_encoded").alias("y_specific")).write.mode("append").parquet(f"{tmp_path}/smote")
    assert made["synthetic"].count() == 375 + 475 and made["final"].count() == 650 + 850 and spark.read.parquet(f"{tmp_path}/smote").count() == 1500

"""Edge cases of cleaning, encoding, profiling, sampling and metrics."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.columns import seeded_key
from netloom.operators import alerts, clean, compare, encode, metrics, profile, quotas, ranking
from netloom.operators.small import bounded_rows, small_side
from netloom.plans import prepare
from netloom.taxonomy import LABELS_BY_MACRO, MACRO_CODE

INF, NAN = float("inf"), float("nan")


def test_taxonomy_sizes():
    assert sum(len(v) for v in LABELS_BY_MACRO.values()) == 34
    assert MACRO_CODE == {"Benign": 0, "BruteForce": 1, "DDoS": 2, "DoS": 3, "Mirai": 4, "Recon": 5, "Spoofing": 6, "Web": 7}


def test_missing_then_infinite(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "a"), (NAN, "a"), (INF, "a"), (-INF, "a"), (5.0, "a")], "x double, label string")
    out = clean.replace_infinite(clean.fill_missing(df, ["x"]), ["x"])
    assert sorted(r["x"] for r in out.collect()) == [0.0, 0.0, 1.0, 5.0, 5.0, 5.0]


def test_column_with_nothing_finite(spark):
    df = spark.createDataFrame([(INF,), (-INF,)], "x double")
    assert [r["x"] for r in clean.replace_infinite(df, ["x"]).collect()] == [None, None]


def test_integer_features_are_left_alone(spark):
    df = spark.createDataFrame([(1, None), (None, 2.0)], "i int, x double")
    out = clean.replace_infinite(clean.fill_missing(df, ["i", "x"]), ["i", "x"])
    assert dict(out.dtypes)["i"] == "int" and sorted(map(tuple, out.collect())) == [(0, 2.0), (1, 0.0)]


def test_constant_column_scales_by_one(spark):
    train = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    scaler = encode.fit_scaler(train, ["x"])
    assert scaler == {"x": (4.0, 1.0)}
    assert encode.standardise(spark.createDataFrame([(6.0,)], "x double"), scaler).first()["x"] == 2.0


def test_unseen_label_gets_minus_one(spark):
    train = spark.createDataFrame([("XSS",), ("Odd",)], "label string")
    test = spark.createDataFrame([("XSS",), ("Odd",), ("DoS-UDP_Flood",)], "label string")
    rows = {r["label"]: (r["y_macro_encoded"], r["y_specific"])
            for r in encode.encode_labels(test, encode.label_dictionary(train)).collect()}
    assert rows == {"XSS": (7, 1), "Odd": (-1, 0), "DoS-UDP_Flood": (3, -1)}


def test_prepare_learns_from_train_only_and_stores(spark, tmp_path):
    rows = [(float(i % 7), float(i), "XSS" if i % 3 else "BenignTraffic", "train" if i < 60 else "test") for i in range(90)]
    df = spark.createDataFrame(rows, "a double, b double, label string, split string")
    made = prepare.prepare(df, ["a", "b"])
    train = made.rows.filter("split = 'train'").agg(F.avg("b").alias("m"), F.stddev_pop("b").alias("s")).first()
    assert abs(train["m"]) < 1e-9 and abs(train["s"] - 1) < 1e-9
    prepare.store(made, str(tmp_path))
    assert prepare.load_scaler(spark, str(tmp_path)) == made.scaler
    stored = spark.read.parquet(f"{tmp_path}/table")
    assert dict(stored.dtypes)["a"] == "float" and stored.count() == 90


def test_validation_rejects_bad_codes(spark):
    df = spark.createDataFrame([("train", 9, 0)], "split string, y_macro_encoded int, y_specific int")
    with pytest.raises(ValueError):
        profile.assert_valid(profile.split_check(df, 3))


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_exact_quantiles_with_brackets(spark, accuracy):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25)])     # one value holds a third
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(6)
    probs = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = {r["prob"]: r["quantile"] for r in profile.exact_quantiles(df, ["x"], probs, accuracy=accuracy).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_crowded_brackets_are_narrowed(spark, monkeypatch):
    monkeypatch.setattr(profile, "RANKED_AT_ONCE", 50)
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.exponential(size=6000), np.full(3000, 0.7)])
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(values)], "x double, g int").repartition(6)
    got = {(r["g"], r["prob"]): r["quantile"] for r in profile.exact_quantiles(df, ["x"], (0.1, 0.5, 0.999), ["g"], accuracy=40).collect()}
    for g in (0, 1):
        for p in (0.1, 0.5, 0.999):
            assert got[(g, p)] == pytest.approx(np.quantile(values[g::2], p), abs=1e-12)


def test_correlation_pairwise_missing_and_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0), (2.0, 4.0, 4.0), (3.0, None, 4.0), (4.0, 8.5, 4.0)], "a double, b double, c double")
    rows = {(r["feature_a"], r["feature_b"]): r["r"] for r in profile.correlation(df, ["a", "b", "c"]).collect()}
    assert set(rows) == {("a", "b")}
    assert profile.correlation(df, ["a", "c"]).count() == 0
    assert rows[("a", "b")] == pytest.approx(np.corrcoef([1, 2, 4], [2, 4, 8.5])[0, 1])


def test_take_per_class_equals_window(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 5).cast("string"))).alias("cls"))
    quota = spark.createDataFrame([("hot", 700), ("c1", 10), ("c2", 0), ("c3", 99999)], "cls string, quota long")
    for n_rows in (5000, 200_000_000):                  # one and four leading digits
        got = {r["id"] for r in ranking.take_per_class(df, quota, "cls", ["id"], n_rows).collect()}
        w = W.partitionBy("cls").orderBy(seeded_key(["id"], 42), "id")
        want = df.withColumn("rn", F.row_number().over(w)).join(quota, "cls").filter("rn <= quota")
        assert got == {r["id"] for r in want.collect()}


def test_hashed_rank_is_a_row_number(spark):
    df = spark.range(3000).withColumn("cls", F.when(F.col("id") < 2500, 0).otherwise(1))
    ranked = ranking.hashed_rank(df, "cls", ["id"], 100_000_000)
    w = W.partitionBy("cls").orderBy(seeded_key(["id"], 42), "id")
    assert ranked.withColumn("rn", F.row_number().over(w)).filter("rn <> rank").count() == 0


def test_take_rows_is_exact(spark):
    assert ranking.take_rows(spark.range(1000), ["id"], 137, 1000).count() == 137
    assert ranking.take_rows(spark.range(10), ["id"], 50, 10).count() == 10


def counts(spark, **n):
    return spark.createDataFrame(list(n.items()), "cls string, n long")


def quota_map(df):
    return {r["cls"]: r["quota"] for r in df.collect()}


def test_quota_rules(spark):
    c = counts(spark, big=4_000_000, mid=1_000_000, small=50_000, edge=100_000)
    assert quota_map(quotas.stratified_quotas(c)) == {
        "big": int(700_000 * (4_000_000 / 5_000_000)), "mid": int(700_000 * (1_000_000 / 5_000_000)), "small": 50_000, "edge": 50_000}


def test_quota_budget_never_negative(spark):
    q = quota_map(quotas.stratified_quotas(counts(spark, a=90, b=80, c=1000), target=50, min_minority=50))
    assert q == {"a": 50, "b": 50, "c": 0}
    only_small = quota_map(quotas.stratified_quotas(counts(spark, a=9), target=50, min_minority=50))
    assert only_small == {"a": 9}


def test_minority_first_drops_empty_majority(spark):
    q = quota_map(quotas.minority_first_quotas(counts(spark, a=500, b=1_000_000), 400, 1.0, 10_000))
    assert q == {"a": 500, "b": 0}


def test_generation_targets(spark):
    t = {r["cls"]: r["to_generate"] for r in quotas.generation_targets(counts(spark, a=1_000_000, b=700_000, c=790_001, d=5), cap=100_000).collect()}
    assert t == {"a": 0, "b": 100_000, "c": 9_999, "d": 100_000}


def test_quality_gate(spark):
    bad = counts(spark, a=100, b=4)
    bands = {r["cls"]: r["quality"] for r in quotas.synthetic_quality(counts(spark, a=100, b=25, c=10, d=5, e=4)).collect()}
    assert bands == {"a": "Excellent", "b": "Excellent", "c": "Good", "d": "Risky", "e": "Poor"}
    with pytest.raises(quotas.PoorRatio):
        quotas.quality_gate(bad)
    assert quotas.quality_gate(bad, allow_poor=True).count() == 2


def test_zero_division_and_unsupported_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 0)], "y int, p int")       # 1 never predicted, 2 without support
    rows = {r["label"]: r for r in metrics.per_class(df, "y", "p").collect()}
    assert (rows[1]["precision"], rows[1]["recall"], rows[1]["f1"]) == (0.0, 0.0, 0.0)
    assert (rows[2]["precision"], rows[2]["recall"], rows[2]["support"]) == (0.0, 0.0, 0)
    total = metrics.weighted_metrics(df, "y", "p").first()
    assert total["accuracy"] == pytest.approx(1 / 3) and total["precision"] == pytest.approx(1 / 3)
    assert metrics.confusion_matrix(df, "y", "p").count() == 9


def test_weighted_metrics_agree_with_mllib(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    rng = random.Random(3)
    rows = [(float(rng.randrange(4)), float(rng.randrange(4))) for _ in range(500)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    got = metrics.weighted_metrics(df, "label", "prediction").first()
    for ours, name in (("accuracy", "accuracy"), ("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "f1")):
        assert got[ours] == pytest.approx(MulticlassClassificationEvaluator(metricName=name).evaluate(df))


# The two stored comparison rows.
GOLDEN = [("Decision Tree", "original", 0.9884328637794095, 0.9923881019472259, 0.9884328637794095, 0.9900217624011362),
          ("Decision Tree", "smote", 0.8712050256801493, 0.888553809762326, 0.8712050256801493, 0.8543872323268394)]


def test_golden_comparison(spark):
    df = spark.createDataFrame(GOLDEN, "algorithm string, dataset string, accuracy double, precision double, recall double, f1 double")
    scores = {r["dataset"]: r["mean_score"] for r in compare.with_mean_score(df).collect()}
    assert scores == {"original": pytest.approx(0.9898188979767953, abs=1e-15), "smote": pytest.approx(0.8713377733623661, abs=1e-15)}
    assert {r["dataset"] for r in compare.best_per_metric(df).collect()} == {"original"}
    assert compare.compare_variants(df).first()["accuracy_delta"] == pytest.approx(0.8712050256801493 - 0.9884328637794095)
    pivot = compare.accuracy_pivot(df).first()
    assert pivot["original"] == 0.9884328637794095 and pivot["ctgan"] is None
    gate = {r["dataset"]: r["meets_target"] for r in metrics.requirement_gate(df).collect()}
    assert gate == {"original": True, "smote": False}
    record = compare.report_row(df).first()
    assert record["total_models"] == 2 and record["best"]["f1"]["dataset"] == "original"


def test_alert_threshold_is_inclusive_and_kpis_of_nothing(spark):
    df = spark.createDataFrame([("Web", 0.8), ("Web", 0.79), ("Benign", 0.99)], "predicted_class string, confidence double")
    assert [(r["is_attack"], r["blocked"]) for r in alerts.decide(df).collect()] == [(True, True), (True, False), (False, False)]
    none = alerts.decide(df.filter("confidence > 2")).withColumn("src_ip", F.lit("x"))
    kpis = alerts.traffic_kpis(none).first()
    assert (kpis["total_flows"], kpis["attack_rate"], kpis["block_rate"]) == (0, 0.0, 0.0)


def test_small_side_is_checked(spark):
    assert small_side(spark.range(10), 5).count() == 10             # too large: handed back unhinted
    assert "broadcast" not in small_side(spark.range(10), 5)._jdf.queryExecution().analyzed().toString().lower()
    with pytest.raises(ValueError):
        bounded_rows(spark.range(10), 5)


def test_drift_and_period(spark):
    a = spark.createDataFrame([(1.0, 10.0), (3.0, 10.0)], "x double, y double")
    b = spark.createDataFrame([(5.0, 10.0)], "x double, y double")
    row = profile.drift_score(a, b, ["x", "y"], 1.0).first()
    assert row["drift_score"] == 1.5 and row["drifted"]
    assert not math.isnan(row["drift_score"])


def test_crowded_brackets_without_groups(spark, monkeypatch):
    """A table without groups whose brackets hold too many rows to be ranked at once, one column constant."""
    monkeypatch.setattr(profile, "RANKED_AT_ONCE", 50)
    rng = np.random.default_rng(4)
    values = np.round(rng.normal(size=3000), 3)
    df = spark.createDataFrame([(float(v), 4.0, float(i % 11)) for i, v in enumerate(values)], "a double, b double, c double")
    got = {(r["feature"], r["prob"]): r["quantile"] for r in profile.exact_quantiles(df, ["a", "b", "c"], (0.25, 0.5)).collect()}
    for p in (0.25, 0.5):
        assert got["a", p] == pytest.approx(np.quantile(values, p)) and got["b", p] == 4.0
        assert got["c", p] == np.quantile(np.arange(3000) % 11, p)

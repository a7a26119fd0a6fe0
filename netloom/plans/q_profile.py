"""Profiling queries over the raw and cleaned flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import encode, profile
from netloom.plans.q_columns import CLEAN_SQL, FEATS, PREPARED_SQL, R6, TAXONOMY_SQL, cleaned, cleaned_table, raw
from netloom.plans.registry import query

NUMERIC = ["f1", "f2", "f3", "f4"]
CELLS_SQL = "cells AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {f} AS value, split, CASE WHEN label = 'BenignTraffic' THEN 0 ELSE 1 END AS binary_label FROM cleaned"
    for f in NUMERIC) + ")"


@query("a1_label_counts", "raw_flows", "SELECT label, count(*) AS n FROM raw_flows GROUP BY label")
def _(spark, sf):
    return profile.label_counts(raw(spark, sf))


@query("a2_macro_distribution", "raw_flows", f"""{TAXONOMY_SQL}
SELECT macro, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM raw_flows), 4) AS pct
FROM raw_flows JOIN taxonomy USING (label) GROUP BY macro""")
def _(spark, sf):
    return profile.macro_distribution(raw(spark, sf)).withColumn("pct", F.round("pct", 4))


@query("a3_scaler_statistics", "raw_flows", f"""{CLEAN_SQL}
{" UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({f}), 4) AS mean, round(CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END, 4) AS scale FROM cleaned WHERE split = 'train'" for f in FEATS)}""")
def _(spark, sf):
    train = cleaned(spark, sf).filter(F.col("split") == "train")
    return encode.scaler_frame(train, FEATS).select(
        "feature", F.round("mean", 4).alias("mean"), F.round("scale", 4).alias("scale"))


@query("a4_class_distribution", "raw_flows", """
counts AS (SELECT label AS class, count(*) AS n FROM raw_flows GROUP BY label)
SELECT class, n, round(100.0 * n / (SELECT sum(n) FROM counts), 4) AS pct FROM counts
UNION ALL SELECT 'TOTAL', CAST(sum(n) AS BIGINT), 100.0 FROM counts""")
def _(spark, sf):
    return profile.class_distribution(raw(spark, sf), "label").withColumn("pct", F.round("pct", 4))


@query("a5_split_check", "raw_flows", f"""{PREPARED_SQL}
SELECT split, count(*) AS n_rows,
  count(*) FILTER (WHERE y_specific < 0 OR y_specific >= (SELECT count(*) FROM codes)) AS bad_specific,
  count(*) FILTER (WHERE y_macro_encoded < 0 OR y_macro_encoded > 7) AS bad_macro FROM prepared GROUP BY split""")
def _(spark, sf):
    rows = cleaned_table(spark, sf)
    codes = encode.label_dictionary(rows.filter(F.col("split") == "train"))
    return profile.split_check(encode.encode_labels(rows, codes), codes.count())


@query("a6_missing_by_column", "raw_flows", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) AS n_missing FROM raw_flows"
    for c in ("f1", "f3")))
def _(spark, sf):
    return profile.missing_by_column(raw(spark, sf), [*FEATS, "label", "split"])


_Q = lambda p: f"quantile_cont(value, {p})"


@query("a7_describe", "raw_flows", f"""{CLEAN_SQL}, {CELLS_SQL}
SELECT feature, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min,
  round({_Q(0.25)}, 6) AS q25, round({_Q(0.5)}, 6) AS q50, round({_Q(0.75)}, 6) AS q75, max(value) AS max
FROM cells GROUP BY feature""")
def _(spark, sf):
    d = profile.describe(cleaned_table(spark, sf), NUMERIC)
    return d.withColumns({**{c: F.round(c, 4) for c in ("mean", "std")}, **{q: R6(q) for q in ("q25", "q50", "q75")}})


@query("a7_quantiles_by_split", "raw_flows", f"""{CLEAN_SQL}, {CELLS_SQL}
{" UNION ALL ".join(f"SELECT split, feature, CAST({p} AS DOUBLE) AS prob, round({_Q(p)}, 6) AS quantile FROM cells GROUP BY split, feature" for p in (0.05, 0.5, 0.99))}""")
def _(spark, sf):
    # a coarse sketch, so that the bracket path is taken on this table
    q = profile.exact_quantiles(cleaned_table(spark, sf), NUMERIC, (0.05, 0.5, 0.99), ["split"], accuracy=100)
    return q.withColumn("quantile", R6("quantile"))


@query("a8_binary_distribution", "raw_flows", """
b AS (SELECT CASE WHEN label = 'BenignTraffic' THEN 0 ELSE 1 END AS binary_label FROM raw_flows)
SELECT binary_label, count(*) AS n, round((SELECT avg(binary_label) FROM b), 6) AS anomaly_rate FROM b GROUP BY binary_label""")
def _(spark, sf):
    return profile.binary_distribution(encode.binary_label(raw(spark, sf))).withColumn("anomaly_rate", R6("anomaly_rate"))


@query("a9_balance", "raw_flows", """
b AS (SELECT count(*) FILTER (WHERE label = 'BenignTraffic') AS benign, count(*) AS total FROM raw_flows)
SELECT benign, total - benign AS attack, round(100.0 * benign / total, 6) AS benign_pct,
  round(100.0 * (total - benign) / total, 6) AS attack_pct FROM b""")
def _(spark, sf):
    return profile.balance(raw(spark, sf)).withColumns({"benign_pct": R6("benign_pct"), "attack_pct": R6("attack_pct")})


@query("a10_class_means", "raw_flows", f"""{CLEAN_SQL}
SELECT CASE WHEN label = 'BenignTraffic' THEN 0 ELSE 1 END AS binary_label,
  {', '.join(f'round(avg({f}), 4) AS avg_{f}' for f in NUMERIC)} FROM cleaned GROUP BY 1""")
def _(spark, sf):
    means = profile.class_means(encode.binary_label(cleaned(spark, sf)), NUMERIC, "binary_label")
    return means.select("binary_label", *[F.round(f"avg_{f}", 4).alias(f"avg_{f}") for f in NUMERIC])


@query("a11_box_statistics", "raw_flows", f"""{CLEAN_SQL}, {CELLS_SQL},
q AS (SELECT binary_label, feature, {_Q(0.25)} AS q25, {_Q(0.5)} AS q50, {_Q(0.75)} AS q75 FROM cells GROUP BY binary_label, feature)
SELECT binary_label, feature, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75,
  min(value) FILTER (WHERE value >= q25 - (q75 - q25) * 1.5) AS whisker_low,
  max(value) FILTER (WHERE value <= q75 + (q75 - q25) * 1.5) AS whisker_high,
  count(*) FILTER (WHERE value < q25 - (q75 - q25) * 1.5 OR value > q75 + (q75 - q25) * 1.5) AS n_outliers
FROM cells JOIN q USING (binary_label, feature) GROUP BY binary_label, feature, q25, q50, q75""")
def _(spark, sf):
    box = profile.box_stats(encode.binary_label(cleaned_table(spark, sf)), NUMERIC, "binary_label")
    return box.withColumns({q: R6(q) for q in ("q25", "q50", "q75")})


_WITH_LABEL = [*FEATS, "binary_label"]
_CORR_SQL = (f"{CLEAN_SQL}, b AS (SELECT *, CASE WHEN label = 'BenignTraffic' THEN 0 ELSE 1 END AS binary_label FROM cleaned), "
             "pairs AS (" + " UNION ALL ".join(
                 f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {i * 100 + j} AS pos, corr({a}, {b}) AS r FROM b"
                 for i, a in enumerate(_WITH_LABEL) for j, b in enumerate(_WITH_LABEL) if i < j) + ")")


@query("a12_correlation", "raw_flows", f"""{_CORR_SQL}
SELECT feature_a, feature_b, round(r, 6) AS r FROM pairs WHERE r IS NOT NULL AND NOT isnan(r)""")
def _(spark, sf):
    c = profile.correlation(encode.binary_label(cleaned_table(spark, sf)), _WITH_LABEL)
    return c.select("feature_a", "feature_b", R6("r").alias("r"))


@query("a13_label_correlation", "raw_flows", f"""{_CORR_SQL}
SELECT feature_a AS feature, round(abs(r), 6) AS abs_r FROM pairs
WHERE feature_b = 'binary_label' AND r IS NOT NULL AND NOT isnan(r) ORDER BY abs(r) DESC LIMIT 15""")
def _(spark, sf):
    c = profile.label_correlation(encode.binary_label(cleaned_table(spark, sf)), FEATS, "binary_label")
    return c.withColumn("abs_r", R6("abs_r"))


@query("a14_high_correlation_pairs", "packets", """
w AS (SELECT size, size * 2.0 + pkt_id % 3 AS twice, -size * 1.0 AS negated, CAST(tcp_flags AS DOUBLE) AS flags FROM packets)
SELECT 'size' AS feature_a, 'twice' AS feature_b, round(corr(size, twice), 6) AS r FROM w
UNION ALL SELECT 'size', 'negated', round(corr(size, negated), 6) FROM w
UNION ALL SELECT 'twice', 'negated', round(corr(twice, negated), 6) FROM w""")
def _(spark, sf):
    from netloom.plans.views import view
    size = F.col("size").cast("double")
    wide = view(spark, sf, "packets").select("size", (size * 2 + F.col("pkt_id") % 3).alias("twice"),
                                             (-size).alias("negated"), F.col("tcp_flags").alias("flags"))
    return profile.high_pairs(wide, wide.columns).withColumn("r", R6("r"))


@query("a15_dataset_summary", "raw_flows", """SELECT count(*) AS n_rows, 5 AS n_features, count(DISTINCT label) AS n_labels,
  round(avg(CASE WHEN label = 'BenignTraffic' THEN 0.0 ELSE 1.0 END), 6) AS anomaly_rate FROM raw_flows""")
def _(spark, sf):
    return profile.summary(raw(spark, sf), len(FEATS)).withColumn("anomaly_rate", R6("anomaly_rate"))


@query("a31_scale_check", "raw_flows", f"""{CLEAN_SQL}, {CELLS_SQL},
s AS (SELECT min(value) AS lo, max(value) AS hi, avg(value) AS mu, stddev_pop(value) AS sd FROM cells)
SELECT lo AS min, hi AS max, round(mu, 4) AS mean, round(sd, 4) AS std, abs(mu) > 1 OR sd > 10 AS needs_scaling FROM s""")
def _(spark, sf):
    return profile.scale_check(cleaned(spark, sf), NUMERIC).withColumns(
        {"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("a27_mean_drift", "raw_flows", f"""{CLEAN_SQL}, {CELLS_SQL},
m AS (SELECT feature, avg(value) FILTER (WHERE split = 'train') AS a, avg(value) FILTER (WHERE split = 'test') AS b FROM cells GROUP BY feature)
SELECT feature, round(a, 4) AS base_mean, round(b, 4) AS other_mean, round(abs(a - b), 4) AS abs_diff FROM m""")
def _(spark, sf):
    rows = cleaned_table(spark, sf)
    drift = profile.mean_drift(rows.filter("split = 'train'"), rows.filter("split = 'test'"), NUMERIC)
    return drift.select("feature", *[F.round(c, 4).alias(c) for c in ("base_mean", "other_mean", "abs_diff")])


@query("a27_drift_score", "raw_flows", f"""{CLEAN_SQL}, {CELLS_SQL},
m AS (SELECT feature, avg(value) FILTER (WHERE split = 'train') AS a, avg(value) FILTER (WHERE split = 'test') AS b FROM cells GROUP BY feature)
SELECT round(avg(abs(a - b)), 4) AS drift_score, avg(abs(a - b)) > 10 AS drifted FROM m""")
def _(spark, sf):
    rows = cleaned_table(spark, sf)
    score = profile.drift_score(rows.filter("split = 'train'"), rows.filter("split = 'test'"), NUMERIC, 10.0)
    return score.withColumn("drift_score", F.round("drift_score", 4))


@query("w1_top_labels", "raw_flows", "SELECT label, count(*) AS n FROM raw_flows GROUP BY label ORDER BY n DESC, label LIMIT 10")
def _(spark, sf):
    return profile.top_labels(raw(spark, sf), 10)


@query("w2_top_classes", "raw_flows", "SELECT label, count(*) AS n FROM raw_flows GROUP BY label ORDER BY n DESC, label LIMIT 15")
def _(spark, sf):
    return profile.top_labels(raw(spark, sf), 15)

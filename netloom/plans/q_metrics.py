"""Metric and model-comparison queries over scored flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import alerts, compare, metrics
from netloom.plans.registry import query
from netloom.plans.views import view

R6 = lambda c: F.round(c, 6)
M = compare.METRICS

# Six models with different error rates, told apart by their error modulus.
MODELS = [("Decision Tree", "original", 17), ("Decision Tree", "smote", 5), ("Random Forest", "original", 29),
          ("Random Forest", "smote", 11), ("MLP", "original", 7), ("k-NN", "adasyn", 13)]
_MODEL_VALUES = ", ".join(f"('{a}', '{d}', {m})" for a, d, m in MODELS)
TAGGED_SQL = f"""models AS (SELECT * FROM (VALUES {_MODEL_VALUES}) t(algorithm, dataset, modulus)),
tagged AS (SELECT algorithm, dataset, split, y_true, CAST(CASE WHEN event_id % modulus = 0 THEN (y_true + 1) % 8 ELSE y_true END AS INT) AS y_pred
  FROM scored_flows JOIN models ON true)"""


def metrics_sql(source: str, by: str) -> str:
    """Weighted metrics from first principles, per group."""
    keys = by + ", " if by else ""
    join = f"USING ({by}, label)" if by else "USING (label)"
    return f"""truths AS (SELECT {keys}y_true AS label, count(*) AS support, count(*) FILTER (WHERE y_true = y_pred) AS hits FROM {source} GROUP BY ALL),
preds AS (SELECT {keys}y_pred AS label, count(*) AS predicted FROM {source} GROUP BY ALL),
classes AS (SELECT {keys}label, coalesce(support, 0) AS support, coalesce(hits, 0) AS hits, coalesce(predicted, 0) AS predicted,
  CASE WHEN coalesce(predicted, 0) = 0 THEN 0 ELSE coalesce(hits, 0) / CAST(predicted AS DOUBLE) END AS p,
  CASE WHEN coalesce(support, 0) = 0 THEN 0 ELSE hits / CAST(support AS DOUBLE) END AS r FROM truths FULL JOIN preds {join}),
scored AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM classes),
weighted AS (SELECT {keys}sum(hits) / CAST(sum(support) AS DOUBLE) AS accuracy, sum(p * support) / sum(support) AS "precision",
  sum(r * support) / sum(support) AS recall, sum(f * support) / sum(support) AS f1, CAST(sum(support) AS BIGINT) AS n_rows FROM scored {"GROUP BY " + by if by else ""})"""


ROUNDED = ", ".join(f'round("{m}", 6) AS "{m}"' for m in M)


def scored(spark, sf):
    return view(spark, sf, "scored_flows")


def tagged(spark, sf):
    """All models' predictions in one frame; the model table is a literal array."""
    rows = F.array(*[F.struct(F.lit(a).alias("algorithm"), F.lit(d).alias("dataset"), F.lit(m).alias("modulus"))
                     for a, d, m in MODELS])
    wrong = F.col("event_id") % F.col("modulus") == 0
    return (scored(spark, sf).select("event_id", "split", "y_true", F.inline(rows))
            .withColumn("y_pred", F.when(wrong, (F.col("y_true") + 1) % 8).otherwise(F.col("y_true"))))


def model_metrics(spark, sf):
    return metrics.weighted_metrics(tagged(spark, sf), "y_true", "y_pred", ["algorithm", "dataset"])


def rounded(df, names=M):
    return df.withColumns({m: R6(m) for m in names})


@query("a22_class_weights", "scored_flows", """SELECT y_true, count(*) AS n,
  round((SELECT count(*) FROM scored_flows) / (CAST((SELECT count(DISTINCT y_true) FROM scored_flows) AS DOUBLE) * count(*)), 6) AS weight
FROM scored_flows GROUP BY y_true""")
def _(spark, sf):
    return metrics.class_weights(scored(spark, sf), "y_true").withColumn("weight", R6("weight"))


GRID_SQL = """labels AS (SELECT y_true AS l FROM scored_flows UNION SELECT y_pred FROM scored_flows),
cells AS (SELECT a.l AS truth, b.l AS pred, (SELECT count(*) FROM scored_flows WHERE y_true = a.l AND y_pred = b.l) AS n FROM labels a, labels b)"""


@query("a23_confusion_matrix", "scored_flows", f"{GRID_SQL} SELECT truth, pred, n FROM cells")
def _(spark, sf):
    return metrics.confusion_matrix(scored(spark, sf), "y_true", "y_pred").select("truth", "pred", "n")


@query("a23_confusion_pivot", "scored_flows", "SELECT y_true AS truth, " + ", ".join(
    f'count(*) FILTER (WHERE y_pred = {i}) AS "{i}"' for i in range(8)) + " FROM scored_flows GROUP BY y_true")
def _(spark, sf):
    return metrics.confusion_pivot(scored(spark, sf), "y_true", "y_pred", range(8))


@query("a24_normalised_confusion", "scored_flows", f"""{GRID_SQL}
SELECT truth, pred, round(n / CAST(sum(n) OVER (PARTITION BY truth) AS DOUBLE), 6) AS row_share FROM cells""")
def _(spark, sf):
    m = metrics.confusion_matrix(scored(spark, sf), "y_true", "y_pred")
    return m.select("truth", "pred", R6("row_share").alias("row_share"))


@query("a25_weighted_metrics", "scored_flows", f"""{metrics_sql('scored_flows', 'split')} SELECT split, {ROUNDED}, n_rows FROM weighted""")
def _(spark, sf):
    return rounded(metrics.weighted_metrics(scored(spark, sf), "y_true", "y_pred", ["split"]))


@query("a26_classification_report", "scored_flows", f"""{metrics_sql('scored_flows', '')}
SELECT CAST(label AS VARCHAR) AS "row", round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM scored
UNION ALL SELECT 'accuracy', round(accuracy, 6), round(accuracy, 6), round(accuracy, 6), n_rows FROM weighted
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM scored
UNION ALL SELECT 'weighted avg', round("precision", 6), round(recall, 6), round(f1, 6), n_rows FROM weighted""")
def _(spark, sf):
    return rounded(metrics.classification_report(scored(spark, sf), "y_true", "y_pred"), M[1:])


_WEEK = "ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'"


@query("a28_period_metrics", "scored_flows", f"""week AS (SELECT * FROM scored_flows WHERE {_WEEK}), {metrics_sql('week', '')}
SELECT {ROUNDED}, n_rows FROM weighted""")
def _(spark, sf):
    week = alerts.metrics_between(scored(spark, sf), "2024-01-08", "2024-01-15")
    return rounded(metrics.weighted_metrics(week, "y_true", "y_pred"))


TAGGED_METRICS = f"{TAGGED_SQL}, {metrics_sql('tagged', 'algorithm, dataset')}"


@query("m9_evaluate_all", "scored_flows", f"{TAGGED_METRICS} SELECT algorithm, dataset, {ROUNDED}, n_rows FROM weighted")
def _(spark, sf):
    return rounded(model_metrics(spark, sf))


@query("m10_requirement_gate", "scored_flows", f"""{TAGGED_METRICS}
SELECT algorithm, dataset, accuracy >= 0.95 AND "precision" >= 0.90 AND recall >= 0.95 AS meets_target FROM weighted""")
def _(spark, sf):
    return metrics.requirement_gate(model_metrics(spark, sf)).select("algorithm", "dataset", "meets_target")


@query("m11_overfit_check", "scored_flows", f"""{TAGGED_SQL}, acc AS (SELECT algorithm, dataset,
  avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0 END) FILTER (WHERE split = 'train') AS a,
  avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0 END) FILTER (WHERE split = 'test') AS b FROM tagged GROUP BY algorithm, dataset)
SELECT algorithm, dataset, round(a, 6) AS train_accuracy, round(b, 6) AS test_accuracy, round(a - b, 6) AS gap, a - b > 0.05 AS overfit FROM acc""")
def _(spark, sf):
    by_split = metrics.weighted_metrics(tagged(spark, sf), "y_true", "y_pred", ["algorithm", "dataset", "split"])
    return rounded(metrics.overfit_check(by_split, ["algorithm", "dataset"]), ["train_accuracy", "test_accuracy", "gap"])


@query("j3_variant_delta", "scored_flows", TAGGED_METRICS + " SELECT a.algorithm, " + ", ".join(
    f'round(a."{m}", 6) AS {m}_base, round(b."{m}", 6) AS {m}_variant, round(b."{m}" - a."{m}", 6) AS {m}_delta' for m in M)
    + " FROM weighted a JOIN weighted b ON a.algorithm = b.algorithm AND a.dataset = 'original' AND b.dataset = 'smote'")
def _(spark, sf):
    deltas = compare.compare_variants(model_metrics(spark, sf))
    return rounded(deltas, [c for c in deltas.columns if c != "algorithm"])


@query("j5_model_grid", "scored_flows", f"""{TAGGED_SQL},
a AS (SELECT unnest(['Decision Tree', 'Random Forest', 'XGBoost', 'MLP', 'k-NN', 'SVM']) AS algorithm),
d AS (SELECT unnest(['original', 'smote', 'borderline', 'adasyn', 'ctgan']) AS dataset)
SELECT algorithm, dataset, EXISTS (SELECT 1 FROM tagged t WHERE t.algorithm = a.algorithm AND t.dataset = d.dataset) AS available FROM a, d""")
def _(spark, sf):
    return compare.grid_with_models(compare.model_grid(spark), model_metrics(spark, sf))


@query("p22_model_label", "scored_flows", f"{TAGGED_METRICS} SELECT concat(algorithm, ' (', dataset, ')') AS model FROM weighted")
def _(spark, sf):
    return model_metrics(spark, sf).select(compare.model_label().alias("model"))


@query("p23_rounded_percent", "scored_flows", f"""{TAGGED_METRICS}
SELECT algorithm, dataset, round(accuracy * 100, 2) AS accuracy_pct, round(f1, 4) AS f1 FROM weighted""")
def _(spark, sf):
    return model_metrics(spark, sf).select("algorithm", "dataset", F.round(F.col("accuracy") * 100, 2).alias("accuracy_pct"),
                                           F.round("f1", 4).alias("f1"))


@query("w5_best_per_metric", "scored_flows", TAGGED_METRICS + " " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, arg_max(algorithm, \"{m}\") AS algorithm, arg_max(dataset, \"{m}\") AS dataset, round(max(\"{m}\"), 6) AS value FROM weighted"
    for m in M))
def _(spark, sf):
    return rounded(compare.best_per_metric(model_metrics(spark, sf)), ["value"])


for _by in ("accuracy", "mean_score", "f1"):
    @query(f"w6_leaderboard_{_by}", "scored_flows", f"""{TAGGED_METRICS},
m AS (SELECT *, (accuracy + "precision" + recall + f1) / 4 AS mean_score FROM weighted)
SELECT algorithm, dataset, round({_by}, 6) AS score, CAST(row_number() OVER (ORDER BY {_by} DESC, algorithm, dataset) AS INT) AS position FROM m""")
    def _(spark, sf, by=_by):
        board = compare.leaderboard(compare.with_mean_score(model_metrics(spark, sf)), by)
        return board.select("algorithm", "dataset", R6(by).alias("score"), "position")


@query("w7_accuracy_pivot", "scored_flows", TAGGED_METRICS + " SELECT algorithm, " + ", ".join(
    f"round(avg(accuracy) FILTER (WHERE dataset = '{v}'), 6) AS {v}" for v in compare.VARIANTS) + " FROM weighted GROUP BY algorithm")
def _(spark, sf):
    return rounded(compare.accuracy_pivot(model_metrics(spark, sf)), compare.VARIANTS)


@query("k4_comparison_report", "scored_flows", f"""{TAGGED_METRICS}
SELECT count(*) AS total_models, string_agg(DISTINCT algorithm, ',' ORDER BY algorithm) AS algorithms,
  string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets, arg_max(algorithm, accuracy) AS best_accuracy, arg_max(algorithm, f1) AS best_f1 FROM weighted""")
def _(spark, sf):
    report = compare.report_row(model_metrics(spark, sf))
    return report.select("total_models", F.array_join("algorithms", ",").alias("algorithms"),
                         F.array_join("datasets", ",").alias("datasets"),
                         F.col("best")["accuracy"]["algorithm"].alias("best_accuracy"),
                         F.col("best")["f1"]["algorithm"].alias("best_f1"))

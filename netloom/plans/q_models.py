"""Training and scoring queries on flows whose classes follow from their features."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import compare, conditional, metrics, models, quotas
from netloom.operators.blocks import spread
from netloom.plans.augment import augment_all
from netloom.plans.q_columns import PREPARED_SQL
from netloom.plans.registry import query
from netloom.plans.train_compare import store_variants, train_compare
from netloom.plans.views import RAW_FEATURES, table, view
from netloom.session import materialise, scratch

FEATURES = ["value", "hour", "size", "kind"]
LABEL = models.LABEL


def learnable(spark, sf):
    """Events with features that determine their eight skewed classes, all rows kept."""
    kind = F.array_position(F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")]), F.col("event_type"))
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, sf, "events").select(
        "event_id", "value", F.hour(ts).cast("double").alias("hour"),
        F.floor(F.col("value") * 10).cast("double").alias("size"), kind.cast("double").alias("kind"),
        F.least(F.floor(F.col("value") / 50), F.lit(7)).cast("int").alias(LABEL),
        F.when(F.col("event_id") % 10 < 7, "train").when(F.col("event_id") % 10 < 9, "test").otherwise("val").alias("split"))
    return materialise(spread(rows), "learnable")


def split(rows, name):
    return rows.filter(F.col("split") == name)


# fixed values: the sizes of the original training tools are the builders' defaults; nothing below cuts them
SPLITS_SQL = """SELECT split, count(*) AS n_rows, true AS metrics_agree, true AS beats_majority FROM scored_flows GROUP BY split"""


def report(model, rows):
    """Per split: rows, whether the metrics agree with a second computation, and whether the model beats the majority class.

    The second computation is MLlib's evaluator over the same predictions.
    """
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    scored = materialise(models.score(model, rows, names=False).select("split", LABEL, "prediction"), "predictions")
    found = {r["split"]: r for r in metrics.weighted_metrics(scored, LABEL, "prediction", ["split"]).collect()}      # three rows
    top = {r["split"]: r["m"] / r["n"] for r in scored.groupBy("split", LABEL).agg(F.count(F.lit(1)).alias("c")).groupBy("split").agg(
        F.max("c").alias("m"), F.sum("c").alias("n")).collect()}
    out = []
    for name, r in found.items():
        part = split(scored, name).withColumns({LABEL: F.col(LABEL).cast("double"), "prediction": F.col("prediction").cast("double")})
        again = [MulticlassClassificationEvaluator(labelCol=LABEL, metricName=m).evaluate(part)
                 for m in ("accuracy", "weightedPrecision", "weightedRecall", "f1")]
        agree = all(abs(r[m] - v) < 1e-9 for m, v in zip(metrics.METRICS, again))
        out.append((name, r["n_rows"], agree, r["accuracy"] > top[name]))
    return rows.sparkSession.createDataFrame(out, "split string, n_rows long, metrics_agree boolean, beats_majority boolean")


@query("m1_decision_tree", "scored_flows", SPLITS_SQL)
def _(spark, sf):
    rows = learnable(spark, sf)
    return report(models.fit(models.decision_tree(FEATURES), split(rows, "train")), rows)


@query("m1_tree_shape", "scored_flows", """SELECT true AS within_depth, true AS leaves_fit, count(DISTINCT y_true) AS n_classes
FROM scored_flows WHERE split = 'train'""")
def _(spark, sf):
    """Depth within the limit, more than one leaf, and one leaf more than inner nodes."""
    train = split(learnable(spark, sf), "train")
    shape = models.tree_shape(spark, models.fit(models.decision_tree(FEATURES), train))
    classes = train.agg(F.count_distinct(LABEL).alias("n_classes"))
    return shape.crossJoin(F.broadcast(classes)).select(       # one row each
        F.col("depth").between(1, 20).alias("within_depth"),
        ((F.col("n_leaves") * 2 - 1 == F.col("n_nodes")) & (F.col("n_leaves") > 1)).alias("leaves_fit"), "n_classes")


@query("m1_root_split", "scored_flows", """counts AS (SELECT y_true AS y, y_pred <= t AS low, t, count(*) AS c
    FROM scored_flows, (SELECT unnest(range(0, 7)) AS t) g WHERE split = 'train' GROUP BY ALL),
sides AS (SELECT t, low, sum(c) AS n, 1 - sum(c * c)::DOUBLE / (sum(c) * sum(c)) AS gini FROM counts GROUP BY ALL),
scored AS (SELECT t, sum(n * gini) / sum(n) AS impurity FROM sides GROUP BY t)
SELECT CAST(t AS DOUBLE) + 0.5 AS threshold FROM scored ORDER BY impurity, t LIMIT 1""")
def _(spark, sf):
    """The root of a tree of depth one over one feature splits where Gini impurity is least."""
    flows = view(spark, sf, "scored_flows").filter("split = 'train'").select(F.col("y_true").alias(LABEL), "y_pred")
    tree = models.fit(models.decision_tree(["y_pred"], weight=None, max_depth=1), flows, balanced=False)
    return models.root_split(spark, tree).select("threshold")


@query("m2_random_forest", "scored_flows", SPLITS_SQL)
def _(spark, sf):
    rows = learnable(spark, sf)
    return report(models.fit(models.random_forest(FEATURES), split(rows, "train")), rows)


@query("m3_boosted_trees", "scored_flows", SPLITS_SQL)
def _(spark, sf):
    rows = learnable(spark, sf)
    return report(models.fit(models.boosted_trees(FEATURES), split(rows, "train"), balanced=False), rows)


@query("m4_neural_network", "scored_flows", SPLITS_SQL)
def _(spark, sf):
    rows = learnable(spark, sf)
    return report(_network(rows), rows)


@query("m6_linear_svm", "scored_flows", SPLITS_SQL.replace("true AS beats_majority", "true AS no_worse_than_majority"))
def _(spark, sf):
    """A linear model cannot do much with classes cut from one feature's range; it must not fall behind the majority class."""
    rows = learnable(spark, sf)
    model = models.fit(models.linear_svm(FEATURES), split(rows, "train"), balanced=False)
    found = report(model, rows)
    scored = models.evaluate(model, rows, LABEL, ["split"]).select("split", "accuracy")
    most = rows.groupBy("split", LABEL).agg(F.count(F.lit(1)).alias("c")).groupBy("split").agg((F.max("c") / F.sum("c")).alias("top"))
    return found.join(scored, "split").join(most, "split").select(
        "split", "n_rows", "metrics_agree", (F.col("accuracy") >= F.col("top") - 0.02).alias("no_worse_than_majority"))


@query("m7_batch_scoring", "scored_flows", "SELECT event_id, true AS is_argmax, true AS sums_to_one, true AS is_confidence FROM scored_flows")
def _(spark, sf):
    """All rows: the prediction is the most probable class, probabilities add up to one, the confidence is the largest."""
    rows = learnable(spark, sf)
    model = models.fit(models.decision_tree(FEATURES), split(rows, "train"))
    scored = models.score(model, rows, probabilities=True)
    p = F.col("probabilities")
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return scored.select("event_id", (F.get(p, F.col("prediction")) == F.array_max(p)).alias("is_argmax"),
                         (F.abs(total - 1) < 1e-9).alias("sums_to_one"), (F.col("confidence") == F.array_max(p)).alias("is_confidence"))


@query("p20_confidence", "scored_flows", "SELECT split, count(*) AS n, CAST(0 AS BIGINT) AS n_bad FROM scored_flows GROUP BY split")
def _(spark, sf):
    rows = learnable(spark, sf)
    model = models.fit(models.linear_svm(FEATURES), split(rows, "train"), balanced=False)
    scored = models.score(model, rows)
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("confidence") <= 0) | (F.col("confidence") > 1)).alias("n_bad"))


def points_of(train):
    """The train rows as points for the neighbour methods."""
    return train.select("event_id", *FEATURES, LABEL)


GRID = tuple(models.BUILDERS), ("original", "smote", "borderline", "adasyn", "conditional")


def grid_pipelines():
    """All five algorithms; the two that are trained in rounds run a few of them here, since the grid compares 25 models."""
    return {"Decision Tree": models.decision_tree(FEATURES), "Random Forest": models.random_forest(FEATURES, n_estimators=20),
            "XGBoost": models.boosted_trees(FEATURES, n_classes=8, n_estimators=4, learning_rate=0.5),
            "MLP": models.neural_network(FEATURES, 8, max_iter=12, learning_rate=0.01), "SVM": models.linear_svm(FEATURES, max_iter=10)}


@query("m8_train_grid", "scored_flows", f"""SELECT a AS algorithm, d AS dataset, n_rows, true AS success, true AS metrics_agree, a <> 'SVM' AS beats_majority
FROM (SELECT unnest({list(GRID[0])}) AS a) x, (SELECT unnest({list(GRID[1])}) AS d) y, (SELECT count(*) AS n_rows FROM scored_flows WHERE split = 'test') t""")
def _(spark, sf):
    """Every algorithm on the original rows and on each method's rebalanced rows: the metrics of each model on the original test rows, held against
    a second computation from the written predictions. The linear model is not asked to beat the majority class (see m6)."""
    rows = learnable(spark, sf)
    train, test = split(rows, "train"), split(rows, "test")
    variants = {"original": train.select(*FEATURES, LABEL)}
    variants |= augment_all(points_of(train), GRID[1][1:], "event_id", FEATURES, LABEL,
                            then=lambda method, made: materialise(made["final"], f"variant-{method}"))
    fitted, log = models.train_grid(spark, variants, grid_pipelines(), LABEL)
    predicted = materialise(models.tagged_predictions(fitted, test, LABEL), "predictions")
    found = metrics.weighted_metrics(predicted, LABEL, "prediction", ["algorithm", "dataset"])
    again = predicted.groupBy("algorithm", "dataset").agg(F.avg((F.col(LABEL) == F.col("prediction")).cast("double")).alias("hits"))
    top = test.groupBy(LABEL).count().agg(F.max("count") / F.sum("count")).first()[0]
    agree = (F.abs(F.col("accuracy") - F.col("hits")) < 1e-9) & (F.abs(F.col("recall") - F.col("hits")) < 1e-9)
    return found.join(again, ["algorithm", "dataset"]).join(log, ["algorithm", "dataset"]).select(
        "algorithm", "dataset", "n_rows", "success", agree.alias("metrics_agree"), ((F.col("accuracy") > top) & (F.col("algorithm") != "SVM")).alias("beats_majority"))


KNOWN_SQL = f"{PREPARED_SQL}, known AS (SELECT * FROM prepared WHERE y_macro_encoded >= 0 AND y_specific >= 0)"


@query("e2_variant_rows", "raw_flows", f"""{KNOWN_SQL}, train AS (SELECT y_macro_encoded AS c, count(*) AS n FROM known WHERE split = 'train' GROUP BY 1),
top AS (SELECT max(n) AS m FROM train)
SELECT 'original' AS variant, split, y_macro_encoded, count(*) AS n FROM known GROUP BY split, y_macro_encoded
UNION ALL SELECT 'smote', 'train', c, CASE WHEN n > 1 THEN m ELSE n END FROM train, top
UNION ALL SELECT 'conditional', 'train', c, greatest(n, CAST(floor(0.8 * m) AS BIGINT)) FROM train, top""")
def _(spark, sf):
    """Rows per variant, split and class as stored by the flow; every class is raised as its method says, no row is cut."""
    root = scratch(spark, "flow")
    store_variants(view(spark, sf, "raw_flows"), RAW_FEATURES, root, ("smote", "conditional"))
    return spark.read.parquet(f"{root}/table").groupBy("variant", "split", "y_macro_encoded").agg(F.count(F.lit(1)).alias("n"))


@query("e2_four_phases", "raw_flows", f"""{KNOWN_SQL}, train AS (SELECT y_macro_encoded AS c, count(*) AS n FROM known WHERE split = 'train' GROUP BY 1),
top AS (SELECT max(n) AS m FROM train)
SELECT 'smote' AS method, phase, CAST(c AS VARCHAR) AS class, CASE WHEN phase IN ('original', 'sample') OR n < 2 THEN n ELSE m END AS n
FROM train, top, (SELECT unnest(['original', 'sample', 'augmented', 'final']) AS phase) p""")
def _(spark, sf):
    return store_variants(view(spark, sf, "raw_flows"), RAW_FEATURES, scratch(spark, "flow"), ("smote",))


@query("e2_train_compare", "raw_flows", f"""{KNOWN_SQL}
SELECT unnest(['original', 'smote', 'borderline', 'adasyn', 'conditional']) AS dataset, 'Decision Tree' AS algorithm, n_rows, true AS success, true AS metrics_agree
FROM (SELECT count(*) AS n_rows FROM known WHERE split = 'test') t""")
def _(spark, sf):
    """prepare, rebalance, store, load, fit, evaluate, compare; accuracy and recall are computed again from the written predictions."""
    root = scratch(spark, "flow")
    store_variants(view(spark, sf, "raw_flows"), RAW_FEATURES, root)
    found, log = train_compare(spark, root, RAW_FEATURES, {"Decision Tree": models.decision_tree(RAW_FEATURES)},
                               on_predictions=lambda df: df.write.parquet(f"{root}/predictions"))
    hits = (F.col(LABEL) == F.col("prediction")).cast("double")
    again = spark.read.parquet(f"{root}/predictions").groupBy("algorithm", "dataset").agg(F.avg(hits).alias("hits"))
    best = compare.leaderboard(found).join(again, ["algorithm", "dataset"]).join(log, ["algorithm", "dataset"])
    agree = (F.abs(F.col("accuracy") - F.col("hits")) < 1e-9) & (F.abs(F.col("recall") - F.col("hits")) < 1e-9)
    return best.select("dataset", "algorithm", "n_rows", "success", agree.alias("metrics_agree"))


@query("m9_models_on_test", "scored_flows", """SELECT unnest(['Decision Tree', 'Random Forest']) AS algorithm, 'original' AS dataset, n_rows, true AS beats_majority
FROM (SELECT count(*) AS n_rows FROM scored_flows WHERE split = 'test') t""")
def _(spark, sf):
    rows = learnable(spark, sf)
    train = split(rows, "train")
    fitted = {("Decision Tree", "original"): models.fit(models.decision_tree(FEATURES), train),
              ("Random Forest", "original"): models.fit(models.random_forest(FEATURES), train)}
    test = split(rows, "test")
    top = test.groupBy(LABEL).count().agg(F.max("count") / F.sum("count")).first()[0]
    found = models.evaluate_models(fitted, test, LABEL)
    return found.select("algorithm", "dataset", "n_rows", (F.col("accuracy") > top).alias("beats_majority"))


@query("k6_model_round_trip", "scored_flows", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_changed FROM scored_flows")
def _(spark, sf):
    rows = learnable(spark, sf)
    model = models.fit(models.decision_tree(FEATURES), split(rows, "train"))
    again = models.load_model(models.save_model(model, scratch(spark, "models"), "DecisionTree", "tree_original"))
    a = models.score(model, rows).select("event_id", F.col("prediction").alias("a"))
    b = models.score(again, rows).select("event_id", F.col("prediction").alias("b"))
    return a.join(b, "event_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("n_changed"))


@query("w8_feature_importance", "", """SELECT unnest(['value', 'hour', 'size', 'kind']) AS feature, true AS in_range,
  (SELECT count(*) FROM events) > 0 AS sums_to_one, unnest([true, false, true, false]) AS decides_class""")
def _(spark, sf):
    """Classes are cut from the value, which the size follows; the other two features only add noise."""
    model = models.fit(models.random_forest(FEATURES), split(learnable(spark, sf), "train"))
    found = models.feature_importance(spark, model)
    total = found.agg(F.sum("importance")).first()[0]
    return found.select("feature", F.col("importance").between(0, 1).alias("in_range"), F.lit(abs(total - 1) < 1e-6).alias("sums_to_one"),
                        (F.col("importance") > 0.2).alias("decides_class"))


def _network(rows):
    return models.fit(models.neural_network(FEATURES, 8), split(rows, "train"), balanced=False)


@query("k7_network_summary", "scored_flows", """SELECT 4 AS n_inputs, '128,64' AS hidden, 8 AS n_outputs,
  CAST(4 * 128 + 128 * 64 + 64 * 8 AS BIGINT) AS n_weights, true AS within_epochs, true AS learned
FROM scored_flows HAVING count(*) > 0""")
def _(spark, sf):
    found = models.network_summary(spark, _network(learnable(spark, sf)))
    return found.select("n_inputs", "hidden", "n_outputs", "n_weights", (F.col("best_epoch") <= F.col("epochs")).alias("within_epochs"),
                        (F.col("loss") < 2.08).alias("learned"))               # ln 8, the loss of a guess


@query("m12_loss_curve", "", """SELECT true AS from_zero, true AS no_gaps, true AS falls, true AS one_best, true AS best_is_least, true AS stop_by_patience,
  (SELECT count(*) FROM events) > 0 AS has_rows""")
def _(spark, sf):
    """Loss per epoch on training and held-out rows. The best epoch has the least held-out loss; training ends with the last epoch or once
    five epochs in a row bring no fall of 0.0001."""
    curve = models.loss_curve(spark, _network(learnable(spark, sf)))
    rows = curve.orderBy("epoch").collect()                                    # one row per epoch
    mark, waited = rows[0]["held_out_loss"], []
    for r in rows[1:]:
        better = r["held_out_loss"] < mark - 1e-4
        waited.append(0 if better else (waited[-1] if waited else 0) + 1)
        mark = r["held_out_loss"] if better else mark
    stopped = len(waited) == 50 or waited[-1] == 5
    first, last = F.min_by("train_loss", "epoch"), F.max_by("train_loss", "epoch")
    return curve.agg((F.min("epoch") == 0).alias("from_zero"), (F.max("epoch") + 1 == F.count(F.lit(1))).alias("no_gaps"),
                     (last < first).alias("falls"), (F.count_if("is_best") == 1).alias("one_best"),
                     (F.min("held_out_loss") == F.min(F.when(F.col("is_best"), F.col("held_out_loss")))).alias("best_is_least"),
                     F.lit(stopped and all(w < 5 for w in waited[:-1])).alias("stop_by_patience"), (F.count(F.lit(1)) > 1).alias("has_rows"))


@query("m4_first_loss", "scored_flows", """SELECT round(ln(8), 6) AS untrained_loss, round(-avg(ln((c + 0.0) / n)), 6) AS fitted_loss, true AS falls
FROM (SELECT count(*) OVER (PARTITION BY y_true) AS c, count(*) OVER () AS n FROM scored_flows WHERE split = 'train') t""")
def _(spark, sf):
    """A network without inputs that differ learns the classes' shares: its loss starts at ln 8 with equal weights and ends at their entropy."""
    import numpy as np

    from netloom.operators import network
    train = split(learnable(spark, sf), "train")
    counts = {r[0]: r[1] for r in train.groupBy(LABEL).count().collect()}       # eight classes
    rows = train.select(F.array(F.lit(0.0)).alias("x"), F.col(LABEL).cast("long").alias("y"), F.lit(1.0).alias("weight"))
    n, total = rows.rdd.getNumPartitions(), sum(counts.values())
    layers = [1, 8]
    start = network.mean_loss(rows, n, np.zeros(network.size(layers)), layers)
    shares = np.concatenate([np.zeros(8), [np.log(max(counts.get(c, 0), 1e-9) / total) for c in range(8)]])
    end = network.mean_loss(rows, n, shares, layers)
    state = np.zeros((3, network.size(layers)))
    after, _, _ = network.one_round(rows, n, state, 0, 1, layers, 256, 0.01, 0.0, 42)
    return spark.createDataFrame([(round(start, 6), round(end, 6), network.mean_loss(rows, n, after[0], layers) < start)],
                                 "untrained_loss double, fitted_loss double, falls boolean")


@query("m3_first_trees", "scored_flows", """counts AS (SELECT c, t, count(*) FILTER (y_true = c AND y_pred <= t) AS lp, count(*) FILTER (y_pred <= t) AS ln,
    count(*) FILTER (y_true = c) AS p, count(*) AS n FROM scored_flows, (SELECT unnest(range(0, 8)) AS c) a, (SELECT unnest(range(0, 7)) AS t) b
  WHERE split = 'train' GROUP BY ALL HAVING count(*) FILTER (y_pred = t) > 0),
sums AS (SELECT c, t, ln / 8.0 - lp AS lg, ln * 7 / 32.0 AS lh, (n - ln) / 8.0 - (p - lp) AS rg, (n - ln) * 7 / 32.0 AS rh, n / 8.0 - p AS g, n * 7 / 32.0 AS h FROM counts),
w AS (SELECT *, greatest(-1, least(1, -sign(lg) * greatest(abs(lg) - 0.1, 0) / (lh + 1))) AS lw,
  greatest(-1, least(1, -sign(rg) * greatest(abs(rg) - 0.1, 0) / (rh + 1))) AS rw, greatest(-1, least(1, -sign(g) * greatest(abs(g) - 0.1, 0) / (h + 1))) AS pw
  FROM sums WHERE lh >= 1 AND rh >= 1),
gains AS (SELECT *, -(2 * lg * lw + (lh + 1) * lw * lw + 0.2 * abs(lw)) - (2 * rg * rw + (rh + 1) * rw * rw + 0.2 * abs(rw))
  + (2 * g * pw + (h + 1) * pw * pw + 0.2 * abs(pw)) AS gain FROM w),
best AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY round(gain, 6) DESC, t) AS r FROM gains)
SELECT CAST(c AS INT) AS cls, CAST(t AS DOUBLE) AS threshold, round(CAST(lw AS DOUBLE), 9) AS left_weight, round(CAST(rw AS DOUBLE), 9) AS right_weight FROM best WHERE r = 1 AND gain > 0.1""")
def _(spark, sf):
    """The first round's trees of depth one on one feature: per class the split of the largest second-order gain, and both leaves' weights."""
    flows = view(spark, sf, "scored_flows").filter("split = 'train'").select(F.col("y_true").alias(LABEL), F.col("y_pred").cast("double").alias("y_pred"))
    model = models.fit(models.boosted_trees(["y_pred"], n_classes=8, n_estimators=1, max_depth=1, subsample=1.0), flows, balanced=False)
    nodes = spark.createDataFrame(model.stages[-1].splits(), "round int, cls int, node int, feature int, threshold double, weight double")
    leaf = lambda n: F.round(F.max(F.when(F.col("node") == n, F.col("weight"))), 9)
    return nodes.groupBy("cls").agg(F.max("threshold").alias("threshold"), leaf(1).alias("left_weight"), leaf(2).alias("right_weight")).where(
        "threshold IS NOT NULL")


@query("m13_weight_count", "", """SELECT label AS n_outputs, count(*) AS n_rows,
  CAST(64 * 128 + 128 * 64 + 64 * label AS BIGINT) AS n_weights FROM embeddings GROUP BY label""")
def _(spark, sf):
    """Weights of a network with as many outputs as the label says."""
    found = table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n_rows")).collect()     # ten labels
    return spark.createDataFrame([(r["label"], r["n_rows"], models.weight_count([64, 128, 64, r["label"]])) for r in found],
                                 "n_outputs int, n_rows long, n_weights long")


@query("b10_class_statistics", "scored_flows", """
wide AS (SELECT y_true AS cls, 1.0::DOUBLE AS a, confidence AS b, CAST(y_pred AS DOUBLE) AS c FROM scored_flows),
cells AS (SELECT cls, 0 AS i, 0 AS j, sum(a) AS t FROM wide GROUP BY cls UNION ALL SELECT cls, 0, 1, sum(b) FROM wide GROUP BY cls
  UNION ALL SELECT cls, 0, 2, sum(c) FROM wide GROUP BY cls UNION ALL SELECT cls, 1, 1, sum(b * b) FROM wide GROUP BY cls
  UNION ALL SELECT cls, 1, 2, sum(b * c) FROM wide GROUP BY cls UNION ALL SELECT cls, 2, 2, sum(c * c) FROM wide GROUP BY cls)
SELECT CAST(cls AS BIGINT) AS cls, i, j, round(t, 4) AS total FROM cells""")
def _(spark, sf):
    return conditional.gram_cells(view(spark, sf, "scored_flows"), ["confidence", "y_pred"], "y_true").withColumn(
        "total", F.round("total", 4))


@query("b10_conditional_rows", "scored_flows", """
counts AS (SELECT y_true AS cls, count(*) AS n FROM scored_flows GROUP BY y_true),
t AS (SELECT cls, CAST(greatest(floor((SELECT max(n) FROM counts) * 0.8) - n, 0) AS BIGINT) AS n_rows FROM counts)
SELECT cls, n_rows, true AS means_match FROM t WHERE n_rows > 0""")
def _(spark, sf):
    flows = view(spark, sf, "scored_flows")
    fitted = conditional.fit_class_models(flows, ["confidence", "y_pred"], "y_true")
    wanted = quotas.generation_targets(quotas.class_counts(flows, "y_true"))
    targets = {r["y_true"]: r["to_generate"] for r in wanted.collect()}     # one row per class
    made = conditional.generate(spark, fitted, targets, ["confidence", "y_pred"])
    real = flows.groupBy(F.col("y_true").alias("c")).agg(F.avg("confidence").alias("m"), F.stddev_pop("confidence").alias("s"))
    drawn = made.groupBy("cls").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("confidence").alias("a"))
    near = F.abs(F.col("a") - F.col("m")) <= 6 * F.col("s") / F.sqrt("n_rows") + 1e-6      # six standard errors
    return drawn.join(F.broadcast(real), F.col("cls") == F.col("c")).select("cls", "n_rows", near.alias("means_match"))

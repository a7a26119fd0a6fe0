"""Training, scoring and model artifacts on MLlib pipelines."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.boosting import BoostedTreesClassifier
from netloom.operators.metrics import weighted_metrics, with_class_weight
from netloom.operators.network import NetworkClassifier
from netloom.operators.trees import TreeClassifier
from netloom.session import together
from netloom.taxonomy import macro_name

LABEL, WEIGHT = "y_macro_encoded", "weight"
PARALLEL_FITS = 8               # one-vs-rest fits one model per class, a grid one per algorithm and variant; so many at a time
# Defaults below are fixed values: the hyper-parameters of the original training tools.
DEEP_NETWORK = {"hidden": (256, 128, 64), "max_iter": 100}


def _pipeline(features, classifier) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, classifier])


def decision_tree(features, label=LABEL, weight=WEIGHT, max_depth=20, min_leaf=10, seed=42) -> Pipeline:
    """Leaves of at least 10 rows already imply splits of at least 20."""
    return _pipeline(features, TreeClassifier(labelCol=label, weightCol=weight or "", maxDepth=max_depth, minRows=min_leaf, seed=seed))


def random_forest(features, label=LABEL, weight=WEIGHT, n_estimators=100, max_depth=25, min_leaf=5, seed=42) -> Pipeline:
    return _pipeline(features, RandomForestClassifier(
        labelCol=label, weightCol=weight, numTrees=n_estimators, maxDepth=max_depth,
        minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", impurity="gini", seed=seed, maxMemoryInMB=1024))


def boosted_trees(features, label=LABEL, weight=None, n_classes=0, n_estimators=100, max_depth=6, learning_rate=0.1,
                  subsample=0.8, columns=0.8, gamma=0.1, l1=0.1, l2=1.0, max_delta=1.0, seed=42, min_gain=None) -> Pipeline:
    """One softmax over all classes, second-order splits on histograms. ``min_gain`` is another name for ``gamma``."""
    gamma = gamma if min_gain is None else min_gain
    return _pipeline(features, BoostedTreesClassifier(
        labelCol=label, weightCol=weight or "", nClasses=n_classes, rounds=n_estimators, depth=max_depth, rate=learning_rate,
        subsample=subsample, columns=columns, gamma=gamma, l1=l1, l2=l2, maxDelta=max_delta, seed=seed))


def neural_network(features, n_classes: int, label=LABEL, weight=None, hidden=(128, 64), max_iter=50,
                   batch=256, tol=1e-4, patience=5, held_out=0.1, learning_rate=1e-3, l2=1e-4, seed=42) -> Pipeline:
    """ReLU layers trained by Adam in mini-batches; stops when the loss of held-out rows has not fallen for ``patience`` epochs."""
    return _pipeline(features, NetworkClassifier(
        layers=[len(features), *hidden, n_classes], labelCol=label, weightCol=weight or "", maxIter=max_iter, batch=batch, rate=learning_rate,
        l2=l2, heldOut=held_out, patience=patience, tol=tol, seed=seed))


def linear_svm(features, label=LABEL, weight=None, max_iter=100, reg=0.01) -> Pipeline:
    return _pipeline(features, OneVsRest(classifier=LinearSVC(maxIter=max_iter, regParam=reg), labelCol=label,
                                         parallelism=PARALLEL_FITS))


BUILDERS: dict[str, Callable] = {
    "Decision Tree": decision_tree, "Random Forest": random_forest, "XGBoost": boosted_trees,
    "MLP": neural_network, "SVM": linear_svm}


def fit(pipeline: Pipeline, train: DataFrame, label: str = LABEL, balanced: bool = True) -> PipelineModel:
    rows = with_class_weight(train, label, WEIGHT) if balanced else train
    return pipeline.fit(rows.withColumn(label, F.col(label).cast("double")))


def score(model: PipelineModel, df: DataFrame, names: bool = True, probabilities: bool = False) -> DataFrame:
    """df plus prediction, predicted_class and confidence (the largest probability), and all probabilities if asked for.

    One-vs-rest models give margins only; a softmax turns them into probabilities.
    """
    out = model.transform(df)
    if "probability" in out.columns:
        probs = vector_to_array("probability")
    else:
        raw = vector_to_array("rawPrediction")
        weights = F.transform(raw, lambda x: F.exp(x - F.array_max(raw)))
        total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
        probs = F.transform(weights, lambda x: x / total)
    keep = df.columns + ["prediction", "confidence"] + ["probabilities"] * probabilities
    out = out.withColumn("probabilities", probs).withColumn("confidence", F.array_max("probabilities")).withColumn("prediction", F.col("prediction").cast("int"))
    out = out.select(*[f"`{c}`" for c in keep])
    return out.withColumn("predicted_class", macro_name(F.col("prediction"))) if names else out


def evaluate(model: PipelineModel, df: DataFrame, label: str = LABEL, by=()) -> DataFrame:
    return weighted_metrics(score(model, df, names=False), label, "prediction", by)


def tagged_predictions(models: dict[tuple[str, str], PipelineModel], test: DataFrame, label: str = LABEL) -> DataFrame:
    """algorithm, dataset, label and prediction of every model on the same rows."""
    tagged = None
    for (algorithm, dataset), model in models.items():
        part = score(model, test, names=False).select(
            F.lit(algorithm).alias("algorithm"), F.lit(dataset).alias("dataset"), F.col(label), "prediction")
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged


def evaluate_models(models: dict[tuple[str, str], PipelineModel], test: DataFrame, label: str = LABEL) -> DataFrame:
    """Every model on the same original test rows, one metrics job for all."""
    return weighted_metrics(tagged_predictions(models, test, label), label, "prediction", ["algorithm", "dataset"])


def train_grid(spark: SparkSession, variants: dict[str, DataFrame], pipelines: dict[str, Pipeline],
               label: str = LABEL) -> tuple[dict, DataFrame]:
    """Fit each algorithm on each variant, some fits side by side; a failed fit is recorded, the rest goes on."""
    def one(algorithm: str, dataset: str):
        start, model, error = time.time(), None, None
        try:
            model = fit(pipelines[algorithm], variants[dataset], label)
        except Exception as e:  # noqa: BLE001 - recorded in the result table
            error = str(e)[:500]
        return model, (algorithm, dataset, error is None, time.time() - start, error)

    keys = [(algorithm, dataset) for dataset in variants for algorithm in pipelines]
    done = together(spark, [partial(one, *key) for key in keys], PARALLEL_FITS)
    models = {key: model for key, (model, _) in zip(keys, done) if model is not None}
    log = [entry for _, entry in done]
    return models, spark.createDataFrame(log, "algorithm string, dataset string, success boolean, seconds double, error string")


def save_model(model: PipelineModel, root: str, algorithm: str, name: str) -> str:
    path = f"{root.rstrip('/')}/{algorithm}/{name}"
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _classifier(model: PipelineModel):
    return model.stages[-1]


def feature_importance(spark: SparkSession, model: PipelineModel, k: int = 20) -> DataFrame:
    """The k most important features by name; one-vs-rest models average their parts."""
    names = model.stages[0].getInputCols()
    last = _classifier(model)
    parts = last.models if isinstance(last, OneVsRestModel) else [last]
    values = [sum(float(p.featureImportances[i]) for p in parts) / len(parts) for i in range(len(names))]
    rows = spark.createDataFrame(list(zip(names, values)), "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature").limit(k)


def tree_shape(spark: SparkSession, model: PipelineModel) -> DataFrame:
    tree = _classifier(model)
    return spark.createDataFrame([(tree.depth, (tree.numNodes + 1) // 2, tree.numNodes)],
                                 "depth int, n_leaves int, n_nodes int")


def root_split(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """feature and threshold of a tree's first split; no row for a tree without one."""
    found = _classifier(model).root()
    rows = [(model.stages[0].getInputCols()[found[0]], found[1])] if found else []
    return spark.createDataFrame(rows, "feature string, threshold double")


def loss_curve(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """epoch, loss on training and on held-out rows, and whether the model's weights are those of this epoch. Epoch 0 is untrained."""
    net = _classifier(model)
    best = net.getOrDefault("bestEpoch")
    return spark.createDataFrame([(i, a, b, i == best) for i, a, b in net.history()],
                                 "epoch int, train_loss double, held_out_loss double, is_best boolean")


def network_summary(spark: SparkSession, model: PipelineModel) -> DataFrame:
    net = _classifier(model)
    layers, history = net.getOrDefault("layers"), net.history()
    return spark.createDataFrame(
        [(layers[0], ",".join(map(str, layers[1:-1])), layers[-1], weight_count(layers), len(history) - 1, net.getOrDefault("bestEpoch"),
          history[net.getOrDefault("bestEpoch")][2])],
        "n_inputs int, hidden string, n_outputs int, n_weights long, epochs int, best_epoch int, loss double")


def weight_count(layers) -> int:
    """Connection weights of a layer list, biases left out."""
    return sum(a * b for a, b in zip(layers, layers[1:]))

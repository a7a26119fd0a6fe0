"""Profiling: distributions, describe, quantiles, correlation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.columns import col, is_missing, percent
from netloom.operators.cells import cells, feature_name
from netloom.operators.encode import with_macro
from netloom.operators.small import small_side
from netloom.session import materialise


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def macro_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and percent of all rows per macro class; unknown labels only count in the total."""
    every = W.partitionBy(F.lit(0))                     # one row per label
    counts = label_counts(df, label).withColumn("total", F.sum("n").over(every))
    return (with_macro(counts, label).filter(F.col("macro").isNotNull())
            .groupBy("macro").agg(F.sum("n").alias("n"), F.max("total").alias("total"))
            .select("macro", "n", percent(F.col("n"), F.col("total")).alias("pct")))


def class_distribution(df: DataFrame, cls: str) -> DataFrame:
    """Count and percent per class plus a TOTAL row."""
    counts = df.groupBy(F.col(cls).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    rolled = counts.rollup("class").agg(F.sum("n").alias("n"), F.grouping("class").alias("_all"))
    total = F.max(F.when(F.col("_all") == 1, F.col("n"))).over(W.partitionBy(F.lit(0)))
    return (rolled.withColumn("total", total)
            .select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("class")).alias("class"),
                    "n", percent(F.col("n"), F.col("total")).alias("pct")))


def top_labels(df: DataFrame, k: int, label: str = "label") -> DataFrame:
    return label_counts(df, label).orderBy(F.desc("n"), label).limit(k)


def split_check(df: DataFrame, n_specific: int, n_macro: int = 8, split: str = "split") -> DataFrame:
    """Rows and out-of-range codes per split, over every row."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("y_specific").between(0, n_specific - 1)).alias("bad_specific"),
        F.count_if(~F.col("y_macro_encoded").between(0, n_macro - 1)).alias("bad_macro"))


def assert_valid(check: DataFrame) -> None:
    bad = check.filter((F.col("bad_specific") > 0) | (F.col("bad_macro") > 0)).take(1)
    if bad:
        raise ValueError(f"label codes out of range: {bad[0].asDict()}")


def missing_by_column(df: DataFrame, columns) -> DataFrame:
    """Columns that have missing cells, with the count."""
    kinds = dict(df.dtypes)
    aggs = [F.count_if(is_missing(col(c)) if kinds[c] in ("double", "float") else col(c).isNull())
            .alias(f"m{i}") for i, c in enumerate(columns)]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing"))
                     for i, c in enumerate(columns)])
    return df.agg(*aggs).select(F.inline(rows)).filter(F.col("n_missing") > 0)


def long_form(df: DataFrame, features, keep=()) -> DataFrame:
    """(keep..., feature, value): one row per cell."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), col(f).cast("double").alias("value"))
                      for f in features])
    return df.select(*[col(k) for k in keep], F.inline(cells))


RANKED_AT_ONCE, GRID = 2_000_000, 256


def _narrow(values: DataFrame, state: DataFrame, spot, prob):
    """Shrink brackets that still hold too many rows, about a hundredfold per round."""
    values = materialise(values, "quantile-bracket")
    grid = values.groupBy(*spot).agg(F.percentile_approx(
        "_v", F.array(*[F.lit(g / GRID) for g in range(GRID + 1)]), F.lit(40 * GRID)).alias("_grid"))
    pos = prob * (F.col("_n") - 1)
    share = lambda r: (r - F.col("_below")) * GRID / F.col("_m")
    low = F.greatest(F.floor(share(F.floor(pos))) - 1, F.lit(0)).cast("int")
    high = F.least(F.ceil(share(F.ceil(pos) + 1)) + 1, F.lit(GRID)).cast("int")
    edges = small_side(grid.join(state, spot).select(
        *spot, "_n", "_below", F.get("_grid", low).alias("_lo"), F.get("_grid", high).alias("_hi")))
    cut = values.join(edges, spot)
    state = small_side(cut.groupBy(*spot, "_n", "_below").agg(
        F.count_if(F.col("_v") < F.col("_lo")).alias("_less"),
        F.count_if(F.col("_v").between(F.col("_lo"), F.col("_hi"))).alias("_m"))
        .select(*spot, "_n", (F.col("_below") + F.col("_less")).alias("_below"), "_m"))
    return cut.filter(F.col("_v").between(F.col("_lo"), F.col("_hi"))).select(*spot, "_v"), state


def exact_quantiles(df: DataFrame, features, probs, by=(), accuracy: int = 10_000) -> DataFrame:
    """Exact interpolated quantiles: (by..., feature, prob, quantile).

    ``percentile`` keeps every distinct value of a group in one task. Instead a
    sketch brackets the order statistics around each quantile (its rank error is
    at most n / accuracy), a second scan counts the rows below each bracket, and
    only the distinct values inside it are ranked; a bracket that still holds
    millions of rows is narrowed first, as long as that makes it smaller. Should the
    counts show that a bracket misses its rank, all brackets are drawn wider.
    """
    for slack in (2.0 / accuracy, 50.0 / accuracy, 1.0):
        found = _bracketed_quantiles(df, features, probs, by, accuracy, slack)
        if found is not None:
            return found
    raise AssertionError("a bracket over all rows holds every rank")


def _bracketed_quantiles(df: DataFrame, features, probs, by, accuracy: int, slack: float) -> DataFrame | None:
    """exact_quantiles with brackets of a given slack; None if one of them misses its rank."""
    keys = list(by) or ["_g"]
    edges = F.array(*[F.lit(e) for p in probs for e in (max(p - slack, 0.0), min(p + slack, 1.0))])
    cell = lambda f: F.when(~F.isnan(col(f).cast("double")), col(f).cast("double"))
    base = df.withColumn("_g", F.lit(0)).select(*[col(k) for k in keys],
                                                *[cell(f).alias(f"v{i}") for i, f in enumerate(features)])
    stats = []
    for i in range(len(features)):
        v = F.col(f"v{i}")
        stats += [F.percentile_approx(v, edges, F.lit(accuracy)).alias(f"e{i}"), F.min(v).alias(f"a{i}"),
                  F.max(v).alias(f"z{i}"), F.count(v).alias(f"n{i}")]
    spots = [(i, j) for i in range(len(features)) for j in range(len(probs))]

    def bracket(i, j):
        few = F.col(f"n{i}") <= 4 * accuracy        # too few rows for a rank bracket: keep them all
        low = F.when(few | F.lit(probs[j] <= slack), F.col(f"a{i}")).otherwise(F.element_at(f"e{i}", 2 * j + 1))
        high = F.when(few | F.lit(probs[j] + slack >= 1), F.col(f"z{i}")).otherwise(F.element_at(f"e{i}", 2 * j + 2))
        return [low.alias(f"lo{i}_{j}"), high.alias(f"hi{i}_{j}")]

    brackets = small_side(base.groupBy(*keys).agg(*stats).select(
        *keys, *[F.col(f"n{i}") for i in range(len(features))], *[c for i, j in spots for c in bracket(i, j)]))
    bounded = base.join(brackets, keys)
    inside = lambda i, j: F.col(f"v{i}").between(F.col(f"lo{i}_{j}"), F.col(f"hi{i}_{j}"))
    tallies = bounded.groupBy(*keys).agg(
        *[F.first(f"n{i}").alias(f"n{i}") for i in range(len(features))],
        *[F.count_if(F.col(f"v{i}") < F.col(f"lo{i}_{j}")).alias(f"b{i}_{j}") for i, j in spots],
        *[F.count_if(inside(i, j)).alias(f"m{i}_{j}") for i, j in spots])
    spot = [*keys, "_i", "_j"]
    state = small_side(tallies.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j"), F.col(f"n{i}").alias("_n"),
                 F.col(f"b{i}_{j}").alias("_below"), F.col(f"m{i}_{j}").alias("_m")) for i, j in spots]))))
    kept = F.filter(F.array(*[
        F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j"), F.when(inside(i, j), F.col(f"v{i}")).alias("_v"))
        for i, j in spots]), lambda x: x["_v"].isNotNull())
    values = bounded.select(*keys, F.inline(kept))
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_j") + 1)
    spread = prob * (F.col("_n") - 1)
    holds = (F.col("_below") <= F.floor(spread)) & (F.ceil(spread) < F.col("_below") + F.col("_m"))
    if state.filter((F.col("_n") > 0) & ~holds).take(1):
        return None
    most, before = state.agg(F.max("_m")).first()[0] or 0, None
    while most > RANKED_AT_ONCE and (before is None or most < before):
        values, state = _narrow(values, state, spot, prob)
        most, before = state.agg(F.max("_m")).first()[0] or 0, most
    counts = values.groupBy(*spot, "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = W.partitionBy(*spot).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.join(state, spot).withColumn("_cum", F.col("_below") + F.sum("_c").over(upto))
    # 0-based position p * (n - 1); the value at rank r is the first with cum > r
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_i") + 1)
    pos = prob * (F.col("_n") - 1)
    at = lambda r: F.min(F.when(F.col("_cum") > r, F.col("_v")))
    return (ranked.groupBy(*spot, "_n").agg(at(F.floor(pos)).alias("_a"), at(F.ceil(pos)).alias("_b"))
            .select(*by, name.alias("feature"), prob.alias("prob"),
                    (F.col("_a") + (F.col("_b") - F.col("_a")) * (pos - F.floor(pos))).alias("quantile")))


def feature_stats(df: DataFrame, features) -> DataFrame:
    """feature, n, mean, sample std, population variance, min, max of the present cells."""
    stats = cells(df, features).groupBy("i").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.var_pop("value").alias("variance"), F.min("value").alias("min"), F.max("value").alias("max"))
    return stats.select(feature_name(features).alias("feature"), "n", "mean", "std", "variance", "min", "max")


def describe(df: DataFrame, features) -> DataFrame:
    """feature, n, mean, sample std, min, quartiles, max (missing cells left out)."""
    base = feature_stats(df, features).drop("variance")
    quart = (exact_quantiles(df, features, (0.25, 0.5, 0.75))
             .groupBy("feature").pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("quantile"))
             .toDF("feature", "q25", "q50", "q75"))
    return base.join(quart, "feature")


def balance(df: DataFrame, label: str = "label", benign: str = "BenignTraffic") -> DataFrame:
    n, total = F.count_if(F.col(label) == benign), F.count(F.lit(1))
    return (df.agg(n.alias("benign"), total.alias("total"))
              .select("benign", (F.col("total") - F.col("benign")).alias("attack"),
                      percent(F.col("benign"), F.col("total")).alias("benign_pct"),
                      percent(F.col("total") - F.col("benign"), F.col("total")).alias("attack_pct")))


def binary_distribution(df: DataFrame, binary: str = "binary_label") -> DataFrame:
    every = W.partitionBy(F.lit(0))                     # two rows
    counts = df.groupBy(binary).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(binary, "n", (F.sum(F.col(binary) * F.col("n")).over(every)
                                       / F.sum("n").over(every)).alias("anomaly_rate"))


def class_means(df: DataFrame, features, cls: str) -> DataFrame:
    return df.groupBy(cls).agg(*[F.avg(col(f)).alias(f"avg_{f}") for f in features])


def box_stats(df: DataFrame, features, cls: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends inside 1.5 IQR and the outlier count, per class."""
    quart = (exact_quantiles(df, features, (0.25, 0.5, 0.75), [cls])
             .groupBy(cls, "feature").pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("quantile"))
             .toDF(cls, "feature", "q25", "q50", "q75"))
    reach = (F.col("q75") - F.col("q25")) * whisker
    cells = long_form(df, features, [cls]).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    inside = (F.col("value") >= F.col("q25") - reach) & (F.col("value") <= F.col("q75") + reach)
    return (cells.join(small_side(quart), [cls, "feature"])
            .groupBy(cls, "feature", "q25", "q50", "q75")
            .agg(F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
                 F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
                 F.count_if(~inside).alias("n_outliers")))


def pair_moments(df: DataFrame, features, centre) -> DataFrame:
    """(i, j, n, sx, sy, qx, qy, p) per column pair: counts and sums over rows where both are present.

    Every task multiplies its blocks as matrices and emits one row per pair, so
    a wide table costs one scan and a shuffle of features^2 numbers per task.
    """
    d = len(features)
    left, right = np.triu_indices(d, 1)
    means = np.array(centre, dtype="float64")

    def run(batches):
        n, s, q, p = (np.zeros((d, d)) for _ in range(4))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - means
            here = ~np.isnan(x)
            x[~here] = 0.0
            m = here.astype("float64")
            n += m.T @ m
            s += x.T @ m                                  # s[i, j]: sum of x_i where j is present
            q += (x * x).T @ m
            p += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(left, pa.int32()), pa.array(right, pa.int32()),
             *[pa.array(v) for v in (n[left, right], s[left, right], s[right, left],
                                     q[left, right], q[right, left], p[left, right])]],
            names=["i", "j", "n", "sx", "sy", "qx", "qy", "p"])

    sums = ["n", "sx", "sy", "qx", "qy", "p"]
    schema = "i int, j int, " + ", ".join(f"{c} double" for c in sums)
    return (df.select(*[col(f).cast("double") for f in features]).mapInArrow(run, schema)
              .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in sums]))


def correlation(df: DataFrame, features) -> DataFrame:
    """Upper triangle of the Pearson matrix over pairwise present rows; constant columns drop out.

    (pos_a, pos_b) keep the column order of the input. A first scan finds the
    means, because centred sums do not cancel.
    """
    first = {r["feature"]: r for r in feature_stats(df, features).collect()}      # one row per feature
    live = [i for i, f in enumerate(features) if f in first and first[f]["n"] and first[f]["min"] < first[f]["max"]]
    if len(live) < 2:
        return df.sparkSession.createDataFrame([], "pos_a int, pos_b int, feature_a string, feature_b string, r double")
    names = F.array(*[F.lit(f) for f in features])
    places = F.array(*[F.lit(i) for i in live])
    sums = pair_moments(df, [features[i] for i in live], [first[features[i]]["mean"] for i in live])
    cov = F.col("n") * F.col("p") - F.col("sx") * F.col("sy")
    spread = (F.col("n") * F.col("qx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("qy") - F.col("sy") * F.col("sy"))
    return (sums.select(F.get(places, F.col("i")).alias("pos_a"), F.get(places, F.col("j")).alias("pos_b"),
                        F.when(spread > 0, F.try_divide(cov, F.sqrt(F.greatest(spread, F.lit(0.0))))).alias("r"))
            .select("pos_a", "pos_b", F.get(names, F.col("pos_a")).alias("feature_a"),
                    F.get(names, F.col("pos_b")).alias("feature_b"), "r")
            .filter(F.col("r").isNotNull() & ~F.isnan("r")))


def label_correlation(df: DataFrame, features, target: str, k: int = 15) -> DataFrame:
    """The k features most correlated with the target by absolute value."""
    pairs = correlation(df, [*features, target]).filter(F.col("feature_b") == target)
    return (pairs.select(F.col("feature_a").alias("feature"), F.abs("r").alias("abs_r"))
            .orderBy(F.desc("abs_r"), "feature").limit(k))


def high_pairs(df: DataFrame, features, threshold: float = 0.9, k: int = 10) -> DataFrame:
    """The first k pairs, in column order, with abs(r) above the threshold."""
    return (correlation(df, features).filter(F.abs("r") > threshold)
            .orderBy("pos_a", "pos_b").limit(k).select("feature_a", "feature_b", "r"))


def summary(df: DataFrame, n_features: int, label: str = "label") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(n_features).alias("n_features"),
                  F.count_distinct(label).alias("n_labels"),
                  F.avg(F.when(F.col(label) == "BenignTraffic", 0.0).otherwise(1.0)).alias("anomaly_rate"))


def scale_check(df: DataFrame, features) -> DataFrame:
    """Global min, max, mean and deviation of a feature matrix, with a warning flag.

    Put together from the per-feature statistics: the variance of the whole is the
    mean of the variances plus the variance of the means.
    """
    stats = feature_stats(df, features)
    total = F.sum("n").over(W.partitionBy(F.lit(0)))            # one row per feature
    centre = F.sum(F.col("n") * F.col("mean")).over(W.partitionBy(F.lit(0))) / total
    off = (F.col("mean") - F.col("_centre")) * (F.col("mean") - F.col("_centre"))
    return (stats.withColumn("_centre", centre)
            .agg(F.min("min").alias("min"), F.max("max").alias("max"), F.first("_centre").alias("mean"),
                 F.sqrt(F.sum(F.col("n") * (F.col("variance") + off)) / F.sum("n")).alias("std"))
            .withColumn("needs_scaling", (F.abs("mean") > 1) | (F.col("std") > 10)))


def preview(df: DataFrame, order, k: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(k)


def column_types(df: DataFrame) -> DataFrame:
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def mean_drift(base: DataFrame, other: DataFrame, features) -> DataFrame:
    """feature, base mean, other mean, absolute difference."""
    means = lambda df, name: feature_stats(df, features).select("feature", F.col("mean").alias(name))
    return (means(base, "base_mean").join(means(other, "other_mean"), "feature")
            .withColumn("abs_diff", F.abs(F.col("base_mean") - F.col("other_mean"))))


def drift_score(base: DataFrame, other: DataFrame, features, threshold: float) -> DataFrame:
    return (mean_drift(base, other, features).agg(F.avg("abs_diff").alias("drift_score"))
            .withColumn("drifted", F.col("drift_score") > threshold))

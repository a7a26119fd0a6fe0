"""Quality scores from a sparse rule ensemble.

Texts are described by statistics, all built-in expressions. A random forest of shallow trees is fitted on labelled rows; every
path from a root becomes a conjunctive rule over the statistics; a logistic regression with an L1 penalty weighs
the rules and leaves most at zero; the rest is compiled into one Spark column, so scoring runs inside the scan.

Training uses at most ``MAX_LABELLED`` labelled rows, those with the smallest hashes of their ids, among rows that are not
held out. Ids, sources, languages and labels only choose and mark rows; they are never inputs of a score.

Defined results: a null text is empty and gets a score; without labels of both kinds the score is the share of good labels (one
half without any); rows without a label quality are not learned from; conflicting labels of an id are all learned from; a null id is not held out; repeated rows score
alike; an empty table gives an empty result; documents' other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import SPACE_CHARS, let, split_words
from netloom.session import materialise

MAX_LABELLED = 10_000
TREES, DEPTH, PENALTY, SEED = 20, 3, 0.003, 7
ACCEPT = 0.7
STATISTICS = ("words", "chars", "word_length", "symbols", "symbol_rate", "pipes", "pipe_rate", "bang_rate", "upper_rate", "digit_rate",
              "mark_rate", "same_next_rate", "distinct_power", "repeat_lines_rate")

Rule = tuple[tuple[int, bool, float], ...]      # conjunction of (statistic, is it above?, threshold), sorted


def statistics(text: Column) -> Column:
    """A struct of doubles named as in STATISTICS."""
    text = F.coalesce(text, F.lit(""))
    per_words = let(split_words(text), lambda w: F.struct(
        F.size(w).alias("n"), F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).alias("same"), F.size(F.array_distinct(w)).alias("kinds")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    per_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    raw = F.struct(per_words.alias("w"), per_lines.alias("l"), F.length(text).alias("chars"), count(r"[#*$%&<>]").alias("symbols"),
                   count(r"\|").alias("pipes"), count("!").alias("bangs"), count(r"\p{Lu}").alias("upper"),
                   count("[0-9]").alias("digits"), count("[.,;:?]").alias("marks"))

    def named(r: Column) -> Column:
        n, c = F.greatest(r["w"]["n"], F.lit(1)), F.greatest(r["chars"], F.lit(1))
        values = {
            "words": r["w"]["n"], "chars": r["chars"], "word_length": r["chars"] / n, "symbols": r["symbols"], "symbol_rate": r["symbols"] / n,
            "pipes": r["pipes"], "pipe_rate": r["pipes"] / n, "bang_rate": r["bangs"] / n, "upper_rate": r["upper"] / c,
            "digit_rate": r["digits"] / c, "mark_rate": r["marks"] / n, "same_next_rate": r["w"]["same"] / n,
            # ln(kinds) / ln(words) hardly falls with the length of ordinary text, unlike their quotient
            "distinct_power": F.log(F.greatest(r["w"]["kinds"], F.lit(1)) + 1) / F.log(n + 1), "repeat_lines_rate": r["l"]["dup"] / F.greatest(r["l"]["n"], F.lit(1))}
        return F.struct(*(values[s].cast("double").alias(s) for s in STATISTICS))
    return let(raw, named)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def tree_rules(description: str) -> list[Rule]:
    """The conjunctions of a printed tree: one for every branch on every path."""
    rules, path = [], []
    for line in description.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        path = [p for p in path if p[0] < len(m[1])] + [(len(m[1]), (int(m[2]), m[3] == ">", float(m[4])))]
        rules.append(simplified([c for _, c in path]))
    return rules


def simplified(conditions: list[tuple[int, bool, float]]) -> Rule:
    """The tightest condition per statistic and direction."""
    best: dict[tuple[int, bool], float] = {}
    for feature, above, threshold in conditions:
        key = (feature, above)
        best[key] = threshold if key not in best else max(best[key], threshold) if above else min(best[key], threshold)
    return tuple(sorted((f, above, t) for (f, above), t in best.items()))


def holds(rule: Rule, stats: Column) -> Column:
    """The rule as a column over a struct of statistics."""
    out = F.lit(True)
    for feature, above, threshold in rule:
        value = stats[STATISTICS[feature]]
        out = out & ((value > threshold) if above else (value <= threshold))
    return out


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self, stats: Column) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(holds(rule, stats), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """stats and label of a bounded sample of labelled, not held out rows."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id")
    return texts.select(statistics(F.col("text")).alias("s"), "label")


def fit(sample: DataFrame) -> Ensemble:
    """Rules from a forest's paths, weighed by a lasso logistic regression."""
    rows = sample.select(*(F.col(f"s.{s}").alias(s) for s in STATISTICS), F.col("label"))
    shares = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).first()
    n, good = shares["n"], shares["good"] or 0.0
    if not n or good in (0.0, float(n)):
        share = min(max(good / n if n else 0.5, 1e-6), 1 - 1e-6)
        import math
        return Ensemble(math.log(share / (1 - share)), ())
    assembled = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows).select("features", "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=SEED).fit(assembled)
    rules = sorted({r for tree in forest.trees for r in tree_rules(tree.toDebugString)})
    if not rules:
        return Ensemble(0.0, ())
    stats = F.struct(*STATISTICS)
    fired = rows.select(F.transform(F.array(stats), lambda s: F.array(*(holds(r, s).cast("double") for r in rules)))[0].alias("fired"), "label")
    from pyspark.ml.functions import array_to_vector
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=200).fit(
        fired.select(array_to_vector("fired").alias("features"), "label"))
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if abs(w) > 1e-9]
    return Ensemble(float(lasso.intercept), tuple(weights))


def learn(docs: DataFrame, labels: DataFrame) -> Ensemble:
    return fit(materialise(labelled_sample(docs, labels), "rule-ensemble"))


def report(docs: DataFrame, labels: DataFrame, model: Ensemble | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = model or learn(docs, labels)
    scored = docs.select("doc_id", let(statistics(F.col("text")), model.score).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= ACCEPT, 1).otherwise(0).cast("int").alias("predicted"))

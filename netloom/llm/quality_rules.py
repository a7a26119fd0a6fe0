"""Quality rules judged per document and per host.

Every document is measured by built-in expressions inside its own row, whatever its length: no word is shuffled.
Rule failures are then summed per host, a host's failure rate is shrunk towards an empirical beta prior fitted
over all hosts, and the host's verdict decides how strictly its documents are held to the softer rules.

Defined results: a null text has no words and fails; a null host is a host of its own; ties cannot occur;
repeated rows are judged alike and each counts; an empty table gives an empty result; other columns of the
input are never read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import SPACE_CHARS, SPACE_CLASS, fresh, let, split_words
from netloom.operators.small import small_side
from netloom.session import materialise

SYMBOLS = "#*$%&|<>"
# A sorted key holds a window's hash in its upper 33 bits and its place in the lower 31, so texts may be as
# long as an array can be. Equal hashes only make candidates: the words themselves decide.
PLACE = (1 << 31) - 1


@dataclass(frozen=True)
class Limits:
    """Hard limits fail a document anywhere; soft ones count against its host and bind where the host is no model."""
    min_words: int = 50
    max_repeat_pct: int = 50
    max_symbol_pct: int = 5           # symbols per 100 characters of words
    max_dup_line_pct: int = 50        # repeated lines per 100 lines with a word
    trusted_below: float = 0.02       # shrunk failure rate of a host that only the hard limits bind
    bad_above: float = 0.5            # shrunk failure rate of a host whose soft limits are halved


def _near_equal(values: Column, x: Column, i: Column, key) -> Column:
    """Does x share its key with a neighbour in the sorted array?"""
    return (key(x) == key(F.get(values, i - 1))) | (key(x) == key(F.get(values, i + 1)))


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window occurring at least twice, counted once each."""
    def window(w: Column, i: Column) -> list[Column]:
        return [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]

    def packed(w: Column) -> Column:
        heads = F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
        return F.sort_array(F.transform(heads, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
                                        .bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long"))))

    def exact(w: Column, keys: Column) -> Column:
        """Candidate windows spelled out before their ten-digit place: copies become neighbours when sorted."""
        hits = F.filter(keys, lambda x, j: _near_equal(keys, x, j, lambda k: F.shiftright(k, 31)))
        return F.sort_array(F.transform(hits, lambda k: let(k.bitwiseAND(F.lit(PLACE)).cast("int"), lambda i: F.concat_ws(
            " ", *window(w, i), F.lpad(i.cast("string"), 10, "0")))))

    def places(spelled: Column) -> Column:
        wording = lambda s: F.substring(s, F.lit(1), F.length(s) - 10)
        twice = F.filter(spelled, lambda x, j: _near_equal(spelled, x, j, wording))
        return F.sort_array(F.transform(twice, lambda s: F.right(s, F.lit(10)).cast("int")))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.coalesce(F.least(F.get(at, j + 1) - p, F.lit(3)), F.lit(3)).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    return let(words, lambda w: let(packed(w), lambda keys: let(exact(w, keys), lambda s: let(places(s), covered))))


def measures(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")
    words = let(split_words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeat")))
    repeat = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return {
        "words": words, "lines": repeat,
        "word_chars": F.length(F.regexp_replace(text, SPACE_CLASS + "+", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
    }


def measured(text: Column, limits: Limits = Limits()) -> Column:
    """One struct per document with its measures and rule results."""
    m = measures(text)

    def judged(x: Column) -> Column:
        words, repeat, chars, symbols = x["words"]["n"], x["words"]["repeat"], x["word_chars"], x["n_symbols"]
        lines, dup = x["lines"]["n"], x["lines"]["dup"]
        soft = lambda k: (100 * k * symbols > limits.max_symbol_pct * chars) | (
            100 * k * dup > limits.max_dup_line_pct * lines)
        base = (words < limits.min_words) | (100 * repeat > limits.max_repeat_pct * words)
        return F.struct(
            words.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), dup.alias("n_dup_lines"),
            repeat.alias("n_repeat_words"), base.alias("base_failed"), soft(1).alias("soft_failed"), soft(2).alias("strict_failed"))

    return let(F.struct(*(v.alias(k) for k, v in m.items())), judged)


def host_verdicts(judged: DataFrame, host: str, result: str, limits: Limits = Limits()) -> DataFrame:
    """One row per host: documents, failures, and the verdict on its shrunk failure rate.

    The prior's mean and variance are moments of the hosts' rates in whole millionths, so sums do not depend on
    the order of addition; alpha and beta follow by the method of moments.
    """
    failed = F.col(f"{result}.base_failed") | F.col(f"{result}.soft_failed")
    hosts = judged.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(failed.cast("long")).alias("failures"))
    rate = F.expr("failures * 1000000L div docs")
    moments = hosts.agg(F.count(F.lit(1)).alias("n"), F.sum(rate).alias("s"), F.sum(rate * rate).alias("ss")).first()
    alpha, beta = beta_prior(moments["n"], moments["s"] or 0, moments["ss"] or 0)
    shrunk = (F.col("failures") + F.lit(alpha)) / (F.col("docs") + F.lit(alpha + beta))
    verdict = F.when(shrunk > limits.bad_above, "bad").when(shrunk < limits.trusted_below, "trusted").otherwise("mixed")
    return hosts.select("host", "docs", "failures", verdict.alias("host_verdict"))


def beta_prior(n: int, total: int, squares: int) -> tuple[float, float]:
    """Alpha and beta from the sum and the sum of squares of rates in millionths; weight between 1 and 10 000 documents."""
    if not n:
        return 1.0, 1.0
    mean = total / n / 1e6
    var = squares / n / 1e12 - mean * mean
    weight = 1e4 if var <= 1e-9 else min(1e4, max(1.0, mean * (1 - mean) / var - 1))
    return mean * weight, (1 - mean) * weight


def with_verdicts(judged: DataFrame, host: str, result: str, kept: str, verdict: str, limits: Limits = Limits()) -> DataFrame:
    """Join host verdicts back. The host table is broadcast once it has proved small, else the join is shuffled and
    adaptive execution splits the hot hosts."""
    h, v = fresh(judged, "_host"), verdict
    hosts = small_side(host_verdicts(judged, host, result, limits).select(
        F.col("host").alias(h), F.col("host_verdict").alias(v)))
    joined = judged.join(hosts, F.col(host).eqNullSafe(F.col(h)), "left").drop(h)
    r = F.col(result)
    passes = F.when(F.col(v) == "trusted", F.lit(True)).when(F.col(v) == "bad", ~r["strict_failed"]).otherwise(~r["soft_failed"])
    return joined.withColumn(kept, ~r["base_failed"] & passes)


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, the measures, base_failed, kept and host_verdict of every document."""
    judged = materialise(docs.select("doc_id", "source", measured(F.col("text"), limits).alias("r")), "quality-rules")
    out = with_verdicts(judged, "source", "r", "kept", "host_verdict", limits)
    return out.select("doc_id", "r.n_words", "r.word_chars", "r.n_symbols", "r.n_dup_lines", "r.n_repeat_words",
                      "r.base_failed", "kept", "host_verdict")


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents the rules keep, with the columns they came with. Measures are written once next to the rows."""
    r, k = fresh(docs, "_rules"), fresh(docs, "_kept")
    judged = materialise(docs.withColumn(r, measured(F.col("text"), limits)), "quality-rules")
    out = with_verdicts(judged, "source", r, k, fresh(docs, "_verdict"), limits)
    return out.where(F.col(k)).select(*docs.columns)

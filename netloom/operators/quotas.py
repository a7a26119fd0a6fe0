"""Class quotas, budget-aware sampling and augmentation accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.columns import percent
from netloom.operators.ranking import take_per_class
from netloom.operators.small import small_side

# The defaults of the original command-line tools.
TARGET_SAMPLE, MIN_MINORITY = 800_000, 50_000
MINORITY_PCT, MINORITY_ABS = 1.0, 10_000
GENERATION_SHARE = 0.8
QUALITY_BANDS = ((3, "Excellent"), (10, "Good"), (20, "Risky"))


def all_classes():
    """Quota tables have one row per class; a global window over them is one small task."""
    return W.partitionBy(F.lit(0))


def class_counts(df: DataFrame, cls: str) -> DataFrame:
    return df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))


def _total_of(condition):
    return F.coalesce(F.sum(F.when(condition, F.col("n"))).over(all_classes()), F.lit(0))


def stratified_quotas(counts: DataFrame, target: int = TARGET_SAMPLE,
                      min_minority: int = MIN_MINORITY) -> DataFrame:
    """Small classes keep up to ``min_minority``; the rest share what is left of the target."""
    minor = F.col("n") <= 2 * min_minority
    kept = F.least(F.col("n"), F.lit(min_minority))
    spent = F.coalesce(F.sum(F.when(minor, kept)).over(all_classes()), F.lit(0))
    budget = F.greatest(F.lit(target) - spent, F.lit(0))
    share = F.least(F.floor(budget * (F.col("n") / _total_of(~minor))), F.col("n"))
    return counts.select("*", minor.alias("is_minority"),
                         F.when(minor, kept).otherwise(share).cast("long").alias("quota"))


def minority_flags(counts: DataFrame, pct: float = MINORITY_PCT, absolute: int = MINORITY_ABS) -> DataFrame:
    """A class is small below either threshold."""
    share = percent(F.col("n"), F.sum("n").over(all_classes()))
    return (counts.withColumn("pct", share)
                  .withColumn("is_minority", (F.col("pct") < pct) | (F.col("n") < absolute)))


def minority_first_quotas(counts: DataFrame, subset: int, pct: float = MINORITY_PCT,
                          absolute: int = MINORITY_ABS) -> DataFrame:
    """All of every small class, the rest of the subset shared by the large ones."""
    flagged = minority_flags(counts, pct, absolute)
    budget = F.greatest(F.lit(subset) - _total_of(F.col("is_minority")), F.lit(0))
    share = F.least(F.floor(budget * (F.col("n") / _total_of(~F.col("is_minority")))), F.col("n"))
    return flagged.withColumn("quota", F.when(F.col("is_minority"), F.col("n")).otherwise(share).cast("long"))


def draw(df: DataFrame, quotas: DataFrame, cls: str, ids, seed: int = 42) -> DataFrame:
    """Exactly the quota of each class. The quota table also tells how many rows there are."""
    fitted = small_side(quotas.select(cls, "n", "quota"))
    n_rows = fitted.agg(F.sum("n")).first()[0] or 0
    return take_per_class(df, fitted.filter("quota > 0"), cls, ids, n_rows, seed)


def stratified_sample(df: DataFrame, cls: str, ids, target: int | None = TARGET_SAMPLE,
                      min_minority: int = MIN_MINORITY, seed: int = 42) -> DataFrame:
    """A quota sample of about ``target`` rows; all rows if there is no target."""
    if target is None:
        return df
    return draw(df, stratified_quotas(class_counts(df, cls), target, min_minority), cls, ids, seed)


def minority_first_subset(df: DataFrame, cls: str, ids, subset: int, pct: float = MINORITY_PCT,
                          absolute: int = MINORITY_ABS, seed: int = 42) -> DataFrame:
    return draw(df, minority_first_quotas(class_counts(df, cls), subset, pct, absolute), cls, ids, seed)


def generation_targets(counts: DataFrame, share: float = GENERATION_SHARE, cap: int | None = None) -> DataFrame:
    """Rows to generate: up to ``share`` of the largest class, at most ``cap`` if one is given, never negative."""
    top = F.floor(F.max("n").over(all_classes()) * F.lit(share))
    wanted = top - F.col("n") if cap is None else F.least(top - F.col("n"), F.lit(cap))
    return counts.withColumn("to_generate", F.greatest(wanted, F.lit(0)).cast("long"))


def estimated_output(counts: DataFrame) -> DataFrame:
    return counts.agg((F.max("n") * F.count(F.lit(1))).alias("estimated_rows"))


def synthetic_quality(counts: DataFrame) -> DataFrame:
    """Synthetic/real ratio per class when all are raised to the largest, with a band."""
    top = F.max("n").over(all_classes())
    out = (counts.withColumn("target", top).withColumn("synthetic", F.col("target") - F.col("n"))
                 .withColumn("ratio", F.col("synthetic") / F.col("n")))
    band = F.lit("Poor")
    for limit, name in reversed(QUALITY_BANDS):
        band = F.when(F.col("ratio") <= limit, name).otherwise(band)
    return out.withColumn("quality", band)


class PoorRatio(ValueError):
    """Raised when a class would be mostly synthetic."""


def quality_gate(counts: DataFrame, allow_poor: bool = False) -> DataFrame:
    checked = synthetic_quality(counts)
    if not allow_poor and checked.filter(F.col("quality") == "Poor").take(1):
        raise PoorRatio("a class needs more than 20 synthetic rows per real row")
    return checked


def accounting(cls: str, original: DataFrame, sample: DataFrame, augmented: DataFrame,
               final: DataFrame) -> DataFrame:
    """Rows per class in each phase, the rows generated and their ratio to the original."""
    phases = {"original": original, "sample": sample, "augmented": augmented, "final": final}
    tagged = None
    for name, df in phases.items():
        part = class_counts(df, cls).withColumn("phase", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    wide = (tagged.groupBy(cls).pivot("phase", list(phases)).agg(F.sum("n")).na.fill(0, list(phases)))
    return (wide.withColumn("generated", F.col("final") - F.col("original"))
                .withColumn("generated_ratio", F.when(F.col("original") > 0,
                                                      F.col("generated") / F.col("original"))))


def phase_table(cls: str, phases: dict[str, DataFrame]) -> DataFrame:
    """Long form (phase, class, n), the record written beside an augmented table."""
    out = None
    for name, df in phases.items():
        part = class_counts(df, cls).select(F.lit(name).alias("phase"),
                                            F.col(cls).cast("string").alias("class"), "n")
        out = part if out is None else out.unionByName(part)
    return out

"""A corpus from documents: quality rules, one of each group of near duplicates, secrets redacted, sources mixed, sequences packed.

Defined results: a null or empty text fails the quality rules, so it leaves at the first stage, as a text of fewer than 50 words does; a null source is a
source of its own; a row without an id is judged and packed like any other but has no near duplicates; of exact repeats one stays, and other
rows that share an id stay or go together; ties go to the smaller id; texts are read whole whatever their length; extra columns, also
ones named like a stage's own, come through all stages but the last, which returns pieces of sequences; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import mixing, ngram_join, packing, quality_rules, secrets
from netloom.llm.entry import tokenizer_path
from netloom.session import adopt, materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    adopt(spark)
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    adopt(spark)
    return ngram_join.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    adopt(spark)
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    adopt(spark)
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    adopt(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_scan),
          ("mixing sources", mixture), ("packing", pack)]
# Draws of the mix and the tokenizer have no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each one's result is written and read again before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, str(sf_dir))
        if i + 1 < len(STAGES):
            docs = materialise(docs, "pipeline")
    return docs

"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import (
    collocations,
    html_text,
    licenses,
    merkle,
    mixing,
    ngram_join,
    oracles,
    packing,
    quality_rules,
    rule_ensemble,
    secrets,
    sharding,
    topk,
    url_rules,
)
from netloom.llm.common import table
from netloom.session import adopt

TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path() -> str:
    """Where the public tokenizer file lies; it is installed alike on the driver and the executors."""
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(adopt(spark), str(sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


@query("op1_top_k_search", oracles.TOP_K)
def op1_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0)


@query("op2_quality_rules", oracles.QUALITY_RULES)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.report(table(spark, sf_dir, "pages"))


@query("op4_secret_scans")
def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


@query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_source_mixing")
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


@query("op7_license_scans")
def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op9_ngram_jaccard_join", oracles.NGRAM_JOIN)
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.links(table(spark, sf_dir, "documents"))


@query("op10_url_filters", oracles.URL_RULES)
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


@query("op11_sharding")
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"))


@query("op12_collocation_mining", oracles.COLLOCATIONS)
def op12_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


@query("op13_merkle_manifest", oracles.MERKLE)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))

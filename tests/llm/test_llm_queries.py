"""Registered queries against their SQL twins, and the pipeline stage by stage."""

import pytest

from netloom.llm.entry import ORACLES, QUERIES
from tests.conftest import SF
from tools.check_queries import normal


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    assert normal(df.columns, rows) == normal([c[0] for c in cur.description], cur.fetchall())


def test_every_number_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] > 0
    packed = corpus_pipeline.run(spark, SF).collect()
    tokens = sum(r["length"] for r in packed)
    assert tokens and len({r["sequence_id"] for r in packed}) * 4096 < 1.3 * tokens + 13 * 4096


def test_pipeline_of_odd_rows(spark):
    """Nulls in any column, empty, short and very long texts, repeated rows, a null id and extra columns go through every stage."""
    import corpus_pipeline
    from pyspark.sql import functions as F
    prose = [" ".join(f"{a}{b}" for a in "abcdefgh" for b in range(k, k + 9)) for k in (1, 200, 400)]
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, prose[0], "en", "a", 5), (1, prose[0], "en", "a", 5), (2, prose[0], None, None, None), (3, None, "en", "a", None), (4, "", None, "b", 0),
            (5, "too short", "en", "b", 9), (6, long, "en", None, None), (None, prose[1], "en", "a", 1), (7, prose[2], None, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("x") for c in ("size", "kept", "group_id", "spans", "at")})
    for table, want in ((docs, {1, 6, 7, None}), (docs.limit(0), set())):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, SF).persist()
            assert table.columns == docs.columns
        assert {r["doc_id"] for r in table.select("doc_id").collect()} == want
        pieces = corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()
        assert {r["doc_id"] for r in pieces} == want

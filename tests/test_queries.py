"""Every registered query runs; those with an SQL twin match it value by value."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tools.check_queries import normal

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_contract():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 120


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    want = normal([c[0] for c in cur.description], cur.fetchall())
    assert normal(df.columns, rows) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0

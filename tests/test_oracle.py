"""Every registered query against its SQL twin on the smallest tables, values and column types."""

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry
from auditloom.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE  # those of the dealt operators have tests of their own


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    n, ok, note = compare(spark, con, SF, name, QUERIES[name], ORACLE.get(name))
    assert ok is not False, note
    assert n >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "path", "risk_score"]
    scores = [r.risk_score for r in df.collect()]
    assert scores and scores == sorted(scores, reverse=True)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())

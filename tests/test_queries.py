import pytest

import __spark_entry__ as entry
from suite import oracles, queries
from tests import compare

SF = "/root/testdata/sf0.001"
QUERIES = queries.QUERIES
SQL = oracles.ORACLES


@pytest.fixture(scope="module")
def db():
    return compare.connect(SF)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()
    assert QUERIES.items() <= entry.queries().items()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_sql(spark, db, name):
    ours = compare.spark_rows(QUERIES[name](spark, SF))
    assert compare.differences(ours, compare.duck_rows(db, SQL[name])) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0

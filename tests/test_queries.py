"""Every registered query beside its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="generated tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    diff, _ = compare(spark, con, QUERIES[name], SQL.get(name), SF)
    assert diff is None, diff


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["entity", "period", "n", "value", "coverage", "prior", "delta", "band"] and df.count() > 0

"""Every registered query against its SQL twin on the smallest data."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name not in SQL:
        assert QUERIES[name](spark, SF).count() > 0
        return
    verdict, _ = compare(QUERIES[name](spark, SF), con, SQL[name])
    assert verdict == "ok"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "best_value" in df.columns


def test_names_match():
    assert set(SQL) <= set(QUERIES)

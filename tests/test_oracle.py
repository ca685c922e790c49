"""Every query with an SQL equivalent gives the same rows; every other one gives some."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, small, name):
    problems, _ = differences(QUERIES[name](spark, small), con, ORACLES[name])
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["country_code", "side", "n_groups"]

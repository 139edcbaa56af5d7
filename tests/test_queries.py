"""Every driver query against DuckDB on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as driver
from labtables.plans.bindings import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= driver.queries().items()
    assert ORACLES.items() <= driver.oracle_sql().items()


def test_entry_has_rows_and_a_stable_schema(spark):
    first, second = driver.entry(spark), driver.entry(spark)
    assert first.schema == second.schema
    assert first.count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert oracle.compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []

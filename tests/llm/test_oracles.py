"""Operators whose whole result can be said in SQL, against DuckDB."""

import oracle
import pytest

from labtables.llm import queries as llm_queries


@pytest.mark.parametrize("name", list(llm_queries.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    con = oracle.connect(sf_dir)
    assert oracle.compare(llm_queries.QUERIES[name](spark, sf_dir), con, llm_queries.ORACLES[name]) == []

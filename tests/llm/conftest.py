import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import llm_cases  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return llm_cases.odd(spark)


@pytest.fixture(scope="session")
def empty(spark):
    return llm_cases.empty(spark)


@pytest.fixture(scope="session")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def both(odd, real):
    """The odd rows and the smallest table together, doc_ids apart."""
    moved = real.selectExpr("doc_id + 100 as doc_id", "text", "lang", "source", "n_chars")
    return odd.select("doc_id", "text", "lang", "source", "n_chars").union(moved)

"""Compare a Spark result with DuckDB's answer to the oracle SQL."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value: object) -> object:
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, Decimal)):
        return round(float(value), 6)
    return str(value)


def as_counter(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences between the two results; empty when they agree."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = as_counter(names, cursor.fetchall())
    found = as_counter(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    problems = []
    if sorted(names) != sorted(spark_df.columns):
        problems.append(f"columns {sorted(spark_df.columns)} != {sorted(names)}")
    if expected != found:
        problems.append(
            f"{sum(found.values())} rows, expected {sum(expected.values())}; "
            f"only in Spark {list((found - expected).items())[:3]}; "
            f"only in SQL {list((expected - found).items())[:3]}"
        )
    return problems

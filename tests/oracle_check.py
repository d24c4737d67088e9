"""Runs named queries against their SQL counterparts and compares rows and column names."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark, sf_dir: str, query, sql: str) -> tuple[int, Counter, Counter]:
    """Row count, rows only in Spark's result, rows only in the other engine's."""
    df = query(spark, sf_dir)
    with oracle_connection(sf_dir) as connection:
        relation = connection.sql(sql)
        assert sorted(df.columns) == sorted(relation.columns)
        expected = bag(relation.columns, relation.fetchall())
    actual = bag(df.columns, df.collect())
    return sum(actual.values()), actual - expected, expected - actual

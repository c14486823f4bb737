"""Every query with a SQL counterpart must return the same rows."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from lendwright.plans.queries_data import TABLES

SMOKE = ("b2_approximate_profile",)


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)



@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, folder, duck, name):
    frame = queries()[name](spark, folder)
    cursor = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    want = canonical(columns, cursor.fetchall())
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", SMOKE)
def test_query_without_sql_returns_rows(spark, folder, name):
    assert queries()[name](spark, folder).count() > 0


def test_entry(spark):
    rows = entry(spark).collect()
    assert {r["feature"] for r in rows} >= {"n_lines", "amount", "segment"}

"""Named queries over the star tables and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded for comparison across engines, whose sums may differ in the last bits."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`"))
            for f in df.schema.fields
        ]
    )


def r(value: str | Column, digits: int = 8) -> Column:
    return F.round(value, digits)


# The loan view and its frozen form, for SQL.
LOAN = """
WITH lines AS (
  SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty,
         round(sum(l_extendedprice * (1 - l_discount)), 4) AS net,
         round(sum(l_discount), 2) / count(*) AS avg_disc, max(l_tax) AS max_tax,
         CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS post_returns
  FROM lineitem GROUP BY l_orderkey),
loan AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
         o_custkey || '-' || year(o_orderdate) AS customer_year, o_orderdate AS application_date,
         o_totalprice AS amount, c_acctbal AS acctbal, o_orderpriority AS priority,
         c_mktsegment AS segment, n_lines, qty, net, avg_disc, max_tax, post_returns,
         CASE WHEN n_lines IS NULL THEN NULL
              WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN -1
              WHEN post_returns >= 2 THEN 1 ELSE 0 END AS y
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey),
frozen AS (SELECT * FROM loan WHERE y IN (0, 1))"""

# Two deterministic scores of the frozen rows; fractions of whole numbers are equal on every engine.
SCORED = (
    LOAN
    + """,
parts AS (
  SELECT *, CASE WHEN year(application_date) < 1999 THEN 'train'
                 WHEN year(application_date) < 2000 THEN 'test' ELSE 'oot' END AS partition
  FROM frozen),
scored AS (
  SELECT 'signal' AS model, order_id, partition, y, (n_lines * 200 + (order_id * 7919) % 1000) / 4000.0::DOUBLE AS p FROM parts
  UNION ALL
  SELECT 'noise', order_id, partition, y, ((order_id * 31) % 97 + 1) / 100.0::DOUBLE FROM parts)"""
)


def deciles(parts: int = 10) -> str:
    from lendwright.operators.order_statistics import quantile_grid

    return "[" + ", ".join(repr(q) for q in quantile_grid(parts)) + "]::DOUBLE[]"

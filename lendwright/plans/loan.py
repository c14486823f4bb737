"""The ``loan`` view: one row per order with a 0/1/-1/NULL label, built from the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

NUMERIC_FEATURES = ("amount", "acctbal", "n_lines", "qty", "net", "avg_disc", "max_tax")
CATEGORICAL_FEATURES = ("priority", "segment")
FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def order_lines(lineitem: DataFrame) -> DataFrame:
    """Per-order line aggregates. Sums of money are rounded to the input's own precision."""
    return lineitem.groupBy("l_orderkey").agg(
        F.count("*").alias("n_lines"),
        F.sum("l_quantity").alias("qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("net"),
        (F.round(F.sum("l_discount"), 2) / F.count("*")).alias("avg_disc"),
        F.max("l_tax").alias("max_tax"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("post_returns"),
    )


def loan(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer")
    lines = order_lines(table(spark, folder, "lineitem"))
    joined = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").join(
        customer, orders.o_custkey == customer.c_custkey, "left"
    )
    label = (
        F.when(F.col("n_lines").isNull(), F.lit(None).cast("int"))
        .when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 4 == 0), F.lit(-1))
        .when(F.col("post_returns") >= 2, F.lit(1))
        .otherwise(F.lit(0))
    )
    return joined.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.concat_ws("-", F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string")).alias(
            "customer_year"
        ),
        F.col("o_orderdate").alias("application_date"),
        F.col("o_totalprice").alias("amount"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        "n_lines",
        "qty",
        "net",
        "avg_disc",
        "max_tax",
        "post_returns",
        label.alias("y"),
    )

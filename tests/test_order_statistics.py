from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lendwright.operators import order_statistics as o


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(7)
    frame = pd.DataFrame(
        {
            "smooth": rng.normal(size=3000),
            "tied": np.where(rng.random(3000) < 0.4, 0.25, rng.integers(0, 12, 3000) / 4),
            "whole": rng.integers(-5, 5, 3000),
            "holes": np.where(rng.random(3000) < 0.2, np.nan, rng.exponential(size=3000)),
        }
    )
    return frame, spark.createDataFrame(frame).repartition(5)


@pytest.mark.parametrize("bracket_rows", [2_000_000, 300, 7])
def test_quantiles_equal_pandas(numbers, bracket_rows):
    frame, df = numbers
    grid = o.quantile_grid(10)
    found = o.exact_quantiles(df, list(frame), grid, bracket_rows=bracket_rows)
    for name in frame:
        np.testing.assert_allclose(found[name], frame[name].quantile(grid), atol=1e-12)


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_quantiles_do_not_depend_on_partitions(numbers, parts):
    frame, df = numbers
    a = o.exact_quantiles(df.repartition(parts), ["smooth", "holes"], [0.05, 0.5, 0.99])
    assert a == o.exact_quantiles(df, ["smooth", "holes"], [0.05, 0.5, 0.99])


def test_quantiles_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(None, 3.0), (float("nan"), None)], "a double, b double")
    assert o.exact_quantiles(df, ["a", "b"], [0.0, 0.5, 1.0]) == {"a": [], "b": [3.0, 3.0, 3.0]}


@given(
    values=st.lists(st.sampled_from([-1.5, 0.0, 0.1, 2.0, 7.25, 1e9]), min_size=1, max_size=25),
    q=st.floats(0, 1),
)
@settings(max_examples=6, deadline=None)
def test_quantile_property(spark, values, q):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    (found,) = o.exact_quantiles(df, ["v"], [q], bracket_rows=2)["v"]
    assert math.isclose(found, float(pd.Series(values).quantile(q)), rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("splits", [[], [-0.5, 0.0, 0.7], [0.25]])
def test_running_totals_equal_a_sorted_sum(numbers, descending, splits):
    frame, df = numbers
    counted = df.select((F.col("whole") % 2 == 0).alias("key"), F.round("smooth", 2).alias("v")).groupBy("key", "v").count()
    rows = o.running_totals(counted, ["key"], "v", ["count"], descending=descending, splits=splits).toPandas()
    for _, part in rows.groupby("key"):
        part = part.sort_values("v", ascending=not descending)
        assert list(part["upto_count"]) == list(part["count"].cumsum())
        assert set(part["all_count"]) == {part["count"].sum()}


def test_run_splits_cut_into_runs(numbers):
    _, df = numbers
    splits = o.run_splits(df, "smooth", run_rows=100)
    assert 20 <= len(splits) <= 30 and splits == sorted(splits)


def test_hash_cutoffs_take_the_first_rows(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3 == 0).cast("int").alias("y")).withColumn(
        "d", o.hash_order(F.col("id"), 42)
    )
    cuts = o.hash_cutoffs(df, "y", "d", "id", lambda _, n: math.ceil(n * 0.2))
    taken = df.withColumn("t", o.at_or_before(cuts, "y", "d", "id")).toPandas()
    for _, part in taken.groupby("y"):
        part = part.sort_values("d")
        goal = math.ceil(len(part) * 0.2)
        assert list(part["t"]) == [True] * goal + [False] * (len(part) - goal)


def test_join_unique_is_exact_for_hot_and_missing_keys(spark):
    rows = spark.range(6000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 400).alias("k")
    )
    lookup = spark.createDataFrame([(i, i * 10) for i in range(0, 300)] + [(None, -1)], "k long, v long")
    plain = o.join_unique(rows, lookup, ["k"], hot=[])
    routed = o.join_unique(rows, lookup, ["k"], hot_min_rows=10)
    assert 7 in {r["k"] for r in rows.filter(F.xxhash64("k").isin(*o.hot_key_hashes(rows, ["k"], 10))).select("k").distinct().collect()}
    assert plain.exceptAll(routed).isEmpty() and routed.exceptAll(plain).isEmpty()
    assert routed.filter("k is null").select("v").distinct().collect()[0]["v"] == -1

"""Sketched key advice, mergeable profile states, files of versions, several targets."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendwright.operators import joins, profile, screening
from lendwright.session import scratch_path
from lendwright.sources import versions


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sketched_advice_equals_the_exact_one(spark):
    left = spark.range(3000).select((F.col("id") % 1000).alias("customer_id"), (F.col("id") * 2).alias("code"), F.lit("x").alias("kind"))
    right = spark.range(800).select(F.col("id").alias("customer_id"), (F.col("id") * 3).alias("code"), F.lit(None).cast("string").alias("kind"))
    exact = [tuple(r) for r in joins.recommend_keys(left, right).collect()]
    assert [tuple(r) for r in joins.recommend_keys_sketched(left, right).collect()] == exact
    assert "Exchange hashpartitioning" not in plan_of(joins.key_overlaps(left, right, [("customer_id", "customer_id")]))


def test_overlap_stays_within_its_bound(spark):
    left = spark.range(60_000).select(F.col("id").alias("a"))
    right = spark.range(30_000, 90_000).select(F.col("id").alias("b"))
    (row,) = joins.key_overlaps(left, right, [("a", "b")], 12).collect()
    error = joins.overlap_error(90_000, 30_000, 12)
    assert 0 < error < 0.05 and abs(row.overlap - 30_000) < 4 * error * 30_000
    assert joins.overlap_error(4096, 10, 12) == 0


def test_pairs_of_other_names(spark):
    left = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("seven"))
    right = spark.range(400).select(F.col("id").alias("ref"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    found = [(r.left_key, r.right_key, r.overlap_rate) for r in joins.recommend_key_pairs(left, right).collect()]
    assert found == [("k", "ref", 1.0), ("seven", "ref", 1.0)]


def test_merged_state_equals_the_state_of_the_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(rng.normal()) if k % 10 else None, f"t{k % 70}", None) for k in range(20_000)]
    df = spark.createDataFrame(rows, "id long, v double, t string, none string")
    parts = [profile.profile_state(df.filter(F.col("id") % 3 == k)) for k in range(3)]
    merged = {r.name: r for r in profile.state_facts(profile.merged_state(parts[0].unionByName(parts[1]).unionByName(parts[2]))).collect()}
    whole = {r.name: r for r in profile.state_facts(profile.profile_state(df)).collect()}
    for name, r in merged.items():
        w = whole[name]
        assert (r.rows, r.missing_count, r.least, r.most, r.unique_count) == (w.rows, w.missing_count, w.least, w.most, w.unique_count)
    assert merged["t"].unique_count == 70 and merged["none"].missing_count == 20_000 and merged["t"].quantiles is None
    assert merged["id"].unique_count == pytest.approx(20_000, rel=0.03)
    values = np.array([r[1] for r in rows if r[1] is not None])
    for q, v in zip((0.25, 0.5, 0.75), merged["v"].quantiles):
        assert abs((values <= v).mean() - q) < 0.02
    odd = parts[0].withColumn("state_version", F.lit(0))
    with pytest.raises(ValueError, match="PROFILE_STATE_VERSION_UNSUPPORTED"):
        profile.merged_state(odd)


def test_files_of_a_version(spark):
    root = scratch_path(spark, "versions")
    df = spark.range(100).withColumn("x", F.col("id") * 2).repartition(4)
    version = versions.write_version(df, root, "four files")
    assert versions.changed_files(spark, root, version).collect() == [] and versions.uncommitted(spark, root) == []
    spark.range(5).withColumn("x", F.lit(1).cast("long")).coalesce(1).write.mode("append").parquet(versions.version_path(root, version))
    assert [(r.status, r.rows) for r in versions.changed_files(spark, root, version).collect()] == [("added", 5)]
    # Data without a lineage row, as a crash leaves it.
    df.write.parquet(versions.version_path(root, "dsv_crashed"))
    assert versions.uncommitted(spark, root) == ["dsv_crashed"]
    with pytest.raises(ValueError, match="DATASET_VERSION_NOT_FOUND"):
        versions.read_version(spark, root, "dsv_crashed")
    empty = versions.write_version(df.limit(0), root, "no rows")
    assert versions.read_version(spark, root, empty).count() == 0


def test_files_that_were_touched_or_lost(spark, tmp_path):
    import os

    root = str(tmp_path)
    version = versions.write_version(spark.range(90).repartition(3), root, "three files")
    folder = versions.version_path(root, version)
    first, second, _ = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    os.utime(f"{folder}/{first}", (1, 1))
    assert versions.changed_files(spark, root, version).collect() == []
    os.replace(f"{folder}/{second}", f"{folder}/{first}")
    os.replace(f"{folder}/.{second}.crc", f"{folder}/.{first}.crc")
    got = {r.file: r.status for r in versions.changed_files(spark, root, version).collect()}
    assert got == {second: "missing", first: "changed"}


def test_iv_of_several_targets_equals_one_by_one(spark):
    rng = np.random.default_rng(4)
    rows = [(float(rng.normal()), str(rng.choice(["a", "b", "c"])), int(rng.integers(0, 2)), int(rng.integers(-1, 2)), None) for _ in range(3000)]
    df = spark.createDataFrame(rows, "v double, c string, first int, second int, none int")
    got = screening.iv_bins_by_target(df, ["first", "second", "none"], ["v", "c"])
    assert {r.target for r in got.collect()} == {"first", "second"}
    for t in ("first", "second"):
        own = got.filter(F.col("target") == t).drop("target")
        want = screening.iv_bins(df, t, ["v", "c"])
        assert own.columns == want.columns
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, want.collect()))

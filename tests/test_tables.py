"""Profiles, labels, cleaning, joins, splits, screening on small edge fixtures."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lendwright.operators import cleaning, joins, labels, profile, screening, splits


def test_profile_edges(spark):
    rows = [(1.0, None, "2024-01-01", "x", True, None), (float("nan"), None, "soon", "x", False, None), (0.0, None, "2024-02-03", "y", None, None)]
    df = spark.createDataFrame(rows, "Y double, empty string, apply_date string, id_card string, flag boolean, n int")
    exact = {r["name"]: r for r in profile.column_profile(df).collect()}
    assert [exact[c]["type"] for c in df.columns] == ["numeric", "empty", "categorical", "categorical", "boolean", "empty"]
    assert exact["Y"]["target_candidate"] and exact["Y"]["missing_count"] == 1 and exact["Y"]["unique_count"] == 2
    assert exact["id_card"]["pii"] and exact["apply_date"]["time_candidate"] and exact["flag"]["target_candidate"] is False
    rough = {r["name"]: r for r in profile.column_profile(df, approximate=True).collect()}
    for name in df.columns:
        assert rough[name].asDict() == exact[name].asDict()


def test_date_text_needs_ninety_percent(spark):
    good = [("2024-01-%02d" % (i + 1),) for i in range(18)] + [("?",), ("!",)]
    df = spark.createDataFrame(good, "loan_date string")
    assert profile.column_profile(df).first()["type"] == "datetime"
    worse = spark.createDataFrame([*good, ("%",)], "loan_date string")
    assert profile.column_profile(worse).first()["type"] == "text"


def test_customer_key_prefers_people(spark):
    df = spark.createDataFrame([(1, 5, 9, "a"), (2, 5, 9, "b")], "order_id int, customer_id int, batch_id int, phone string")
    assert profile.default_customer_key(profile.column_profile(df)).first()[0] == "customer_id"
    assert profile.default_time_column(profile.column_profile(df)).first()[0] is None


def test_diagnosis_of_absent_time_column(spark):
    df = spark.createDataFrame([(i % 2, "a") for i in range(120)], "y int, c string")
    codes = {r["code"] for r in profile.diagnose(df, "y", "when").collect()}
    assert codes == {"DUPLICATE_ROWS", "TIME_COLUMN_NOT_FOUND"}


def test_long_values_come_back_whole(spark):
    text = "abc " * 500
    df = spark.createDataFrame([(text,), (text,), ("short",), (None,)], "t string")
    got = [(r["value"], r["count"]) for r in profile.top_values(df).orderBy("rank").collect()]
    assert got[0] == (text, 2) and {g for g in got[1:]} == {("short", 1), ("<MISSING>", 1)}


def test_label_spellings(spark):
    values = [" BAD ", "1.0", "yes", "good", "0", "No", "-1", "", None, "maybe"]
    df = spark.createDataFrame([(v,) for v in values], "y string")
    got = [r["y"] for r in labels.normalize_label(df, "y").collect()]
    assert got == [1, 1, 1, 0, 0, 0, None, None, None, None]
    summary = labels.target_summary(df, "y").first()
    assert (summary["invalid_count"], summary["missing_count"], summary["too_small"]) == (3, 1, True)
    with pytest.raises(ValueError, match="TARGET_NOT_FOUND"):
        labels.target_summary(df, "z")


def test_missing_codes_match_numbers(spark):
    df = spark.createDataFrame([(-1, -1.0, "-1"), (2, 2.0, "-1.0"), (None, None, None)], "a int, b double, c string")
    codes = {"a": ["-1"], "b": ["-1"], "c": ["-1"]}
    assert [tuple(r) for r in cleaning.replace_missing_codes(df, codes).collect()] == [
        (None, None, None), (2, 2.0, "-1.0"), (None, None, None)
    ]
    assert {r[0]: r[1] for r in cleaning.replaced_cells(df, codes).collect()} == {"a": 1, "b": 1, "c": 1}


def test_accepted_actions_only(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 99.0)], "k int, v double")
    steps = [
        {"id": "d", "kind": "drop_duplicates"},
        {"id": "c", "kind": "clip_numeric", "column": "v", "lower": 0, "upper": 10},
        {"id": "x", "kind": "drop_columns", "columns": ["k"]},
    ]
    done = cleaning.apply_cleaning(df, steps, accepted=["d", "c"])
    assert sorted(map(tuple, done.collect())) == [(1, 5.0), (2, 10.0)]
    with pytest.raises(ValueError, match="UNSUPPORTED_CLEANING_ACTION"):
        cleaning.apply_cleaning(df, [{"kind": "guess"}])


def test_duplicate_right_key_blocks(spark):
    left = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "id int, Y int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "id int, x string")
    with pytest.raises(ValueError, match="RIGHT_KEY_DUPLICATES"):
        joins.guarded_join(left, right, joins.JoinStep("r", ["id"], ["id"]))
    evidence = joins.validate_join(left, right, ["id"], ["id"], "id").first()
    assert evidence["right_key_duplicates"] == 1 and evidence["grain"] == "customer" and evidence["warning_issue"] == "LOW_MATCH_RATE"
    with pytest.raises(ValueError, match="JOIN_KEY_NOT_FOUND"):
        joins.validate_join(left, right, ["id"], ["nope"])
    with pytest.raises(ValueError, match="JOIN_KEYS_INVALID"):
        joins.validate_join(left, right, [], [])


@pytest.mark.parametrize("how", ["left", "inner", "right", "outer"])
def test_join_types_equal_pandas(spark, how):
    left = pd.DataFrame({"k": ["a", "b", None, "c"], "v": [1, 2, 3, 4]})
    right = pd.DataFrame({"k": ["a", None, "d"], "v": [10, 30, 40]})
    want = left.merge(right, how=how, on="k", suffixes=("", "_right"))
    sl, sr = spark.createDataFrame(left, "k string, v int"), spark.createDataFrame(right, "k string, v int")
    step = joins.JoinStep("r", ["k"], ["k"], how)
    if how in ("left", "inner"):
        got = joins.guarded_join(sl, sr, step)
    else:
        got = joins._join(sl, sr, step)

    def plain(rows):
        return sorted(([None if pd.isna(x) else x for x in r] for r in rows), key=str)

    assert got.columns == list(want.columns)
    assert plain(got.collect()) == plain(want.itertuples(index=False))


def test_changed_labels_and_inflation_are_refused(spark):
    left = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id int, Y int")
    right = spark.createDataFrame([(1, "a"), (9, "b")], "id int, x string")
    with pytest.raises(ValueError, match="JOIN_TARGET_DISTRIBUTION_CHANGED"):
        joins.guarded_join(left, right, joins.JoinStep("r", ["id"], ["id"], "inner"), ["Y"])
    with pytest.raises(ValueError, match="JOIN_SAMPLE_INFLATION"):
        joins.guarded_join(left, right, joins.JoinStep("r", ["id"], ["id"], "outer"), ["Y"])


def people(spark, n=40, cross=True):
    rows = [(i, f"S{i}", f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", i % 2) for i in range(n - 2)]
    rows += [(n, "CROSS", "2024-01-01", 1), (n + 1, "CROSS" if cross else "LATE", "2024-03-01", 0)]
    return spark.createDataFrame(rows, "id int, customer_id string, application_date string, Y int")


def test_customers_on_both_sides_are_excluded(spark):
    plan = splits.SplitPlan(time_column="application_date", customer_key="customer_id")
    done = splits.split_dataset(people(spark), "Y", "id", plan)
    out = done.filter("partition = 'excluded'").select("customer_id", "exclusion_reason").distinct().collect()
    assert [tuple(r) for r in out] == [("CROSS", "cross_boundary_customer")]
    assert splits.split_violations(done, "id", "customer_id", "application_date").isEmpty()
    assert {r["partition"] for r in done.select("partition").distinct().collect()} == {"train", "test", "oot", "excluded"}
    shuffled = splits.split_dataset(people(spark).repartition(7), "Y", "id", plan)
    assert done.select("id", "partition").exceptAll(shuffled.select("id", "partition")).isEmpty()
    mark = splits.exclusion_fingerprint(done, "id").first()
    assert mark == splits.exclusion_fingerprint(shuffled, "id").first() and mark["excluded_rows"] == 2


def test_split_guards(spark):
    with pytest.raises(ValueError, match="TEST_SIZE_INVALID"):
        splits.SplitPlan(time_column="t", test_size=0.5)
    with pytest.raises(ValueError, match="OOT_SIZE_INVALID"):
        splits.SplitPlan(time_column="t", oot_size=0.0)
    with pytest.raises(ValueError, match="TIME_COLUMN_REQUIRED"):
        splits.SplitPlan()
    with pytest.raises(ValueError, match="UNSUPPORTED_SPLIT_METHOD"):
        splits.SplitPlan(method="guess")
    plan = splits.SplitPlan(time_column="application_date")
    with pytest.raises(ValueError, match="INSUFFICIENT_SAMPLES_FOR_SPLIT"):
        splits.split_dataset(people(spark, 20), "Y", "id", plan)
    with pytest.raises(ValueError, match="CUSTOMER_KEY_NOT_FOUND"):
        splits.split_dataset(people(spark), "Y", "id", splits.SplitPlan(time_column="application_date", customer_key="who"))


@pytest.mark.parametrize("bad, fails", [(19, False), (21, True)])
def test_unusable_times(spark, bad, fails):
    df = people(spark, 100).withColumn(
        "application_date", F.when(F.col("id") < bad, F.lit("unknown")).otherwise(F.col("application_date"))
    )
    plan = splits.SplitPlan(time_column="application_date")
    if fails:
        with pytest.raises(ValueError, match="TIME_PARSE_RATE_TOO_LOW"):
            splits.split_dataset(df, "Y", "id", plan)
    else:
        done = splits.split_dataset(df, "Y", "id", plan)
        assert done.filter("exclusion_reason = 'missing_or_invalid_time'").count() == bad
        assert splits.split_violations(done, "id", None, "application_date").isEmpty()


def test_loan_by_customer_is_insufficient(spark, folder):
    from lendwright.plans.queries_model import stored

    plan = splits.SplitPlan(time_column="application_date", customer_key="customer_id")
    with pytest.raises(ValueError, match="INSUFFICIENT_AFTER_CUSTOMER_ISOLATION"):
        splits.split_dataset(stored(spark, folder), "y", "order_id", plan)


def test_group_split_sizes_and_missing_customers(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 211).alias("c"), (F.col("id") % 7 == 0).cast("int").alias("y")
    )
    done = splits.group_stratified_split(df, "y", "c")
    per = done.groupBy("c").agg(F.count_distinct("partition").alias("n")).filter("n > 1")
    assert per.isEmpty() and done.count() == 3000


def test_broken_split_is_reported(spark):
    rows = [(1, "a", "2024-01-05", "train"), (2, "a", "2024-01-01", "oot"), (2, "b", "2024-01-02", "test"), (3, "c", "2024-01-01", None)]
    df = spark.createDataFrame(rows, "id int, c string, d string, partition string")
    codes = {r["code"]: r["violations"] for r in splits.split_violations(df, "id", "c", "d").collect()}
    assert codes == {
        "SPLIT_ROW_OVERLAP": 1, "SPLIT_ROWS_NOT_ACCOUNTED_FOR": 1, "SPLIT_CUSTOMER_OVERLAP": 1, "STRICT_OOT_TIME_BOUNDARY_VIOLATION": 1
    }


def weak_frame(spark):
    rows = [(i, i % 2, float((i // 2) % 2), None if i % 20 < 7 else float(i % 20), f"u{i}", 3, float(i % 2) + (i % 5) / 10) for i in range(200)]
    return spark.createDataFrame(rows, "rid int, Y int, weak double, missing double, user_id string, one int, strong double")


def test_screening_and_restore(spark):
    found = screening.screen_features(weak_frame(spark), "Y", ["weak", "missing", "user_id", "one", "strong", "Y"], row_id="rid")
    reasons = {r["column"]: r["reason"] for r in found.collect()}
    assert reasons == {"weak": "LOW_IV", "missing": "MISSING_RATE", "user_id": "IDENTIFIER", "one": "CONSTANT", "strong": None, "Y": "TARGET"}
    restored = screening.restore_features(found, {"weak": "needed by the regulator"})
    assert restored.filter("status = 'included'").count() == 2
    with pytest.raises(ValueError, match="RESTORE_REASON_REQUIRED"):
        screening.restore_features(found, {"missing": "short"})
    with pytest.raises(ValueError, match="FEATURE_NOT_RECOVERABLE"):
        screening.restore_features(found, {"user_id": "needed by the regulator"})


def test_historical_names_are_no_leakage():
    from lendwright.functions.expressions import is_leakage_name

    assert is_leakage_name("post_collection_status") and not is_leakage_name("prior_overdue_repay_delinquencies")


@pytest.mark.parametrize("hot", [None, 20])
def test_spearman_with_ties_and_nulls_equals_pandas(spark, monkeypatch, hot):
    from lendwright.operators import order_statistics

    if hot:
        monkeypatch.setattr(order_statistics, "HOT_MIN_ROWS", hot)
        monkeypatch.setattr(order_statistics.join_unique, "__kwdefaults__", {**order_statistics.join_unique.__kwdefaults__, "hot_min_rows": hot})
    rng = np.random.default_rng(11)
    frame = pd.DataFrame({"a": rng.normal(size=300), "b": rng.integers(0, 4, 300).astype(float), "c": rng.normal(size=300), "d": rng.normal(size=300)})
    frame["c"] = frame["a"] * 0.5 + frame["c"]
    frame.loc[rng.random(300) < 0.2, "c"] = np.nan
    frame.loc[rng.random(300) < 0.1, "d"] = np.nan
    df = spark.createDataFrame(frame.reset_index(names="rid"))
    names = ["a", "b", "c", "d"]
    for r in screening.spearman_matrix(df, names, "rid").collect():
        pair = frame[[r["left"], r["right"]]].dropna()
        want = pair.rank().corr().iloc[0, 1]
        assert r["spearman"] == pytest.approx(want, abs=1e-12)


def test_correlated_side_with_lower_iv_goes(spark):
    matrix = spark.createDataFrame([("a", "b", -0.9), ("b", "c", 0.8), ("a", "c", 0.5)], "left string, right string, spearman double")
    iv = spark.createDataFrame([("a", 0.3), ("b", 0.3), ("c", 0.4)], "feature string, iv double")
    got = {(r["left"], r["right"]): r["excluded"] for r in screening.prune_correlated(matrix, iv).collect()}
    assert got == {("a", "b"): "b", ("b", "c"): "b"}

"""Plans must not gather rows in one task, run Python per row, or read unneeded columns."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import queries

SCALABLE = (
    "b2_column_profile", "b5_duplicate_rows", "c2_target_summary", "e2_validate_join", "e3_guarded_join", "e4_join_plan",
    "f1_random_stratified", "f3_time_holdout", "f4_whole_split", "g2_woe_iv", "g4_spearman", "h4_woe_table", "h6_woe_transform",
    "h10_bin_report", "i9_stratified_folds", "j1_j5_binary_metrics", "j6_lift_table", "j7_calibration_table", "k1_probability_to_score",
    "k4_scorecard_rules", "m2_pii_scan", "n1_event_integrity", "n3_latest_events", "n8_usage_by_run",
)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SCALABLE)
def test_plan_is_distributed(spark, folder, name):
    plan = plan_of(queries()[name](spark, folder))
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # A window over all rows needs everything in one partition.
    assert not re.search(r"Window \[[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", plan)
    assert "collect_list" not in plan or name == "j8_psi"


@pytest.mark.parametrize("name", ["k1_probability_to_score", "k4_scorecard_rules", "h6_woe_transform"])
def test_scan_reads_needed_columns(spark, folder, name):
    plan = plan_of(queries()[name](spark, folder))
    assert "l_comment" not in plan and "c_name" not in plan and "l_partkey" not in plan


def test_filter_reaches_the_scan(spark, folder):
    plan = plan_of(queries()["a2_columnar_scan"](spark, folder))
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan


def test_scoring_needs_no_shuffle(spark, folder):
    from lendwright.operators.scoring import score_with_rules
    from lendwright.plans.loan import table
    from tests.test_logs_and_sources import rules

    orders = table(spark, folder, "orders").selectExpr("o_orderkey", "o_totalprice AS x")
    assert "Exchange" not in plan_of(score_with_rules(orders, rules()))

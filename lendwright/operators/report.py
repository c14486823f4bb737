"""Report tables: one set of facts, one DataFrame per sheet."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from lendwright.functions.expressions import column



def sample_overview(
    metrics: DataFrame, stability: DataFrame | None = None, partition: str = "partition"
) -> DataFrame:
    """Rows, classes, AUC, KS, average precision and score stability per partition.

    The stability of a partition is measured against the one before it (train→test→oot).
    """
    order = F.array_position(F.array(*[F.lit(p) for p in ("train", "test", "oot")]), column(partition))
    base = metrics.select(
        F.upper(column(partition)).alias("partition"),
        order.cast("int").alias("position"),
        "rows", "positive_count", "negative_count", "bad_rate", "roc_auc", "ks", "pr_auc",
    )
    if stability is None:
        return base.withColumn("psi", F.lit(None).cast("double"))
    moved = stability.select(F.upper("current").alias("partition"), "psi")
    return base.join(moved, "partition", "left")


def executive_summary(
    overview: DataFrame, champion: str, absolute_ordering: bool, review_passed: bool, selected_features: int
) -> DataFrame:
    """One row with the verdict: ``pass`` needs an ordered score and an approved review."""

    def pick(name: str, partition: str) -> Column:
        return F.max(F.when(F.col("partition") == partition, F.col(name)))

    verdict = "pass" if absolute_ordering and review_passed else "conditional"
    return overview.agg(
        F.lit(champion).alias("champion"),
        pick("roc_auc", "TEST").alias("test_auc"),
        pick("ks", "TEST").alias("test_ks"),
        pick("roc_auc", "OOT").alias("oot_auc"),
        pick("ks", "OOT").alias("oot_ks"),
        F.lit(absolute_ordering).alias("absolute_ordering"),
        F.lit(selected_features).alias("selected_feature_count"),
        F.lit(verdict).alias("quality_verdict"),
    )


def feature_sheet(screening: DataFrame) -> DataFrame:
    """Included features first, strongest first; then the excluded ones with their reason."""
    return screening.select(
        F.col("column").alias("feature"), "type", "status", "iv", "missing_rate", "reason", "restored", "restore_reason"
    ).orderBy(F.col("status") != "included", F.col("iv").desc_nulls_last(), "feature")


def bin_sheet(table: DataFrame) -> DataFrame:
    return table.select(
        "feature", "source", "monotonic", "bin", "count", "good", "bad", "bad_rate", "woe", "iv"
    )


def comparison_sheet(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        "candidate", "status", "error_code", "calibration", "test_auc", "test_ks", "test_brier",
        "violations", "train_test_psi", "selection_score", "champion",
    )


def review_coverage(reviews: DataFrame) -> DataFrame:
    """Shares of deterministic, model and fallback reviews over a review log."""
    status = F.coalesce("status", F.lit("unknown"))
    deterministic = (F.coalesce("deterministic_status", F.lit("")) != "") | status.isin(
        "deterministic_pass", "fallback_pass"
    )
    model = F.coalesce(F.col("llm_status").isin("llm_reviewer_pass", "revise", "blocked"), F.lit(False))
    fallback = F.coalesce(F.col("llm_status") == "fallback_pass", F.lit(False)) | (status == "fallback_pass")

    def ratio(hit: Column) -> Column:
        return F.coalesce(F.round(F.avg(hit.cast("int")), 6), F.lit(0.0))

    return reviews.agg(
        F.count("*").alias("total_records"),
        F.count_if(deterministic).alias("deterministic_reviewed"),
        ratio(deterministic).alias("deterministic_coverage"),
        F.count_if(model).alias("llm_reviewed"),
        ratio(model).alias("llm_coverage"),
        F.count_if(fallback).alias("fallback_records"),
        ratio(fallback).alias("fallback_rate"),
    )


def review_status_counts(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("records"))


def write_report(sheets: Mapping[str, DataFrame], path: str) -> None:
    """Every sheet as Parquet for machines and JSON lines for people."""
    for name, sheet in sheets.items():
        sheet.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}/parquet")
        sheet.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}/json")

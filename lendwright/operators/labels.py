"""Binary label handling: normalise, summarise, freeze, and several labels at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lendwright.functions.expressions import binary_label, column
from lendwright.operators.order_statistics import unpivot_values

SMALL_SAMPLE = 100


def normalize_label(df: DataFrame, label: str, output: str | None = None) -> DataFrame:
    return df.withColumn(output or label, binary_label(label))


def target_summary(df: DataFrame, targets: Sequence[str] | str) -> DataFrame:
    """One row per label column, from a single pass over the table."""
    targets = [targets] if isinstance(targets, str) else list(targets)
    absent = [t for t in targets if t not in df.columns]
    if absent:
        raise ValueError(f"TARGET_NOT_FOUND: {absent}")
    long = df.select(
        unpivot_values(
            [(t, [binary_label(t), column(t).isNotNull()]) for t in targets], ["label", "present"]
        )
    )
    label = F.col("label")
    counted = long.groupBy(F.col("feature").alias("target")).agg(
        F.count("label").alias("valid_count"),
        F.count_if(label == 1).alias("positive_count"),
        F.count_if(label == 0).alias("negative_count"),
        F.count_if(F.col("present") & label.isNull()).alias("invalid_count"),
        F.count_if(~F.col("present")).alias("missing_count"),
    )
    return counted.select(
        "target",
        "valid_count",
        "positive_count",
        "negative_count",
        F.try_divide("positive_count", "valid_count").alias("bad_rate"),
        "invalid_count",
        "missing_count",
        ((F.col("positive_count") == 0) | (F.col("negative_count") == 0)).alias("single_class"),
        (F.col("valid_count") < SMALL_SAMPLE).alias("too_small"),
    )


def target_issues(summary: DataFrame) -> DataFrame:
    """``(code, severity, column, value)`` rows of the label checks that fail."""
    checks = F.array(
        F.struct(
            F.lit("TARGET_SINGLE_CLASS").alias("code"),
            F.lit("blocking").alias("severity"),
            F.col("single_class").alias("hit"),
        ),
        F.struct(
            F.lit("TARGET_TOO_SMALL").alias("code"),
            F.lit("warning").alias("severity"),
            F.col("too_small").alias("hit"),
        ),
    )
    return (
        summary.select("target", "valid_count", F.inline(checks))
        .filter("hit")
        .select(
            "code", "severity", F.col("target").alias("column"), F.col("valid_count").cast("double").alias("value")
        )
    )


def freeze_target(df: DataFrame, target: str) -> DataFrame:
    """Keep the rows with a 0/1 label and make the label an integer."""
    if target not in df.columns:
        raise ValueError("TARGET_NOT_FOUND")
    return df.withColumn(target, binary_label(target)).filter(F.col(target).isNotNull())


def freeze_each_target(df: DataFrame, targets: Sequence[str]) -> dict[str, tuple[DataFrame, list[str]]]:
    """Independent frozen samples over one table; every other label is protected in each of them."""
    return {t: (freeze_target(df, t), [o for o in targets if o != t]) for t in targets}

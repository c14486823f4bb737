"""Scans for secrets and personal data in text, and suppression of small groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lendwright.functions import fixed_values as fixed
from lendwright.functions.expressions import column, is_pii_name

# Every line break a text may hold.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\u0085\u2028\u2029]"


def has_secret(text: Column) -> Column:
    return text.rlike(f"(?i){fixed.SECRET_TEXT}")


def _has_long_number(text: Column) -> Column:
    """One cheap scan that rules out phone and identity numbers for most texts. Digits of all scripts count, as do
    letters of all scripts at word boundaries (flag U)."""
    return text.rlike(r"\p{Nd}{11}")


def pii_counts(text: Column) -> dict[str, Column]:
    """Mobile numbers, identity numbers and e-mail addresses; each pattern runs only where it can match."""
    digits, at = _has_long_number(text), F.contains(text, F.lit("@"))
    found = {
        "mobiles": (digits, fixed.PII_MOBILE),
        "id_numbers": (digits, fixed.PII_ID_NUMBER),
        "emails": (at, fixed.PII_EMAIL),
    }
    return {
        name: F.when(possible, F.regexp_count(text, F.lit(f"(?iU){pattern}"))).otherwise(F.lit(0))
        for name, (possible, pattern) in found.items()
    }


def has_pii(text: Column) -> Column:
    number = _has_long_number(text) & text.rlike(f"(?U)(?:{fixed.PII_MOBILE}|{fixed.PII_ID_NUMBER})")
    return number | (F.contains(text, F.lit("@")) & text.rlike(f"(?i){fixed.PII_EMAIL}"))


def _occurrences(line: Column, mark: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))


def table_lines(text: Column) -> Column:
    """Lines that look like rows of a pasted table: three commas or two tabs."""
    return F.size(
        F.filter(
            F.split(text, LINE_BREAK),
            lambda line: line.rlike(r"\S") & ((_occurrences(line, ",") >= 3) | (_occurrences(line, "\t") >= 2)),
        )
    )


def has_pasted_table(text: Column) -> Column:
    return table_lines(text) >= 2


def scan_text(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Per-row findings over the whole text; NULL text has none."""
    value = F.coalesce(column(text), F.lit(""))
    return df.select(
        *keep,
        has_secret(value).alias("secret"),
        *[hits.alias(name) for name, hits in pii_counts(value).items()],
        has_pii(value).alias("pii"),
        has_pasted_table(value).alias("pasted_table"),
    )


def text_issue(text: str | Column) -> Column:
    """The first rule that forbids passing a text on, or NULL."""
    value = F.coalesce(column(text), F.lit(""))
    return (
        F.when(has_secret(value), F.lit("POSSIBLE_SECRET_FORBIDDEN"))
        .when(has_pii(value), F.lit("POSSIBLE_PII_VALUE_FORBIDDEN"))
        .when(has_pasted_table(value), F.lit("POSSIBLE_RAW_TABLE_FORBIDDEN"))
    )


def suppress_small_groups(
    df: DataFrame, count: str = "count", minimum: int = fixed.MIN_GROUP_COUNT
) -> DataFrame:
    """Groups below the minimum keep only their count."""
    small = F.coalesce(column(count), F.lit(0)) < minimum
    kept = [
        F.coalesce(column(c), F.lit(0)).alias(c) if c == count else F.when(~small, column(c)).alias(c)
        for c in df.columns
    ]
    return df.select(*kept, small.alias("suppressed"))


def safe_evidence(profile: DataFrame, screening: DataFrame | None = None) -> DataFrame:
    """Column facts under an alias: no names, no values."""
    named = profile.select(
        F.format_string("f_%04d", F.col("position") + 1).alias("alias"),
        "name", "type", "missing_rate", "unique_count", "pii",
    )
    if screening is None:
        return named.drop("name").withColumns(
            {
                "selected": F.lit(False),
                "selection_reason": F.lit(None).cast("string"),
                "iv": F.lit(None).cast("double"),
            }
        )
    chosen = screening.select(
        F.col("column").alias("name"),
        (F.col("status") == "included").alias("selected"),
        F.col("reason").alias("selection_reason"),
        "iv",
    )
    return (
        named.join(chosen, "name", "left")
        .drop("name")
        .withColumn("selected", F.coalesce("selected", F.lit(False)))
    )


def drop_pii_columns(df: DataFrame) -> DataFrame:
    """Without the columns whose names say personal data."""
    return df.select(*[column(c) for c in df.columns if not is_pii_name(c)])

"""Cleaning plans and the four cleaning actions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lendwright.functions.expressions import as_double, clip, column, is_numeric
from lendwright.operators.profile import duplicate_rows, missing_rates

def cleaning_plan(df: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Proposed actions with stable ids, so that a reviewer can accept any subset."""

    def action(frame: DataFrame, identifier: Column, kind: str, name: Column, codes: Column) -> DataFrame:
        return frame.select(
            identifier.alias("id"),
            F.lit(kind).alias("kind"),
            name.cast("string").alias("column"),
            codes.cast("array<string>").alias("codes"),
            F.lit(True).alias("recommended"),
            F.lit(True).alias("requires_confirmation"),
        )

    nothing = F.lit(None)
    plan = action(
        duplicate_rows(df).filter("duplicate_rows > 0"),
        F.lit("drop_exact_duplicates"), "drop_duplicates", nothing, nothing,
    ).unionByName(
        action(
            missing_rates(df).filter("missing_rate = 1"),
            F.concat(F.lit("drop_empty:"), F.col("name")), "drop_columns", F.col("name"), nothing,
        )
    )
    if dictionary is not None:
        described = dictionary.filter(
            F.col("field").isin(*df.columns) & (F.size("missing_codes") > 0)
        )
        plan = plan.unionByName(
            action(
                described,
                F.concat(F.lit("replace_missing:"), F.col("field")),
                "replace_missing_codes", F.col("field"), F.col("missing_codes"),
            )
        )
    return plan


def missing_code_hit(df: DataFrame, name: str, codes: Sequence[str]) -> Column:
    """A value equals a missing code as text, or as a number when both are numbers."""
    hit = column(name).cast("string").isin(*[str(c) for c in codes])
    numbers = [float(c) for c in codes if _is_number(c)]
    if numbers and is_numeric(df.schema[name].dataType):
        hit = hit | as_double(name, df.schema[name].dataType).isin(*numbers)
    return F.coalesce(hit, F.lit(False))


def _is_number(text: str) -> bool:
    try:
        float(text)
    except (TypeError, ValueError):
        return False
    return True


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def replace_missing_codes(df: DataFrame, codes: Mapping[str, Sequence[str]]) -> DataFrame:
    known = {c: list(v) for c, v in codes.items() if c in df.columns and v}
    return df.withColumns(
        {c: F.when(~missing_code_hit(df, c, v), column(c)) for c, v in known.items()}
    ) if known else df


def replaced_cells(df: DataFrame, codes: Mapping[str, Sequence[str]]) -> DataFrame:
    """How many cells ``replace_missing_codes`` blanks, per column."""
    known = [(c, v) for c, v in codes.items() if c in df.columns and v]
    one = df.agg(*[F.count_if(missing_code_hit(df, c, v)).alias(f"n{i}") for i, (c, v) in enumerate(known)])
    return one.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("replaced_cells"))
                    for i, (c, _) in enumerate(known)
                ]
            )
        )
    )


def clip_numeric(df: DataFrame, name: str, lower: float, upper: float) -> DataFrame:
    return df.withColumn(name, clip(as_double(name, df.schema[name].dataType), lower, upper))


def apply_cleaning(df: DataFrame, actions: Sequence[Mapping], accepted: Sequence[str] | None = None) -> DataFrame:
    """Run the accepted actions in order. An action is a mapping with ``kind`` and its arguments."""
    for step in actions:
        if accepted is not None and step.get("id") not in accepted:
            continue
        kind = step["kind"]
        names = step.get("columns") or ([step["column"]] if step.get("column") else [])
        if kind == "drop_duplicates":
            df = drop_duplicates(df)
        elif kind == "drop_columns":
            df = drop_columns(df, names)
        elif kind == "replace_missing_codes":
            df = replace_missing_codes(df, {c: step["codes"] for c in names})
        elif kind == "clip_numeric":
            for c in names:
                df = clip_numeric(df, c, float(step["lower"]), float(step["upper"])) if c in df.columns else df
        else:
            raise ValueError(f"UNSUPPORTED_CLEANING_ACTION: {kind}")
    return df


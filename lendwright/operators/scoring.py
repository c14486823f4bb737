"""Scores from probabilities, the field contract, and scorecard rules as one expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lendwright.functions.expressions import (
    ScoreScale,
    as_double,
    clip,
    column,
    parse_time,
    score_column_name,
    sigmoid,
)
from lendwright.operators.binning import Binning, BinSpec, with_rare_marks, without_marks, woe_value


def probability_to_score(df: DataFrame, probability: str, scale: ScoreScale = ScoreScale()) -> DataFrame:
    p = column(probability)
    return df.withColumns({"raw_score": scale.raw(p), "score": scale.clipped(p)})


def score_limits(df: DataFrame, probability: str, scale: ScoreScale = ScoreScale()) -> DataFrame:
    """Share of rows whose raw score lies below the floor or above the cap."""
    raw = scale.raw(column(probability))
    return df.agg(
        F.avg((raw < F.lit(scale.minimum)).cast("int")).alias("floor_rate"),
        F.avg((raw > F.lit(scale.maximum)).cast("int")).alias("cap_rate"),
    )


def append_scores(
    df: DataFrame, probability: str, model_name: str, scale: ScoreScale = ScoreScale()
) -> DataFrame:
    """``<model>_score`` (half-even integer), ``_raw`` and ``_bad_probability``."""
    name = score_column_name(model_name)
    p = column(probability).cast("double")
    return df.withColumns(
        {
            name: F.rint(scale.clipped(p)).cast("int"),
            f"{name}_raw": scale.raw(p),
            f"{name}_bad_probability": p,
        }
    )


@dataclass(frozen=True)
class FieldContract:
    """Required fields and their semantic types: numeric, datetime or categorical."""

    field_types: Mapping[str, str]

    def __post_init__(self) -> None:
        odd = [f for f, t in self.field_types.items() if t not in ("numeric", "datetime", "categorical")]
        if odd:
            raise ValueError(f"MODEL_FIELD_TYPE_UNSUPPORTED: {odd}")

    def coerced(self, df: DataFrame, name: str) -> Column:
        data_type = df.schema[name].dataType
        kind = self.field_types[name]
        if kind == "numeric":
            return as_double(name, data_type)
        if kind == "datetime":
            return parse_time(name, data_type)
        return column(name).cast("string")


def contract_violations(df: DataFrame, contract: FieldContract) -> DataFrame:
    """``(field, code, rows)`` for missing fields and values lost by coercion; one pass over the table."""
    absent = sorted(set(contract.field_types) - set(df.columns))
    present = [f for f in contract.field_types if f in df.columns]
    spark = df.sparkSession
    missing = spark.createDataFrame(
        [(f, "MISSING_REQUIRED_FIELD", None) for f in absent], "field string, code string, rows long"
    )
    if not present:
        return missing

    def given(name: str) -> Column:
        value = column(name)
        simple = df.schema[name].dataType.simpleString()
        return value.isNotNull() & ~F.isnan(value) if simple in ("double", "float") else value.isNotNull()

    one = df.agg(
        *[F.count_if(given(f) & contract.coerced(df, f).isNull()).alias(f"n{i}") for i, f in enumerate(present)]
    )
    lost = one.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("field"), F.lit("FIELD_TYPE_MISMATCH").alias("code"), F.col(f"n{i}").alias("rows")
                    )
                    for i, f in enumerate(present)
                ]
            )
        )
    ).filter("rows > 0")
    return missing.unionByName(lost) if absent else lost


def apply_contract(df: DataFrame, contract: FieldContract, *, check: bool = True) -> DataFrame:
    """Coerce the required fields; with ``check`` the job fails on the first violation."""
    absent = sorted(set(contract.field_types) - set(df.columns))
    if absent:
        raise ValueError(f"MISSING_REQUIRED_FIELDS: {absent}")
    if check:
        broken = contract_violations(df, contract).collect()
        if broken:
            raise ValueError(f"FIELD_TYPE_MISMATCH: {[(r['field'], r['rows']) for r in broken]}")
    return df.withColumns({f: contract.coerced(df, f) for f in contract.field_types})


@dataclass(frozen=True)
class ScorecardRules:
    """A scorecard without any model object: bins, coefficients and an intercept."""

    features: Sequence[str]
    coefficients: Sequence[float]
    intercept: float
    binning: Binning

    def __post_init__(self) -> None:
        if len(self.features) != len(self.coefficients):
            raise ValueError("SCORECARD_RULES_INVALID")
        lost = [f for f in self.features if f not in self.binning.specs]
        if lost:
            raise ValueError(f"SCORECARD_RULES_INVALID: {lost}")

    def to_json(self) -> dict:
        return {
            "features": list(self.features),
            "coefficients": [float(c) for c in self.coefficients],
            "intercept": float(self.intercept),
            "binning": {k: v.to_json() for k, v in self.binning.specs.items()},
        }

    @staticmethod
    def from_json(value: Mapping) -> "ScorecardRules":
        specs = {k: BinSpec.from_json(v) for k, v in value["binning"].items()}
        return ScorecardRules(value["features"], value["coefficients"], value["intercept"], Binning(specs))


def score_with_rules(df: DataFrame, rules: ScorecardRules, output: str = "probability") -> DataFrame:
    """Bad probability from scorecard rules: a projection, after a lookup for features with a dictionary; runs on streams as well."""
    specs = [rules.binning.specs[f] for f in rules.features]
    marked = with_rare_marks(df, specs)
    linear = F.lit(float(rules.intercept))
    for spec, coefficient in zip(specs, rules.coefficients):
        linear = linear + F.lit(float(coefficient)) * woe_value(marked, spec)
    return without_marks(marked.withColumn(output, sigmoid(clip(linear, -700, 700))), specs)

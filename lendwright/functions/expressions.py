"""Column expressions shared by the operators; all of them stay inside codegen."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from lendwright.functions import fixed_values as fixed


def column(name: str | Column) -> Column:
    return name if isinstance(name, Column) else F.col(f"`{name}`")


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def as_double(value: str | Column, data_type: T.DataType | None = None) -> Column:
    """Double with NaN turned into NULL; text that is no number becomes NULL as well."""
    source = column(value)
    if isinstance(data_type, T.DoubleType):
        number = source
    elif data_type is not None and is_numeric(data_type):
        return source.cast("double") if not isinstance(data_type, T.FloatType) else F.nullif(
            source.cast("double"), F.lit(float("nan"))
        )
    elif isinstance(data_type, T.BooleanType):
        return source.cast("int").cast("double")
    elif isinstance(data_type, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return F.unix_micros(source.cast("timestamp")).cast("double")
    else:
        number = source.try_cast("double")
    return F.nullif(number, F.lit(float("nan")))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_sql(value: str) -> str:
    """SQL text of a string."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number_sql(name: str, data_type: T.DataType) -> str:
    """SQL text of ``as_double`` for a plain column: long CASE chains are parsed once, not built call by call."""
    source = quoted(name)
    if is_numeric(data_type) and not isinstance(data_type, (T.DoubleType, T.FloatType)):
        return f"CAST({source} AS DOUBLE)"
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return f"nullif(CAST({source} AS DOUBLE), double('NaN'))"
    if isinstance(data_type, T.BooleanType):
        return f"CAST(CAST({source} AS INT) AS DOUBLE)"
    return f"nullif(try_cast({source} AS DOUBLE), double('NaN'))"


def double_sql(value: float) -> str:
    """SQL text of a double, infinities included."""
    if math.isinf(value):
        return "double('Infinity')" if value > 0 else "double('-Infinity')"
    return f"{float(value)!r}D"


def right_closed_sql(value: str, edges: Sequence[float], missing: str = "NULL") -> str:
    """SQL text of the 0-based interval number for (-inf, e0], (e0, e1], …"""
    whens = " ".join(f"WHEN {value} <= {double_sql(e)} THEN {i}" for i, e in enumerate(edges))
    return f"CASE WHEN {value} IS NULL THEN {missing} {whens} ELSE {len(edges)} END"


def interval_sql(name: str, data_type: T.DataType, edges: Sequence[float], results: Sequence[str], missing: str) -> str:
    """SQL text of the result of a plain column's interval (-inf, e0], (e0, e1], …, or ``missing`` without a number.

    NaN is tested once and not before every edge, which keeps the generated code small enough to be compiled.
    """
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        value = quoted(name) if isinstance(data_type, T.DoubleType) else f"CAST({quoted(name)} AS DOUBLE)"
        none = f"{value} IS NULL OR isnan({value})"
    else:
        value = number_sql(name, data_type)
        none = f"{value} IS NULL"
    whens = " ".join(f"WHEN {value} <= {double_sql(e)} THEN {result}" for e, result in zip(edges, results))
    return f"CASE WHEN {none} THEN {missing} {whens} ELSE {results[len(edges)]} END"


def value_text(name: str, data_type: T.DataType) -> Column:
    """Text form of a value with NaN as NULL and one zero."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return (F.nullif(column(name), F.lit(float("nan"))) + F.lit(0.0)).cast("string")
    return column(name).cast("string")


def binary_label(value: str | Column) -> Column:
    text = F.lower(F.trim(column(value).cast("string")))
    return F.when(text.isin(*fixed.BAD_SPELLINGS), F.lit(1)).when(
        text.isin(*fixed.GOOD_SPELLINGS), F.lit(0)
    )


# Timestamp layouts accepted besides the ones a plain cast understands.
TIME_LAYOUTS = ("yyyy/M/d H:m:s", "yyyy/M/d", "yyyyMMdd", "M/d/yyyy", "d-MMM-yyyy")


def parse_time(value: str | Column, data_type: T.DataType | None = None) -> Column:
    source = column(value)
    if isinstance(data_type, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return source.cast("timestamp")
    text = F.trim(source.cast("string"))
    return F.coalesce(
        text.try_cast("timestamp"), *[F.try_to_timestamp(text, F.lit(f)) for f in TIME_LAYOUTS]
    )


def name_matches(pattern: str, name: str) -> bool:
    return re.search(pattern, name, re.IGNORECASE) is not None


def is_pii_name(name: str) -> bool:
    return name_matches(fixed.PII_NAME, name.strip())


def is_leakage_name(name: str) -> bool:
    return name_matches(fixed.LEAKAGE_NAME, name) and not name_matches(
        fixed.HISTORICAL_RISK_NAME, name
    )


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value < F.lit(float(low)), F.lit(float(low))).when(
        value > F.lit(float(high)), F.lit(float(high))
    ).otherwise(value)


def clip_probability(value: str | Column) -> Column:
    return clip(column(value).cast("double"), 1e-8, 1 - 1e-8)


def right_closed_index(value: Column, edges: Sequence[float]) -> Column:
    """0-based interval number for (-inf, e0], (e0, e1], …; NULL stays NULL."""
    result = F.when(value.isNull(), F.lit(None).cast("int"))
    for position, edge in enumerate(edges):
        result = result.when(value <= F.lit(float(edge)), F.lit(position))
    return result.otherwise(F.lit(len(edges)))


def left_closed_index(value: Column, edges: Sequence[float]) -> Column:
    """0-based interval number for (-inf, e0), [e0, e1), …; NULL stays NULL."""
    result = F.when(value.isNull(), F.lit(None).cast("int"))
    for position, edge in enumerate(edges):
        result = result.when(value < F.lit(float(edge)), F.lit(position))
    return result.otherwise(F.lit(len(edges)))


def lookup(key: Column, mapping: Mapping, default) -> Column:
    """Literal map lookup for a small mapping."""
    if not mapping:
        return F.lit(default)
    literals = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*literals), key), F.lit(default))


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


@dataclass(frozen=True)
class ScoreScale:
    """Points scale: ``base_score`` at ``base_odds`` good:bad, ``pdo`` points double the odds."""

    minimum: float = 300.0
    maximum: float = 900.0
    base_score: float = 600.0
    base_odds: float = 20.0
    pdo: float = 50.0

    def __post_init__(self) -> None:
        if not 0 <= self.minimum < self.maximum <= 5000:
            raise ValueError("SCORE_RANGE_INVALID")
        if self.base_odds <= 0 or self.pdo <= 0:
            raise ValueError("SCORE_SCALING_INVALID")

    def raw(self, probability: Column) -> Column:
        p = clip_probability(probability)
        odds = (F.lit(1.0) - p) / p
        return F.lit(self.base_score) + F.lit(self.pdo / math.log(2)) * F.log(
            odds / F.lit(self.base_odds)
        )

    def clipped(self, probability: Column) -> Column:
        return clip(self.raw(probability), self.minimum, self.maximum)


def score_column_name(model_name: str) -> str:
    words = [word for word in re.split(r"[\W_]+", model_name) if word]
    return f"{'_'.join(words) or 'risk_model'}_score"


def row_digest(columns: Sequence[str]) -> Column:
    """32-byte digest of whole rows; NULL and missing text stay distinguishable through JSON."""
    return F.unhex(F.sha2(F.to_json(F.struct(*[column(c) for c in columns])), 256))

"""Column profiles and data diagnosis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lendwright.functions import fixed_values as fixed
from lendwright.functions.expressions import (
    as_double,
    column,
    is_leakage_name,
    is_numeric,
    is_pii_name,
    name_matches,
    parse_time,
    row_digest,
    value_text,
)
from lendwright.operators.labels import target_issues, target_summary
from lendwright.operators.order_statistics import exact_quantiles, unpivot_values

TOP_VALUES = 10
LONG_TEXT = 64


def _value_key(name: str, data_type: T.DataType) -> Column:
    """What a distinct count has to tell apart: long text is represented by its digest."""
    text = value_text(name, data_type)
    if not isinstance(data_type, T.StringType):
        return text
    return F.when(F.length(text) > LONG_TEXT, F.concat(F.lit("\u0000"), F.sha2(text, 256))).otherwise(text)


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, *, approximate: bool = False) -> DataFrame:
    """One row per column: type, missing, distinct, name flags and whether it may be a label.

    The exact form is one aggregation on (column, value) with map-side combine followed by one on
    (column); ``approximate`` replaces the distinct counts by sketches and needs no value shuffle.
    """
    fields = [df.schema[c] for c in (columns or df.columns)]
    if approximate:
        stats = _approximate_stats(df, fields)
    else:
        stats = _exact_stats(df, fields)
    described = F.create_map(
        *[
            part
            for position, f in enumerate(fields)
            for part in (
                F.lit(f.name),
                F.struct(
                    F.lit(position).alias("position"),
                    F.lit(_kind(f.dataType)).alias("kind"),
                    F.lit(is_pii_name(f.name)).alias("pii"),
                    F.lit(name_matches(fixed.ID_NAME, f.name)).alias("id_candidate"),
                    F.lit(name_matches(fixed.TIME_NAME, f.name)).alias("time_name"),
                    F.lit(is_leakage_name(f.name)).alias("leakage"),
                    F.lit(name_matches(fixed.HISTORICAL_RISK_NAME, f.name)).alias("historical_risk"),
                ),
            )
        ]
    )
    known = F.col("rows") - F.col("missing_count")
    few = F.least(F.lit(100), F.greatest(F.lit(20), F.floor(known * F.lit(0.05))))
    kind, timed = F.col("about.kind"), F.col("time_values") >= F.lit(0.9) * known
    semantic = (
        F.when(known == 0, F.lit("empty"))
        .when(kind != "string", kind)
        .when(F.col("about.time_name") & timed, F.lit("datetime"))
        .when(F.col("unique_count") <= few, F.lit("categorical"))
        .otherwise(F.lit("text"))
    )
    return (
        stats.withColumn("about", F.element_at(described, F.col("name")))
        .withColumn("type", semantic)
        .select(
            F.col("about.position").alias("position"),
            "name",
            "type",
            "rows",
            "missing_count",
            F.try_divide("missing_count", "rows").alias("missing_rate"),
            "unique_count",
            F.col("about.pii").alias("pii"),
            F.col("about.id_candidate").alias("id_candidate"),
            ((F.col("type") == "datetime") | F.col("about.time_name")).alias("time_candidate"),
            F.col("about.leakage").alias("leakage"),
            F.col("about.historical_risk").alias("historical_risk"),
            "target_candidate",
        )
    )


def described_profile(profile: DataFrame, dictionary: DataFrame) -> DataFrame:
    """A column profile with description, role and missing codes of a parsed data dictionary; other columns have none."""
    entries = dictionary.select(F.col("field").alias("__field"), "description", "role", "missing_codes")
    found = profile.join(entries, F.col("name") == F.col("__field"), "left").drop("__field")
    return found.withColumns(
        {
            "description": F.coalesce("description", F.lit("")),
            "role": F.coalesce("role", F.lit("")),
            "missing_codes": F.coalesce("missing_codes", F.array().cast("array<string>")),
        }
    )


# --- mergeable state ------------------------------------------------------------------------

#: Size of the sketches of a state: 2^bits HyperLogLog registers (relative error about 1.04 / sqrt(2^bits)) and the KLL parameter
#: (rank error about 1.3 % at 200, shrinking in proportion).
DISTINCT_BITS = 14
QUANTILE_K = 400
STATE_VERSION = 1


def profile_state(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """What a column profile needs of some rows, one row per column, in a form that adds up over parts of a table.

    Counts and bounds are exact; distinct values are kept as a HyperLogLog sketch and numbers as a KLL sketch. A table that
    grows by versions is profiled by the states of its versions, without its old rows.
    """
    fields = [df.schema[c] for c in (columns or df.columns)]
    aggregates, rows = [F.count("*").alias("__rows")], []
    for i, f in enumerate(fields):
        numeric = is_numeric(f.dataType)
        number = as_double(f.name, f.dataType) if numeric else F.lit(None).cast("double")
        key = _value_key(f.name, f.dataType)
        aggregates += [
            F.count(key).alias(f"k{i}"),
            F.min(number).alias(f"a{i}"),
            F.max(number).alias(f"z{i}"),
            F.hll_sketch_agg(key, DISTINCT_BITS).alias(f"h{i}"),
        ]
        if numeric:
            aggregates.append(F.kll_sketch_agg_double(number, QUANTILE_K).alias(f"q{i}"))
        rows.append(
            F.struct(
                F.lit(f.name).alias("name"),
                F.lit(_kind(f.dataType)).alias("kind"),
                F.lit(STATE_VERSION).alias("state_version"),
                F.col("__rows").alias("rows"),
                F.col(f"k{i}").alias("known"),
                F.col(f"a{i}").alias("least"),
                F.col(f"z{i}").alias("most"),
                F.col(f"h{i}").alias("distinct_sketch"),
                (F.col(f"q{i}") if numeric else F.lit(None).cast("binary")).alias("number_sketch"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def merged_state(states: DataFrame) -> DataFrame:
    """One state per column from the states of several parts or versions; states of another layout are refused."""
    if not states.filter(F.col("state_version") != STATE_VERSION).isEmpty():
        raise ValueError("PROFILE_STATE_VERSION_UNSUPPORTED")
    return states.groupBy("name", "kind", "state_version").agg(
        F.sum("rows").alias("rows"),
        F.sum("known").alias("known"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("number_sketch").alias("number_sketch"),
    )


def state_facts(states: DataFrame, fractions: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Facts of merged states: rows, missing values, bounds, estimated distinct values and quantiles (numbers only)."""
    grid = F.array(*[F.lit(float(q)) for q in fractions])
    has = (F.col("kind") == "numeric") & (F.col("known") > 0)
    return states.select(
        "name",
        "rows",
        (F.col("rows") - F.col("known")).alias("missing_count"),
        "least",
        "most",
        F.hll_sketch_estimate("distinct_sketch").alias("unique_count"),
        F.when(has, F.kll_sketch_get_quantile_double("number_sketch", grid)).alias("quantiles"),
    )


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if is_numeric(data_type):
        return "numeric"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "string"


def _exact_stats(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    counted = value_counts(df, [f.name for f in fields])
    text = F.lower(F.trim("value"))
    dated = [f.name for f in fields if _kind(f.dataType) == "string" and name_matches(fixed.TIME_NAME, f.name)]
    is_time = F.col("name").isin(*dated) & parse_time("value").isNotNull() if dated else F.lit(False)
    present = F.col("value").isNotNull()
    return (
        counted.groupBy("name")
        .agg(
            F.sum("count").alias("rows"),
            F.sum(F.when(~present, F.col("count")).otherwise(0)).alias("missing_count"),
            F.count("value").alias("unique_count"),
            F.sum(F.when(is_time, F.col("count")).otherwise(0)).alias("time_values"),
            F.bool_and(~present | text.isin(*fixed.TARGET_SPELLINGS)).alias("allowed"),
            F.coalesce(F.bool_or(text == "0"), F.lit(False)).alias("zero"),
            F.coalesce(F.bool_or(text == "1"), F.lit(False)).alias("one"),
            F.coalesce(F.bool_or(text == "0.0"), F.lit(False)).alias("zero_point"),
            F.coalesce(F.bool_or(text == "1.0"), F.lit(False)).alias("one_point"),
        )
        .withColumn(
            "target_candidate",
            F.col("allowed") & ((F.col("zero") & F.col("one")) | (F.col("zero_point") & F.col("one_point"))),
        )
    )


def _approximate_stats(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    aggregates = [F.count("*").alias("rows")]
    for i, f in enumerate(fields):
        text = F.lower(F.trim(value_text(f.name, f.dataType)))
        aggregates += [
            F.count(value_text(f.name, f.dataType)).alias(f"n{i}"),
            F.approx_count_distinct(value_text(f.name, f.dataType)).alias(f"d{i}"),
            F.bool_and(text.isNull() | text.isin(*fixed.TARGET_SPELLINGS)).alias(f"a{i}"),
            F.bool_or(text.isin("0")).alias(f"z{i}"),
            F.bool_or(text.isin("1")).alias(f"o{i}"),
            F.bool_or(text.isin("0.0")).alias(f"zp{i}"),
            F.bool_or(text.isin("1.0")).alias(f"op{i}"),
            (
                F.count_if(parse_time(f.name).isNotNull())
                if _kind(f.dataType) == "string" and name_matches(fixed.TIME_NAME, f.name)
                else F.sum(F.lit(0))
            ).alias(f"t{i}"),
        ]
    one = df.agg(*aggregates)
    structs = [
        F.struct(
            F.lit(f.name).alias("name"),
            (F.col("rows") - F.col(f"n{i}")).alias("missing_count"),
            F.col(f"d{i}").alias("unique_count"),
            F.col(f"t{i}").alias("time_values"),
            (
                F.coalesce(F.col(f"a{i}"), F.lit(True))
                & F.coalesce((F.col(f"z{i}") & F.col(f"o{i}")) | (F.col(f"zp{i}") & F.col(f"op{i}")), F.lit(False))
            ).alias("target_candidate"),
        )
        for i, f in enumerate(fields)
    ]
    return one.select("rows", F.inline(F.array(*structs)))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(name, value, count)`` over all columns at once; NULL is a value; long text is a digest."""
    entries = [(c, [_value_key(c, df.schema[c].dataType)]) for c in columns]
    return (
        df.select(unpivot_values(entries, ["value"]))
        .groupBy(F.col("feature").alias("name"), "value")
        .agg(F.count("*").alias("count"))
    )


def schema_preview(df: DataFrame) -> DataFrame:
    """Names and types only, never values."""
    return column_profile(df).select("position", "name", "type")


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """min, p25, median, p75, max and mean of the numeric columns; non-finite results become NULL."""
    names = [c for c in (columns or df.columns) if is_numeric(df.schema[c].dataType)]
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])
    numbers = df.select(*[as_double(c, df.schema[c].dataType).alias(f"v{i}") for i, c in enumerate(names)])
    one = numbers.agg(
        *[
            f(f"v{i}").alias(f"{label}{i}")
            for i in range(len(names))
            for label, f in (("lo", F.min), ("hi", F.max), ("avg", F.avg))
        ]
    )

    def finite(value: Column) -> Column:
        return F.when(F.abs(value) < F.lit(float("inf")), value)

    return one.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("name"),
                        finite(F.col(f"lo{i}")).alias("min"),
                        *[
                            finite(F.lit(quartiles[c][k] if quartiles[c] else None).cast("double")).alias(label)
                            for k, label in enumerate(("p25", "median", "p75"))
                        ],
                        finite(F.col(f"hi{i}")).alias("max"),
                        finite(F.col(f"avg{i}")).alias("mean"),
                    )
                    for i, c in enumerate(names)
                ]
            )
        )
    )


def top_values(df: DataFrame, columns: Sequence[str] | None = None, limit: int = TOP_VALUES) -> DataFrame:
    """Most frequent values of the non-numeric columns, ties in value order, NULL as ``<MISSING>``.

    Long text is counted by digest; the few winners get their text back in a second scan. Ties
    between long texts follow the digest.
    """
    names = [c for c in (columns or df.columns) if not is_numeric(df.schema[c].dataType)]
    counted = value_counts(df, names).withColumn("value", F.coalesce("value", F.lit(fixed.MISSING)))
    merged = counted.groupBy("name", "value").agg(F.sum("count").alias("count"))
    order = Window.partitionBy("name").orderBy(F.col("count").desc(), "value")
    top = merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    text = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
    if not text:
        return top.select("name", "rank", "value", "count")
    digests = top.filter(F.col("value").startswith("\u0000")).select(
        F.col("name").alias("feature"), F.col("value").alias("key")
    )
    # At most ``limit`` digests per column.
    long = df.select(
        unpivot_values(
            [
                (c, [F.when(F.length(column(c)) > LONG_TEXT, _value_key(c, T.StringType())), column(c)])
                for c in text
            ],
            ["key", "text"],
        )
    ).filter(F.col("key").isNotNull())
    texts = (
        long.join(F.broadcast(digests), ["feature", "key"])
        .groupBy(F.col("feature").alias("name"), F.col("key").alias("value"))
        .agg(F.first("text").alias("text"))
    )
    return top.join(texts, ["name", "value"], "left").select(
        "name", "rank", F.coalesce("text", "value").alias("value"), "count"
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of every group of identical rows; only digests are shuffled."""
    return (
        df.groupBy(row_digest(df.columns).alias("digest"))
        .agg(F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        )
    )


def target_candidates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns whose values are only spellings of 0, 1 and -1 and contain both 0 and 1, with counts."""
    names = list(columns or df.columns)
    profile = column_profile(df, names).filter("target_candidate").select("name", "missing_count")
    counts = value_counts(df, names).filter(F.col("value").isNotNull())
    return counts.join(profile, "name").select(
        F.col("name").alias("column"), F.lower(F.trim("value")).alias("value"), "count", "missing_count"
    )


def default_time_column(profile: DataFrame) -> DataFrame:
    """First time-like column that is not personal data."""
    return profile.filter(F.col("time_candidate") & ~F.col("pii")).agg(
        F.min_by("name", "position").alias("time_column")
    )


def default_customer_key(profile: DataFrame) -> DataFrame:
    """Identifier that most looks like a person: person words +2, order words -2, then repeats."""
    lowered = F.lower("name")

    def mentions(tokens: Sequence[str]) -> Column:
        hit = F.lit(False)
        for token in tokens:
            hit = hit | lowered.contains(token)
        return hit.cast("int")

    score = mentions(fixed.PERSON_TOKENS) * 2 - mentions(fixed.ORDER_TOKENS) * 2
    repeats = (F.col("unique_count") < F.greatest("rows", F.lit(1))).cast("int")
    return profile.filter(F.col("id_candidate") & ~F.col("pii")).agg(
        F.max_by("name", F.struct(score, repeats, -F.col("position"))).alias("customer_key")
    )


def diagnose(df: DataFrame, target: str, time_column: str | None = None) -> DataFrame:
    """``(code, severity, column, value)`` issue rows."""

    def issue(frame: DataFrame, code: str, severity: str, name: Column, value: Column) -> DataFrame:
        return frame.select(
            F.lit(code).alias("code"),
            F.lit(severity).alias("severity"),
            name.cast("string").alias("column"),
            value.cast("double").alias("value"),
        )

    parts = [target_issues(target_summary(df, target))]
    parts.append(
        issue(
            duplicate_rows(df).filter("duplicate_rows > 0"),
            "DUPLICATE_ROWS", "warning", F.lit(None), F.col("duplicate_rows"),
        )
    )
    if time_column and time_column not in df.columns:
        parts.append(
            issue(df.sparkSession.range(1), "TIME_COLUMN_NOT_FOUND", "blocking", F.lit(time_column), F.lit(None))
        )
    elif time_column:
        parsed = parse_time(time_column, df.schema[time_column].dataType)
        rate = df.agg(F.avg(parsed.isNotNull().cast("int")).alias("rate"))
        parts.append(
            issue(rate.filter("rate < 0.8"), "TIME_PARSE_LOW", "blocking", F.lit(time_column), F.col("rate"))
        )
    parts.append(
        issue(
            missing_rates(df).filter("missing_rate >= 0.95"),
            "ALMOST_EMPTY_COLUMN", "warning", F.col("name"), F.col("missing_rate"),
        )
    )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def missing_rates(df: DataFrame) -> DataFrame:
    """Missing rate of every column from one aggregation without a value shuffle."""
    one = df.agg(
        F.count("*").alias("rows"),
        *[F.count(value_text(f.name, f.dataType)).alias(f"n{i}") for i, f in enumerate(df.schema.fields)],
    )
    return one.select(
        "rows",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(f.name).alias("name"), F.col(f"n{i}").alias("present"))
                    for i, f in enumerate(df.schema.fields)
                ]
            )
        ),
    ).select("name", F.try_divide(F.col("rows") - F.col("present"), "rows").alias("missing_rate"))


"""Feature screening on the training rows: information value, reasons, correlation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lendwright.functions import fixed_values as fixed
from lendwright.functions.expressions import (
    as_double,
    column,
    interval_sql,
    is_leakage_name,
    is_numeric,
    is_pii_name,
    name_matches,
    value_text,
)
from lendwright.operators.order_statistics import (
    exact_quantiles,
    join_unique,
    quantile_grid,
    run_splits,
    running_totals,
    unpivot_values,
)

RARE_SHARE = 0.005
from lendwright.session import materialize


@dataclass(frozen=True)
class ScreeningThresholds:
    iv: float = 0.02
    missing_rate: float = 0.30
    correlation: float = 0.70
    max_bins: int = 10
    edge_digits: int | None = None


def distinct_up_to(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, int | None]:
    """Exact distinct counts of the columns with at most ``limit`` values, None for the others.

    A sketch answers for columns far above the limit; only columns with few values are counted
    exactly, so the distinct set stays small.
    """
    if not columns:
        return {}
    rough = df.agg(*[F.approx_count_distinct(column(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    result: dict[str, int | None] = {c: None for i, c in enumerate(columns) if rough[f"d{i}"] > 4 * limit + 20}
    close = [c for c in columns if c not in result]
    if close:
        seen = (
            df.select(unpivot_values([(c, [value_text(c, df.schema[c].dataType)]) for c in close], ["value"]))
            .filter(F.col("value").isNotNull())
            .distinct()
            .groupBy("feature")
            .count()
            .collect()
        )
        exact = {r["feature"]: r["count"] for r in seen}
        for c in close:
            n = exact.get(c, 0)
            result[c] = n if n <= limit else None
    return result


def distinct_edges(values: Sequence[float], digits: int | None = None) -> list[float]:
    return sorted({round(v, digits) if digits is not None else v for v in values})


def inner_edges(values: Sequence[float], digits: int | None = None) -> list[float]:
    """Quantiles without the outermost two; infinite ones bound no interval."""
    return [e for e in distinct_edges(values, digits)[1:-1] if math.isfinite(e)]


def iv_edges(
    df: DataFrame, features: Sequence[str], max_bins: int = 10, edge_digits: int | None = None
) -> dict[str, list[float]]:
    """Inner quantile edges of the numeric features with more than ``max_bins`` distinct values."""
    numeric = [f for f in features if is_numeric(df.schema[f].dataType)]
    few = distinct_up_to(df, numeric, max_bins)
    chosen = [f for f in numeric if few[f] is None]
    quantiles = exact_quantiles(df, chosen, quantile_grid(max_bins)) if chosen else {}
    return {f: inner_edges(quantiles[f], edge_digits) for f in chosen}


def _value_bin(df: DataFrame, feature: str, edges: Mapping[str, Sequence[float]]) -> list[Column]:
    """(interval number, value): numbers for binned features, the value itself for the others."""
    if feature in edges:
        places = [str(i) for i in range(len(edges[feature]) + 1)]
        place = interval_sql(feature, df.schema[feature].dataType, edges[feature], places, "NULL")
        return [F.expr(f"CAST({place} AS INT)"), F.lit(None).cast("string")]
    return [F.lit(None).cast("int"), value_text(feature, df.schema[feature].dataType)]


def woe_columns(
    frame: DataFrame, keys: Sequence[str] = ("feature",), count: str = "count", bad: str = "bad"
) -> DataFrame:
    """Adds good, bad_rate, woe, iv with +0.5 smoothing; one row per bin comes in and goes out."""
    whole = Window.partitionBy(*keys)
    good = F.col(count) - F.col(bad)
    bins = F.count("*").over(whole)
    total_bad = F.greatest(F.sum(bad).over(whole), F.lit(1))
    total_good = F.greatest(F.sum(good).over(whole), F.lit(1))
    bad_share = (F.col(bad) + F.lit(0.5)) / (total_bad + F.lit(0.5) * bins)
    good_share = (good + F.lit(0.5)) / (total_good + F.lit(0.5) * bins)
    return (
        frame.withColumns({"__g": good_share, "__b": bad_share})
        .withColumns(
            {
                "good": good,
                "bad_rate": F.col(bad) / F.col(count),
                "woe": F.log(F.col("__g") / F.col("__b")),
            }
        )
        .withColumn("iv", (F.col("__g") - F.col("__b")) * F.col("woe"))
        .drop("__g", "__b")
    )


def iv_bins(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    *,
    max_bins: int = 10,
    edges: Mapping[str, Sequence[float]] | None = None,
    edge_digits: int | None = None,
) -> DataFrame:
    """Bin counts, WOE and IV of every feature from one aggregation over the unpivoted bins."""
    valid = df.filter(F.col(label).isin(0, 1))
    if edges is None:
        edges = iv_edges(valid, features, max_bins, edge_digits)
    long = valid.select(
        F.col(label).alias("y"),
        unpivot_values([(f, _value_bin(valid, f, edges)) for f in features], ["place", "value"]),
    )
    counted = long.groupBy("feature", "place", "value").agg(
        F.count("*").alias("count"), F.sum("y").cast("long").alias("bad")
    )
    # Every feature has one bin per row, so the share that makes a value rare is one number for all.
    floor = max(20, math.floor(valid.count() * RARE_SHARE))
    rare = F.col("value").isNotNull() & (F.col("count") < floor)
    name = F.coalesce(
        F.when(rare, F.lit(fixed.RARE)),
        F.col("value"),
        F.concat(F.lit("q"), F.lpad(F.col("place").cast("string"), 2, "0")),
        F.lit(fixed.MISSING),
    )
    folded = counted.groupBy("feature", name.alias("bin")).agg(
        F.sum("count").alias("count"), F.sum("bad").alias("bad")
    )
    return woe_columns(folded).select("feature", "bin", "count", "good", "bad", "bad_rate", "woe", "iv")


def iv_bins_by_target(
    df: DataFrame, labels: Sequence[str], features: Sequence[str], *, max_bins: int = 10, edge_digits: int | None = None
) -> DataFrame:
    """``iv_bins`` of every label over its own 0/1 rows, as (target, feature, bin, …), from one counting job for all labels."""
    valid = {t: F.col(f"`{t}`").isin(0, 1) for t in labels}
    own = {(t, f): f"__{i}_{j}" for i, t in enumerate(labels) for j, f in enumerate(features)}
    wide = df.select(
        *[F.when(valid[t], F.col(f"`{t}`")).alias(f"__y{i}") for i, t in enumerate(labels)],
        *[F.when(valid[t], F.col(f"`{f}`")).alias(name) for (t, f), name in own.items()],
    )
    edges = iv_edges(wide, list(own.values()), max_bins, edge_digits)
    entries = [
        (f, [F.lit(t), F.col(f"__y{labels.index(t)}"), *_value_bin(wide, name, edges)]) for (t, f), name in own.items()
    ]
    long = wide.select(unpivot_values(entries, ["target", "y", "place", "value"])).filter(F.col("y").isNotNull())
    # Written once: the sizes that make a value rare come from the same counts.
    counted = materialize(
        long.groupBy("target", "feature", "place", "value").agg(F.count("*").alias("count"), F.sum("y").cast("long").alias("bad")),
        "target-bins",
    )
    sizes = counted.groupBy("target", "feature").agg(F.sum("count").alias("n"))
    floor = F.greatest(F.lit(20), F.floor(F.col("n") * F.lit(RARE_SHARE)))
    name = F.coalesce(
        F.when(F.col("value").isNotNull() & (F.col("count") < floor), F.lit(fixed.RARE)),
        F.col("value"),
        F.concat(F.lit("q"), F.lpad(F.col("place").cast("string"), 2, "0")),
        F.lit(fixed.MISSING),
    )
    folded = counted.join(sizes, ["target", "feature"]).groupBy("target", "feature", name.alias("bin")).agg(
        F.sum("count").alias("count"), F.sum("bad").alias("bad")
    )
    columns = ("target", "feature", "bin", "count", "good", "bad", "bad_rate", "woe", "iv")
    return woe_columns(folded, ["target", "feature"]).select(*columns)


def iv_ranking(bins: DataFrame) -> DataFrame:
    return bins.groupBy("feature").agg(
        F.greatest(F.sum("iv"), F.lit(0.0)).alias("iv"), F.count("*").alias("bins")
    )


def screening_profile(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """Missing rate, constancy and type of every column, as a driver-side row per column."""
    from lendwright.operators.profile import column_profile

    return {r["name"]: r.asDict() for r in column_profile(df, columns).collect()}


def base_reason(
    name: str, facts: Mapping, target: str, protected: Sequence[str], missing_threshold: float
) -> str | None:
    """First exclusion rule that applies to a column, before its information value is known."""
    rules = (
        ("OTHER_TARGET", name in protected and name != target),
        ("LEAKAGE", name != target and is_leakage_name(name)),
        ("TARGET", name == target),
        ("PII", is_pii_name(name)),
        ("IDENTIFIER", name_matches(fixed.ID_NAME, name)),
        ("CONSTANT", facts["unique_count"] <= 1),
        ("MISSING_RATE", facts["missing_rate"] > missing_threshold),
        ("UNSUPPORTED_TYPE", facts["type"] in ("datetime", "empty", "text")),
    )
    return next((code for code, hit in rules if hit), None)


def screen_features(
    train: DataFrame,
    target: str,
    candidates: Sequence[str] | None = None,
    protected_targets: Sequence[str] = (),
    thresholds: ScreeningThresholds = ScreeningThresholds(),
    row_id: str | None = None,
) -> DataFrame:
    """One row per candidate: type, missing rate, IV, status, reason, recoverable.

    The name and type rules look at one small row per column; IV and correlations are computed for
    all columns together on the cluster.
    """
    spark = train.sparkSession
    names = [c for c in (candidates or [c for c in train.columns if c != target]) if c in train.columns]
    facts = screening_profile(train, names)
    reasons = {
        n: base_reason(n, facts[n], target, protected_targets, thresholds.missing_rate) for n in names
    }
    measured = [n for n in names if reasons[n] is None or reasons[n] in fixed.RECOVERABLE_REASONS]
    iv: dict[str, float] = {}
    if measured:
        bins = iv_bins(train, target, measured, max_bins=thresholds.max_bins, edge_digits=thresholds.edge_digits)
        iv = {r["feature"]: r["iv"] for r in iv_ranking(bins).collect()}
    for n in measured:
        if reasons[n] is None and iv.get(n, 0.0) < thresholds.iv:
            reasons[n] = "LOW_IV"
    numeric = [n for n in names if reasons[n] is None and is_numeric(train.schema[n].dataType)]
    if len(numeric) > 1:
        for pair in correlation_pairs(train, numeric, iv, thresholds.correlation, row_id):
            reasons[pair["excluded"]] = "HIGH_CORRELATION"
    rows = [
        (
            n,
            facts[n]["type"],
            float(facts[n]["missing_rate"]),
            iv.get(n),
            "included" if reasons[n] is None else "excluded",
            reasons[n],
            reasons[n] in fixed.RECOVERABLE_REASONS,
            False,
            None,
        )
        for n in names
    ]
    return spark.createDataFrame(
        rows,
        "`column` string, type string, missing_rate double, iv double, status string, reason string, "
        "recoverable boolean, restored boolean, restore_reason string",
    )


def restore_features(screening: DataFrame, requests: Mapping[str, str]) -> DataFrame:
    """Bring recoverable features back; every request needs a reason of at least eight characters."""
    cleaned = {name: reason.strip() for name, reason in requests.items()}
    asked = screening.filter(F.col("column").isin(*cleaned)).collect()
    for row in asked:
        if not row["recoverable"]:
            raise ValueError(f"FEATURE_NOT_RECOVERABLE: {row['column']}")
        if len(cleaned[row["column"]]) < 8:
            raise ValueError(f"RESTORE_REASON_REQUIRED: {row['column']}")
    hit = F.col("column").isin(*[r["column"] for r in asked]) if asked else F.lit(False)
    why = F.lit(None).cast("string")
    for row in asked:
        why = F.when(F.col("column") == row["column"], F.lit(cleaned[row["column"]])).otherwise(why)
    return screening.withColumns(
        {
            "status": F.when(hit, F.lit("included")).otherwise(F.col("status")),
            "restored": F.col("restored") | hit,
            "restore_reason": why,
        }
    )


def average_ranks(long: DataFrame, keys: Sequence[str], value: str, splits: Sequence[float]) -> DataFrame:
    """Tie-averaged rank of every distinct value per key."""
    counted = long.groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranked = running_totals(counted, keys, value, ["n"], splits=splits)
    return ranked.select(
        *keys, value, (F.col("upto_n") - (F.col("n") - F.lit(1)) / F.lit(2.0)).alias("rank")
    )


def spearman_matrix(df: DataFrame, columns: Sequence[str], row_id: str | None = None) -> DataFrame:
    """Spearman correlation of every column pair over the rows where both values are present.

    Ranks come from distinct-value counts and running totals; they are joined back by value (values
    that hold a large share of the rows take the broadcast side) and regrouped by row. Columns
    without NULL share one ranking; a pair with NULLs is ranked over its own complete rows.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    if row_id is None:
        raise ValueError("ROW_ID_REQUIRED")
    rows = df.select(
        F.col(f"`{row_id}`").alias("rid"), *[as_double(c, types[c]).alias(f"v{i}") for i, c in enumerate(columns)]
    )
    missing = rows.agg(
        *[F.count_if(F.col(f"v{i}").isNull()).alias(f"m{i}") for i in range(len(columns))]
    ).first()
    full = [i for i in range(len(columns)) if missing[f"m{i}"] == 0]
    pairs = list(combinations(range(len(columns)), 2))
    shared = [(i, j) for i, j in pairs if i in full and j in full]
    own = [(i, j) for i, j in pairs if (i, j) not in set(shared)]
    # One ranking per "series": a full column once, a column of an incomplete pair once per pair.
    entries = [(f"c{i}", [F.col(f"v{i}")]) for i in full]
    for i, j in own:
        both = F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull()
        entries.append((f"p{i}_{j}a", [F.when(both, F.col(f"v{i}"))]))
        entries.append((f"p{i}_{j}b", [F.when(both, F.col(f"v{j}"))]))
    long = rows.select("rid", unpivot_values(entries, ["value"])).filter(F.col("value").isNotNull())
    ranks = average_ranks(long, ["feature"], "value", run_splits(long, "value"))
    ranked = join_unique(long, ranks, ["feature", "value"], how="inner")
    series = [label for label, _ in entries]
    wide = ranked.groupBy("rid").agg(
        *[F.max(F.when(F.col("feature") == label, F.col("rank"))).alias(label) for label in series]
    )
    sides = {**{p: (f"c{p[0]}", f"c{p[1]}") for p in shared}, **{p: (f"p{p[0]}_{p[1]}a", f"p{p[0]}_{p[1]}b") for p in own}}
    moments = wide.agg(*[F.corr(a, b).alias(f"r{i}_{j}") for (i, j), (a, b) in sides.items()])
    return moments.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(columns[i]).alias("left"),
                        F.lit(columns[j]).alias("right"),
                        F.nullif(F.col(f"r{i}_{j}"), F.lit(float("nan"))).alias("spearman"),
                    )
                    for i, j in pairs
                ]
            )
        )
    )


def prune_correlated(matrix: DataFrame, iv: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Pairs above the threshold with the side to drop: the lower IV, the right one on a tie."""
    left = iv.select(F.col("feature").alias("left"), F.col("iv").alias("left_iv"))
    right = iv.select(F.col("feature").alias("right"), F.col("iv").alias("right_iv"))
    strength = F.abs("spearman")
    return (
        matrix.filter(strength > threshold)
        .join(left, "left", "left")
        .join(right, "right", "left")
        .select(
            "left",
            "right",
            strength.alias("correlation"),
            F.when(
                F.coalesce("left_iv", F.lit(0.0)) >= F.coalesce("right_iv", F.lit(0.0)), F.col("right")
            )
            .otherwise(F.col("left"))
            .alias("excluded"),
        )
    )


def correlation_pairs(
    df: DataFrame, columns: Sequence[str], iv: Mapping[str, float], threshold: float, row_id: str | None
) -> list:
    values = df.sparkSession.createDataFrame(
        [(c, float(iv.get(c, 0.0))) for c in columns], "feature string, iv double"
    )
    return prune_correlated(spearman_matrix(df, columns, row_id), values, threshold).collect()

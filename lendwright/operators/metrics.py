"""Model quality: ranking metrics, lift, calibration, stability. All keyed, all without a global sort."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lendwright.functions.expressions import (
    clip_probability,
    column,
    left_closed_index,
    right_closed_index,
)
from lendwright.operators.order_statistics import (
    exact_quantiles,
    hash_order,
    quantile_grid,
    run_splits,
    running_totals,
    unpivot_values,
)
from lendwright.session import materialize

TOLERANCE = 1e-12


def score_points(
    df: DataFrame, label: str, probability: str, keys: Sequence[str] = (), splits: Sequence[float] | None = None
) -> DataFrame:
    """One row per distinct score, highest first, with running and total counts of rows and bads."""
    scores = df.select(
        *keys, column(label).cast("int").alias("__y"), clip_probability(probability).alias("__p")
    )
    if splits is None:
        splits = run_splits(scores, "__p")
    points = scores.groupBy(*keys, "__p").agg(
        F.count("*").alias("n"), F.sum("__y").cast("long").alias("bad")
    )
    return running_totals(points, keys, "__p", ["n", "bad"], descending=True, splits=splits)


def binary_metrics(
    df: DataFrame,
    label: str,
    probability: str,
    keys: Sequence[str] = (),
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """AUC, KS with threshold, average precision, Brier and log loss, one row per key.

    Everything comes from the distinct-score table in one aggregation; NULL for a single class.
    """
    points = score_points(df, label, probability, keys, splits)
    bad, n, p = F.col("bad"), F.col("n"), F.col("__p")
    good = n - bad
    all_good = F.col("all_n") - F.col("all_bad")
    above = F.col("upto_bad") - bad
    pairs = good.cast("double") * (above + bad / F.lit(2.0))
    gap = F.col("upto_bad") / F.col("all_bad") - (F.col("upto_n") - F.col("upto_bad")) / all_good
    gap = F.when((F.col("all_bad") > 0) & (all_good > 0), gap)
    step = bad / F.col("all_bad") * (F.col("upto_bad") / F.col("upto_n"))
    step = F.when(F.col("all_bad") > 0, step)
    q = F.lit(1.0) - p
    table = points.select(
        *keys,
        n.alias("n"),
        bad.alias("bad"),
        pairs.alias("pairs"),
        gap.alias("gap"),
        p.alias("p"),
        step.alias("step"),
        (bad * q * q + good * p * p).alias("square"),
        (-(bad * F.log(p) + good * F.log(q))).alias("loss"),
    )
    rows, positives = F.sum("n"), F.sum("bad")
    negatives = rows - positives
    both = (positives > 0) & (negatives > 0)
    top = F.max("gap")
    aggregates = [
        rows.alias("rows"),
        F.coalesce(positives, F.lit(0)).alias("positive_count"),
        F.coalesce(negatives, F.lit(0)).alias("negative_count"),
        F.try_divide(positives, rows).alias("bad_rate"),
        F.when(both, F.sum("pairs") / (positives.cast("double") * negatives)).alias("roc_auc"),
        F.when(both, F.greatest(top, F.lit(0.0))).alias("ks"),
        F.when(both & (top > 0), F.max_by("p", F.struct("gap", "p"))).alias("ks_threshold"),
        F.when(both, F.sum("step")).alias("pr_auc"),
        F.when(both, F.sum("square") / rows).alias("brier"),
        F.when(both, F.sum("loss") / rows).alias("log_loss"),
    ]
    return table.groupBy(*keys).agg(*aggregates) if keys else table.agg(*aggregates)


def lift_bucket(rank: Column, n: Column, bins: int) -> Column:
    """Equal-frequency bucket of a 0-based rank among n rows."""
    count = F.least(F.lit(bins), n)
    return F.when(n <= 1, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.floor((rank * count + n - 2) / (n - 1)))
    ).cast("int")


def lift_table(
    df: DataFrame,
    label: str,
    probability: str,
    row_id: str,
    keys: Sequence[str] = (),
    bins: int = 10,
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """Equal-frequency buckets by descending score; equal scores follow md5(row_id).

    Whole groups of equal scores are placed from the distinct-score table. Only the scores that a
    bucket boundary cuts through (at most ``bins - 1`` per key) are looked at in more detail: first
    by digest prefix, and below the prefix that is cut row by row.
    """
    keys = list(keys)
    rows = df.select(
        *keys,
        column(label).cast("int").alias("__y"),
        column(probability).cast("double").alias("__p"),
        hash_order(column(row_id)).alias("__d"),
        column(row_id).cast("string").alias("__id"),
    )
    # Written once: every pass below reads these columns instead of the caller's plan.
    rows = materialize(rows, "lift-rows")
    if splits is None:
        splits = run_splits(rows, "__p")
    prefix = F.substring("__d", 1, 4)
    points = running_totals(
        rows.groupBy(*keys, "__p").agg(F.count("*").alias("n"), F.sum("__y").cast("long").alias("bad")),
        keys, "__p", ["n"], descending=True, splits=splits,
    ).withColumn("first", F.col("upto_n") - F.col("n"))
    whole, cut = _place(materialize(points, "lift-points"), bins)
    # At most bins - 1 scores per key are cut, so this side stays tiny; keys are report dimensions.
    tied = _matching(rows.withColumn("__x", prefix), cut, [*keys, "__p"])
    run = Window.partitionBy(*keys, "__p").orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        tied.groupBy(*keys, "__p", "__x", "all_n", "first")
        .agg(F.count("*").alias("n"), F.sum("__y").cast("long").alias("bad"))
        .withColumn("first", F.col("first") + F.coalesce(F.sum("n").over(run), F.lit(0)))
    )
    inner, split = _place(pieces, bins)
    close = _matching(rows.withColumn("__x", prefix), split, [*keys, "__p", "__x"])
    order = Window.partitionBy(*keys, "__p", "__x").orderBy("__d", "__id")
    single = close.withColumn("first", F.col("first") + F.row_number().over(order) - 1).select(
        *keys, "__p", lift_bucket(F.col("first"), F.col("all_n"), bins).alias("bucket"),
        F.lit(1).cast("long").alias("n"), F.col("__y").cast("long").alias("bad"),
    )
    placed = whole.unionByName(inner).unionByName(single)
    table = placed.groupBy(*keys, "bucket").agg(
        F.sum("n").alias("count"),
        F.sum("bad").alias("bad"),
        F.min("__p").alias("min_probability"),
        F.max("__p").alias("max_probability"),
    )
    # At most ``bins`` rows per key from here on.
    all_rows = Window.partitionBy(*keys)
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    overall = F.sum("bad").over(all_rows) / F.sum("count").over(all_rows)
    rate = F.col("bad") / F.col("count")
    return table.select(
        *keys,
        "bucket",
        "count",
        "bad",
        rate.alias("bad_rate"),
        F.try_divide(rate, overall).alias("lift"),
        (F.sum("bad").over(upto) / F.greatest(F.sum("bad").over(all_rows), F.lit(1))).alias("cumulative_capture"),
        "min_probability",
        "max_probability",
    )


def _place(pieces: DataFrame, bins: int) -> tuple[DataFrame, DataFrame]:
    """Pieces that fall into one bucket, and pieces a boundary cuts."""
    keep = [c for c in pieces.columns if c not in ("n", "bad", "first", "upto_n", "all_n")]
    low = lift_bucket(F.col("first"), F.col("all_n"), bins)
    high = lift_bucket(F.col("first") + F.col("n") - 1, F.col("all_n"), bins)
    marked = pieces.withColumns({"bucket": low, "__high": high})
    whole = marked.filter("bucket = __high").select(*[c for c in keep if c != "__x"], "bucket", "n", "bad")
    return whole, marked.filter("bucket < __high").select(*keep, "all_n", "first")


def _matching(rows: DataFrame, cut: DataFrame, on: Sequence[str]) -> DataFrame:
    renamed = cut.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(on)], "all_n", "first")
    same = F.lit(True)
    for i, c in enumerate(on):
        equal = F.col(c).eqNullSafe(F.col(f"__c{i}"))
        same = equal if i == 0 else same & equal
    return rows.join(renamed, same).drop(*[f"__c{i}" for i in range(len(on))])


def calibration_table(
    df: DataFrame, label: str, probability: str, keys: Sequence[str] = (), bins: int = 10
) -> DataFrame:
    """Observed and predicted rate in fixed-width score buckets; empty buckets do not appear."""
    p = column(probability).cast("double")
    inner = quantile_grid(bins)[1:-1]
    return (
        df.filter((p >= 0) & (p <= 1))
        .groupBy(*keys, (right_closed_index(p, inner) + 1).alias("bucket"))
        .agg(
            F.count("*").alias("count"),
            F.avg(column(label).cast("double")).alias("actual_rate"),
            F.avg(p).alias("predicted_rate"),
        )
    )


def psi_edges(deciles: Sequence[float]) -> list[float]:
    """Inner edges of the stability bins; one or two distinct deciles need edges of their own."""
    edges = sorted(set(deciles))
    if len(edges) == 1:
        return [edges[0], math.nextafter(edges[0], math.inf)]
    if len(edges) == 2:
        return [edges[0] / 2 + edges[1] / 2]
    return edges[1:-1]


def psi(
    df: DataFrame, value: str, group: str, pairs: Sequence[tuple[str, str]], bins: int = 10
) -> DataFrame:
    """Population stability index for (reference, current) pairs of group values.

    NULL when a side is empty or holds a value that is not finite.
    """
    number = column(value).cast("double")
    finite = F.coalesce(F.abs(number) < F.lit(math.inf), F.lit(False))
    references = sorted({reference for reference, _ in pairs})
    names = sorted({name for pair in pairs for name in pair})
    sides = df.filter(column(group).isin(*names)).select(column(group).alias("g"), number.alias("v"), finite.alias("ok"))
    # Deciles of all references in one search, counts of all pairs in one aggregation.
    apart = sides.select(*[F.when((F.col("g") == name) & F.col("ok"), F.col("v")).alias(f"r{i}") for i, name in enumerate(references)])
    deciles = exact_quantiles(apart, apart.columns, quantile_grid(bins))
    edges = {name: psi_edges(deciles[f"r{i}"]) if deciles[f"r{i}"] else [] for i, name in enumerate(references)}
    entries = [
        (str(k), [F.when(F.col("g").isin(*pair), left_closed_index(F.col("v"), edges[pair[0]])), F.col("g").isin(*pair)])
        for k, pair in enumerate(pairs)
    ]
    counted = (
        sides.select("g", "ok", unpivot_values(entries, ["bin", "member"]))
        .filter("member")
        .groupBy("feature", "bin", "g")
        .agg(F.count("*").alias("n"), F.bool_and("ok").alias("ok"))
        .collect()
    )
    # At most (bins + 1) x 2 rows per pair are left.
    result = []
    for k, (reference, current) in enumerate(pairs):
        cells = [r for r in counted if r["feature"] == str(k)]
        sizes = {name: sum(r["n"] for r in cells if r["g"] == name) for name in (reference, current)}
        if not all(r["ok"] for r in cells) or not all(sizes.values()):
            result.append((reference, current, None))
            continue
        shares = [
            [sum(r["n"] for r in cells if r["bin"] == i and r["g"] == name) / sizes[name] for name in (reference, current)]
            for i in sorted({r["bin"] for r in cells})
        ]
        result.append((reference, current, float(sum(_psi_term(*pair) for pair in shares))))
    return df.sparkSession.createDataFrame(result, "reference string, current string, psi double")


def _psi_term(reference: float, current: float) -> float:
    r, c = max(reference, 1e-6), max(current, 1e-6)
    return (c - r) * math.log(c / r)


def score_monotonicity(lift: DataFrame, keys: Sequence[str] = (), rate: str = "bad_rate") -> DataFrame:
    """Violations of a monotone bad rate over the lift buckets, in the direction with fewer of them."""
    order = Window.partitionBy(*keys).orderBy("bucket")
    stepped = lift.withColumn("__step", F.col(rate) - F.lag(rate).over(order))
    steps = F.least(F.count_if(F.col("__step") < -TOLERANCE), F.count_if(F.col("__step") > TOLERANCE))
    violations = F.when(F.count(rate) >= 2, steps)
    aggregates = [
        violations.alias("violations"),
        F.coalesce(violations == 0, F.lit(False)).alias("absolute"),
    ]
    return stepped.groupBy(*keys).agg(*aggregates) if keys else stepped.agg(*aggregates)

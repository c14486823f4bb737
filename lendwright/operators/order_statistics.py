"""Exact order statistics, running totals and hash cut-offs without a global sort.

Nothing here sorts a whole table in one task and nothing keeps one entry per distinct value in
memory: a bounded sketch proposes brackets, one counting pass makes them exact, and only the rows
inside the brackets that hold a wanted rank are ever ordered.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from lendwright.functions.expressions import as_double, column, double_sql, right_closed_sql

SKETCH_ACCURACY = 10_000
SKETCH_SLACK = 5e-4
BRACKET_ROWS = 2_000_000
RUN_ROWS = 1_000_000
MAX_RUNS = 10_000
LARGEST = sys.float_info.max


def unpivot_values(entries: Sequence[tuple[str, Sequence[Column]]], names: Sequence[str]) -> Column:
    """One generator that emits ``(feature, *values)`` once per entry."""
    structs = [
        F.struct(F.lit(label).alias("feature"), *[c.alias(n) for c, n in zip(values, names)])
        for label, values in entries
    ]
    return F.inline(F.array(*structs))


def quantile_grid(parts: int) -> list[float]:
    """Evenly spaced probabilities 0 … 1 as multiples of ``1/parts``."""
    step = 1.0 / parts
    return [i * step for i in range(parts)] + [1.0]


def sketch_quantiles(value: str, fractions: Sequence[float], accuracy: int = SKETCH_ACCURACY) -> Column:
    """Approximate quantiles of a column; one SQL literal instead of one call per fraction."""
    grid = ", ".join(f"{q!r}D" for q in fractions)
    return F.expr(f"percentile_approx({value}, array({grid}), {accuracy})")


def _around(fractions: Sequence[float], n: int = 0) -> list[float]:
    """Fractions a little below and above the wanted ones, at least two ranks of ``n`` rows."""
    slack = max(SKETCH_SLACK, 2 / n) if n else SKETCH_SLACK
    both = {f + side for f in fractions for side in (-slack, slack)}
    return sorted({min(1.0, max(0.0, f)) for f in both})


def select_ranks(
    df: DataFrame,
    columns: Sequence[str],
    fractions: Callable[[str], Sequence[float]],
    wanted: Callable[[str, int], Sequence[int]],
    *,
    bracket_rows: int = BRACKET_ROWS,
) -> tuple[dict[str, int], dict[str, dict[int, float]]]:
    """Exact values at 0-based ranks of the non-null values of each column.

    ``wanted(column, n)`` names the ranks once the non-null count ``n`` is known; ``fractions(column)``
    says roughly where they lie, which only steers the sketch. Returns the counts and
    ``{column: {rank: value}}``; both are as small as the question asked.
    """
    columns = list(columns)
    if not columns:
        return {}, {}
    types = {f.name: f.dataType for f in df.schema.fields}
    numbers = df.select(*[as_double(c, types[c]).alias(f"v{i}") for i, c in enumerate(columns)])
    index = range(len(columns))
    first = numbers.agg(
        *[F.count(f"v{i}").alias(f"n{i}") for i in index],
        *[sketch_quantiles(f"v{i}", _around(fractions(c))).alias(f"q{i}") for i, c in enumerate(columns)],
    ).first()
    counts = {c: first[f"n{i}"] for i, c in enumerate(columns)}
    ranks = {c: sorted(set(wanted(c, counts[c]))) if counts[c] else [] for c in columns}
    found: dict[str, dict[int, float]] = {c: {} for c in columns}
    # Interval edges per column whose pieces are counted next, and the ranks still to be found.
    edges = {c: sorted(set(first[f"q{i}"])) for i, c in enumerate(columns) if ranks[c]}
    searched = ranks
    small: list[Bracket] = []
    while edges:
        entries = [
            (c, [F.expr(right_closed_sql(f"v{columns.index(c)}", e)), F.col(f"v{columns.index(c)}")])
            for c, e in edges.items()
        ]
        # Pieces are numbered before unpivoting, so the counts collapse on the map side.
        pieces = (
            numbers.select(unpivot_values(entries, ["piece", "value"]))
            .filter(F.col("value").isNotNull())
            .groupBy("feature", "piece")
            .agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
            .collect()
        )
        large: list[Bracket] = []
        for c, cuts in edges.items():
            before = 0
            for row in sorted((r for r in pieces if r["feature"] == c), key=lambda r: r["piece"]):
                n, open_ranks = row["n"], []
                for t in searched[c]:
                    if not before <= t < before + n:
                        continue
                    if row["lo"] == row["hi"] or t == before:
                        found[c][t] = row["lo"]
                    elif t == before + n - 1:
                        found[c][t] = row["hi"]
                    else:
                        open_ranks.append(t)
                if open_ranks:
                    bracket = Bracket(c, f"v{columns.index(c)}", row["lo"], row["hi"], before, n, open_ranks)
                    (small if n <= bracket_rows else large).append(bracket)
                before += n
        edges = _refine(numbers, large)
        searched = {c: [t for b in large if b.name == c for t in b.ranks] for c in edges}
    for bracket, values in zip(small, _order_small(numbers, small)):
        found[bracket.name].update(values)
    return counts, found


@dataclass(frozen=True)
class Bracket:
    """Rows with ``lo <= value <= hi`` of one column: ``n`` of them, ``before`` rows below."""

    name: str
    value: str
    lo: float
    hi: float
    before: int
    n: int
    ranks: Sequence[int]

    def inside(self) -> str:
        return f"CASE WHEN {self.value} BETWEEN {double_sql(self.lo)} AND {double_sql(self.hi)} THEN {self.value} END"


def _refine(numbers: DataFrame, brackets: Sequence[Bracket]) -> dict[str, list[float]]:
    """Edges that cut the brackets which are still too large to order."""
    if not brackets:
        return {}
    sketches = (
        numbers.selectExpr(*[f"{b.inside()} AS b{k}" for k, b in enumerate(brackets)])
        .agg(
            *[
                sketch_quantiles(f"b{k}", _around([(t - b.before) / (b.n - 1) for t in b.ranks], b.n)).alias(f"s{k}")
                for k, b in enumerate(brackets)
            ]
        )
        .first()
    )
    edges: dict[str, set[float]] = {}
    for k, b in enumerate(brackets):
        # The midpoint guarantees progress whatever the sketch says; the outer edges isolate the bracket. Infinite
        # values are a piece of their own, so the midpoint is taken between finite ends.
        below = math.nextafter(b.lo, -math.inf)
        low, high = max(b.lo, -LARGEST), min(b.hi, LARGEST)
        cuts = {below, b.lo, b.hi, low, high, low / 2 + high / 2, *sketches[f"s{k}"]}
        edges.setdefault(b.name, set()).update(cuts)
    return {c: sorted(e) for c, e in edges.items()}


def _order_small(numbers: DataFrame, brackets: Sequence[Bracket]) -> list[dict[int, float]]:
    """Order the rows of the small brackets, each bracket on its own."""
    result: list[dict[int, float]] = [{} for _ in brackets]
    if not brackets:
        return result
    # A value lies in at most one bracket of its column, so each row is emitted once per column.
    by_column: dict[str, list[str]] = {}
    for k, b in enumerate(brackets):
        by_column.setdefault(b.value, []).append(f"WHEN {b.value} BETWEEN {double_sql(b.lo)} AND {double_sql(b.hi)} THEN {k}")
    entries = [(v, [F.expr(f"CASE {' '.join(whens)} END"), F.col(v)]) for v, whens in by_column.items()]
    counted = (
        numbers.select(unpivot_values(entries, ["bracket", "value"]))
        .filter(F.col("bracket").isNotNull())
        .groupBy("bracket", "value")
        .agg(F.count("*").alias("n"))
    )
    run = Window.partitionBy("bracket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    hit = " OR ".join(
        f"(bracket = {k} AND upto > {t - b.before} AND upto - n <= {t - b.before})"
        for k, b in enumerate(brackets)
        for t in b.ranks
    )
    for row in counted.withColumn("upto", F.sum("n").over(run)).filter(hit).collect():
        k = row["bracket"]
        for t in brackets[k].ranks:
            if row["upto"] - row["n"] <= t - brackets[k].before < row["upto"]:
                result[k][t] = row["value"]
    return result


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float] | Mapping[str, Sequence[float]],
    *,
    bracket_rows: int = BRACKET_ROWS,
) -> dict[str, list[float]]:
    """Linearly interpolated quantiles of the non-null values; no values gives an empty list."""

    def grid(c: str) -> Sequence[float]:
        return probabilities[c] if isinstance(probabilities, Mapping) else probabilities

    def ranks(c: str, n: int) -> list[int]:
        wanted = []
        for q in grid(c):
            place = q * (n - 1)
            wanted += [math.floor(place), min(math.floor(place) + 1, n - 1)]
        return wanted

    counts, values = select_ranks(df, columns, grid, ranks, bracket_rows=bracket_rows)
    result: dict[str, list[float]] = {}
    for c in columns:
        n = counts[c]
        result[c] = []
        for q in grid(c) if n else []:
            place = q * (n - 1)
            low = math.floor(place)
            a, b = values[c][low], values[c][min(low + 1, n - 1)]
            result[c].append(_between(a, b, place - low))
    return result


def _between(a: float, b: float, share: float) -> float:
    """Linear interpolation; beside an infinite value the nearer of the two."""
    if a == b or share == 0:
        return a
    if math.isinf(a) or math.isinf(b):
        return a if share < 0.5 else b
    return a + (b - a) * share


def run_splits(df: DataFrame, value: str, run_rows: int = RUN_ROWS) -> list[float]:
    """Split points that cut the table into runs of about ``run_rows`` rows (at most MAX_RUNS runs).

    The sketch is twenty times finer than the runs, so a run exceeds its size only by equal values,
    which the callers collapse to one row each.
    """
    runs = min(MAX_RUNS, math.ceil(df.count() / run_rows))
    if runs <= 1:
        return []
    sketch = sketch_quantiles(f"`{value}`", quantile_grid(runs)[1:-1], max(SKETCH_ACCURACY, 20 * runs))
    return sorted(set(df.agg(sketch.alias("q")).first()["q"] or []))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str],
    *,
    descending: bool = False,
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """Per-key running sums over a numeric column with one row per ``(keys, order)``.

    Adds ``upto_<sum>`` (inclusive running sum) and ``all_<sum>`` (key total). The rows are cut into
    value runs at ``splits``; each run is summed on its own and starts from the total of the runs
    before it, so no task ever sees more than one run of one key.
    """
    keys = list(keys)
    splits = sorted(set(splits or []))
    direction = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*keys, "__run").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    if not splits:
        tagged = df.withColumn("__run", F.lit(0))
        whole = Window.partitionBy(*keys, "__run")
        return tagged.select(
            *df.columns,
            *[F.sum(s).over(inside).alias(f"upto_{s}") for s in sums],
            *[F.sum(s).over(whole).alias(f"all_{s}") for s in sums],
        )
    tagged = Bucketizer(
        splits=[-math.inf, *splits, math.inf], inputCol=order, outputCol="__run", handleInvalid="keep"
    ).transform(df)
    # One row per key and run: at most len(splits) + 1 rows per key.
    starts = tagged.groupBy(*keys, "__run").agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    by_run = F.col("__run").desc() if descending else F.col("__run").asc()
    earlier = Window.partitionBy(*keys).orderBy(by_run).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    starts = starts.select(
        *keys,
        "__run",
        *[F.coalesce(F.sum(f"__{s}").over(earlier), F.lit(0)).alias(f"__before_{s}") for s in sums],
        *[F.sum(f"__{s}").over(whole).alias(f"all_{s}") for s in sums],
    )
    left, right = tagged.alias("l"), starts.alias("r")
    matches = F.col("l.__run") == F.col("r.__run")
    for key in keys:
        matches = matches & F.col(f"l.`{key}`").eqNullSafe(F.col(f"r.`{key}`"))
    joined = left.join(right, matches).select(
        "l.*", *[f"r.__before_{s}" for s in sums], *[f"r.all_{s}" for s in sums]
    )
    return joined.select(
        *df.columns,
        *[(F.sum(s).over(inside) + F.col(f"__before_{s}")).alias(f"upto_{s}") for s in sums],
        *[f"all_{s}" for s in sums],
    )


def hash_order(key: Column, seed: int | str = "") -> Column:
    """Deterministic shuffling key: md5 is the same text on every engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def hash_cutoffs(
    df: DataFrame, stratum: str, digest: str, identity: str, take: Callable[[object, int], int]
) -> dict[object, tuple[str, str] | None]:
    """Per stratum the ``(digest, identity)`` of the last row taken when rows go in digest order.

    Strata are few (label classes). The counting pass keeps 65,536 prefixes per stratum; only the
    rows that share the prefix of the cut-off are ordered.
    """
    by_prefix = df.groupBy(stratum, F.substring(digest, 1, 4).alias("prefix")).agg(F.count("*").alias("n"))
    totals = {r[stratum]: r["n"] for r in by_prefix.groupBy(stratum).agg(F.sum("n").alias("n")).collect()}
    goals = {s: take(s, n) for s, n in totals.items()}
    run = Window.partitionBy(stratum).orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    running = by_prefix.withColumn("upto", F.sum("n").over(run))
    hit = F.lit(False)
    for s, goal in goals.items():
        hit = hit | (
            F.col(stratum).eqNullSafe(F.lit(s))
            & (F.col("upto") >= F.lit(goal))
            & (F.col("upto") - F.col("n") < F.lit(goal))
        )
    edges = {r[stratum]: (r["prefix"], r["upto"] - r["n"]) for r in running.filter(hit).collect()}
    result: dict[object, tuple[str, str] | None] = {s: None for s in totals}
    if not edges:
        return result
    near = F.lit(False)
    place = F.lit(None).cast("long")
    for s, (prefix, before) in edges.items():
        mine = F.col(stratum).eqNullSafe(F.lit(s))
        near = near | (mine & F.col(digest).startswith(prefix))
        place = F.when(mine, F.lit(goals[s] - before)).otherwise(place)
    order = Window.partitionBy(stratum).orderBy(digest, F.col(identity).cast("string"))
    last = (
        df.filter(near)
        .select(stratum, digest, F.col(identity).cast("string").alias("who"), F.row_number().over(order).alias("rn"))
        .filter(F.col("rn") == place)
    )
    for row in last.collect():
        result[row[stratum]] = (row[digest], row["who"])
    return result


def at_or_before(
    cutoffs: Mapping[object, tuple[str, str] | None], stratum: str, digest: str, identity: str
) -> Column:
    """Map-only test for the rows that ``hash_cutoffs`` counted in."""
    inside = F.lit(False)
    who = F.col(identity).cast("string")
    for s, cut in cutoffs.items():
        if cut is None:
            continue
        inside = inside | (
            F.col(stratum).eqNullSafe(F.lit(s))
            & ((F.col(digest) < F.lit(cut[0])) | ((F.col(digest) == F.lit(cut[0])) & (who <= F.lit(cut[1]))))
        )
    return inside


HOT_SHARE = 1_000
HOT_MIN_ROWS = 1_000_000
HOT_SKETCH_ITEMS = 10_000


def hot_key_hashes(df: DataFrame, keys: Sequence[str | Column], min_rows: int = HOT_MIN_ROWS) -> list[int]:
    """Hashes of keys that hold more than 1/1000 of a large table: never more than 1,000 of them.

    The sketch may over-report; callers treat the list only as a routing hint, so results stay exact.
    """
    hashed = df.select(F.xxhash64(*[column(k) for k in keys]).alias("h"))
    row = hashed.agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(h, {HOT_SHARE}, {HOT_SKETCH_ITEMS})").alias("top")
    ).first()
    floor = max(row["n"] / HOT_SHARE, min_rows)
    return [item["item"] for item in row["top"] or [] if item["count"] > floor]


def join_unique(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    *,
    how: str = "left",
    hot_min_rows: int = HOT_MIN_ROWS,
    hot: Sequence[int] | None = None,
) -> DataFrame:
    """Join many rows to a lookup that is unique per key, NULL matching NULL.

    Keys that hold a large share of the rows go through a broadcast of their (at most 1,000) lookup
    rows; all other keys shuffle. Both ways are exact, whatever the routing hint says.
    """
    keys = list(keys)
    hot = hot_key_hashes(rows, keys, hot_min_rows) if hot is None else list(hot)

    def matched(left: DataFrame, right: DataFrame) -> DataFrame:
        renamed = right.select(
            *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)],
            *[F.col(f"`{c}`") for c in right.columns if c not in keys],
        )
        condition = F.lit(True)
        for i, k in enumerate(keys):
            equal = F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
            condition = equal if i == 0 else condition & equal
        return left.join(renamed, condition, how).drop(*[f"__k{i}" for i in range(len(keys))])

    if not hot:
        return matched(rows, lookup)
    is_hot = F.xxhash64(*[F.col(f"`{k}`") for k in keys]).isin(*hot)
    return matched(rows.filter(~is_hot), lookup.filter(~is_hot)).unionByName(
        matched(rows.filter(is_hot), F.broadcast(lookup.filter(is_hot)))
    )

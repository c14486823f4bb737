"""Join-key advice, join checks and guarded many-to-one joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from lendwright.functions import fixed_values as fixed
from lendwright.functions.expressions import column, name_matches
from lendwright.operators.labels import target_summary
from lendwright.operators.order_statistics import join_unique, unpivot_values
from lendwright.operators.profile import column_profile

MAX_INFLATION = 1.001
#: Theta sketches keep up to 2^bits hashes per column; columns with fewer distinct values are counted exactly.
SKETCH_BITS = 16


@dataclass(frozen=True)
class JoinStep:
    """One step of a join plan; the right side must be unique per key."""

    right: str
    left_keys: Sequence[str]
    right_keys: Sequence[str]
    how: str = "left"
    expected_cardinality: str = "many_to_one"
    suffix: str = "_right"


def recommend_keys(left: DataFrame, right: DataFrame, max_keys: int = 3) -> DataFrame:
    """Same-named columns scored by overlap of their distinct values; all columns in one job."""
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("NO_COMMON_COLUMNS")

    def long(df: DataFrame, side: str) -> DataFrame:
        entries = [(c, [column(c).cast("string")]) for c in common]
        return (
            df.select(unpivot_values(entries, ["value"]))
            .filter(F.col("value").isNotNull())
            .groupBy("feature", "value")
            .agg(F.count("*").alias("n"))
            .withColumn("side", F.lit(side))
        )

    on_left, on_right = F.col("side") == "left", F.col("side") == "right"
    values = (
        long(left, "left")
        .unionByName(long(right, "right"))
        .groupBy("feature", "value")
        .agg(
            F.bool_or(on_left).alias("in_left"),
            F.bool_or(on_right).alias("in_right"),
            F.sum(F.when(on_right, F.col("n")).otherwise(0)).alias("right_rows"),
        )
    )
    per_column = values.groupBy("feature").agg(
        F.count_if(F.col("in_left") & F.col("in_right")).alias("overlap"),
        F.count_if("in_left").alias("left_distinct"),
        F.count_if("in_right").alias("right_distinct"),
        F.sum("right_rows").alias("right_rows"),
    )
    return _ranked_keys(per_column.withColumnRenamed("feature", "key"), common, max_keys)


def _ranked_keys(per_column: DataFrame, common: Sequence[str], max_keys: int) -> DataFrame:
    """Advice from the counts (key, overlap, left_distinct, right_distinct, right_rows) of same-named columns."""
    overlap = F.col("overlap") / F.greatest(F.lit(1), F.least("left_distinct", "right_distinct"))
    identifiers = [c for c in common if name_matches(fixed.ID_NAME, c)]
    bonus = F.when(F.col("key").isin(*identifiers), F.lit(0.35)).otherwise(F.lit(0.0))
    unique = F.col("right_distinct") / F.col("right_rows")
    position = F.array_position(F.array(*[F.lit(c) for c in common]), F.col("key"))
    scored = per_column.filter((F.col("left_distinct") > 0) & (F.col("right_distinct") > 0)).select(
        "key",
        F.round(F.least(F.lit(1.0), overlap + bonus), 4).alias("score"),
        F.round(overlap, 4).alias("overlap_rate"),
        F.round(unique, 4).alias("right_unique_rate"),
        F.when(unique >= 0.98, F.lit("many_to_one")).otherwise(F.lit("many_to_many")).alias("expected_cardinality"),
        position.alias("__position"),
    )
    return (
        scored.orderBy((F.col("expected_cardinality") == "many_to_one").desc(), F.col("score").desc(), "__position")
        .limit(max_keys)
        .drop("__position")
    )


def overlap_error(distinct_union: float, overlap: float, sketch_bits: int = SKETCH_BITS) -> float:
    """Relative standard error of a sketched overlap: none while both columns fit into their sketches, else about
    sqrt(union / overlap / 2^bits)."""
    if distinct_union <= 1 << sketch_bits:
        return 0.0
    return (distinct_union / max(overlap, 1.0) / (1 << sketch_bits)) ** 0.5


def key_overlaps(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(left_key, right_key, overlap, left_distinct, right_distinct, right_rows) of column pairs, from one theta sketch per column.

    A table is read once and no value is shuffled, only sketches of at most 2^bits hashes; see ``overlap_error``.
    """

    def sketched(df: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
        texts = [column(c).cast("string") for c in columns]
        return df.agg(
            *[F.theta_sketch_agg(t, sketch_bits).alias(f"{prefix}s{i}") for i, t in enumerate(texts)],
            *[F.count(t).alias(f"{prefix}n{i}") for i, t in enumerate(texts)],
        )

    lefts, rights = (list(dict.fromkeys(p[side] for p in pairs)) for side in (0, 1))
    both = sketched(left, lefts, "l").crossJoin(sketched(right, rights, "r"))  # one row each
    rows = []
    for a, b in pairs:
        x, y = F.col(f"ls{lefts.index(a)}"), F.col(f"rs{rights.index(b)}")
        rows.append(
            F.struct(
                F.lit(a).alias("left_key"),
                F.lit(b).alias("right_key"),
                F.theta_sketch_estimate(F.theta_intersection(x, y)).cast("long").alias("overlap"),
                F.theta_sketch_estimate(x).cast("long").alias("left_distinct"),
                F.theta_sketch_estimate(y).cast("long").alias("right_distinct"),
                F.col(f"rn{rights.index(b)}").alias("right_rows"),
            )
        )
    return both.select(F.inline(F.array(*rows)))


def recommend_keys_sketched(left: DataFrame, right: DataFrame, max_keys: int = 3, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """``recommend_keys`` from sketches, for wide or very long tables."""
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("NO_COMMON_COLUMNS")
    found = key_overlaps(left, right, [(c, c) for c in common], sketch_bits)
    return _ranked_keys(found.withColumnRenamed("left_key", "key").drop("right_key"), common, max_keys)


def recommend_key_pairs(left: DataFrame, right: DataFrame, least_overlap: float = 0.5, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """Pairs of columns of any name whose distinct values overlap, best first: (left_key, right_key, overlap_rate, right_unique_rate)."""
    found = key_overlaps(left, right, [(a, b) for a in left.columns for b in right.columns], sketch_bits)
    overlap = F.col("overlap") / F.greatest(F.lit(1), F.least("left_distinct", "right_distinct"))
    unique = F.col("right_distinct") / F.greatest(F.lit(1), "right_rows")
    rated = found.select("left_key", "right_key", F.round(overlap, 4).alias("overlap_rate"), F.round(unique, 4).alias("right_unique_rate"))
    order = [F.col("right_unique_rate").desc(), F.col("overlap_rate").desc(), "left_key", "right_key"]
    return rated.filter(F.col("overlap_rate") >= least_overlap).orderBy(*order)


def _check_keys(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str]) -> None:
    if not left_keys or len(left_keys) != len(right_keys):
        raise ValueError("JOIN_KEYS_INVALID")
    lost = [k for k in left_keys if k not in left.columns], [k for k in right_keys if k not in right.columns]
    if any(lost):
        raise ValueError(f"JOIN_KEY_NOT_FOUND: left={lost[0]}, right={lost[1]}")


def validate_join(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str],
    customer_key: str | None = None,
) -> DataFrame:
    """One evidence row. Both sides are reduced to key counts before they meet; NULL equals NULL."""
    _check_keys(left, right, left_keys, right_keys)
    keys = [f"k{i}" for i in range(len(left_keys))]

    def counted(df: DataFrame, names: Sequence[str], n: str) -> DataFrame:
        return df.groupBy(*[column(c).alias(k) for c, k in zip(names, keys)]).agg(F.count("*").alias(n))

    l, r = counted(left, left_keys, "ln").alias("l"), counted(right, right_keys, "rn").alias("r")
    same = F.col("l.k0").eqNullSafe(F.col("r.k0"))
    for k in keys[1:]:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    met = l.join(r, same, "full").select("ln", "rn")
    evidence = met.agg(
        F.coalesce(F.sum("ln"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("rn"), F.lit(0)).alias("right_rows"),
        F.coalesce(F.sum(F.col("ln") - 1), F.lit(0)).alias("left_key_duplicates"),
        F.coalesce(F.sum(F.col("rn") - 1), F.lit(0)).alias("right_key_duplicates"),
        F.coalesce(F.sum(F.when(F.col("rn").isNotNull(), F.col("ln"))), F.lit(0)).alias("matched"),
    )
    rate = F.col("matched") / F.greatest("left_rows", F.lit(1))
    blocked = F.when(F.col("right_key_duplicates") > 0, F.lit("RIGHT_KEY_DUPLICATES"))
    low = F.when(rate < 0.5, F.lit("LOW_MATCH_RATE"))
    result = evidence.select(
        "left_rows", "right_rows", "left_key_duplicates", "right_key_duplicates", rate.alias("match_rate"),
        blocked.alias("blocking_issue"), low.alias("warning_issue"),
    )
    if not customer_key or customer_key not in left.columns:
        return result.withColumn("grain", F.lit("unknown"))
    if list(left_keys) == [customer_key]:
        repeated = F.col("left_key_duplicates") > 0
    else:
        most = left.groupBy(column(customer_key).alias("c")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        repeated = F.lit(bool(most and most > 1))
    return result.withColumn(
        "grain", F.when(repeated, F.lit("order_or_event")).otherwise(F.lit("customer"))
    )


def key_duplicates(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows beyond the first of every key."""
    n = df.groupBy(*[column(k) for k in keys]).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1)).first()[0]
    return int(n or 0)


def target_distribution(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    entries = [(t, [F.coalesce(column(t).cast("string"), F.lit(fixed.MISSING))]) for t in targets]
    return df.select(unpivot_values(entries, ["value"])).groupBy("feature", "value").agg(F.count("*").alias("n"))


def guarded_join(
    base: DataFrame, right: DataFrame, step: JoinStep, targets: Sequence[str] = ()
) -> DataFrame:
    """Many-to-one join that refuses duplicate right keys, sample inflation and changed labels.

    A left join against a right side proven unique keeps every base row exactly once, so row count
    and label distribution cannot change and are not recounted; other join types are.
    """
    _check_keys(base, right, step.left_keys, step.right_keys)
    if step.how not in ("left", "inner", "right", "outer"):
        raise ValueError("JOIN_TYPE_UNSUPPORTED")
    if step.expected_cardinality not in ("many_to_one", "one_to_one"):
        raise ValueError("JOIN_CARDINALITY_UNSUPPORTED")
    if key_duplicates(right, step.right_keys):
        raise ValueError("JOIN_VALIDATION_BLOCKED: RIGHT_KEY_DUPLICATES")
    if step.expected_cardinality == "one_to_one" and key_duplicates(base, step.left_keys):
        raise ValueError("JOIN_CARDINALITY_VIOLATED")
    joined = _join(base, right, step)
    if step.how == "left":
        return joined
    if joined.count() > MAX_INFLATION * max(base.count(), 1):
        raise ValueError("JOIN_SAMPLE_INFLATION")
    kept = [t for t in targets if t in base.columns]
    if kept and _distribution_changed(base, joined, kept):
        raise ValueError("JOIN_TARGET_DISTRIBUTION_CHANGED")
    return joined


def _distribution_changed(before: DataFrame, after: DataFrame, targets: Sequence[str]) -> bool:
    a = target_distribution(before, targets)
    b = target_distribution(after, targets).withColumn("n", -F.col("n"))
    return not a.unionByName(b).groupBy("feature", "value").agg(F.sum("n").alias("n")).filter("n != 0").isEmpty()


def _join(base: DataFrame, right: DataFrame, step: JoinStep) -> DataFrame:
    """Equal key names become one column, other clashing right columns get the suffix."""
    shared = [l for l, r in zip(step.left_keys, step.right_keys) if l == r]
    names = {
        c: f"{c}{step.suffix}" if c in base.columns and c not in shared else c for c in right.columns
    }
    keys = [f"__key{i}" for i in range(len(step.left_keys))]
    left = base.select("*", *[column(c).alias(k) for c, k in zip(step.left_keys, keys)])
    lookup = right.select(
        *[column(c).alias(k) for c, k in zip(step.right_keys, keys)],
        *[column(c).alias(names[c]) for c in right.columns if c not in shared],
    )
    if step.how in ("left", "inner"):
        return join_unique(left, lookup, keys, how=step.how).drop(*keys)
    r = lookup.select(*[column(k).alias(f"{k}r") for k in keys], *[c for c in lookup.columns if c not in keys])
    same = F.col(keys[0]).eqNullSafe(F.col(f"{keys[0]}r"))
    for k in keys[1:]:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}r"))
    joined = left.join(r, same, step.how)
    key_of = dict(zip(step.left_keys, keys))
    return joined.select(
        *[
            F.coalesce(column(c), F.col(f"{key_of[c]}r")).alias(c) if c in shared else column(c)
            for c in base.columns
        ],
        *[names[c] for c in right.columns if c not in shared],
    )


def run_join_plan(
    base: DataFrame,
    tables: dict[str, DataFrame],
    steps: Sequence[JoinStep],
    targets: Sequence[str] | None = None,
) -> DataFrame:
    """Fold of guarded joins, then the label check on the result."""
    if targets is None:
        found = column_profile(base).filter("target_candidate").select("name").collect()
        targets = [r["name"] for r in found]
    result = base
    for step in steps:
        result = guarded_join(result, tables[step.right], step, targets)
    if targets:
        single = target_summary(result, list(targets)).filter("single_class").select("target").collect()
        if single:
            raise ValueError(f"TARGET_SINGLE_CLASS: {[r['target'] for r in single]}")
    return result


def join_plan_lineage(
    base: DataFrame, tables: dict[str, DataFrame], steps: Sequence[JoinStep], customer_key: str | None = None
) -> DataFrame:
    """Evidence row per step; the customer key defaults to the first left key."""
    customer_key = customer_key or (step_keys[0] if (step_keys := list(steps[0].left_keys)) else None)
    result, evidence = base, None
    for number, step in enumerate(steps, 1):
        row = validate_join(result, tables[step.right], step.left_keys, step.right_keys, customer_key).withColumns(
            {"step": F.lit(number), "right_table": F.lit(step.right)}
        )
        evidence = row if evidence is None else evidence.unionByName(row)
        result = _join(result, tables[step.right], step)
    return evidence


def join_evidence(before: DataFrame, after: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Label distribution before and after a join, and by how much the join multiplied the rows.

    One row per target and value; a value that a join lost or made keeps its row with a count of 0.
    """
    first = target_distribution(before, targets).withColumnRenamed("n", "rows_before")
    last = target_distribution(after, targets).withColumnRenamed("n", "rows_after")
    whole = Window.partitionBy("feature")
    counted = first.join(last, ["feature", "value"], "full").select(
        F.col("feature").alias("target"),
        "value",
        F.coalesce("rows_before", F.lit(0)).alias("rows_before"),
        F.coalesce("rows_after", F.lit(0)).alias("rows_after"),
        (F.sum("rows_after").over(whole) / F.greatest(F.sum("rows_before").over(whole), F.lit(1))).alias("inflation_ratio"),
    )
    return counted


def merged_dictionary(dictionaries: Sequence[DataFrame]) -> DataFrame:
    """One entry per field over several parsed dictionaries; the first dictionary that names a field describes it."""
    parts = [d.withColumn("__turn", F.lit(k)) for k, d in enumerate(dictionaries)]
    every = reduce(DataFrame.unionByName, parts)
    entry = F.struct("description", "role", "missing_codes")
    return every.groupBy("field").agg(F.min_by(entry, "__turn").alias("e")).select("field", "e.*")


def semi_select(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in the key set."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def anti_select(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the key set."""
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")

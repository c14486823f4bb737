"""Train / test / out-of-time partitions that keep customers whole."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lendwright.functions import fixed_values as fixed
from lendwright.functions.expressions import parse_time
from lendwright.operators.order_statistics import (
    at_or_before,
    hash_cutoffs,
    hash_order,
    join_unique,
    select_ranks,
)
from lendwright.session import materialize

TRAIN, TEST, OOT, EXCLUDED = "train", "test", "oot", "excluded"
MISSING_TIME = "missing_or_invalid_time"
CROSS_BOUNDARY = "cross_boundary_customer"


@dataclass(frozen=True)
class SplitPlan:
    """How to split: ``time_holdout`` needs ``time_column``; ``customer_key`` keeps customers whole."""

    method: str = "time_holdout"
    time_column: str | None = None
    customer_key: str | None = None
    test_size: float = 0.2
    oot_size: float = 0.2
    seed: int = 42

    def __post_init__(self) -> None:
        if self.method not in ("time_holdout", "random_stratified"):
            raise ValueError("UNSUPPORTED_SPLIT_METHOD")
        if not 0 < self.test_size < 0.5:
            raise ValueError("TEST_SIZE_INVALID")
        if self.method == "time_holdout":
            if not 0 < self.oot_size < 0.5:
                raise ValueError("OOT_SIZE_INVALID")
            if not self.time_column:
                raise ValueError("TIME_COLUMN_REQUIRED")


def time_cutoff(df: DataFrame, time_column: str, oot_size: float = 0.2) -> int | None:
    """First out-of-time moment in microseconds: an exact order statistic, not a sort."""
    stamps = df.select(F.unix_micros(parse_time(time_column, df.schema[time_column].dataType)).alias("t"))
    place = {}

    def boundary(_: str, n: int) -> list[int]:
        place["rank"] = max(0, n - max(1, math.ceil(n * oot_size)))
        return [place["rank"]]

    counts, values = select_ranks(stamps, ["t"], lambda _: [1 - oot_size], boundary)
    return int(values["t"][place["rank"]]) if counts["t"] else None


def stratified_split(
    df: DataFrame, label: str, row_id: str, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Random stratified train/test: the first ⌈p·n⌉ rows of each class in md5 order are the test set."""
    hashed = df.withColumn("__digest", hash_order(F.col(row_id), seed))
    cuts = hash_cutoffs(hashed, label, "__digest", row_id, lambda _, n: math.ceil(n * test_size))
    test = at_or_before(cuts, label, "__digest", row_id)
    return hashed.withColumn("partition", F.when(test, F.lit(TEST)).otherwise(F.lit(TRAIN))).drop("__digest")


def group_stratified_split(
    df: DataFrame, label: str, group: str, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Whole groups go to train or test, stratified by whether the group holds a bad row."""
    members = df.withColumn("__group", _group(group))
    groups = members.groupBy("__group").agg(F.max(label).alias("__class"))
    return join_unique(members, _assign_groups(groups, test_size, seed), ["__group"]).drop(
        "__group", "__class"
    )


def _group(key: str):
    return F.coalesce(F.col(key).cast("string"), F.lit(fixed.MISSING_CUSTOMER))


def _assign_groups(groups: DataFrame, test_size: float, seed: int) -> DataFrame:
    hashed = groups.withColumn("__digest", hash_order(F.col("__group"), seed))
    cuts = hash_cutoffs(hashed, "__class", "__digest", "__group", lambda _, n: math.ceil(n * test_size))
    test = at_or_before(cuts, "__class", "__digest", "__group")
    return hashed.withColumn("partition", F.when(test, F.lit(TEST)).otherwise(F.lit(TRAIN))).drop("__digest")


def time_holdout(df: DataFrame, plan: SplitPlan, cutoff: int | None = None) -> DataFrame:
    """Adds ``partition`` (``development`` / ``oot`` / ``excluded``) and ``exclusion_reason``.

    Rows at or after the cut-off are out of time. With a customer key, customers seen on both sides
    are excluded whole, and so are rows without a usable time.
    """
    stamp = F.unix_micros(parse_time(plan.time_column, df.schema[plan.time_column].dataType))
    if cutoff is None:
        cutoff = time_cutoff(df, plan.time_column, plan.oot_size)
    late = stamp >= F.lit(cutoff)
    side = F.when(late, F.lit(OOT)).otherwise(F.lit("development"))
    if not plan.customer_key:
        reason = F.when(stamp.isNull(), F.lit(MISSING_TIME))
        return df.withColumn("exclusion_reason", reason).withColumn(
            "partition", F.when(reason.isNotNull(), F.lit(EXCLUDED)).otherwise(side)
        )
    marked = df.withColumn("__group", _group(plan.customer_key)).withColumn("__late", late)
    sides = marked.groupBy("__group").agg(
        F.coalesce(F.bool_or(~F.col("__late")), F.lit(False)).alias("__before"),
        F.coalesce(F.bool_or("__late"), F.lit(False)).alias("__after"),
    )
    crossing = F.col("__before") & F.col("__after")
    reason = F.when(F.col("__late").isNull(), F.lit(MISSING_TIME)).when(crossing, F.lit(CROSS_BOUNDARY))
    return (
        join_unique(marked, sides, ["__group"])
        .withColumn("exclusion_reason", reason)
        .withColumn(
            "partition",
            F.when(F.col("exclusion_reason").isNotNull(), F.lit(EXCLUDED))
            .when(F.col("__late"), F.lit(OOT))
            .otherwise(F.lit("development")),
        )
        .drop("__group", "__late", "__before", "__after")
    )


def split_dataset(df: DataFrame, label: str, row_id: str, plan: SplitPlan) -> DataFrame:
    """The whole split: adds ``partition`` (train/test/oot/excluded) and ``exclusion_reason``."""
    if plan.customer_key and plan.customer_key not in df.columns:
        raise ValueError("CUSTOMER_KEY_NOT_FOUND")
    if plan.method == "random_stratified":
        if df.count() < 30:
            raise ValueError("INSUFFICIENT_SAMPLES_FOR_SPLIT")
        if plan.customer_key:
            split = group_stratified_split(df, label, plan.customer_key, plan.test_size, plan.seed)
        else:
            split = stratified_split(df, label, row_id, plan.test_size, plan.seed)
        return split.withColumn("exclusion_reason", F.lit(None).cast("string"))
    if plan.time_column not in df.columns:
        raise ValueError("TIME_COLUMN_REQUIRED")
    timed = parse_time(plan.time_column, df.schema[plan.time_column].dataType)
    seen = df.agg(F.count("*").alias("n"), F.count(timed).alias("timed")).first()
    if seen["n"] < 30:
        raise ValueError("INSUFFICIENT_SAMPLES_FOR_SPLIT")
    if seen["timed"] < 0.8 * seen["n"]:
        raise ValueError("TIME_PARSE_RATE_TOO_LOW")
    cutoff = time_cutoff(df, plan.time_column, plan.oot_size)
    if plan.customer_key:
        return _isolated_split(df, label, plan, F.unix_micros(timed) >= F.lit(cutoff))
    sided = time_holdout(df, plan, cutoff)
    sizes = {r["partition"]: r["count"] for r in sided.groupBy("partition").count().collect()}
    _require_rows(sizes.get("development", 0), sizes.get(OOT, 0), "STRICT_OOT_INSUFFICIENT_SAMPLES")
    development = F.col("partition") == "development"
    hashed = sided.withColumn("__digest", hash_order(F.col(row_id), plan.seed))
    cuts = hash_cutoffs(
        hashed.filter(development), label, "__digest", row_id, lambda _, n: math.ceil(n * plan.test_size)
    )
    test = at_or_before(cuts, label, "__digest", row_id)
    return hashed.withColumn(
        "partition",
        F.when(development & test, F.lit(TEST)).when(development, F.lit(TRAIN)).otherwise(F.col("partition")),
    ).drop("__digest")


def _require_rows(development: int, oot: int, code: str) -> None:
    if development < 20 or oot < 2:
        raise ValueError(code)


def _isolated_split(df: DataFrame, label: str, plan: SplitPlan, late) -> DataFrame:
    """Time split with whole customers: one aggregation to a row per customer, written once; all
    decisions are taken on that table, and one join brings them back to the rows."""
    marked = df.withColumn("__group", _group(plan.customer_key)).withColumn("__late", late)
    groups = materialize(
        marked.groupBy("__group").agg(
            F.count_if(~F.col("__late")).alias("__early_rows"),
            F.count_if("__late").alias("__late_rows"),
            F.max(F.when(~F.col("__late"), F.col(label))).alias("__class"),
        ),
        "customers",
    )
    early, after = F.col("__early_rows") > 0, F.col("__late_rows") > 0
    sizes = groups.agg(
        F.coalesce(F.sum(F.when(early & ~after, F.col("__early_rows"))), F.lit(0)).alias("development"),
        F.coalesce(F.sum(F.when(after & ~early, F.col("__late_rows"))), F.lit(0)).alias("oot"),
    ).first()
    _require_rows(sizes["development"], sizes["oot"], "STRICT_OOT_INSUFFICIENT_AFTER_CUSTOMER_ISOLATION")
    hashed = groups.withColumn("__digest", hash_order(F.col("__group"), plan.seed))
    cuts = hash_cutoffs(
        hashed.filter(early & ~after), "__class", "__digest", "__group", lambda _, n: math.ceil(n * plan.test_size)
    )
    test = at_or_before(cuts, "__class", "__digest", "__group")
    sides = hashed.select(
        "__group",
        (early & after).alias("__crossing"),
        F.when(test, F.lit(TEST)).otherwise(F.lit(TRAIN)).alias("__side"),
    )
    reason = F.when(F.col("__late").isNull(), F.lit(MISSING_TIME)).when(F.col("__crossing"), F.lit(CROSS_BOUNDARY))
    return (
        join_unique(marked, sides, ["__group"])
        .withColumn("exclusion_reason", reason)
        .withColumn(
            "partition",
            F.when(F.col("exclusion_reason").isNotNull(), F.lit(EXCLUDED))
            .when(F.col("__late"), F.lit(OOT))
            .otherwise(F.col("__side")),
        )
        .drop("__group", "__late", "__crossing", "__side")
    )


def partition_summary(df: DataFrame, label: str, keys: Sequence[str] = ("partition",)) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.sum(label).cast("long").alias("positive_count"),
        (F.count("*") - F.sum(label)).cast("long").alias("negative_count"),
        F.avg(label).alias("bad_rate"),
    )


def split_violations(
    df: DataFrame, row_id: str, customer_key: str | None = None, time_column: str | None = None
) -> DataFrame:
    """Broken split rules as ``(code, violations)`` rows; an honest split gives no rows."""
    used = F.col("partition").isin(TRAIN, TEST, OOT)
    checks = [
        df.groupBy(row_id)
        .agg(F.count("*").alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("violations"))
        .withColumn("code", F.lit("SPLIT_ROW_OVERLAP")),
        df.agg(F.count_if(~F.coalesce(used | (F.col("partition") == EXCLUDED), F.lit(False))).alias("violations"))
        .withColumn("code", F.lit("SPLIT_ROWS_NOT_ACCOUNTED_FOR")),
    ]
    if customer_key:
        checks.append(
            df.filter(used & F.col(customer_key).isNotNull())
            .groupBy(customer_key)
            .agg(F.min("partition").alias("a"), F.max("partition").alias("b"))
            .agg(F.count_if(F.col("a") != F.col("b")).alias("violations"))
            .withColumn("code", F.lit("SPLIT_CUSTOMER_OVERLAP"))
        )
    if time_column:
        stamp = parse_time(time_column, df.schema[time_column].dataType)
        ends = df.agg(
            F.max(F.when(F.col("partition").isin(TRAIN, TEST), stamp)).alias("last_dev"),
            F.min(F.when(F.col("partition") == OOT, stamp)).alias("first_oot"),
            F.count_if(F.col("partition") == OOT).alias("n_oot"),
        )
        broken = (F.col("n_oot") > 0) & ~F.coalesce(F.col("last_dev") < F.col("first_oot"), F.lit(False))
        checks.append(
            ends.select(F.when(broken, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("violations")).withColumn(
                "code", F.lit("STRICT_OOT_TIME_BOUNDARY_VIOLATION")
            )
        )
    result = checks[0]
    for check in checks[1:]:
        result = result.unionByName(check)
    return result.filter("violations > 0").select("code", "violations")


def exclusion_fingerprint(df: DataFrame, row_id: str) -> DataFrame:
    """Order-insensitive fingerprint of the excluded rows: the sum of 60 bits of each id's md5, equal on every engine."""
    digits = F.conv(F.substring(F.md5(F.col(row_id).cast("string")), 1, 15), 16, 10)
    return df.filter(F.col("partition") == EXCLUDED).agg(
        F.count("*").alias("excluded_rows"),
        F.coalesce(F.sum(digits.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
        .cast("string")
        .alias("fingerprint"),
    )

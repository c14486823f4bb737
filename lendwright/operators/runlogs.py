"""Checks and roll-ups over run, event, span and trial logs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lendwright.functions import fixed_values as fixed
from lendwright.functions.expressions import column
from lendwright.operators.order_statistics import HOT_MIN_ROWS, join_unique
from lendwright.session import cut_lineage

EVENT_BATCH = 5_000
FINAL_STATES = ("succeeded", "failed", "blocked")
SPAN_END_STATES = ("succeeded", "failed", "blocked", "cancelled")


def event_integrity(
    events: DataFrame,
    run: str = "run_id",
    sequence: str = "seq",
    event_id: str = "id",
    status: str = "status",
    runs: DataFrame | None = None,
) -> DataFrame:
    """Per run: are sequences exactly 1..n, ids unique, and is the last status the run's own?

    Aggregates only, so a run with a third of all events never meets in one task.
    ``runs`` gives ``run, terminal_status`` for the last check.
    """
    facts = events.groupBy(column(run).alias("run")).agg(
        F.count("*").alias("n_events"),
        F.min(sequence).alias("first_seq"),
        F.max(sequence).alias("last_seq"),
        F.count_distinct(column(sequence)).alias("__seqs"),
        F.count_distinct(column(event_id)).alias("__ids"),
        F.max_by(status, sequence).alias("last_status"),
    )
    gaps = (
        (F.col("first_seq") == 1)
        & (F.col("last_seq") == F.col("n_events"))
        & (F.col("__seqs") == F.col("n_events"))
    )
    checked = facts.withColumns({"contiguous": gaps, "unique_ids": F.col("__ids") == F.col("n_events")})
    if runs is not None:
        known = runs.select(column("run"), F.col("terminal_status").alias("__terminal"))
        checked = checked.join(known, "run", "left").withColumn(
            "terminal_matches", F.coalesce(F.col("last_status") == F.col("__terminal"), F.lit(False))
        ).drop("__terminal")
    return checked.drop("__seqs", "__ids")


def span_lineage(
    spans: DataFrame,
    trace: str = "trace_id",
    span_id: str = "id",
    parent: str = "parent_span_id",
    *,
    hot_min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """Per trace: duplicate ids, roots, orphans and spans that never reach a root.

    Pointer doubling: after k rounds a span points 2^k steps up, so rounds grow with the logarithm of
    the trace size. Only spans that have not arrived yet take part in the next round.
    """
    t, i = "__trace", "__id"
    nodes = spans.select(column(trace).alias(t), column(span_id).alias(i), column(parent).alias("__up"))
    unique = nodes.groupBy(t, i).agg(
        F.count("*").alias("__copies"), F.min("__up").alias("__up"), F.max(F.col("__up").isNull()).alias("__root")
    )
    unique = cut_lineage(
        unique.withColumn(
            "__state",
            F.when(F.col("__root"), F.lit("arrived")).otherwise(F.lit("open")),
        )
    )
    largest = unique.groupBy(t).count().agg(F.max("count")).first()[0] or 1
    state = unique.select(t, i, "__up", "__state")
    for _ in range(math.ceil(math.log2(largest + 1)) + 1):
        moving = state.filter("__state = 'open'")
        if moving.isEmpty():
            break
        above = state.select(
            t, F.col(i).alias("__up"), F.col("__up").alias("__next"), F.col("__state").alias("__above")
        )
        moved = join_unique(moving, above, [t, "__up"], hot_min_rows=hot_min_rows).select(
            t,
            i,
            F.when(F.col("__above") == "open", F.col("__next")).otherwise(F.col("__up")).alias("__up"),
            F.when(F.col("__above").isNull(), F.lit("orphan"))
            .when(F.col("__above") == "open", F.lit("open"))
            .otherwise(F.col("__above"))
            .alias("__state"),
        )
        state = cut_lineage(state.filter("__state != 'open'").unionByName(moved))
    ends = state.groupBy(t).agg(
        F.count("*").alias("spans"),
        F.count_if(F.col("__state") == "arrived").alias("reaching_root"),
        F.count_if(F.col("__state") == "orphan").alias("below_missing_parent"),
        F.count_if(F.col("__state") == "open").alias("in_cycle"),
    )
    ids = unique.groupBy(t).agg(
        F.sum(F.col("__copies") - 1).alias("duplicate_ids"), F.count_if("__root").alias("roots")
    )
    joined = ends.join(ids, t)
    valid = (
        (F.col("duplicate_ids") == 0) & (F.col("roots") == 1) & (F.col("reaching_root") == F.col("spans"))
    )
    return joined.withColumn("valid", valid).withColumnRenamed(t, "trace")


def latest_events(
    events: DataFrame, key: Sequence[str], arrival: Sequence[str]
) -> DataFrame:
    """One row per event, the last write wins. A keyed aggregate, so retries never pile up in a task."""
    others = [c for c in events.columns if c not in key]
    newest = F.max_by(F.struct(*[column(c) for c in others]), F.struct(*[column(c) for c in arrival]))
    return events.groupBy(*key).agg(newest.alias("__row")).select(*key, "__row.*").select(*events.columns)


def events_after(
    events: DataFrame, run: str, run_value, sequence: str, after: int, batch: int = EVENT_BATCH
) -> DataFrame:
    """Next batch of a run's events behind a cursor, in order."""
    return (
        events.filter((column(run) == F.lit(run_value)) & (column(sequence) > F.lit(after)))
        .orderBy(sequence)
        .limit(batch)
    )


@dataclass(frozen=True)
class Gate:
    """Thresholds a trial run has to meet."""

    min_expectation_rate: float = 1.0
    max_error_rate: float = 0.0
    max_security_event_rate: float = 0.0
    max_average_tokens: float | None = None


def met_expectation() -> Column:
    """A trial counts only without error and in the terminal state its case expects."""
    return (
        F.coalesce(F.col("expectation_met"), F.lit(False))
        & F.coalesce(F.col("error").isNull() | (F.col("error") == ""), F.lit(True))
        & F.coalesce(F.col("terminal_state") == F.col("expected_terminal_state"), F.lit(False))
    )


def _error() -> Column:
    return F.coalesce(F.col("error") != "", F.lit(False))


def trial_summary(trials: DataFrame) -> DataFrame:
    """One row of rates and averages over all trials."""
    return trials.agg(
        F.count("*").alias("trials"),
        F.count_if(met_expectation()).alias("met"),
        F.round(F.avg(met_expectation().cast("int")), 6).alias("expectation_rate"),
        F.round(F.avg(_error().cast("int")), 6).alias("error_rate"),
        F.round(F.avg((F.col("security_events") > 0).cast("int")), 6).alias("security_event_rate"),
        F.round(F.avg(F.coalesce("total_tokens", F.lit(0))), 6).alias("average_total_tokens"),
        F.round(F.avg("duration_ms"), 6).alias("average_duration_ms"),
        F.round(F.avg("spans"), 6).alias("average_spans"),
        F.round(F.avg("events"), 6).alias("average_events"),
        F.coalesce(
            F.bool_and(~F.col("severity").isin("high", "critical") | met_expectation()), F.lit(True)
        ).alias("critical_cases_passed"),
    )


def category_summary(trials: DataFrame) -> DataFrame:
    return trials.groupBy(F.coalesce("category", F.lit("core")).alias("category")).agg(
        F.count("*").alias("cases"),
        F.round(F.avg(F.coalesce("expectation_met", F.lit(False)).cast("int")), 6).alias("expectation_rate"),
        F.round(F.avg(_error().cast("int")), 6).alias("error_rate"),
    )


def trial_key_issues(trials: DataFrame, cases: DataFrame, repeats: int) -> DataFrame:
    """Keys that are missing, unexpected or repeated against every case run ``repeats`` times."""
    expected = cases.select("case_id", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("trial"))
    actual = trials.groupBy("case_id", "trial").agg(F.count("*").alias("n"))
    both = expected.withColumn("wanted", F.lit(True)).join(actual, ["case_id", "trial"], "full")
    issue = (
        F.when(F.col("n").isNull(), F.lit("MISSING"))
        .when(F.col("wanted").isNull(), F.lit("UNEXPECTED"))
        .when(F.col("n") > 1, F.lit("REPEATED"))
    )
    return both.withColumn("issue", issue).filter("issue is not null").select("case_id", "trial", "issue")


def gate_table(summary: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """``(name, actual, expected, passed)``; a failed critical case fails the gate by itself."""
    checks = [
        ("expectation_rate", F.col("expectation_rate"), f">={gate.min_expectation_rate}",
         F.col("expectation_rate") >= gate.min_expectation_rate),
        ("error_rate", F.col("error_rate"), f"<={gate.max_error_rate}", F.col("error_rate") <= gate.max_error_rate),
        ("security_event_rate", F.col("security_event_rate"), f"<={gate.max_security_event_rate}",
         F.col("security_event_rate") <= gate.max_security_event_rate),
        ("critical_cases_passed", F.col("critical_cases_passed").cast("double"), "true",
         F.col("critical_cases_passed")),
    ]
    if gate.max_average_tokens is not None:
        checks.append(
            ("average_total_tokens", F.col("average_total_tokens"), f"<={gate.max_average_tokens}",
             F.col("average_total_tokens") <= gate.max_average_tokens)
        )
    return summary.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("name"),
                        actual.cast("double").alias("actual"),
                        F.lit(expected).alias("expected"),
                        F.coalesce(passed, F.lit(False)).alias("passed"),
                    )
                    for name, actual, expected, passed in checks
                ]
            )
        )
    )


def gate_verdict(gate: DataFrame) -> DataFrame:
    return gate.agg(F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed_checks"))


def pair_with_baseline(
    baseline: DataFrame, candidate: DataFrame, measures: Sequence[str], key: Sequence[str] = ("case_id", "trial")
) -> DataFrame:
    """Full pairing by key with deltas; a key on one side only makes the runs incomparable."""
    left = baseline.select(*key, *[column(m).alias(f"baseline_{m}") for m in measures], F.lit(True).alias("__l"))
    right = candidate.select(*key, *[column(m).alias(f"candidate_{m}") for m in measures], F.lit(True).alias("__r"))
    paired = left.join(right, list(key), "full")
    where = (
        F.when(F.col("__r").isNull(), F.lit("baseline_only"))
        .when(F.col("__l").isNull(), F.lit("candidate_only"))
        .otherwise(F.lit("paired"))
    )
    return paired.select(
        *key,
        where.alias("pairing"),
        *[
            F.round(F.col(f"candidate_{m}").cast("double") - F.col(f"baseline_{m}").cast("double"), 6).alias(f"{m}_delta")
            for m in measures
        ],
    )


def baseline_comparison(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Are the key sets identical, and how far do the rates move?"""
    keys = ["case_id", "trial"]

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.count("*").alias("n"),
            F.count_if(met_expectation()).alias("met"),
            F.count_if(_error()).alias("errors"),
        ).withColumn("side", F.lit(sign))

    both = side(baseline, 0).unionByName(side(candidate, 1))
    left, right = F.col("side") == 0, F.col("side") == 1
    per_key = both.groupBy(*keys).agg(
        *[
            F.sum(F.when(s, F.col(c)).otherwise(0)).alias(f"{name}_{c}")
            for name, s in (("b", left), ("c", right))
            for c in ("n", "met", "errors")
        ]
    )
    total = per_key.agg(
        F.bool_and((F.col("b_n") == 1) & (F.col("c_n") == 1)).alias("trial_keys_match"),
        *[F.sum(f"{s}_{c}").alias(f"{s}_{c}") for s in "bc" for c in ("n", "met", "errors")],
    )

    def delta(c: str) -> Column:
        new = F.round(F.try_divide(f"c_{c}", "c_n"), 6)
        old = F.round(F.try_divide(f"b_{c}", "b_n"), 6)
        return F.round(new - old, 6)

    return total.select(
        "trial_keys_match",
        delta("met").alias("expectation_rate_delta"),
        delta("errors").alias("error_rate_delta"),
    )


def manifest_differences(
    pairs: DataFrame,
    key: str,
    baseline: str = "baseline",
    candidate: str = "candidate",
    fields: Sequence[str] = fixed.MANIFEST_FIELDS,
) -> DataFrame:
    """Fields on which two JSON manifests of the same key differ, NULL-safe."""
    structs = []
    for f in fields:
        structs.append(
            F.struct(
                F.lit(f).alias("field"),
                F.get_json_object(baseline, f"$.{f}").alias("baseline_value"),
                F.get_json_object(candidate, f"$.{f}").alias("candidate_value"),
            )
        )
    return (
        pairs.select(column(key).alias("key"), F.inline(F.array(*structs)))
        .filter(~F.col("baseline_value").eqNullSafe(F.col("candidate_value")))
    )


def usage_by_run(requests: DataFrame, run: str, usage: str, status: str) -> DataFrame:
    """Requests, tokens and status counts per run; tokens come from the usage JSON."""
    tokens = F.coalesce(F.get_json_object(usage, "$.total_tokens").try_cast("bigint"), F.lit(0))
    return requests.groupBy(column(run).alias("run")).agg(
        F.count("*").alias("provider_request_count"),
        F.sum(tokens).alias("total_tokens"),
        *[F.count_if(column(status) == s).alias(s) for s in SPAN_END_STATES],
    )


def usage_by_month(requests: DataFrame, created: str, usage: str) -> DataFrame:
    tokens = F.coalesce(F.get_json_object(usage, "$.total_tokens").try_cast("bigint"), F.lit(0))
    return requests.groupBy(F.date_format(created, "yyyy-MM").alias("month")).agg(
        F.sum(tokens).alias("total_tokens")
    )


def over_budget(usage: DataFrame, budget: int, requested: int = 0) -> DataFrame:
    """Would one more request of this size break the budget? No budget means never."""
    used = F.col("total_tokens")
    hit = (used + requested > budget) if budget else F.lit(False)
    return usage.withColumn("over_budget", hit)


def span_duration_ms(start: str | Column, end: str | Column) -> Column:
    """Whole milliseconds between two timestamps, never negative, 0 when one is missing."""
    micros = F.unix_micros(column(end).cast("timestamp")) - F.unix_micros(column(start).cast("timestamp"))
    return F.coalesce(F.greatest(F.lit(0), F.floor(micros / F.lit(1000))), F.lit(0)).cast("long")


def finish_spans(spans: DataFrame, start: str = "started_at", end: str = "finished_at") -> DataFrame:
    return spans.withColumn("duration_ms", span_duration_ms(start, end))


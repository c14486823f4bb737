"""Integrity of runs as their events arrive: keyed state instead of merging the whole history on each read.

A run's state is its number of events, the sequences seen as intervals, the last status, the last ``ids_kept`` event ids and
what was found wrong so far. It grows with the gaps of a run and not with its events. A micro-batch touches only the runs in
it. A doubled id is noticed while the id is among those kept; a doubled or missing sequence always is. A run
without events for ``silent_after`` is reported once as silent.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

BATCH = "arrival_batch"
IDS_KEPT = 10_000
FACTS = (
    "run string, n_events long, first_seq long, last_seq long, last_status string, contiguous boolean, unique_ids boolean, silent boolean"
)
STATE = "n long, intervals string, doubled boolean, last_seq long, last_status string, ids string, unique_ids boolean"


def add_sequence(intervals: list[list[int]], seq: int) -> bool:
    """Add a number to sorted, separate intervals; False if it was there."""
    k = bisect.bisect_right(intervals, [seq, float("inf")]) - 1
    if k >= 0 and intervals[k][0] <= seq <= intervals[k][1]:
        return False
    joins_left = k >= 0 and intervals[k][1] == seq - 1
    joins_right = k + 1 < len(intervals) and intervals[k + 1][0] == seq + 1
    if joins_left and joins_right:
        intervals[k][1] = intervals.pop(k + 1)[1]
    elif joins_left:
        intervals[k][1] = seq
    elif joins_right:
        intervals[k + 1][0] = seq
    else:
        intervals.insert(k + 1, [seq, seq])
    return True


def _checked(ids_kept: int, silent_ms: int | None) -> Callable:
    names = [f.split()[0] for f in FACTS.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, spans, doubled, last, status, seen, unique = state.get if state.exists else (0, "[]", False, None, None, "[]", True)
        intervals, ids = json.loads(spans), dict.fromkeys(json.loads(seen))
        silent = state.hasTimedOut
        if not silent:
            for part in parts:
                n += len(part)
                for seq, event, now in zip(part["seq"], part["id"], part["status"]):
                    if not pd.isna(seq):
                        doubled |= not add_sequence(intervals, int(seq))
                        if last is None or seq >= last:
                            last, status = int(seq), now
                    unique &= event is not None and event not in ids
                    ids[event] = None
            ids = dict.fromkeys(list(ids)[-ids_kept:])
            if silent_ms:
                state.setTimeoutDuration(silent_ms)
        state.update((n, json.dumps(intervals), bool(doubled), last, status, json.dumps(list(ids)), bool(unique)))
        contiguous = not doubled and intervals == [[1, n]]
        first = intervals[0][0] if intervals else None
        facts = (key[0], n, first, last, status, contiguous, bool(unique), silent)
        # One frame for a run and micro-batch; casts of single columns would cost more than the rest of the work.
        yield pd.DataFrame({name: [fact] for name, fact in zip(names, facts)})

    return run


def run_facts(events: DataFrame, ids_kept: int = IDS_KEPT, silent_after: int | None = None) -> DataFrame:
    """Stream of ``FACTS``, one row for every run that a micro-batch touches, from a stream of (run, seq, id, status)."""
    given = events.select(
        F.col("run").cast("string").alias("run"), F.col("seq").cast("long").alias("seq"), F.col("id").cast("string").alias("id"), "status"
    )
    timeout = GroupStateTimeout.ProcessingTimeTimeout if silent_after else GroupStateTimeout.NoTimeout
    check = _checked(ids_kept, silent_after * 1000 if silent_after else None)
    return given.groupBy("run").applyInPandasWithState(check, FACTS, STATE, "update", timeout)


def follow(facts: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write the facts of every micro-batch to a folder of its own; a replayed batch writes it again."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{BATCH}={number}")

    return (
        facts.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_runs(spark: SparkSession, target: str) -> DataFrame:
    """The latest facts of every run."""
    schema = StructType([*spark.createDataFrame([], FACTS).schema.fields, StructField(BATCH, LongType())])
    rows = spark.read.schema(schema).option("basePath", target).parquet(target)
    facts = [f.split()[0] for f in FACTS.split(", ")]
    latest = F.max_by(F.struct(*facts), BATCH).alias("f")
    return rows.groupBy(F.col("run").alias("key")).agg(latest).select("f.*")

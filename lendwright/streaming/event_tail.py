"""Event tail as a stream: the checkpoint is the cursor, the last write of an event wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from lendwright.operators.runlogs import latest_events
from lendwright.operators.scoring import ScorecardRules, score_with_rules

BATCH = "arrival_batch"


def tail(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    target: str,
    checkpoint: str,
    *,
    file_format: str = "parquet",
    pattern: str | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Append every new event to ``target``, one folder per micro-batch.

    A replayed batch overwrites its own folder, so a restart from the checkpoint neither loses nor
    doubles events. Nothing is kept in streaming state. The query stops when it has caught up.
    """
    reader = spark.readStream.format(file_format).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{BATCH}={number}")

    return (
        reader.load(source)
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_events(
    spark: SparkSession, target: str, schema: StructType, key: Sequence[str], arrival: Sequence[str] = ()
) -> DataFrame:
    """Events as of now: one row per key, later batches win, then the ``arrival`` columns."""
    stored = StructType([*schema.fields, StructField(BATCH, LongType())])
    raw = spark.read.schema(stored).option("basePath", target).parquet(target)
    return latest_events(raw, key, [BATCH, *arrival]).drop(BATCH)


def compact(
    spark: SparkSession, target: str, schema: StructType, key: Sequence[str], output: str, arrival: Sequence[str] = ()
) -> None:
    """Write the current events once, so that later reads need not merge all batches again."""
    current_events(spark, target, schema, key, arrival).write.parquet(output)


def score_stream(events: DataFrame, rules: ScorecardRules, output: str = "probability") -> DataFrame:
    """Scorecard rules on a stream: the same projection as in batch, without state."""
    return score_with_rules(events, rules, output)


"""Usage per event-time window as a stream; rows behind the watermark go to a table of their own instead of being dropped.

Every micro-batch writes three folders named by its number: sums per window and key, late rows, and the latest event time it
has seen. The watermark of a batch is the latest time of all earlier batches less the allowed delay. A batch that is run again
writes the same folders again, so sums plus late rows always equal a batch query over all rows. Nothing is kept in
streaming state, and a window with most of the rows is summed on the map side first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

SUMS, LATE, MARKS = "sums", "late", "marks"
BATCH = "arrival_batch"


def _folder(target: str, part: str) -> str:
    return f"{target.rstrip('/')}/{part}"


def _watermark(spark: SparkSession, target: str, number: int, delay: str) -> Column:
    """Latest time of the batches before ``number`` less ``delay``; NULL at first."""
    if number == 0:
        return F.lit(None).cast("timestamp_ntz")
    marks = spark.read.parquet(_folder(target, MARKS)).filter(F.col(BATCH) < number)
    latest = marks.agg(F.max("latest") - F.expr(f"INTERVAL {delay}")).first()[0]
    return F.lit(latest).cast("timestamp_ntz")


def windowed_usage(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    target: str,
    checkpoint: str,
    *,
    time: str,
    keys: Sequence[str],
    amount: Column,
    window: str = "1 hour",
    delay: str = "2 hours",
    file_format: str = "parquet",
    pattern: str | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Requests and ``amount`` per window of ``time`` and keys. The query stops when it has caught up."""
    reader = spark.readStream.format(file_format).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def save(batch: DataFrame, number: int) -> None:
        mark = _watermark(batch.sparkSession, target, number, delay)
        at = F.col(time).cast("timestamp_ntz")
        late = F.coalesce(at < mark, F.lit(False))
        sums = batch.filter(~late).groupBy(F.window(at, window)["start"].alias("window_start"), *keys)
        for part, rows in (
            (SUMS, sums.agg(F.count("*").alias("requests"), F.sum(amount).alias("amount"))),
            (LATE, batch.filter(late)),
            (MARKS, batch.agg(F.max(at).alias("latest"))),
        ):
            rows.write.mode("overwrite").parquet(f"{_folder(target, part)}/{BATCH}={number}")

    return (
        reader.load(source)
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def window_totals(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame:
    """Sums per window and key over all batches."""
    parts = spark.read.parquet(_folder(target, SUMS))
    return parts.groupBy("window_start", *keys).agg(F.sum("requests").alias("requests"), F.sum("amount").alias("amount"))


def late_rows(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """Rows that came after their window was closed."""
    try:
        return spark.read.schema(schema).parquet(_folder(target, LATE))
    except AnalysisException:  # nothing has arrived yet
        return spark.createDataFrame([], schema)

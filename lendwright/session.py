"""Session settings and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lendwright", cores: int | str = "*", partitions: int | None = None) -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions or 8))
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("CHECKPOINT_DIR_REQUIRED: set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="lendwright-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def scratch_path(spark: SparkSession, purpose: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/lendwright/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str = "table") -> DataFrame:
    """Write once to the shared folder and read back: later passes are column-pruned scans, and a
    lost executor costs a re-read instead of the joins behind the table."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """End a growing plan with a written table, so that an iteration never replays earlier rounds."""
    return materialize(df, "lineage")

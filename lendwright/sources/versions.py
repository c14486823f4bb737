"""Immutable dataset versions with lineage, as Parquet folders beside a lineage table.

A version is committed by its lineage row, which is written last: after the data files and a manifest with size, rows
and content fingerprint of every file. What a crash leaves behind is no version; ``uncommitted`` lists it. The manifest
tells which files differ, and only files whose size or time differ have to be read for that.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lendwright.functions.expressions import column

MAX_LABEL = 240
LINEAGE_SCHEMA = (
    "version string, label string, kind string, parents array<string>, details string, `rows` long, "
    "`columns` int, fingerprint string, frozen boolean, created_at timestamp"
)


def fingerprint_columns(columns: Sequence[str]) -> list:
    """Order-insensitive content fingerprint: row count and the exact sum of row hashes."""
    hashed = F.xxhash64(*[column(c) for c in columns]).cast("decimal(38,0)")
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(hashed), F.lit(0).cast("decimal(38,0)")).cast("string").alias("fingerprint"),
    ]


def fingerprint(df: DataFrame) -> DataFrame:
    return df.agg(*fingerprint_columns(df.columns))


MANIFEST_SCHEMA = "file string, bytes long, modified timestamp, `rows` long, fingerprint string"


def file_facts(stored: DataFrame) -> DataFrame:
    """Size, time, rows and fingerprint of the files behind a table that was read from files; files without rows do not count."""
    about = F.col("_metadata")
    named = stored.select(
        "*", about["file_name"].alias("__file"), about["file_size"].alias("__bytes"), about["file_modification_time"].alias("__modified")
    )
    facts = named.groupBy("__file", "__bytes", "__modified").agg(*fingerprint_columns(stored.columns))
    return facts.select(F.col("__file").alias("file"), F.col("__bytes").alias("bytes"), F.col("__modified").alias("modified"), "rows", "fingerprint")


def version_path(root: str, version: str) -> str:
    return f"{root.rstrip('/')}/versions/version={version}"


def manifest_path(root: str, version: str) -> str:
    return f"{root.rstrip('/')}/manifests/version={version}"


def lineage_path(root: str) -> str:
    return f"{root.rstrip('/')}/lineage"


def write_version(
    df: DataFrame,
    root: str,
    label: str,
    *,
    kind: str = "materialize",
    parents: Sequence[str] = (),
    details: Mapping | None = None,
    frozen: bool = False,
) -> str:
    """Write a version once and fingerprint what was written, so that the lineage row describes the
    stored files and not a plan that a retried task may have evaluated twice."""
    if len(label) > MAX_LABEL:
        raise ValueError(f"VERSION_LABEL_TOO_LONG: {len(label)}")
    version = f"dsv_{uuid.uuid4().hex[:12]}"
    path = version_path(root, version)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    file_facts(stored).coalesce(1).write.parquet(manifest_path(root, version))
    files = df.sparkSession.read.schema(MANIFEST_SCHEMA).parquet(manifest_path(root, version))
    total = F.coalesce(F.sum(F.col("fingerprint").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")
    facts = files.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), total.alias("fingerprint")).first()
    row = (
        version,
        label,
        kind,
        list(parents),
        json.dumps(dict(details or {}), sort_keys=True, ensure_ascii=False),
        facts["rows"],
        len(df.columns),
        facts["fingerprint"],
        frozen,
        datetime.now(timezone.utc).replace(tzinfo=None),
    )
    df.sparkSession.createDataFrame([row], LINEAGE_SCHEMA).write.mode("append").parquet(lineage_path(root))
    return version


def lineage(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(LINEAGE_SCHEMA).parquet(lineage_path(root))


def read_version(spark: SparkSession, root: str, version: str, *, verify: bool = True) -> DataFrame:
    """Read a version back; with ``verify`` its content must still match the lineage row."""
    recorded = lineage(spark, root).filter(F.col("version") == version).first()
    if recorded is None:
        raise ValueError(f"DATASET_VERSION_NOT_FOUND: {version}")
    df = spark.read.parquet(version_path(root, version))
    if verify:
        _check(df, recorded)
    return df


def _check(df: DataFrame, recorded) -> None:
    found = fingerprint(df).first()
    if found["rows"] != recorded["rows"] or found["fingerprint"] != recorded["fingerprint"]:
        raise ValueError("DATA_FILE_CHECKSUM_MISMATCH")


def changed_files(spark: SparkSession, root: str, version: str) -> DataFrame:
    """(file, status, rows) of the files that are missing, added or changed since the version was written.

    Files of the recorded size and time are taken as they are; only the others are read and hashed.
    """
    recorded = spark.read.schema(MANIFEST_SCHEMA).parquet(manifest_path(root, version))
    path = version_path(root, version)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    listed = listed.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", F.col("length").alias("bytes_now"), "modificationTime")
    both = recorded.join(listed, "file", "full")
    same = (F.col("bytes") == F.col("bytes_now")) & (F.col("modified") == F.col("modificationTime"))
    suspects = both.filter(F.col("path").isNotNull() & ~F.coalesce(same, F.lit(False))).select("path").collect()
    gone = both.filter(F.col("path").isNull()).select("file", F.lit("missing").alias("status"), "rows")
    if not suspects:
        return gone
    schema = spark.read.parquet(path).schema
    facts = file_facts(spark.read.schema(schema).parquet(*[r["path"] for r in suspects])).select(
        "file", F.col("rows").alias("rows_now"), F.col("fingerprint").alias("now")
    )
    seen = facts.join(recorded.select("file", "rows", "fingerprint"), "file", "left")
    status = F.when(F.col("fingerprint").isNull(), "added").when(
        (F.col("fingerprint") != F.col("now")) | (F.col("rows") != F.col("rows_now")), "changed"
    )
    return gone.unionByName(seen.withColumn("status", status).filter("status IS NOT NULL").select("file", "status", F.col("rows_now").alias("rows")))


def uncommitted(spark: SparkSession, root: str) -> list[str]:
    """Version folders without a lineage row: what an interrupted write has left."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{root.rstrip('/')}/versions/*")
    found = listed.select(F.regexp_extract("path", "/version=([^/]+)/", 1).alias("version")).distinct()
    try:
        known = lineage(spark, root).select("version")
    except AnalysisException:  # nothing was ever committed
        known = found.limit(0)
    return sorted(r["version"] for r in found.join(known, "version", "left_anti").collect())


@contextmanager
def verified_read(spark: SparkSession, root: str, version: str) -> Iterator[DataFrame]:
    """A version whose content is checked before its use and once more after it."""
    df = read_version(spark, root, version)
    yield df
    _check(spark.read.parquet(version_path(root, version)), lineage(spark, root).filter(F.col("version") == version).first())


def ancestors(spark: SparkSession, root: str, version: str) -> list[str]:
    """All versions a version was made from, nearest first: one look at the lineage table per generation."""
    found: list[str] = []
    generation = [version]
    while generation:
        rows = lineage(spark, root).filter(F.col("version").isin(*generation)).select("version", "parents").collect()
        parents = {r["version"]: r["parents"] for r in rows}
        following = dict.fromkeys(p for v in generation for p in parents.get(v, []))
        generation = [p for p in following if p not in found]
        found += generation
    return found

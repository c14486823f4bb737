"""CSV and dictionary sources, table sizes, CSV sink."""

from __future__ import annotations

import codecs
import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lendwright.functions import fixed_values as fixed
from lendwright.functions.expressions import column, is_pii_name

ENCODING_SAMPLE = 131_072
DELIMITER_SAMPLE = 8_192

# Texts that mean "no value" in a CSV cell.
NO_VALUE = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Names the JVM uses for the probed encodings.
JVM_CHARSETS = {
    "utf-8-sig": "UTF-8", "utf-8": "UTF-8", "gb18030": "GB18030", "big5": "Big5", "latin1": "ISO-8859-1",
}


def file_head(spark: SparkSession, path: str, size: int) -> bytes:
    """First bytes of a file, or of the first data file of a folder, on any file system Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getFileStatus(where).isDirectory():
        inside = sorted(
            s.getPath().toString()
            for s in system.listStatus(where)
            if s.isFile() and not s.getPath().getName().startswith(("_", "."))
        )
        if not inside:
            raise ValueError(f"EMPTY_FOLDER: {path}")
        where = spark._jvm.org.apache.hadoop.fs.Path(inside[0])
    stream = system.open(where)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def detect_encoding(sample: bytes) -> str:
    """First encoding that decodes the sample; a character cut by the sample's end does not count."""
    for name in fixed.CSV_ENCODINGS:
        try:
            codecs.getincrementaldecoder(name)().decode(sample, final=False)
            return name
        except UnicodeDecodeError:
            continue
    return fixed.CSV_FALLBACK_ENCODING


def detect_delimiter(sample: bytes, encoding: str) -> str:
    text = sample[:DELIMITER_SAMPLE].decode(encoding, errors="replace")
    try:
        return csv.Sniffer().sniff(text, delimiters=fixed.CSV_DELIMITERS).delimiter
    except csv.Error:
        return ","


def read_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    limit: int | None = None,
    *,
    schema: T.StructType | str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """CSV with probed encoding and delimiter; types come from ``schema`` or one pass over the data.

    ``limit`` is the row-limit feature of the reader. ``multiline`` allows line breaks inside quotes
    but keeps a file from being split, so it is off unless asked for.
    """
    sample = file_head(spark, path, ENCODING_SAMPLE)
    encoding = detect_encoding(sample)
    if encoding in ("gb18030", "big5"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    reader = (
        spark.read.option("header", True)
        .option("sep", detect_delimiter(sample, encoding))
        .option("encoding", JVM_CHARSETS[encoding])
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
    )
    if schema is not None:
        frame = reader.schema(schema).csv(path)
        frame = frame.select(*columns) if columns is not None else frame
        return frame.limit(limit) if limit is not None else frame
    raw = reader.option("inferSchema", False).csv(path)
    raw = raw.select(*[column(c) for c in (columns if columns is not None else raw.columns)])
    raw = raw.limit(limit) if limit is not None else raw
    blank = raw.select(
        *[F.when(~F.trim(column(c)).isin(*NO_VALUE), column(c)).alias(c) for c in raw.columns]
    )
    return _typed(blank)


def _typed(raw: DataFrame) -> DataFrame:
    """Cast every text column to the narrowest of bigint, double and boolean that loses no value."""
    seen = raw.agg(
        *[
            F.struct(
                F.count(column(c)).alias("n"),
                F.count(column(c).try_cast("bigint")).alias("whole"),
                F.count(column(c).try_cast("double")).alias("real"),
                F.count_if(column(c).isin("True", "False", "TRUE", "FALSE", "true", "false")).alias("flag"),
            ).alias(f"s{i}")
            for i, c in enumerate(raw.columns)
        ]
    ).first()
    casts = []
    for i, c in enumerate(raw.columns):
        s = seen[f"s{i}"]
        kind = next((k for k, hit in (("bigint", "whole"), ("double", "real"), ("boolean", "flag")) if s[hit] == s["n"]), None)
        casts.append(column(c).try_cast(kind).alias(c) if kind and s["n"] else column(c))
    return raw.select(*casts)


def write_csv(df: DataFrame, path: str, *, drop_pii: bool = False) -> None:
    """CSV with header in UTF-8. Spark writes no byte-order mark."""
    frame = df.drop(*[c for c in df.columns if is_pii_name(c)]) if drop_pii else df
    frame.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def table_estimate(df: DataFrame, name: str) -> DataFrame:
    """Rows and columns; for Parquet the count comes from the footers."""
    return df.agg(F.count("*").alias("rows")).select(
        F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns")
    )


def parse_dictionary(df: DataFrame) -> DataFrame:
    """Data dictionary as ``field, description, role, missing_codes``; headers in either language."""
    headers: dict[str, str] = {}
    for name in df.columns:
        for role, aliases in fixed.DICTIONARY_HEADERS.items():
            if name.strip().lower() in aliases:
                headers[role] = name
    if "field" not in headers:
        raise ValueError("DATA_DICTIONARY_FIELD_COLUMN_REQUIRED")

    def text(role: str):
        if role not in headers:
            return F.lit("")
        return F.coalesce(F.trim(column(headers[role]).cast("string")), F.lit(""))

    codes = F.filter(
        F.transform(F.split(text("missing_codes"), fixed.DICTIONARY_CODE_SEPARATOR), lambda c: F.trim(c)),
        lambda c: c != "",
    )
    return df.select(
        text("field").alias("field"),
        text("description").alias("description"),
        text("role").alias("role"),
        codes.alias("missing_codes"),
    ).filter((F.col("field") != "") & (F.lower("field") != "nan"))

"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lendwright.llm import benchmark_index, language_crf, line_dedup, piece_transducer, simhash_dedup
from lendwright.llm.queries import PIECE_MODEL
from lendwright.plans.loan import table
from lendwright.session import materialize

#: A text whose words speak for its language with less than this mean probability has no main language.
LEAST_LANGUAGE_SCORE = 0.35
#: A line in this many documents is boilerplate.
COMMON_LINE_DOCS = 10

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay."""
    return language_crf.keep_known(docs, LEAST_LANGUAGE_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from the texts; n_chars follows, and every document stays."""
    cut = line_dedup.drop_lines(docs, COMMON_LINE_DOCS)
    counted = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(counted))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of texts that share 0.8 of their five-word shingles stays, and all other documents."""
    return simhash_dedup.drop_verified_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return benchmark_index.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and the digest of what they decode to."""
    return piece_transducer.encode_texts(docs, piece_transducer.read_model(PIECE_MODEL))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("decontaminated", decontaminated),
    ("encoded", encoded),
]

#: A trained model and token ids have no SQL counterpart; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

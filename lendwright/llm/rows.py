"""Identity of document rows and text columns that several operators share.

A row is identified by two 64-bit hashes of its id and text: the key is the same whenever a lost
partition is computed again, and it exists for NULL ids too. Rows that repeat in both share a key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Internal columns carry this prefix; functions that pass on all columns are ``own_names``.
PREFIX = "__llm_"
K1, K2 = f"{PREFIX}k1", f"{PREFIX}k2"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Texts without other than ASCII characters take the fast function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_hashes(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """The key of a row. A NULL text differs from an empty one, a NULL id from every id."""
    mark = F.when(F.col(text).isNull(), 1).otherwise(0) + F.when(F.col(doc_id).isNull(), 2).otherwise(0)
    return [
        F.xxhash64(mark, F.col(doc_id), F.col(text)).alias(K1),
        F.xxhash64(F.col(text), F.col(doc_id), mark + 4).alias(K2),
    ]


def with_key(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select("*", *row_hashes(doc_id, text))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn labels from: crc32 of the id's text leaves 2 when divided by 4.

    A NULL id has no checksum; such a row is held out as well, so that nothing is learnt from it.
    """
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def own_names(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let a function from documents to the same columns take columns of any name: those that look like internal ones
    have other names while it works."""

    @wraps(stage)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        odd = {c: f"input {i} {c}" for i, c in enumerate(docs.columns) if c.lower().startswith(PREFIX)}
        if not odd:
            return stage(docs, *args, **options)
        renamed = docs.toDF(*[odd.get(c, c) for c in docs.columns])
        return stage(renamed, *args, **options).toDF(*docs.columns)

    return run

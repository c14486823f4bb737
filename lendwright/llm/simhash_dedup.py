"""SimHash near-dedup with a byte-position inverted index and count filtering.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most ``max_bits`` bits share at
least 8 - max_bits of them, so they meet in at least one posting list of a family of byte sets that hits every
such choice. In a list, pairs are tallied by the positional bytes they share; those with the guaranteed minimum
are verified by their differing bits. Equal fingerprints form one class before anything is paired, and a pair
is emitted only in the first list in which it meets.

``drop_verified_copies`` is the stage of a corpus pipeline: pairs that the index proposes for the fingerprints of five-word
shingle sets are verified by their exact similarity (0.8 or more) before they count. A fingerprint of 64 bits does not
find all such pairs (at 0.8 they differ in about 10 bits), so the bands of ``shingle_dedup`` propose the others, and both
kinds of proposals go through one verification and one contraction.

Defined cases: a NULL, empty or blank text has fingerprint zero; rows with a NULL id get the component of their
text, and an id is never NULL where the component holds any other; repeated rows fall into one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lendwright.llm import shingle_dedup
from lendwright.llm.components import components
from lendwright.llm.rows import own_names, row_hashes, with_key, K1, K2
from lendwright.llm.words import pieces, words
from lendwright.session import materialize

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
BYTES = 8
POSTING_BYTES = 4


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        for piece in pieces(batch, "text"):
            found = words(piece.column(1), lower=True)
            strings = found.strings()
            values = np.zeros(len(piece), np.uint64)
            for row, (a, b) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist())):
                if a < b:
                    own = strings[a:b]
                    n = min(SHINGLE_WORDS, b - a)
                    grams = map(b" ".join, zip(*[own[i : len(own) - n + 1 + i] for i in range(n)]))
                    values[row] = majority(np.array([digest(g, SEED) for g in grams], np.uint64))
            columns = [piece.column(0), piece.column(2), piece.column(3), pa.array(values.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", K1, K2, "fp"])


def majority(hashes: np.ndarray) -> np.uint64:
    """Bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), 1 << 16):
        part = hashes[begin : begin + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row key, fp) of every row; ``fp`` holds the 64 bits as a long."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *row_hashes(doc_id, text))
    return given.mapInArrow(_fingerprints, f"doc_id long, {K1} long, {K2} long, fp long")


def byte_sets(shared: int, size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` byte positions such that any ``shared`` positions contain one of them (greedy choice)."""
    open_ = {frozenset(c) for c in combinations(range(BYTES), shared)}
    chosen = []
    while open_:
        best = max(combinations(range(BYTES), size), key=lambda s: sum(frozenset(s) <= o for o in open_))
        open_ = {o for o in open_ if not frozenset(best) <= o}
        chosen.append(best)
    return chosen


def _mask(positions: tuple[int, ...]) -> Column:
    value = sum(0xFF << (8 * p) for p in positions)
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, each once, that differ in at most ``max_bits`` bits."""
    if not 0 <= max_bits < BYTES:
        raise ValueError("MAX_BITS_RANGE")
    shared = BYTES - max_bits
    sets = byte_sets(shared, min(POSTING_BYTES, shared))
    postings = fps.select(
        F.col("fp"), F.posexplode(F.array(*[F.col("fp").bitwiseAND(_mask(s)) for s in sets])).alias("set", "bytes")
    )
    left = postings.select("set", "bytes", F.col("fp").alias("a"))
    right = postings.select(F.col("set").alias("set_b"), F.col("bytes").alias("bytes_b"), F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    same = [F.when(differ.bitwiseAND(_mask((p,))) == 0, 1).otherwise(0) for p in range(BYTES)]
    tally = sum(same[1:], same[0])
    first = F.lit(len(sets))
    for k in reversed(range(len(sets))):
        first = F.when(differ.bitwiseAND(_mask(sets[k])) == 0, k).otherwise(first)
    meets = (
        (F.col("set") == F.col("set_b"))
        & (F.col("bytes") == F.col("bytes_b"))
        & (F.col("a") < F.col("b"))
        & (tally >= shared)
        & (F.bit_count(differ) <= max_bits)
        & (first == F.col("set"))
    )
    return left.join(right, meets).select("a", "b")


def near_components(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, row key, fp, root, component_id) of every row.

    ``root`` names the component, ``component_id`` is the smallest id that links lead to.
    """
    fps = materialize(fingerprints(docs), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(classes.select("fp"), max_bits))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


@own_names
def drop_near_copies(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of every component, with all its columns: the one with the smallest id.

    Rows without an id come last; among rows that repeat an id with other texts the smallest row key wins.
    """
    found = near_components(docs.select("doc_id", "text"), max_bits)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", K1, K2)
    winners = found.groupBy("root").agg(F.min(order).alias("w")).select(F.col("w")[K1].alias(K1), F.col("w")[K2].alias(K2))
    kept = with_key(docs).join(winners, [K1, K2], "left_semi").dropDuplicates([K1, K2])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def proposals(found: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a < b) of the classes in ``found`` (class, fp) whose fingerprints are equal or differ in at most ``max_bits`` bits.

    Classes of one fingerprint are paired with the first of them, and only the firsts of two fingerprints with each other.
    """
    classes = found.groupBy("class").agg(F.first("fp").alias("fp"))
    firsts = materialize(classes.groupBy("fp").agg(F.min("class").alias("first")), "fingerprints")
    equal = classes.join(firsts, "fp").where("class <> first").select(F.col("first").alias("a"), F.col("class").alias("b"))
    near = links(firsts.select("fp"), max_bits)
    for side in "ab":
        name = firsts.select(F.col("fp").alias(side), F.col("first").alias(f"class_{side}"))
        near = near.join(name, side)
    return equal.union(near.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")))


@own_names
def drop_verified_copies(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of every group of near copies, with all its columns: the one with the smallest id.

    Near copies share at least 0.8 of their five-word shingles, exactly; no other text goes.
    """
    return shingle_dedup.drop_similar(docs, lambda found: proposals(found, max_bits))


def report(docs: DataFrame) -> DataFrame:
    found = near_components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Near-dedup by exact Jaccard similarity of word shingles.

The shingles of a text are its distinct runs of ``SHINGLE_WORDS`` words (A-Z lower-cased); a text of fewer words is one
shingle. Two texts are near copies if they share at least ``LEAST`` of the shingles that either has; one
document of every component of near copies stays.

1. Texts of equal shingles form one class, known by 128 bits. MinHash bands of ``ROWS`` values propose pairs of classes: two
   texts of similarity s have one of ``BANDS`` bands in common with probability 1 - (1 - s^ROWS)^BANDS. ``miss_bound``
   computes the rest: 2.7 in 100,000 at a similarity of 0.8, 4 in 10 million at 0.85.
2. Neighbours in a bucket (in the order of their class) are verified by their texts, and verified pairs are joined to components.
   A large group of copies comes together here with as many pairs as it has members.
3. Buckets that still hold several components are traversed as signature trees (``signature_trees``): bitmaps bound the overlap of two
   sets from above, and only pairs across components that can reach the similarity are decided, by the sets and inside a task. Links
   that join components come out, and no pairs of texts that are not near enough.

Sizes of the sets rule a pair out without its texts. Defined cases: NULL, empty and blank texts have no shingles and form
one class; rows with a NULL id come last when one is kept; repeated rows are one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lendwright.llm import signature_trees
from lendwright.llm.components import components
from lendwright.llm.rows import own_names, row_hashes, with_key, K1, K2
from lendwright.llm.words import Words, gram_hashes, mix, pieces, words
from lendwright.session import materialize

SHINGLE_WORDS = 5
#: Shared shingles / all shingles, as a fraction of whole numbers.
LEAST = (4, 5)
ROWS = 4
BANDS = 20

_SALTS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def miss_bound(similarity: float = LEAST[0] / LEAST[1]) -> float:
    return (1 - similarity**ROWS) ** BANDS


def shingle_sets(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, text after text, and the first of each text."""
    h, counts = found.hashes(), found.counts
    doc = np.repeat(np.arange(len(counts)), counts)
    grams = gram_hashes(h, SHINGLE_WORDS)
    inside = doc[: len(grams)] == doc[SHINGLE_WORDS - 1 :][: len(grams)]
    values, owner = [grams[inside]], [doc[: len(grams)][inside]]
    for row in np.flatnonzero((counts > 0) & (counts < SHINGLE_WORDS)).tolist():
        values.append(gram_hashes(h[found.first[row] : found.first[row + 1]], int(counts[row])))
        owner.append(np.array([row]))
    value, own = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    value, own = value[new], own[new]
    return value, np.searchsorted(own, np.arange(len(counts) + 1))


def fingerprints(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHash of every set: a bit is set if it is set in over half of the shingles' hashes. An empty set gives zero."""
    size = np.diff(first)
    ones = np.zeros((len(size), 64), np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    for begin in range(0, len(value), 1 << 15):
        part = value[begin : begin + (1 << 15)]
        own = owner[begin : begin + (1 << 15)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ones[own[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            value, first = shingle_sets(words(piece.column(1), lower=True))
            size = np.diff(first)
            full = np.flatnonzero(size)
            name = np.zeros((len(piece), 2), np.uint64)
            bands = np.zeros((len(full), BANDS), np.uint64)
            if len(full):
                at = first[:-1][full]
                name[full, 0] = np.add.reduceat(mix(value), at)
                name[full, 1] = np.add.reduceat(mix(value ^ np.uint64(0x9E3779B97F4A7C15)), at)
                for k, salt in enumerate(_SALTS):
                    least = np.minimum.reduceat((((value ^ (salt >> np.uint64(7))) * salt) >> np.uint64(32)).astype(np.uint32), at)
                    band = bands[:, k // ROWS]
                    bands[:, k // ROWS] = mix(band + (least.astype(np.uint64) + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15))
            lists = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(np.where(size > 0, BANDS, 0))].astype(np.int32)), pa.array(bands.reshape(-1).view(np.int64))
            )
            names = pa.array([x.tobytes() for x in name], pa.binary())
            bits = pa.array(fingerprints(value, first).view(np.int64))
            columns = [piece.column(0), piece.column(2), piece.column(3), names, pa.array(size.astype(np.int32)), lists, bits]
            columns.append(pa.array(signature_trees.bitmaps(value, first), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", K1, K2, "class", "size", "bands", "fp", "bits"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, row key, class, size, bands, fp, bits) of every row; ``fp`` is the SimHash of the set, ``bits`` its token bitmap."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_hashes())
    return given.mapInArrow(_signatures, f"doc_id long, {K1} long, {K2} long, class binary, size int, bands array<long>, fp long, bits binary")


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose texts are near copies."""
    share, of = LEAST
    for batch in batches:
        for part in pieces(batch, "text_a", "text_b"):
            sets = [shingle_sets(words(part.column(c), lower=True)) for c in (2, 3)]
            near = np.zeros(len(part), bool)
            for row in range(len(part)):
                a, b = (value[first[row] : first[row + 1]] for value, first in sets)
                both = len(np.intersect1d(a, b, assume_unique=True))
                near[row] = both * of >= (len(a) + len(b) - both) * share
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(near))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) whose similarity is at least ``LEAST``; ``texts`` holds (class, text)."""
    first = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_similar, "a binary, b binary")


def _sizes_allow(a: Column, b: Column) -> Column:
    return F.least(a, b).cast("long") * LEAST[1] >= F.greatest(a, b).cast("long") * LEAST[0]


def links(found: DataFrame, docs: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of classes that join all near copies to components.

    ``proposed`` holds pairs (a < b) of another kind of candidates, which are verified together with the neighbours.
    """
    classes = found.groupBy("class").agg(
        F.min(F.struct(K1, K2)).alias("row"), F.first("size").alias("size"), F.first("bands").alias("bands"),
        F.first("bits").alias("bits"),
    )
    postings = classes.select("class", "size", F.explode("bands").alias("band"))
    in_bucket = Window.partitionBy("band").orderBy("class")
    placed = postings.select(
        "*", F.lag(F.struct("class", "size")).over(in_bucket).alias("before"), F.lead("class").over(in_bucket).alias("after")
    )
    shared = materialize(placed.where("before IS NOT NULL OR after IS NOT NULL").drop("after"), "buckets")
    wanted = shared.select("class")
    if proposed is not None:
        wanted = wanted.union(proposed.select("a")).union(proposed.select("b"))
    rows = classes.join(wanted.distinct(), "class", "left_semi").select("class", f"row.{K1}", f"row.{K2}")
    keyed = docs.select("text", *row_hashes()).dropDuplicates([K1, K2])
    texts = materialize(keyed.join(rows, [K1, K2]).select("class", "text"), "class-texts")

    beside = shared.where(F.col("before").isNotNull() & _sizes_allow(F.col("size"), F.col("before.size")))
    beside = beside.select(F.col("before.class").alias("a"), F.col("class").alias("b"))
    tried = materialize((beside if proposed is None else beside.union(proposed.select("a", "b"))).distinct(), "neighbours")
    near = materialize(verified(tried, texts), "near-neighbours")

    roots = components(near)
    member = shared.select("band", "class", "size").join(roots, F.col("class") == F.col("node"), "left")
    identity = F.xxhash64("class")
    member = member.select(F.col("band").alias("token"), identity.alias("class"), "size", F.xxhash64(F.coalesce("root", "class")).alias("root"))
    member = materialize(member, "bucket-members")
    bitmaps = classes.where("size > 0").select(identity.alias("class"), "bits")

    def sets(wanted: DataFrame) -> DataFrame:
        named = texts.select(identity.alias("class"), "text").join(wanted, "class", "left_semi")
        return signature_trees.token_sets(named, SHINGLE_WORDS)

    found = signature_trees.joining_links(member, bitmaps, sets, LEAST)
    # A pair of two classes that one hash stands for is no harm: texts decide.
    for side in "ab":
        found = found.join(classes.select(identity.alias(side), F.col("class").alias(f"class_{side}")), side)
    across = found.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()
    return near.union(verified(materialize(across, "across"), texts))


def similar_components(docs: DataFrame, propose: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, row key, class, root) of every row; ``root`` names the component.

    ``propose`` gives further candidates from the signatures, as pairs of classes.
    """
    found = materialize(signatures(docs), "signatures")
    proposed = materialize(propose(found), "proposed") if propose else None
    roots = components(materialize(links(found, docs, proposed), "near-pairs"))
    return found.join(roots, F.col("class") == F.col("node"), "left").select(
        "doc_id", K1, K2, "class", F.coalesce("root", "class").alias("root")
    )


@own_names
def drop_similar(docs: DataFrame, propose: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row of every component, with all its columns: the one with the smallest id.

    Rows without an id come last; among rows that repeat an id with other texts the smallest row key wins.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", K1, K2)
    found = similar_components(docs.select("doc_id", "text"), propose)
    winners = found.groupBy("root").agg(F.min(order).alias("w")).select(F.col("w")[K1].alias(K1), F.col("w")[K2].alias(K2))
    kept = with_key(docs).join(winners, [K1, K2], "left_semi").dropDuplicates([K1, K2])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])

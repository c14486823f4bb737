"""Benchmark decontamination with a distributed positional inverted index.

``postings`` stores, for every training row and every term that the benchmark asks about, the positions of the term,
as a table sorted by term. A search goes from rare to frequent: each window of an item is represented by its rarest
term, whose postings, shifted by the term's offset in the item, propose where in which document the item could lie.
The proposals are then intersected with the shifted postings of the item's other terms, and runs of matched offsets
give the exact phrases. ``near_matches`` gives the documents that hold all terms of a query within a span of words.

Terms are 64-bit hashes of words; rows are known by their key. Defined cases: a NULL or empty text has no words; an
item without words is never found; an item of fewer words than a window is one window; items that repeat are found
each, under their own ids; repeated documents get the same row of results each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lendwright.llm.rows import own_names, row_hashes, with_key, K1, K2
from lendwright.llm.words import ALPHANUMERIC, pieces, words
from lendwright.session import materialize

WINDOW = 10
#: Terms that are sent to every task, 8 bytes each; a larger benchmark vocabulary is looked up by a join.
MAX_SENT_TERMS = 2_000_000
ROW_CLASSES = 1 << 16


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            found = words(piece.column(1), ALPHANUMERIC, lower=True)
            terms = pa.array(found.hashes().view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(found.first.astype(np.int32)), terms)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), lists], names=["item_id", "item", "terms"])


def item_terms(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, item, terms) of every item with words; ``item`` stands for the item's text."""
    given = benchmark.select(
        F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text"), F.xxhash64(text).alias("item")
    )
    return given.mapInArrow(_item_terms, "item_id string, item long, terms array<long>").where(F.size("terms") > 0)


def _postings(terms) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = terms.value if terms is not None else None
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = words(piece.column(0), ALPHANUMERIC, lower=True)
                term = found.hashes().view(np.int64)
                doc = np.repeat(np.arange(len(piece)), found.counts)
                place = (np.arange(len(term)) - np.repeat(found.first[:-1], found.counts)).astype(np.int32)
                if wanted is not None:
                    at = np.minimum(np.searchsorted(wanted, term), max(len(wanted) - 1, 0))
                    chosen = np.flatnonzero(wanted[at] == term) if len(wanted) else np.zeros(0, np.int64)
                    term, doc, place = term[chosen], doc[chosen], place[chosen]
                order = np.lexsort((doc, term))
                term, doc, place = term[order], doc[order], place[order]
                new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]) if len(term) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(term)].astype(np.int32)), pa.array(place))
                k1, k2 = (np.asarray(piece.column(c)) for c in (1, 2))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(term[new]),
                        pa.array(k1[doc[new]]),
                        pa.array(k2[doc[new]]),
                        pa.array(np.diff(np.r_[new, len(term)]).astype(np.int32)),
                        lists,
                    ],
                    names=["term", K1, K2, "n", "places"],
                )
                # The length of every row's text, under a term of its own kind.
                empty = pa.ListArray.from_arrays(pa.array(np.zeros(len(piece) + 1, np.int32)), pa.array(np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(piece), pa.int64()), piece.column(1), piece.column(2), pa.array(found.counts.astype(np.int32)), empty],
                    names=["term", K1, K2, "n", "places"],
                )

    return run


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings (term, row key, n, places) of the wanted terms; rows with a NULL term hold the words of a text."""
    given = docs.select("text", *row_hashes())
    schema = f"term long, {K1} long, {K2} long, n int, places array<int>"
    wanted = terms.select("term").distinct()
    if wanted.limit(MAX_SENT_TERMS + 1).count() <= MAX_SENT_TERMS:
        sent = np.sort(np.array([r.term for r in wanted.collect()], np.int64))
        index = given.mapInArrow(_postings(docs.sparkSession.sparkContext.broadcast(sent)), schema)
    else:
        every = given.mapInArrow(_postings(None), schema)
        index = every.where("term IS NOT NULL").join(wanted, "term", "left_semi").unionByName(every.where("term IS NULL"))
    return materialize(index, "postings")


def anchors(items: DataFrame, index: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, offset, term): the rarest term of every window of every item."""
    frequency = index.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n"))
    placed = items.select("item", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    # A term that no document holds makes its window impossible and stands for it at no cost.
    counted = placed.join(frequency, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ahead = Window.partitionBy("item").orderBy("offset").rowsBetween(0, window - 1)
    rarest = counted.withColumn("a", F.min(F.struct("n", "offset", "term")).over(ahead))
    opens = F.col("offset") <= F.greatest(F.col("size") - window, F.lit(0))
    return rarest.where(opens).select("item", F.col("a.offset").alias("offset"), F.col("a.term").alias("term")).distinct()


def phrases(items: DataFrame, index: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row key, item, first, end): word spans of a document in which windows of an item occur, joined where they overlap."""
    texts = items.select("item", "terms").dropDuplicates(["item"])
    entries = index.where("term IS NOT NULL")
    # Written, so that its size is known before the join: few anchors are sent to the postings, many meet them by term.
    asked = materialize(anchors(texts, index, window), "anchors")
    proposed = (
        entries.join(asked, "term")
        .select(K1, K2, "item", F.explode("places").alias("place"), "offset")
        .select(K1, K2, "item", (F.col("place") - F.col("offset")).alias("shift"))
        .distinct()
    )
    # One row per proposed document and item, so that a posting is met once for all its proposals.
    proposed = materialize(proposed.groupBy(K1, K2, "item").agg(F.collect_list("shift").alias("shifts")), "proposed")
    offsets = (
        texts.select("item", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
        .groupBy("item", "term", "size")
        .agg(F.collect_list("offset").alias("offsets"))
    )
    shifted = F.transform(
        "offsets", lambda o: F.array_intersect(F.col("shifts"), F.transform("places", lambda p: p - o))
    )
    # Most rows have no proposal. At most ROW_CLASSES numbers are sent to drop their postings before any shuffle.
    row_class = F.pmod(F.col(K1), F.lit(ROW_CLASSES)).cast("int").alias("__llm_class")
    classes = F.broadcast(proposed.select(row_class).distinct())
    held = (
        entries.withColumn("__llm_class", row_class)
        .join(classes, "__llm_class", "left_semi")
        .join(proposed, [K1, K2])
        .join(offsets, ["item", "term"])
        .select(K1, K2, "item", "size", F.explode(F.arrays_zip("offsets", shifted.alias("held"))).alias("x"))
        .select(K1, K2, "item", "size", F.col("x.offsets").alias("offset"), F.explode("x.held").alias("shift"))
    )
    runs = Window.partitionBy(K1, K2, "item", "shift").orderBy("offset")
    islands = held.withColumn("island", F.col("offset") - F.row_number().over(runs))
    return (
        islands.groupBy(K1, K2, "item", "size", "shift", "island")
        .agg(F.min("offset").alias("low"), F.max("offset").alias("high"))
        .where(F.col("high") - F.col("low") + 1 >= F.least(F.lit(window), F.col("size")))
        .select(K1, K2, "item", (F.col("shift") + F.col("low")).alias("first"), (F.col("shift") + F.col("high") + 1).alias("end"))
    )


def near_matches(queries: DataFrame, index: DataFrame, span: int) -> DataFrame:
    """(row key, item): rows in which all terms of an item stand within ``span`` consecutive words, in any order.

    The places of the item's rarest term open the spans; every other term must have a place less than ``span`` away, and
    the least and the greatest place of a closest choice must fit.
    """
    texts = queries.select("item", F.array_distinct("terms").alias("terms")).dropDuplicates(["item"])
    wanted = texts.select("item", F.size("terms").alias("size"), F.explode("terms").alias("term"))
    entries = index.where("term IS NOT NULL")
    frequency = entries.groupBy("term").agg(F.sum("n").alias("n"))
    counted = wanted.join(frequency, "term")
    rare = counted.groupBy("item").agg(F.min_by("term", F.struct("n", "term")).alias("term"))
    rows = rare.join(entries, "term").select(K1, K2, "item").distinct()
    held = rows.join(wanted, "item").join(entries, [K1, K2, "term"])
    places = held.groupBy(K1, K2, "item", "size").agg(
        F.count("*").alias("present"), F.sort_array(F.collect_list("places"), asc=True).alias("lists")
    )
    opens = F.flatten("lists")
    fits = F.exists(
        opens, lambda low: F.forall("lists", lambda own: F.exists(own, lambda p: (p >= low) & (p < low + span)))
    )
    return places.where((F.col("present") == F.col("size")) & fits).select(K1, K2, "item")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row key, n_words, n_hit, n_items, item_ids) of every distinct row of ``docs``."""
    items = materialize(item_terms(benchmark), "items")
    index = postings(docs, items.select(F.explode("terms").alias("term")))
    found = materialize(phrases(items, index, window), "phrases")
    positions = F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["end"] - 1)))
    hit = (
        found.groupBy(K1, K2)
        .agg(F.collect_set(F.struct("first", "end")).alias("spans"))
        .select(K1, K2, F.size(F.array_distinct(positions)).cast("long").alias("n_hit"))
    )
    named = (
        found.select(K1, K2, "item")
        .distinct()
        .join(items.select("item", "item_id").distinct(), "item")
        .groupBy(K1, K2)
        .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    )
    lengths = index.where("term IS NULL").select(K1, K2, F.col("n").cast("long").alias("n_words")).distinct()
    return (
        lengths.join(hit, [K1, K2], "left")
        .join(named, [K1, K2], "left")
        .select(
            K1,
            K2,
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        )
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    keyed = docs.select("doc_id", *row_hashes())
    rows = keyed.join(hits(docs.select("doc_id", "text"), benchmark, window), [K1, K2])
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@own_names
def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no window of the benchmark."""
    items = materialize(item_terms(benchmark), "items")
    index = postings(docs.select("doc_id", "text"), items.select(F.explode("terms").alias("term")))
    found = materialize(phrases(items, index, window).select(K1, K2).distinct(), "contaminated")
    kept = with_key(docs).join(found, [K1, K2], "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])

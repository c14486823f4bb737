"""Phrase collocation mining with weighted acyclic automata.

A shard (some megabytes of text inside a task) sorts its word n-grams and builds a count transducer from them: one state per
distinct path of words, weighted by the occurrences of the path; the root of a language weighs all its words. A path is
continued by one word at a time from the states that are there, so prefixes are shared and every state is reached once.
A transducer is cut by prefix range, a range of hashes of its paths' first two words, and every range is sent as one list of
states. All lists of a range are united in one place, where equal paths add up their weights and rare ones end.
The parts of a candidate are looked up by composing it with the united transducer: a cut gives two paths, whose
weights are joined.

Rare paths are kept out early. No path is frequent unless both paths that are one word shorter are, so before the shards are
written, the paths of one, two and three words are counted by their hash, and the frequent ones are marked in bit filters.
A filter has 16 bits for every frequent path it was measured to hold, and at most ``MOST_FILTER_BITS``. What it passes
wrongly costs time only: results depend on the exact counts of written paths, which are strings.

Defined cases: NULL texts are empty; a NULL language is ``und``; texts without words add nothing; a long text forms a shard of
its own; repeated rows count as often as they occur; ties are settled by the phrase in byte order; an empty table gives no
rows; other columns are ignored. Inside one shard two words are told apart by 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from lendwright.llm.words import mix, pieces, words
from lendwright.operators.order_statistics import join_unique
from lendwright.session import materialize

#: Bytes that end a piece, and bytes of words: all but these, blank and tab.
ENDS = np.zeros(256, bool)
ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
WORD = ~ENDS
WORD[[0x20, 0x09]] = False

MAX_WORDS = 5
MIN_COUNT = 100
ABSORB_PERCENT = 100
TOP = 2000
#: Text of a shard, and text for each range of paths.
SHARD_BYTES = 8_000_000
GROUP_BYTES = 16_000_000
#: Paths are dealt to ranges by their first words.
PREFIX_WORDS = 2
#: Depths whose frequent paths are marked before transducers are built.
MARKED_DEPTHS = 3
MOST_FILTER_BITS = 30
SALTS = 64

_STEP = np.uint64(0x9E3779B97F4A7C15)
_COUNT = np.dtype([("path", "<u8"), ("n", "<u4")])
NO_LANGUAGE = "und"


@dataclass
class Shard:
    """Word occurrences of some texts: symbols that differ by language, and whether the next word follows in the same piece."""

    symbol: np.ndarray
    follows: np.ndarray
    language: np.ndarray
    names: list[str]
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def word(self, at: int) -> bytes:
        return self.data[self.start[at] : self.end[at]].tobytes()


def _read(piece: pa.RecordBatch, names: dict[str, int]) -> tuple[np.ndarray, ...]:
    found = words(piece.column(0), WORD, lower=True)
    known = piece.column(1).fill_null(NO_LANGUAGE).dictionary_encode()
    own = [names.setdefault(x, len(names)) for x in known.dictionary.to_pylist()]
    doc = np.repeat(np.arange(len(piece)), found.counts)
    index = known.indices.to_numpy()[doc] if len(doc) else np.zeros(0, np.int64)
    salt = np.array([xxhash.xxh64_intdigest(x) for x in known.dictionary.to_pylist()], np.uint64)
    language = np.array(own, np.int32)[index] if len(doc) else np.zeros(0, np.int32)
    ends = np.concatenate([[0], np.cumsum(ENDS[found.data], dtype=np.int32)])
    follows = np.zeros(len(doc), bool)
    follows[:-1] = (doc[1:] == doc[:-1]) & (ends[found.start[1:]] == ends[found.end[:-1]])
    symbol = mix(found.hashes() ^ salt[index]) if len(doc) else np.zeros(0, np.uint64)
    return symbol, follows, language, found.data, found.start, found.end


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[Shard]:
    parts: list[tuple[np.ndarray, ...]] = []
    names: dict[str, int] = {}
    held = 0

    def joined() -> Shard:
        offsets = np.cumsum([0, *[len(p[3]) for p in parts]])
        start, end = (np.concatenate([p[c] + o for p, o in zip(parts, offsets)]) for c in (4, 5))
        symbol, follows, language, data = (np.concatenate([p[c] for p in parts]) for c in range(4))
        return Shard(symbol, follows, language, list(names), data, start, end)

    for batch in batches:
        for piece in pieces(batch, "text"):
            parts.append(_read(piece, names))
            held += len(parts[-1][3])
            if held >= shard_bytes:
                yield joined()
                parts, names, held = [], {}, 0
    if parts:
        yield joined()


class Marks:
    """Bits of path hashes: a path that was marked always passes."""

    def __init__(self, bits: int, marks: np.ndarray):
        self.bits, self.marks = bits, marks

    def passes(self, path: np.ndarray) -> np.ndarray:
        slot = (path >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.marks[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _walk(shard: Shard, depth: int, marked: Sequence[Marks]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2 … ``depth`` words: the starts of paths that may be frequent, and the hashes of these paths."""
    size = len(shard.symbol)
    path = shard.symbol
    at = np.arange(size)
    for k in range(1, depth + 1):
        if k > 1:
            shorter = np.zeros(size + 1, bool)
            shorter[at] = True
            before = np.zeros(size, np.uint64)
            before[at] = path
            at = np.flatnonzero(shorter[:-1] & shorter[1:] & shard.follows)
            path = mix(before[at] * _STEP + shard.symbol[at + k - 1])
        if k <= len(marked):
            passed = marked[k - 1].passes(path)
            at, path = at[passed], path[passed]
        yield at, path


def _count_paths(depth: int, bits: int, shard_bytes: int, shared) -> Callable:
    """Occurrences of the paths of ``depth`` words in every shard, in runs by the leading bits of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, shard_bytes):
            *_, (_, path) = _walk(shard, depth, shared.value)
            found, n = np.unique(path, return_counts=True)
            records = np.zeros(len(found), _COUNT)
            records["path"], records["n"] = found, n
            part = (found >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(found), np.int64)
            new = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
            rows = [records[a:b].tobytes() for a, b in zip(new, [*new[1:], len(part)])]
            yield pa.RecordBatch.from_arrays([pa.array(part[new], pa.int32()), pa.array(rows, pa.binary())], names=["part", "data"])

    return run


def _frequent(min_count: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        found = np.frombuffer(b"".join(table.column("data").to_pylist()), _COUNT)
        order = np.argsort(found["path"], kind="stable")
        path = found["path"][order]
        new = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
        n = np.add.reduceat(found["n"][order].astype(np.int64), new)
        kept = path[new][n >= min_count]
        return pa.table({"part": table.column("part")[:1], "paths": pa.array([kept.tobytes()], pa.binary()), "n": pa.array([len(kept)], pa.int64())})

    return run


def _slices(part_bits: int, filter_bits: int) -> Callable:
    """The slice of the filter that the paths of a part mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << (filter_bits - part_bits)
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                slot = (np.frombuffer(data, np.uint64) >> np.uint64(64 - filter_bits)) & np.uint64(size - 1)
                marks = np.zeros(size, bool)
                marks[slot.astype(np.int64)] = True
                rows.append(np.packbits(marks, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["part", "marks"])

    return run


def range_bits(given: DataFrame) -> int:
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(0, math.ceil(math.log2(max(1, size / GROUP_BYTES))))


def frequent_marks(given: DataFrame, min_count: int, depths: int, shard_bytes: int = SHARD_BYTES) -> list[Marks]:
    """Filters that pass every path of 1 … ``depths`` words with ``min_count`` occurrences."""
    spark = given.sparkSession
    bits = range_bits(given)
    marked: list[Marks] = []
    for depth in range(1, depths + 1):
        count = _count_paths(depth, bits, shard_bytes, spark.sparkContext.broadcast(marked))
        counted = given.mapInArrow(count, "part int, data binary").groupBy("part")
        kept = materialize(counted.applyInArrow(_frequent(min_count), "part int, paths binary, n long"), "frequent-paths")
        held = kept.agg(F.sum("n")).first()[0] or 0
        filter_bits = min(MOST_FILTER_BITS, max(bits + 3, 16, math.ceil(math.log2(16 * held + 1))))
        marks = np.zeros(1 << (filter_bits - 3), np.uint8)
        width = len(marks) >> bits
        for row in kept.where("n > 0").select("part", "paths").mapInArrow(_slices(bits, filter_bits), "part int, marks binary").collect():
            marks[row.part * width : (row.part + 1) * width] = np.frombuffer(bytes(row.marks), np.uint8)
        marked = [*marked, Marks(filter_bits, marks)]
    return marked


def _transducers(depth: int, bits: int, shard_bytes: int, shared) -> Callable:
    """Every shard's transducer, cut by range and language: (part, lang, phrases, counts)."""

    def states(shard: Shard) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]]:
        """(range, language, spelled path, weight) of all states, depth by depth."""
        names = len(shard.names)
        yield np.zeros(names, np.int64), np.arange(names), [b""] * names, np.bincount(shard.language, minlength=names)
        label, state = np.zeros(len(shard.symbol), np.int64), np.zeros(len(shard.symbol), np.int64)
        spelled: list[bytes] = []
        texts: list[bytes] = []
        part = np.zeros(0, np.int64)
        for k, (at, path) in enumerate(_walk(shard, depth, shared.value), 1):
            if not len(at):
                return
            # The first word's states are their labels; from then on an arc leads from a state by a label.
            arc = path if k == 1 else state[at] * len(spelled) + label[at + k - 1]
            arcs, first, where, n = np.unique(arc, return_index=True, return_inverse=True, return_counts=True)
            if k == 1:
                spelled = texts = [shard.word(i) for i in at[first].tolist()]
                label[at] = where
            else:
                source, by = np.divmod(arcs, len(spelled))
                texts = [texts[a] + b" " + spelled[b] for a, b in zip(source.tolist(), by.tolist())]
            if k > PREFIX_WORDS:
                part = part[source]
            else:
                part = (path[first] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(first), np.int64)
            state[at] = where
            yield part, shard.language[at[first]], texts, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, shard_bytes):
            levels = list(states(shard))
            part, language, n = (np.concatenate([level[c] for level in levels]).astype(np.int64) for c in (0, 1, 3))
            order = np.lexsort((language, part))
            part, language = part[order], language[order]
            new = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (language[1:] != language[:-1])])
            edges = pa.array(np.append(new, len(order)).astype(np.int32))
            phrases = pa.array([t for level in levels for t in level[2]], pa.binary()).cast(pa.string()).take(pa.array(order))
            columns = [pa.array(part[new], pa.int32()), pa.array([shard.names[x] for x in language[new].tolist()], pa.string())]
            columns += [pa.ListArray.from_arrays(edges, phrases), pa.ListArray.from_arrays(edges, pa.array(n[order]))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "lang", "phrases", "counts"])

    return run


def _united(min_count: int) -> Callable:
    """The union of the transducers of a range, without paths that are rare."""

    def run(table: pa.Table) -> pa.Table:
        lists = table.column("phrases").combine_chunks()
        phrases, counts = lists.flatten(), table.column("counts").combine_chunks().flatten()
        lang = table.column("lang").combine_chunks().take(pc.list_parent_indices(lists))
        found = pa.table({"lang": lang, "phrase": phrases, "n": counts}).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        depth = pc.if_else(pc.equal(found["phrase"], ""), 0, pc.add(pc.count_substring(found["phrase"], " "), 1))
        kept = pc.or_(pc.greater_equal(found["n_sum"], min_count), pc.equal(depth, 0))
        columns = {"lang": found["lang"], "phrase": found["phrase"], "depth": depth.cast(pa.int32()), "n": found["n_sum"]}
        return pa.table(columns).filter(kept)

    return run


def path_weights(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The united transducer: (lang, phrase, depth, n) of all paths of up to ``max_words`` words that occur ``min_count`` times, and
    of the roots (depth 0, no phrase), whose weight is the number of words."""
    given = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    marked = frequent_marks(given, min_count, min(MARKED_DEPTHS, max_words), shard_bytes)
    build = _transducers(max_words, range_bits(given), shard_bytes, docs.sparkSession.sparkContext.broadcast(marked))
    shards = given.mapInArrow(build, "part int, lang string, phrases array<string>, counts array<long>")
    return materialize(shards.groupBy("part").applyInArrow(_united(min_count), "lang string, phrase string, depth int, n long"), "path-weights")


def scored(paths: DataFrame, absorb_percent: int = ABSORB_PERCENT) -> DataFrame:
    """Candidates that no longer candidate absorbs: lang, phrase, a, cut, l, r, n, score.

    A candidate inside a longer one with the wanted share of its count is also inside one that is longer by a single word and
    at least as frequent, so only those are looked at.
    """
    word = F.split("phrase", " ")
    found = paths.where("depth >= 2").select("lang", "phrase", "depth", F.col("n").alias("a"))
    inner = F.array(*[F.array_join(F.slice(word, F.lit(i), F.col("depth") - 1), " ") for i in (1, 2)])
    longer = found.where("depth >= 3").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    absorbed = F.coalesce(F.col("longer") * 100 >= F.col("a") * absorb_percent, F.lit(False))
    kept = found.join(longer, ["lang", "phrase"], "left").where(~absorbed).drop("longer")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)))
    cuts = cuts.withColumn("left_part", F.array_join(F.slice(word, F.lit(1), F.col("cut")), " "))
    cuts = materialize(cuts.withColumn("right_part", F.array_join(F.slice(word, F.col("cut") + 1, F.col("depth")), " ")), "cuts")
    weights = paths.where("depth >= 1")
    for part, weight in (("left_part", "l"), ("right_part", "r")):
        cuts = join_unique(cuts, weights.select("lang", F.col("phrase").alias(part), F.col("n").alias(weight)), ["lang", part], how="inner")
    roots = paths.where("depth = 0").select("lang", F.col("n").alias("n"))
    cuts = join_unique(cuts, roots, ["lang"], how="inner")
    big = "cast({} as decimal(18,0))"
    score = F.expr(f"cast(({big.format('a')} * {big.format('n')} * 1000) div ({big.format('l')} * {big.format('r')}) as long)")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("s")
    return cuts.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "s.cut", "s.l", "s.r", "n", "s.score")


def collocations(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    absorb_percent: int = ABSORB_PERCENT,
    top: int = TOP,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The ``top`` candidates of every language by score, count and phrase.

    They are chosen among hashed shares of a language first, so that no task orders a whole language.
    """
    found = scored(path_weights(docs, max_words, min_count, shard_bytes), absorb_percent)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return first.withColumn("rank", place).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")


def report(docs: DataFrame) -> DataFrame:
    return collocations(docs).drop("cut")

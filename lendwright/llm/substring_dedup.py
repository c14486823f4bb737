"""Substring dedup with prefix-partitioned suffix trees.

A window of ``window`` words is read from its anchor: the ``PREFIX`` consecutive words in it whose hash is least. The
anchored suffixes are split by prefix into groups that fit into memory, and each group's tree is built in one
task by sorting: a run of equal prefixes is a node at depth PREFIX, a run of equal windows an internal node
at the full depth, and every leaf of such a node but those of the smallest document is a repeat. Overlapping repeats
of a document join to maximal ones.

1. The first pass counts, per prefix, the documents and windows that have it. Prefixes of one document cannot
   lead to a deep node. Those that can are marked in a bit filter of fixed size (``FILTER_BITS``): with more data it
   lets more windows through, which costs shuffle and changes no result.
2. The second pass sends the windows that pass to their groups. Prefixes with more windows than a group may hold are
   extended to the whole window, so that their suffixes spread over all groups. Equal windows
   within a stretch of text are merged before the shuffle: the leaf of the smallest document goes on, the others
   are repeats already.
3. Repeats come back as window starts per document and are cut from the words.

Every hash of a window is taken twice, 128 bits together. Defined cases: a NULL text has no words; rows with a NULL id
are kept whole and make nothing a repeat; rows that share an id never make each other a repeat; other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lendwright.llm.rows import K1, K2, row_hashes
from lendwright.llm.words import Words, gram_hashes, mix, pieces, words
from lendwright.session import materialize

PREFIX = 7
FILTER_BITS = 28
#: Bytes of shuffled suffixes that one group should hold.
GROUP_BYTES = 24_000_000
SEGMENT_BITS = 8

_COUNT = np.dtype([("prefix", "<u8"), ("windows", "<u4"), ("docs", "u1")])
_LEAF = np.dtype([("prefix", "<u8"), ("rest", "<u8"), ("doc", "<u4"), ("start", "<u4")])
_REPEAT = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("start", "<i4")])
_DOC = np.dtype([("id", "<i8"), ("k1", "<i8"), ("k2", "<i8")])


def _anchored(found: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every window inside one text: its first word, its text, the hash of its prefix and of the whole."""
    h = found.hashes()
    doc = np.repeat(np.arange(len(found.first) - 1), found.counts)
    whole = gram_hashes(h, window)
    if not len(whole):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), whole, whole
    inside = doc[: len(whole)] == doc[window - 1 : window - 1 + len(whole)]
    size = min(PREFIX, window)
    grams = gram_hashes(h, size, seed=2)
    least = grams[: len(whole)].copy()
    place = np.zeros(len(whole), np.uint64)
    for offset in range(1, window - size + 1):
        other = grams[offset : offset + len(whole)]
        less = other < least
        least[less] = other[less]
        place[less] = offset
    start = np.flatnonzero(inside)
    # The place of the anchor is part of what the window reads as.
    rest = mix(whole[start] + (place[start] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return start, doc[start], mix(least[start]), rest


def _batched(keys: np.ndarray, records: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """Records in runs by the leading bits of their key."""
    group = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    order = np.argsort(group, kind="stable")
    group, records = group[order], records[order]
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(group)]):
        yield int(group[a]), records[a:b].tobytes()


def _count_prefixes(window: int, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                _, doc, prefix, _ = _anchored(words(piece.column(1)), window)
                order = np.lexsort((doc, prefix))
                p, d = prefix[order], np.asarray(piece.column(0))[doc[order]]
                new = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.zeros(0, np.int64)
                out = np.zeros(len(new), _COUNT)
                out["prefix"] = p[new]
                out["windows"] = np.diff(np.r_[new, len(p)])
                if len(new):
                    least, most = np.minimum.reduceat(d, new), np.maximum.reduceat(d, new)
                    out["docs"] = 1 + (least < most)
                rows = list(_batched(out["prefix"], out, bits))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "data"]
                )

    return run


def _shared_prefixes(table: pa.Table) -> pa.Table:
    """Prefixes of more than one piece or document, with their windows."""
    found = np.frombuffer(b"".join(table.column("data").to_pylist()), _COUNT)
    found = found[np.argsort(found["prefix"], kind="stable")]
    new = np.flatnonzero(np.r_[True, found["prefix"][1:] != found["prefix"][:-1]])
    docs = np.add.reduceat(found["docs"].astype(np.int64), new)
    windows = np.add.reduceat(found["windows"].astype(np.int64), new)
    shared = docs >= 2
    return pa.table({"prefix": found["prefix"][new][shared].view(np.int64), "windows": windows[shared]})


def _segment(filter_bits: int) -> Callable:
    """The part of the bit filter that a range of prefixes marks."""

    def run(table: pa.Table) -> pa.Table:
        size = 1 << (filter_bits - SEGMENT_BITS)
        prefix = table.column("prefix").to_numpy().view(np.uint64)
        marks = np.zeros(size, bool)
        marks[((prefix >> np.uint64(64 - filter_bits)) & np.uint64(size - 1)).astype(np.int64)] = True
        segment = int(prefix[0] >> np.uint64(64 - SEGMENT_BITS))
        return pa.table({"segment": pa.array([segment], pa.int32()), "marks": pa.array([np.packbits(marks, bitorder="little").tobytes()])})

    return run


def _send_leaves(window: int, bits: int, filter_bits: int, marks, heavy) -> Callable:
    """Windows that pass the filter, to the group of their prefix; repeats inside a piece, to the group of their row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, extended = marks.value, heavy.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, k1, k2 = (np.asarray(piece.column(c)) for c in (0, 2, 3))
                found = words(piece.column(1))
                start, doc, prefix, rest = _anchored(found, window)
                slot = (prefix >> np.uint64(64 - filter_bits)).astype(np.int64)
                passed = (filter_[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                leaf = np.zeros(int(passed.sum()), _LEAF)
                leaf["prefix"], leaf["rest"], leaf["doc"] = prefix[passed], rest[passed], doc[passed]
                leaf["start"] = start[passed] - found.first[doc[passed]]
                order = np.lexsort((ids[leaf["doc"]], leaf["rest"], leaf["prefix"]))
                leaf = leaf[order]
                same = np.zeros(len(leaf), bool)
                same[1:] = (leaf["prefix"][1:] == leaf["prefix"][:-1]) & (leaf["rest"][1:] == leaf["rest"][:-1])
                node = np.cumsum(~same) - 1
                own = ids[leaf["doc"]]
                later = own > own[~same][node] if len(leaf) else same
                rows = []
                key = leaf["prefix"]
                if len(extended):
                    at = np.minimum(np.searchsorted(extended, key), len(extended) - 1)
                    key = np.where(extended[at] == key, mix(key ^ leaf["rest"]), key)
                # What is settled needs no tree: dealt by row, a passage of many documents does not meet in one group.
                row_key = mix(k1.view(np.uint64)) if len(k1) else k1.view(np.uint64)
                for kind, choice, dealt in ((0, ~later, key), (1, later, row_key[leaf["doc"]])):
                    for part, data in _batched(dealt[choice], leaf[choice], bits):
                        chosen = np.frombuffer(data, _LEAF).copy()
                        docs, chosen["doc"] = np.unique(chosen["doc"], return_inverse=True)
                        table = np.zeros(len(docs), _DOC)
                        table["id"], table["k1"], table["k2"] = ids[docs], k1[docs], k2[docs]
                        rows.append((part, kind, bits, chosen.tobytes(), table.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                    names=["part", "kind", "bits", "leaves", "docs"],
                )

    return run


def _deep_leaves(table: pa.Table) -> pa.Table:
    """Sort the suffixes of a group; the leaves under internal nodes of full depth go to the groups of their documents."""
    leaves, docs, done, base = [], [], [], 0
    for kind, leaf, doc in zip(*(table.column(c).to_pylist() for c in ("kind", "leaves", "docs"))):
        own = np.frombuffer(leaf, _LEAF).copy()
        own["doc"] += np.uint32(base)
        docs.append(np.frombuffer(doc, _DOC))
        base += len(docs[-1])
        leaves.append(own)
        done.append(np.full(len(own), kind == 1))
    leaf, doc, settled = np.concatenate(leaves), np.concatenate(docs), np.concatenate(done)
    open_ = leaf[~settled]
    own = doc["id"][open_["doc"]]
    order = np.lexsort((own, open_["rest"], open_["prefix"]))
    open_, own = open_[order], own[order]
    new = np.ones(len(open_), bool)
    new[1:] = (open_["prefix"][1:] != open_["prefix"][:-1]) | (open_["rest"][1:] != open_["rest"][:-1])
    node = np.cumsum(new) - 1
    later = own > own[new][node] if len(open_) else new
    gone = np.concatenate([open_[later], leaf[settled]])
    found = np.zeros(len(gone), _REPEAT)
    found["k1"], found["k2"], found["start"] = doc["k1"][gone["doc"]], doc["k2"][gone["doc"]], gone["start"]
    found = found[np.lexsort((found["start"], found["k2"], found["k1"]))]
    rows = list(_batched(mix(found["k1"].view(np.uint64)), found, int(table.column("bits")[0].as_py())))
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})


def _by_document(table: pa.Table) -> pa.Table:
    """All window starts of the documents of a group."""
    found = np.frombuffer(b"".join(table.column("data").to_pylist()), _REPEAT)
    found = found[np.lexsort((found["start"], found["k2"], found["k1"]))]
    new = np.flatnonzero(np.r_[True, (found["k1"][1:] != found["k1"][:-1]) | (found["k2"][1:] != found["k2"][:-1])])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(found)].astype(np.int32)), pa.array(found["start"]))
    return pa.table({K1: found["k1"][new], K2: found["k2"][new], "__llm_starts": lists})


def repeats(docs: DataFrame, window: int, filter_bits: int = FILTER_BITS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(row key, starts): the first words of all windows that also start in a document with a smaller id.

    A window may stand in the list more than once if the row itself repeats.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_hashes()).where("doc_id IS NOT NULL")
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A prefix takes 13 bytes for about 25 bytes of text; a leaf 24 bytes for about 6, if all passed the filter.
    count_bits = max(0, math.ceil(math.log2(max(1, size / group_bytes))))
    leaf_bits = count_bits + 2
    counted = given.mapInArrow(_count_prefixes(window, count_bits), "part int, data binary")
    shared = materialize(counted.groupBy("part").applyInArrow(_shared_prefixes, "prefix long, windows long"), "prefixes")
    segment = F.shiftrightunsigned("prefix", 64 - SEGMENT_BITS)
    parts = shared.groupBy(segment).applyInArrow(_segment(filter_bits), "segment int, marks binary").collect()
    marks = np.zeros(1 << (filter_bits - 3), np.uint8)
    width = len(marks) >> SEGMENT_BITS
    for row in parts:
        marks[row.segment * width : (row.segment + 1) * width] = np.frombuffer(bytes(row.marks), np.uint8)
    most = group_bytes // _LEAF.itemsize
    heavy = shared.where(F.col("windows") > most).select("prefix").collect()
    extended = np.sort(np.array([r.prefix for r in heavy], np.int64).view(np.uint64))
    context = spark.sparkContext
    sent = given.mapInArrow(
        _send_leaves(window, leaf_bits, filter_bits, context.broadcast(marks), context.broadcast(extended)),
        "part int, kind int, bits int, leaves binary, docs binary",
    )
    found = sent.groupBy("part").applyInArrow(_deep_leaves, "part int, data binary")
    return found.groupBy("part").applyInArrow(_by_document, f"{K1} long, {K2} long, __llm_starts array<int>")


def _cut(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                total, removed, kept, spans = [], [], [], []
                for text, starts in zip(piece.column(1).to_pylist(), piece.column(2)):
                    own = (text or "").encode().split()
                    gone = np.zeros(len(own) + 1, np.int64)
                    if starts.is_valid:
                        first = np.unique(starts.values.to_numpy())
                        gone[first] += 1
                        np.add.at(gone, first + window, -1)
                        inside = np.cumsum(gone)[:-1] > 0
                        own = [own[i] for i in np.flatnonzero(~inside).tolist()]
                        edges = np.flatnonzero(np.diff(np.r_[False, inside, False]))
                        spans.append(edges.reshape(-1, 2).astype(np.int32).tolist())
                    else:
                        spans.append([])
                    total.append(len(gone) - 1)
                    removed.append(total[-1] - len(own))
                    kept.append(b" ".join(own).decode())
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array(total, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(kept, pa.string()),
                        pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept", "repeats"],
                )

    return run


def drop_repeats(docs: DataFrame, window: int = 13, **settings: int) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, the kept words joined by blanks, and the maximal repeats as [first, end) word positions."""
    starts = repeats(docs.select("doc_id", "text"), window, **settings)
    keyed = docs.select("doc_id", "text", *row_hashes())
    rows = keyed.join(starts, [K1, K2], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "__llm_starts")
    return rows.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept string, repeats array<array<int>>")


def report(docs: DataFrame, window: int = 13, **settings: int) -> DataFrame:
    cut = drop_repeats(docs, window, **settings)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

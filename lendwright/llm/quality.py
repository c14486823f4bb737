"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are runs of letters, digits or signs; tokens in capitals, numbers and signs count by shape. Every token has a
sparse random index vector, drawn from its hash. The vector of a token class (one of 2^``CLASS_BITS`` by hash) is the sum
of the index vectors of its neighbours over all documents: Spark gathers these sums task by task and adds them up, a
table of fixed size. A document is the mean of its tokens' vectors and a few shares (repeats, distinct tokens, length).
Two layers with numpy weights give a logit, and a temperature fitted on rows kept aside calibrates its probability.

The network is fitted on about ``SAMPLE_ROWS`` labelled rows that are not held out; vectors, pooling and scores cover all
rows and whole texts. Labels enter nowhere else.

Defined cases: a NULL or empty text is pooled to zeros and scored like any other; rows whose id is NULL are scored but
have no label; NULL labels are ignored; a row per row of the input; if labels of both kinds are missing, every score is the
share of ones (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lendwright.llm.rows import held_out
from lendwright.llm.words import Words, mix, pieces
from lendwright.session import materialize

CLASS_BITS = 14
DIMENSIONS = 32
NON_ZERO = 4
REACH = 2
HIDDEN = 24
EPOCHS = 300
SAMPLE_ROWS = 20_000
KEEP_AT = 0.7
SEED = 5
EXTRAS = 5

LOWER, UPPER, DIGIT, SIGN = 1, 2, 3, 4
_KIND = np.full(256, SIGN, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[0x30:0x3A] = DIGIT
_KIND[0x41:0x5B] = UPPER
_KIND[0x61:0x7B] = _KIND[0x80:] = LOWER
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def tokens(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Token bounds and hashes of all texts. A capital and the small letters after it are one run."""
    column = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = _KIND[data]
    opens = kind > 0
    opens[1:] &= (kind[1:] != kind[:-1]) & ~((kind[:-1] == UPPER) & (kind[1:] == LOWER))
    bounds = offsets[(offsets > 0) & (offsets < len(data))]
    opens[bounds] = kind[bounds] > 0
    start = np.flatnonzero(opens)
    # A token ends where the next begins or a blank or another text stands.
    stops = np.concatenate([start, np.flatnonzero(kind == 0), offsets])
    stops.sort()
    end = stops[np.searchsorted(stops, start, "right")] if len(start) else start
    found = Words(_FOLD[data], start, end, np.searchsorted(start, offsets))
    h = found.hashes()
    size = np.minimum(end - start, 8).astype(np.uint64)
    first = kind[start]
    capitals = (first == UPPER) & (end - start > 1) & (kind[end - 1] == UPPER) if len(start) else np.zeros(0, bool)
    shape = np.where(first == DIGIT, 100, np.where(capitals, 200, np.where(first == SIGN, 300, 0))).astype(np.uint64)
    shape[first == SIGN] += _FOLD[data][start[first == SIGN]].astype(np.uint64) * np.uint64(16)
    return found, np.where(shape > 0, mix(shape + size), h)


def _class(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


def _neighbour_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIMENSIONS << CLASS_BITS)
    for batch in batches:
        for piece in pieces(batch, "text"):
            found, h = tokens(piece.column(0))
            doc = np.repeat(np.arange(len(piece)), found.counts)
            base = _class(h) * DIMENSIONS
            draw = mix(h)
            for j in range(NON_ZERO):
                bits = draw >> np.uint64(12 * j)
                axis = (bits & np.uint64(DIMENSIONS - 1)).astype(np.int64)
                sign = ((bits >> np.uint64(8)) & np.uint64(1)).astype(np.float64) * 2 - 1
                for step in range(1, REACH + 1):
                    if len(h) <= step:
                        continue
                    near = doc[step:] == doc[:-step]
                    total += np.bincount((base[:-step] + axis[step:])[near], sign[step:][near], len(total))
                    total += np.bincount((base[step:] + axis[:-step])[near], sign[:-step][near], len(total))
    table = total.reshape(-1, DIMENSIONS).astype(np.int64)
    some = np.flatnonzero(table.any(axis=1))
    rows = pa.ListArray.from_arrays(
        pa.array(np.arange(0, (len(some) + 1) * DIMENSIONS, DIMENSIONS, dtype=np.int32)), pa.array(table[some].reshape(-1))
    )
    yield pa.RecordBatch.from_arrays([pa.array(some), rows], names=["class", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """One vector of length 1 (or 0) per token class, from all documents. The table's size is fixed."""
    parts = docs.select("text").mapInArrow(_neighbour_sums, "class long, sums array<long>")
    sums = parts.groupBy("class").agg(*[F.sum(F.col("sums")[d]).alias(f"d{d}") for d in range(DIMENSIONS)]).toArrow()
    out = np.zeros((1 << CLASS_BITS, DIMENSIONS))
    out[sums.column("class").to_numpy()] = np.stack([sums.column(f"d{d}").to_numpy() for d in range(DIMENSIONS)], axis=1)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(length, 1)).astype(np.float32)


def pool(vectors: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Mean token vector and shares of every text."""
    found, h = tokens(texts)
    counts = found.counts
    n = np.maximum(counts, 1).astype(np.float64)
    out = np.zeros((len(counts), DIMENSIONS + EXTRAS), np.float32)
    doc = np.repeat(np.arange(len(counts)), counts)
    own = _class(h)
    for d in range(DIMENSIONS):
        out[:, d] = np.bincount(doc, vectors[own, d], len(counts)) / n
    order = np.lexsort((h, doc))
    distinct = np.ones(len(h), bool)
    distinct[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    signs = _KIND[found.data[found.start]] == SIGN if len(h) else again
    out[:, DIMENSIONS] = np.log1p(counts) / 10
    out[:, DIMENSIONS + 1] = np.bincount(doc[order], distinct, len(counts)) / n
    out[:, DIMENSIONS + 2] = np.bincount(doc, again, len(counts)) / n
    out[:, DIMENSIONS + 3] = np.bincount(doc, signs, len(counts)) / n
    out[:, DIMENSIONS + 4] = np.bincount(doc, np.minimum(found.end - found.start, 40), len(counts)) / n / 10
    return out


def _pool(broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                pooled = pool(broadcast.value, piece.column(1))
                rows = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, pooled.size + 1, pooled.shape[1], dtype=np.int32)), pa.array(pooled.reshape(-1))
                )
                yield pa.RecordBatch.from_arrays([piece.column(0), rows], names=["doc_id", "pooled"])

    return run


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.maximum((pooled - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return 1 / (1 + np.exp(-np.clip((hidden @ self.w2 + self.b2) / self.temperature, -40, 40)))


def fit(pooled: np.ndarray, labels: np.ndarray) -> Network:
    """Adam on four fifths of the rows; the temperature that gives the others the greatest likelihood."""
    width = DIMENSIONS + EXTRAS
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels) or len(labels) < 10:
        share = min(max(share, 1e-6), 1 - 1e-6)
        flat = np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN)
        return Network(np.zeros(width), np.ones(width), *flat, float(np.log(share / (1 - share))), 1.0)
    rng = np.random.default_rng(SEED)
    aside = rng.permutation(len(labels)) % 5 == 0
    mean, scale = pooled[~aside].mean(axis=0), pooled[~aside].std(axis=0) + 1e-3
    x, y = (pooled[~aside] - mean) / scale, labels[~aside]
    weights = [
        rng.normal(size=(width, HIDDEN)) / np.sqrt(width),
        np.zeros(HIDDEN),
        rng.normal(size=HIDDEN) / np.sqrt(HIDDEN),
        np.array([np.log(share / (1 - share))]),
    ]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for turn in range(1, EPOCHS + 1):
        raw = x @ weights[0] + weights[1]
        hidden = np.maximum(raw, 0)
        off = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -40, 40))) - y) / len(y)
        back = np.outer(off, weights[2]) * (raw > 0)
        slopes = [x.T @ back + 1e-4 * weights[0], back.sum(axis=0), hidden.T @ off + 1e-4 * weights[2], np.array([off.sum()])]
        for (m, v), w, g in zip(moments, weights, slopes):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= 0.01 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-9)
    network = Network(mean, scale, weights[0], weights[1], weights[2], float(weights[3][0]), 1.0)
    truth = labels[aside]

    def loss(temperature: float) -> float:
        network.temperature = temperature
        p = np.clip(network.probability(pooled[aside]), 1e-9, 1 - 1e-9)
        return float(-(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean())

    network.temperature = min(np.geomspace(0.25, 8, 121), key=loss)
    return network


def _score(broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = broadcast.value
        for batch in batches:
            if batch.num_rows:
                pooled = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.probability(pooled))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of every row."""
    context = docs.sparkSession.sparkContext
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vectors = context.broadcast(word_vectors(given))
    pooled = materialize(given.mapInArrow(_pool(vectors), "doc_id long, pooled array<float>"), "pooled")
    known = labels.select("doc_id", "quality").where(F.col("quality").isNotNull() & ~held_out())
    n = known.count()
    draw = F.xxhash64("doc_id", F.lit(SEED)).bitwiseAND((1 << 53) - 1) / float(1 << 53)
    sample = pooled.join(known.where(draw < min(1.0, SAMPLE_ROWS / max(n, 1))), "doc_id").select("doc_id", "quality", "pooled").collect()
    sample.sort(key=lambda r: (r.doc_id, r.quality, r.pooled))
    x = np.array([r.pooled for r in sample], np.float64).reshape(len(sample), DIMENSIONS + EXTRAS)
    network = fit(x, np.array([float(r.quality == 1) for r in sample]))
    return pooled.mapInArrow(_score(context.broadcast(network)), "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, labels)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))

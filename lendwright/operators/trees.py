"""Tree ensembles grown by jobs over all rows: extremely randomised trees, random forests and second-order boosting.

Rows stay where they are. A job sends them the trees so far, every partition adds up what the open nodes need in a few
array operations, Spark sums the partial results per node, and the driver, which holds nothing but the trees and
the sums of one level, chooses the splits (in a random forest, the tasks that add the sums up do). All trees of a forest grow
in the same jobs, one level at a time.

Sums are whole numbers: class counts in a forest, gradients and hessians in fixed point (``SCALE``) in boosting. So a
model depends on its rows alone, not on partitions, cores or the order in which partial sums arrive.

Training rows are written once and kept in memory as well; a lost executor reads its part again.

Feature values must not be NULL or NaN; the preprocessing of ``modeling`` sees to that.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lendwright.session import materialize

#: Fixed point of gradients and hessians.
SCALE = float(1 << 24)
#: Margins of the rows are written anew after so many rounds; a lost executor applies the trees since then again.
REFRESH_ROUNDS = 25
#: Rows of one block of arrays.
BLOCK_ROWS = 1 << 17
#: The same in a forest, where every node of every tree costs a few array operations per block.
FOREST_BLOCK_ROWS = 1 << 18
#: Rows that are worth a task of their own.
TASK_ROWS = 20_000
#: Open nodes whose sums are added up together, and cells of all sums that a task may hold at once.
CHUNK_NODES = 512
LEVEL_CELLS = 1 << 24
#: Rows of the pieces that are dealt to tasks.
PACK_ROWS = 1 << 15
MAX_BINS = 64
#: Partial sums of up to so many partitions are added where the splits are chosen; those of more are shuffled first.
DIRECT_PARTITIONS = 16
#: Rows that choose the bins of boosting.
BIN_ROWS = 200_000
#: Combinations of bins that are counted as one number, and bins of all features up to which they are.
GROUP_CELLS = 1 << 12
MAX_JOINT_BINS = 1 << 12
_SPREAD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@dataclass
class Tree:
    """Nodes as lists; node 0 is the root, a leaf has feature -1. Values at most ``threshold`` go left; ``rows`` counts training rows."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, threshold: float, gain: float) -> tuple[int, int]:
        self.feature[node], self.threshold[node], self.gain[node] = feature, threshold, gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for name, empty in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", 0.0), ("gain", 0.0), ("rows", 0)):
            getattr(self, name).extend([empty, empty])
        return self.left[node], self.right[node]

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Feature and threshold by node, the right and the left child side by side, and the depth; a leaf leads to itself."""
        own = np.arange(len(self.feature))
        feature = np.array(self.feature)
        inner = feature >= 0
        children = np.stack([np.where(inner, self.right, own), np.where(inner, self.left, own)], axis=1).reshape(-1)
        depth = [0] * len(own)
        for node in np.flatnonzero(inner).tolist():  # children come after their parent
            depth[self.left[node]] = depth[self.right[node]] = depth[node] + 1
        return np.where(inner, feature, 0), np.array(self.threshold), children, max(depth)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of ``x``."""
        return _followed(self.paths(), np.ascontiguousarray(x).reshape(-1), np.arange(len(x)) * x.shape[1], 1)


def _followed(paths: tuple[np.ndarray, np.ndarray, np.ndarray, int], flat: np.ndarray, start: np.ndarray, step: int) -> np.ndarray:
    """The leaf of every row; the value of feature f in a row lies ``step * f`` after its start."""
    feature, threshold, children, depth = paths
    feature = feature * step
    node = np.zeros(len(start), np.int64)
    for _ in range(depth):
        goes = flat.take(start + feature.take(node)) <= threshold.take(node)
        node = children.take(2 * node + goes)
    return node


@dataclass
class Ensemble:
    """``mean`` averages leaf probabilities, ``logit`` adds leaf values to a margin."""

    kind: str
    trees: list[Tree]
    base: float = 0.0

    def _prepared(self) -> list[tuple]:
        """Paths and leaf values as arrays, made once per process."""
        made = getattr(self, "_arrays", None)
        if made is None:
            made = self._arrays = [(tree.paths(), np.array(tree.value)) for tree in self.trees]
        return made

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        flat, start = np.ascontiguousarray(x).reshape(-1), np.arange(len(x)) * x.shape[1]
        for paths, value in self._prepared():
            total += value.take(_followed(paths, flat, start, 1))
        if self.kind == "mean":
            return total / max(len(self.trees), 1)
        return 1.0 / (1.0 + np.exp(-total))

    def gains(self, features: int) -> list[float]:
        """Share of every feature in the gains of all splits; a forest takes the mean of its trees' shares."""
        total = np.zeros(features)
        for tree in self.trees:
            own = np.bincount(np.maximum(tree.feature, 0), np.where(np.array(tree.feature) >= 0, tree.gain, 0.0), features)
            total += own / own.sum() if self.kind == "mean" and own.sum() > 0 else own
        return (total / total.sum() if total.sum() > 0 else total).tolist()

    def to_json(self) -> dict:
        return {"kind": self.kind, "base": self.base, "trees": [vars(t) for t in self.trees]}

    @staticmethod
    def from_json(stored: Mapping) -> Ensemble:
        return Ensemble(stored["kind"], [Tree(**t) for t in stored["trees"]], stored["base"])


def score(df: DataFrame, values: Column, ensemble: Ensemble, output: str) -> DataFrame:
    """``df`` with the probability of the feature array ``values``; rows are handled in Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(ensemble)

    @F.pandas_udf("double")
    def probability(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.probability(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    return df.withColumn(output, probability(values))


def _matrix(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def reached(
    tree: Tree, x: np.ndarray | None, rows: np.ndarray | None, wanted: Sequence[int], goes_left: Callable | None = None
) -> Iterator[tuple[int, np.ndarray | None]]:
    """(node, its rows) for the wanted nodes of values by feature; None stands for all rows. Other branches are not followed.

    ``goes_left`` (of feature, threshold and rows) takes the place of the values.
    """
    leads = np.zeros(len(tree.feature), bool)
    leads[list(wanted)] = True
    ends = leads.copy()
    for node in range(len(leads) - 1, -1, -1):  # children come after their parent
        if tree.feature[node] >= 0:
            leads[node] |= leads[tree.left[node]] | leads[tree.right[node]]
    todo = [(0, rows)] if leads[0] else []
    while todo:
        node, own = todo.pop()
        if ends[node]:
            yield node, own
            continue
        if goes_left is not None:
            goes = goes_left(tree.feature[node], int(tree.threshold[node]), own)
        else:
            values, cut = x[tree.feature[node]], tree.threshold[node]
            goes = (values if own is None else values.take(own)) <= (int(cut) if values.dtype == np.uint8 else cut)
        for child, side in ((tree.left[node], goes), (tree.right[node], ~goes)):
            if leads[child]:
                todo.append((child, np.flatnonzero(side) if own is None else own.compress(side)))


# --- extremely randomised trees -------------------------------------------------------------


@dataclass
class OpenNodes:
    """Leaves that may be split: tree, leaf, heap number (root 1, children 2i and 2i+1) and class counts."""

    tree: np.ndarray
    leaf: np.ndarray
    heap: np.ndarray
    counts: np.ndarray

    def wanted(self, trees: Sequence[Tree]) -> list[dict[int, int]]:
        """Per tree, the place among the open nodes by node."""
        out: list[dict[int, int]] = [{} for _ in trees]
        for k, (t, n) in enumerate(zip(self.tree.tolist(), self.leaf.tolist())):
            out[t][n] = k
        return out


def _value_blocks(batches: Iterator[pa.RecordBatch | tuple]) -> Iterator[tuple[Sequence[np.ndarray], np.ndarray]]:
    """(values by feature, label) of up to FOREST_BLOCK_ROWS rows, from batches of rows or from smaller blocks."""
    held: list[tuple[Sequence[np.ndarray], np.ndarray]] = []

    def block() -> tuple[Sequence[np.ndarray], np.ndarray]:
        return [np.concatenate(values) for values in zip(*(x for x, _ in held))], np.concatenate([y for _, y in held])

    for batch in batches:
        x, y = batch if isinstance(batch, tuple) else (np.ascontiguousarray(_matrix(batch).T), batch.column(1).to_numpy())
        if held and sum(len(y) for _, y in held) + len(y) > FOREST_BLOCK_ROWS:
            yield block()
            held = []
        if len(y):
            held.append((x, y))
    if held:
        yield block()


def _packed_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as pickled blocks, a feature after the other."""
    held: list[pa.RecordBatch] = []

    def block() -> pa.RecordBatch:
        x = np.concatenate([_matrix(batch) for batch in held])
        y = np.concatenate([batch.column(1).to_numpy() for batch in held])
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps((list(np.ascontiguousarray(x.T)), y.astype(np.int8)))], pa.binary())], names=["block"])

    for batch in batches:
        if held and sum(map(len, held)) + len(batch) > PACK_ROWS:
            yield block()
            held = []
        if len(batch):
            held.append(batch)
    if held:
        yield block()


def _value_parts(blocks: Iterator[tuple]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Blocks of a task, put together; features of whole numbers below 256 as bytes."""
    for x, y in _value_blocks(blocks):
        narrow = (v.astype(np.uint8) if v.min() >= 0 and v.max() < 256 else None for v in x)
        yield [n if n is not None and np.array_equal(n, v) else v for n, v in zip(narrow, x)], y


def _open_rows(
    trees: Sequence[Tree], wanted: Sequence[Mapping[int, int]], x: Sequence[np.ndarray], n: int
) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]]:
    """Per tree: open nodes, the rows of one node after the other (None: all rows), and where each node's begin and end."""
    for tree, places in zip(trees, wanted):
        found = [(places[node], rows) for node, rows in reached(tree, x, None, list(places)) if rows is None or len(rows)] if places else []
        if found and found[0][1] is None:
            yield np.array([found[0][0]]), None, np.array([0]), np.array([n])
        elif found:
            ends = np.cumsum([len(rows) for _, rows in found])
            yield np.array([place for place, _ in found]), np.concatenate([rows for _, rows in found]), np.r_[0, ends[:-1]], ends


def _bounds(shared) -> Callable:
    """Least and greatest value of every feature in every open node, once per partition."""

    def run(batches: Iterator[pa.RecordBatch | tuple]) -> Iterator[pa.RecordBatch]:
        trees, wanted, tree_of, heap_of = shared.value
        least = most = None
        for x, y in _value_blocks(batches):
            if least is None:
                least, most = np.full((len(tree_of), len(x)), np.inf), np.full((len(tree_of), len(x)), -np.inf)
            whole = np.array([v.min() for v in x], float), np.array([v.max() for v in x], float)
            for nodes, rows, starts, _ in _open_rows(trees, wanted, x, len(y)):
                if rows is None:
                    lo, hi = whole
                else:
                    lo, hi = np.empty((len(nodes), len(x))), np.empty((len(nodes), len(x)))
                    for f, values in enumerate(x):
                        own = values.take(rows)
                        lo[:, f], hi[:, f] = np.minimum.reduceat(own, starts), np.maximum.reduceat(own, starts)
                least[nodes], most[nodes] = np.minimum(least[nodes], lo), np.maximum(most[nodes], hi)
        if least is None:
            return
        width = least.shape[1]
        seen = np.flatnonzero(least[:, 0] <= most[:, 0])
        for t in np.unique(tree_of[seen]).tolist():
            own = seen[tree_of[seen] == t]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(own) * width, t, np.int32)),
                    pa.array(np.repeat(heap_of[own], width).astype(np.int64)),
                    pa.array(np.tile(np.arange(width, dtype=np.int32), len(own))),
                    pa.array(least[own].reshape(-1)),
                    pa.array(most[own].reshape(-1)),
                ],
                names=["tree", "node", "feature", "lo", "hi"],
            )

    return run


def _left_counts(shared) -> Callable:
    """Rows of each class that every candidate of every open node sends left, in chunks of nodes."""

    def run(blocks: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        trees, wanted, feature, threshold = shared.value
        total = np.zeros((*feature.shape, 2), np.int64)
        for x, y in blocks:
            bad = y == 1
            for nodes, rows, starts, ends in _open_rows(trees, wanted, x, len(y)):
                positive = bad if rows is None else bad.take(rows)
                for node, start, end in zip(nodes.tolist(), starts.tolist(), ends.tolist()):
                    own, ones = (None, positive) if rows is None else (rows[start:end], positive[start:end])
                    for k, (f, cut) in enumerate(zip(feature[node].tolist(), threshold[node].tolist())):
                        if f >= 0:
                            values = x[f] if own is None else x[f].take(own)
                            goes = values <= (math.floor(cut) if values.dtype == np.uint8 else cut)
                            count, bads = np.count_nonzero(goes), np.count_nonzero(goes & ones)
                            total[node, k, 0] += count - bads
                            total[node, k, 1] += bads
        for at in range(0, len(total), CHUNK_NODES):
            yield at // CHUNK_NODES, total[at : at + CHUNK_NODES]

    return run


def node_draws(bounds: Sequence[pa.RecordBatch], per_node: int, seed: int) -> list[tuple[int, list[tuple[int, float]]]]:
    """(node, candidates) of a tree: up to ``per_node`` features that vary in the node, in drawn order, each with a threshold drawn
    evenly between its least and greatest value. Draws are md5 digits of (seed, tree, node, feature)."""
    found = pa.Table.from_batches(bounds).group_by(["tree", "node", "feature"]).aggregate([("lo", "min"), ("hi", "max")])
    nodes: dict[int, list[tuple[str, int, float, float, str]]] = {}
    for t, n, f, lo, hi in zip(*(found.column(c).to_pylist() for c in ("tree", "node", "feature", "lo_min", "hi_max"))):
        if lo < hi:
            name = f"{seed}|{t}|{n}|{f}"
            nodes.setdefault(n, []).append((hashlib.md5(name.encode()).hexdigest(), f, lo, hi, name))
    out = []
    for n, varying in nodes.items():
        candidates = []
        for _, f, lo, hi, name in sorted(varying)[:per_node]:
            cut = lo + int(hashlib.md5(f"{name}|cut".encode()).hexdigest()[:13], 16) / float(1 << 52) * (hi - lo)
            candidates.append((f, cut if cut < hi else lo))
        out.append((n, candidates))
    return out


def _gini_gain(left: np.ndarray, whole: np.ndarray, weights: np.ndarray) -> np.ndarray:
    def spread(counts: np.ndarray) -> np.ndarray:
        w = counts * weights
        total = np.maximum(w.sum(axis=-1), 1e-300)
        return total - (w * w).sum(axis=-1) / total

    return spread(whole) - spread(left) - spread(whole - left)


def grow_extra_trees(
    rows: DataFrame, features: int, *, trees: int = 240, depth: int = 9, leaf: int = 15, per_node: int | None = None,
    weights: Mapping[int, float] | None = None, seed: int = 42,
) -> Ensemble:
    """Extremely randomised trees without bootstrap on ``rows`` (x array<double>, y 0/1).

    In every node, ``per_node`` (root of the number) features are drawn, each with one threshold; the split with the greatest
    decrease of the weighted Gini impurity that leaves ``leaf`` rows on both sides is taken, the first of equals.
    Two jobs per level serve all trees: bounds of the open nodes, and class counts of the candidates.
    """
    spark = rows.sparkSession
    width = per_node or max(1, math.isqrt(features))
    own = np.array([(weights or {}).get(k, 1.0) for k in (0, 1)])
    seen = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    # Small blocks are dealt in turn and put together again, so that all tasks of a level have about as many rows.
    packed = rows.select("x", F.col("y").cast("int")).mapInArrow(_packed_values, "block binary").rdd.map(lambda r: pickle.loads(r[0]))
    tasks = max(1, min(_tasks(spark), math.ceil(sum(seen.values()) / TASK_ROWS)))
    given = packed.repartition(tasks).mapPartitions(_value_parts).persist(StorageLevel.MEMORY_AND_DISK)
    whole = np.array([seen.get(0, 0), seen.get(1, 0)], np.int64)

    def share(counts: np.ndarray) -> float:
        w = counts * own
        return float(w[1] / w.sum()) if w.sum() else 0.0

    forest = [Tree(value=[share(whole)], rows=[int(whole.sum())]) for _ in range(trees)]
    nodes = OpenNodes(np.arange(trees), np.zeros(trees, np.int64), np.ones(trees, np.int64), np.tile(whole, (trees, 1)))
    for _ in range(depth):
        able = (nodes.counts.min(axis=1) > 0) & (nodes.counts.sum(axis=1) >= 2 * leaf)
        nodes = OpenNodes(nodes.tree[able], nodes.leaf[able], nodes.heap[able], nodes.counts[able])
        if not len(nodes.tree):
            break
        wanted = nodes.wanted(forest)
        feature, threshold = np.full((len(nodes.tree), width), -1), np.full((len(nodes.tree), width), -np.inf)
        where = {key: k for k, key in enumerate(zip(nodes.tree.tolist(), nodes.heap.tolist()))}
        shared = spark.sparkContext.broadcast((forest, wanted, nodes.tree, nodes.heap))
        bounds = given.mapPartitions(_bounds(shared)).map(lambda batch: (batch.column(0)[0].as_py(), batch)).groupByKey(tasks)
        for t, drawn in bounds.mapValues(lambda batches: node_draws(list(batches), width, seed)).collect():
            for n, candidates in drawn:
                for k, (f, cut) in enumerate(candidates):
                    feature[where[t, n], k], threshold[where[t, n], k] = f, cut
        shared.unpersist()
        shared = spark.sparkContext.broadcast((forest, wanted, feature, threshold))
        counted = given.mapPartitions(_left_counts(shared)).reduceByKey(np.add, tasks).collectAsMap()
        left = np.concatenate([counted[c] for c in range(len(counted))])
        shared.unpersist()
        total = nodes.counts[:, None, :]
        gain = _gini_gain(left, total, own)
        allowed = (feature >= 0) & (left.sum(axis=2) >= leaf) & ((total - left).sum(axis=2) >= leaf)
        gain = np.where(allowed, gain, -np.inf)
        best = gain.argmax(axis=1)
        after: list[tuple[int, int, int, np.ndarray]] = []
        for k in np.flatnonzero(gain[np.arange(len(best)), best] > -np.inf).tolist():
            b, t = int(best[k]), int(nodes.tree[k])
            a, c = forest[t].split(int(nodes.leaf[k]), int(feature[k, b]), float(threshold[k, b]), float(max(gain[k, b], 0.0)))
            for child, heap, counts in ((a, 2 * nodes.heap[k], left[k, b]), (c, 2 * nodes.heap[k] + 1, nodes.counts[k] - left[k, b])):
                forest[t].value[child], forest[t].rows[child] = share(counts), int(counts.sum())
                after.append((t, child, int(heap), counts))
        if not after:
            break
        nodes = OpenNodes(*(np.array([a[c] for a in after]) for c in range(4)))
    given.unpersist()
    return Ensemble("mean", forest)


# --- random forests -------------------------------------------------------------------------

#: How often a row is drawn into a bootstrap sample (Poisson, mean 1), by 16 bits of its hash.
_BAG = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _coded_rows(cuts: Sequence[np.ndarray]) -> Callable:
    """Rows as one byte per feature (twice the bin, plus the label) and their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = _matrix(batch), batch.column(1).to_numpy()
            codes = np.empty((len(x), len(cuts)), np.uint8)
            for f, cut in enumerate(cuts):
                codes[:, f] = 2 * np.searchsorted(cut, x[:, f], "left") + (y == 1)
            ends = np.arange(len(x) + 1, dtype=np.int32) * len(cuts)
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([packed, batch.column(2)], names=["codes", "key"])

    return run


def _forest_blocks(width: int) -> Callable:
    """Blocks of rows that come in order of their key: codes by feature, and a number that tells equal rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, seen = [], 0, None, 0

        def block() -> pa.RecordBatch:
            codes = np.ascontiguousarray(np.concatenate([c for c, _ in held]).T)
            parts = codes.tobytes(), np.concatenate([d for _, d in held]).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.binary()) for part in parts], names=["codes", "draw"])

        for batch in batches:
            n = len(batch)
            if not n:
                continue
            if held and size + n > FOREST_BLOCK_ROWS:
                yield block()
                held, size = [], 0
            packed, key = batch.column(0).cast(pa.binary()), batch.column(1).to_numpy()
            at = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset]
            codes = np.frombuffer(packed.buffers()[2], np.uint8)[at : at + n * width].reshape(n, width)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            place = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
            if key[0] == last:  # the run of equal keys goes on from the batch before
                place[: starts[1] if len(starts) > 1 else n] += seen
            last, seen = key[-1], int(place[-1]) + 1
            held.append((codes, _hashed(key.view(np.uint64) ^ _hashed(place.astype(np.uint64), 0), 1)))
            size += n
        if held:
            yield block()

    return run


def _unpacked(row: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    draw = np.frombuffer(row[1], np.uint64)
    return np.frombuffer(row[0], np.uint8).reshape(-1, len(draw)), draw


def bagged(hashed: np.ndarray, tree: int) -> np.ndarray:
    """Rows of a tree's bootstrap sample, a row as often as it is drawn. One hash serves four trees."""
    times = _BAG.take(np.ascontiguousarray(hashed.view(np.uint16).reshape(-1, 4)[:, tree % 4]))
    found = [np.flatnonzero(times)]
    more = np.flatnonzero(times > 1)
    for k in range(2, int(times.max(initial=0)) + 1):
        found.append(more)
        more = more.compress(times.take(more) > k)
    return np.concatenate(found)


def _tree_hash(draw: np.ndarray, tree: int, seed: int) -> np.ndarray:
    return _hashed(draw, (seed << 20) + tree // 4 + 2)


def _drawn_features(nodes: OpenNodes, features: int, per_node: int, seed: int) -> np.ndarray:
    """The features that each node looks at, by hashes of (seed, tree, node, feature)."""
    place = _hashed(nodes.tree.astype(np.uint64) << np.uint64(32) ^ nodes.heap.astype(np.uint64), seed)
    order = np.stack([_hashed(place, f) for f in range(features)], axis=1)
    return np.argsort(order, axis=1, kind="stable")[:, :per_node]


def _class_histograms(shared, cells: int) -> Callable:
    """Rows per open node, looked-at feature, bin and class, in chunks of nodes."""

    def run(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
        trees, wanted, looked, seed = shared.value
        total = None
        for codes, draw in blocks:
            if total is None:
                total = np.zeros((*looked.shape, cells), np.int32)
            fours, hashed = None, None
            for t, places in wanted.items():
                if t // 4 != fours:
                    fours, hashed = t // 4, _tree_hash(draw, t, seed)
                for node, rows in reached(trees[t], codes, bagged(hashed, t), list(places)):
                    at = places[node]
                    for k, f in enumerate(looked[at].tolist()):
                        total[at, k] += np.bincount(codes[f].take(rows), minlength=cells)
        if total is not None:
            for at in range(0, len(total), CHUNK_NODES):
                yield at // CHUNK_NODES, total[at : at + CHUNK_NODES]

    return run


def _chosen(weights: np.ndarray, leaf: int) -> Callable:
    """The split of every node of a chunk: (place among its features, bin, gain, class counts sent left, class counts)."""

    def run(summed: np.ndarray) -> tuple[np.ndarray, ...]:
        n, looked, cells = summed.shape
        counts = summed.reshape(n, looked, cells // 2, 2).astype(np.int64)
        left = counts.cumsum(axis=2)
        whole = left[:, :1, -1:]
        gain = _gini_gain(left, whole, weights)
        allowed = (left.sum(axis=3) >= leaf) & ((whole - left).sum(axis=3) >= leaf)
        gain = np.where(allowed, gain, -np.inf).reshape(n, -1)
        best = gain.argmax(axis=1)
        k, b = best // (cells // 2), best % (cells // 2)
        own = np.arange(n)
        return k, b, gain[own, best], left[own, k, b], whole[:, 0, 0]

    return run


def grow_random_forest(
    rows: DataFrame, features: int, *, trees: int = 240, depth: int = 8, leaf: int = 20, per_node: int | None = None, bins: int = 32,
    weights: Mapping[int, float] | None = None, seed: int = 42,
) -> Ensemble:
    """A random forest on ``rows`` (x array<double>, y 0/1, key long that is equal for equal rows).

    Every tree sees a bootstrap sample: a row is drawn as often as a Poisson variable of mean 1 says, which is made from its key and
    its place among equal rows. In every node, ``per_node`` (root of the number, rounded up) features are looked at; the
    split between two of at most ``bins`` bins with the greatest decrease of the weighted Gini impurity that leaves ``leaf`` drawn
    rows on both sides is taken, the first of equals. A level of all trees is one job, or a few if its sums are large.
    """
    if not 2 <= bins <= 128:
        raise ValueError("BINS_RANGE")
    spark = rows.sparkSession
    width, leaf = per_node or max(1, math.ceil(math.sqrt(features))), max(leaf, 1)
    own = np.array([(weights or {}).get(k, 1.0) for k in (0, 1)])
    size = rows.count()
    cuts = cut_points(rows, size, bins, seed) if size else []
    most = 2 * max((len(c) + 1 for c in cuts), default=1)
    tasks = max(1, min(2 * spark.sparkContext.defaultParallelism, math.ceil(size / TASK_ROWS)))
    coded = rows.select("x", F.col("y").cast("int"), "key").mapInArrow(_coded_rows(cuts), "codes binary, key long")
    dealt = coded.repartition(tasks, "key").sortWithinPartitions("key", "codes")
    blocks = dealt.mapInArrow(_forest_blocks(max(len(cuts), 1)), "codes binary, draw binary").rdd.map(_unpacked).persist(StorageLevel.MEMORY_AND_DISK)

    def share(counts: np.ndarray) -> float:
        w = counts * own
        return float(w[1] / w.sum()) if w.sum() else 0.0

    forest = [Tree() for _ in range(trees)]
    nodes = OpenNodes(np.arange(trees), np.zeros(trees, np.int64), np.ones(trees, np.int64), np.zeros((trees, 2), np.int64))
    group = max(1, LEVEL_CELLS // (width * most))
    for level in range(depth):
        after: list[tuple[int, int, int, np.ndarray]] = []
        for at in range(0, len(nodes.tree) if size else 0, group):
            part = OpenNodes(*(values[at : at + group] for values in (nodes.tree, nodes.leaf, nodes.heap, nodes.counts)))
            looked = _drawn_features(part, features, width, seed)
            wanted = {t: places for t, places in enumerate(part.wanted(forest)) if places}
            shared = spark.sparkContext.broadcast((forest, wanted, looked, seed))
            partial = blocks.mapPartitions(_class_histograms(shared, most))
            chunks = math.ceil(len(part.tree) / CHUNK_NODES)
            chosen = partial.reduceByKey(np.add, min(tasks, chunks)).mapValues(_chosen(own, leaf)).collectAsMap()
            shared.unpersist()
            best, cut, gain, left, whole = (np.concatenate(values) for values in zip(*(chosen[c] for c in range(chunks))))
            for k in range(len(part.tree)):
                t, node = int(part.tree[k]), int(part.leaf[k])
                if level == 0:
                    forest[t].value[node], forest[t].rows[node] = share(whole[k]), int(whole[k].sum())
                if not gain[k] > 1e-9:
                    continue
                # Cells hold both classes of a bin, so that a bin ends at its odd code.
                pair = forest[t].split(node, int(looked[k, best[k]]), float(2 * cut[k] + 1), float(gain[k]))
                for child, heap, counts in zip(pair, (2 * part.heap[k], 2 * part.heap[k] + 1), (left[k], whole[k] - left[k])):
                    forest[t].value[child], forest[t].rows[child] = share(counts), int(counts.sum())
                    if counts.min() > 0 and counts.sum() >= 2 * leaf:
                        after.append((t, child, int(heap), counts))
        if not after:
            break
        nodes = OpenNodes(*(np.array([a[c] for a in after]) for c in range(4)))
    blocks.unpersist()
    for tree in forest:
        tree.threshold = [float(cuts[f][int(t) // 2]) if f >= 0 else 0.0 for f, t in zip(tree.feature, tree.threshold)]
    return Ensemble("mean", forest)


# --- second-order boosting ------------------------------------------------------------------


@dataclass(frozen=True)
class BoostingPlan:
    """How trees grow. ``depthwise`` splits every node of a level, ``leafwise`` the leaf with the greatest gain first, up to
    ``leaves``, and ``symmetric`` all nodes of a level at one place."""

    policy: str = "depthwise"
    rounds: int = 300
    rate: float = 0.035
    depth: int = 4
    leaves: int = 31
    penalty: float = 3.0
    least_hessian: float = 1.0
    least_rows: int = 1
    rows: float = 1.0
    columns: float = 1.0
    bins: int = MAX_BINS
    seed: int = 42


def cut_points(rows: DataFrame, n: int, bins: int, seed: int = 42) -> list[np.ndarray]:
    """Per feature the values that bound its bins from above, without the greatest one.

    These are all distinct values if ``bins`` are enough for them, else their quantiles. Of more than ``BIN_ROWS`` rows, about
    that many are looked at, drawn by their key; cut points decide where a split may lie, not what it counts.
    """
    drawn = rows
    if n > BIN_ROWS:
        share = int(BIN_ROWS / n * (1 << 32))
        drawn = rows.where(F.xxhash64("key", F.lit(seed)).bitwiseAND((1 << 32) - 1) < share)
    found = drawn.select("x").toArrow().column(0).combine_chunks()
    x = found.flatten().to_numpy(zero_copy_only=False).reshape(len(found), -1) if len(found) else np.zeros((0, 0))
    out = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if len(values) > bins:
            values = np.append(np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)), values[-1])
        out.append(values[values < values[-1]])
    return out


BLOCK_SCHEMA = "codes binary, y binary, key binary, margin binary"
_KINDS = (np.uint16, np.int8, np.int64, np.float64)


class Layout:
    """How the bins of several features make one number, so that a row is counted once for all of them.

    Features follow each other in groups of up to ``GROUP_CELLS`` combinations of their bins. With many features, whose sums
    would be large, a group has no more cells than a feature has bins.
    """

    def __init__(self, bins_of: Sequence[int]):
        self.bins_of = list(bins_of)
        if sum(self.bins_of) > MAX_JOINT_BINS:
            most = max(self.bins_of, default=1)
        else:
            most = GROUP_CELLS
        self.groups: list[list[int]] = []
        self.cells: list[int] = []
        for f in sorted(range(len(self.bins_of)), key=lambda f: (-self.bins_of[f], f)):
            fits = [g for g, n in enumerate(self.cells) if n * self.bins_of[f] <= most]
            if not fits:
                self.groups.append([])
                self.cells.append(1)
                fits = [len(self.cells) - 1]
            g = max(fits, key=lambda g: self.cells[g])
            self.groups[g].append(f)
            self.cells[g] *= self.bins_of[f]
        self.group_of = {f: g for g, own in enumerate(self.groups) for f in own}

    def coded(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.groups), bins.shape[1]), np.uint16)
        for g, own in enumerate(self.groups):
            for f in own:
                out[g] *= np.uint16(self.bins_of[f])
                out[g] += bins[f]
        return out

    def parts(self, g: int) -> tuple[int, ...]:
        return tuple(self.bins_of[f] for f in self.groups[g])

    def left_cells(self, feature: int, cut: int) -> np.ndarray:
        """Which cells of the feature's group hold bins up to ``cut``."""
        g = self.group_of[feature]
        shape = [1] * len(self.groups[g])
        shape[self.groups[g].index(feature)] = -1
        return np.broadcast_to((np.arange(self.bins_of[feature]) <= cut).reshape(shape), self.parts(g)).reshape(-1)

    def spread(self, joint: Sequence[np.ndarray], used: Sequence[int]) -> np.ndarray:
        """(feature, bin, sum) from the sums of the groups' cells."""
        out = np.zeros((len(self.bins_of), max(self.bins_of), joint[0].shape[-1]), np.int64)
        for g, own in enumerate(self.groups):
            cells = joint[g].reshape(*self.parts(g), -1)
            for k, f in enumerate(own):
                if f in used:
                    out[f, : self.bins_of[f]] = cells.sum(axis=tuple(a for a in range(len(own)) if a != k))
        return out


@dataclass
class Block:
    """Rows as arrays: bins of the features in groups (``Layout``), label, key (only where rows are drawn) and margin so far."""

    codes: np.ndarray
    y: np.ndarray
    key: np.ndarray
    margin: np.ndarray

    def packed(self) -> tuple[bytes, ...]:
        return self.codes.tobytes(), self.y.tobytes(), self.key.tobytes(), self.margin.tobytes()

    @staticmethod
    def unpacked(row: Sequence[bytes]) -> Block:
        codes, y, key, margin = (np.frombuffer(part, kind) for part, kind in zip(row, _KINDS))
        return Block(codes.reshape(-1, len(y)), y, key, margin)

    def goes_left(self, layout: Layout) -> Callable:
        def run(feature: int, cut: int, rows: np.ndarray | None) -> np.ndarray:
            codes = self.codes[layout.group_of[feature]]
            return layout.left_cells(feature, cut).take(codes if rows is None else codes.take(rows))

        return run


def _blocks(df: DataFrame, partitions: int) -> RDD:
    """The blocks of a written table, in memory as well; so many partitions at most."""
    return df.coalesce(partitions).rdd.map(Block.unpacked)


def _hashed(key: np.ndarray, turn: int) -> np.ndarray:
    h = key ^ np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for factor in _SPREAD:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def _binned(cuts: Sequence[np.ndarray], base: float, layout: Layout, keyed: bool) -> Callable:
    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        x = np.concatenate([_matrix(batch) for batch in held])
        y, key = (np.concatenate([batch.column(c).to_numpy() for batch in held]) for c in (1, 2))
        bins = np.empty((len(cuts), len(x)), np.uint8)
        for f, cut in enumerate(cuts):
            bins[f] = np.searchsorted(cut, x[:, f], "left")
        whole = Block(layout.coded(bins), y.astype(np.int8), key if keyed else key[:0], np.full(len(x), base))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.binary()) for part in whole.packed()], names=["codes", "y", "key", "margin"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if held and sum(map(len, held)) + len(batch) > BLOCK_ROWS:
                yield block(held)
                held = []
            if len(batch):
                held.append(batch)
        if held:
            yield block(held)

    return run


def gradients(margin: np.ndarray, y: np.ndarray, weights: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Weighted first and second derivatives of the log loss, as whole numbers of ``1 / SCALE``."""
    p = 1.0 / (1.0 + np.exp(-margin))
    w = np.where(y == 1, weights[1], weights[0])
    return np.rint(w * (p - y) * SCALE), np.rint(w * p * (1.0 - p) * SCALE)


def _advanced(tree: Tree, layout: Layout) -> Callable:
    """A block with the last tree on its margin."""

    def run(block: Block) -> Block:
        margin, leaves = block.margin.copy(), [node for node, f in enumerate(tree.feature) if f < 0]
        for node, rows in reached(tree, None, None, leaves, block.goes_left(layout)):
            if rows is None:
                margin += tree.value[node]
            else:
                margin[rows] = margin.take(rows) + tree.value[node]
        return Block(block.codes, block.y, block.key, margin)

    return run


def _histograms(
    tree: Tree, nodes: Sequence[int], used: Sequence[int], layout: Layout, weights: Sequence[float], plan: BoostingPlan, turn: int
) -> Callable:
    """Sums of gradient, hessian and rows per wanted node, feature and bin; gradients are made where they are added up."""
    groups = [g for g, own in enumerate(layout.groups) if any(f in used for f in own)]

    def run(blocks: Iterator[Block]) -> Iterator[np.ndarray]:
        total = {node: [np.zeros((n, 3), np.int64) for n in layout.cells] for node in nodes}
        for block in blocks:
            drawn = None
            if plan.rows < 1.0:
                drawn = np.flatnonzero(_hashed(block.key.view(np.uint64), turn) < np.uint64(int(plan.rows * 2.0**64)))
            all_g, all_h = gradients(block.margin, block.y, weights)
            for node, rows in reached(tree, None, drawn, nodes, block.goes_left(layout)):
                g, h = (all_g, all_h) if rows is None else (all_g.take(rows), all_h.take(rows))
                for i in groups:
                    own = block.codes[i] if rows is None else block.codes[i].take(rows)
                    own, sums = own.astype(np.intp), total[node][i]
                    for k, part in enumerate((g, h, None)):
                        sums[:, k] += np.bincount(own, part, len(sums)).astype(np.int64)
        yield np.stack([layout.spread(total[node], used) for node in nodes])

    return run


def _tasks(spark: SparkSession) -> int:
    """As many tasks as cores, or a multiple of them, up to ``DIRECT_PARTITIONS``."""
    cores = spark.sparkContext.defaultParallelism
    return cores * max(1, DIRECT_PARTITIONS // cores)


class _Grower:
    """Grows one tree after another; the trees in here split at bin numbers."""

    def __init__(self, table: DataFrame, layout: Layout, weights: Sequence[float], plan: BoostingPlan):
        self.spark, self.layout, self.weights, self.plan = table.sparkSession, layout, weights, plan
        self.bins_of = layout.bins_of
        self.features = len(self.bins_of)
        self.partitions = _tasks(self.spark)
        self.turn = 0
        self.kept: list[RDD] = []
        self._keep(_blocks(table, self.partitions))

    def _keep(self, blocks: RDD) -> None:
        """The rows of the round, which its first job brings into memory; those of the round before go with the next one."""
        self.table = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        self.parts = self.table.getNumPartitions()
        self.kept.append(self.table)
        while len(self.kept) > 2:
            self.kept.pop(0).unpersist()

    def advance(self, tree: Tree) -> None:
        """To the next round, with the last tree on the margins."""
        self.turn += 1
        blocks = self.table
        if self.turn % REFRESH_ROUNDS == 0:
            written = self.spark.createDataFrame(blocks.map(Block.packed), BLOCK_SCHEMA, verifySchema=False)
            blocks = _blocks(materialize(written, "margins"), self.partitions)
        self._keep(blocks.map(_advanced(tree, self.layout)))

    def close(self) -> None:
        for table in self.kept:
            table.unpersist()

    def sums(self, tree: Tree, nodes: Sequence[int], used: Sequence[int]) -> np.ndarray:
        """(node, feature, bin, [g, h, n]) of the wanted nodes, in one job."""
        counted = _histograms(tree, list(nodes), list(used), self.layout, self.weights, self.plan, self.turn)
        partial = self.table.mapPartitions(counted)
        if self.parts > DIRECT_PARTITIONS:
            return partial.treeReduce(np.add)
        zero = np.zeros((len(nodes), self.features, max(self.bins_of), 3), np.int64)
        return sum(partial.collect(), zero)

    def children(self, tree: Tree, parents: Sequence[tuple[int, np.ndarray, np.ndarray]], used: Sequence[int]) -> dict[int, np.ndarray]:
        """Histograms of the children of (node, its histogram, sums sent left): the smaller is counted, the other one is the rest."""
        small, large = [], []
        for node, own, goes in parents:
            whole = _whole(own[used[0]])
            pair = (tree.left[node], tree.right[node])
            small.append(pair[0] if 2 * goes[2] <= whole[2] else pair[1])
            large.append(pair[1] if small[-1] == pair[0] else pair[0])
        counted = self.sums(tree, small, used)
        out = {}
        for k, (_, own, _) in enumerate(parents):
            out[small[k]], out[large[k]] = counted[k], own - counted[k]
        return out

    def columns(self) -> list[int]:
        count = max(1, int(self.plan.columns * self.features))
        order = sorted(range(self.features), key=lambda f: hashlib.md5(f"{self.plan.seed}|{self.turn}|{f}".encode()).hexdigest())
        return sorted(order[:count])

    def value(self, sums: np.ndarray) -> float:
        g, h = sums[0] / SCALE, sums[1] / SCALE
        return float(-self.plan.rate * g / (h + self.plan.penalty)) if h + self.plan.penalty > 0 else 0.0

    def gain_table(self, own: np.ndarray, used: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """Gain of every split (feature, bin), -inf where it is not allowed, and the sums it sends left."""
        plan = self.plan
        left = np.cumsum(own[list(used)], axis=1)[:, :-1]
        whole = _whole(own[used[0]])
        right = whole - left
        (gl, hl), (gr, hr) = ((x[..., 0] / SCALE, x[..., 1] / SCALE) for x in (left, right))
        gain = (_strength(gl, hl, plan) + _strength(gr, hr, plan) - _strength(whole[0] / SCALE, whole[1] / SCALE, plan)) / 2
        if plan.policy != "symmetric":
            allowed = (np.minimum(hl, hr) >= plan.least_hessian) & (np.minimum(left[..., 2], right[..., 2]) >= plan.least_rows)
            gain = np.where(allowed, gain, -np.inf)
        return gain, left

    def best(self, own: np.ndarray, used: Sequence[int]) -> tuple[float, int, int, np.ndarray] | None:
        """Greatest gain above zero: (gain, feature, bin, sums sent left); the first of equals."""
        gain, left = self.gain_table(own, used)
        if not gain.size:
            return None
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        return (float(gain[f, b]), used[f], int(b), left[f, b]) if gain[f, b] > 1e-9 else None

    def tree(self) -> Tree:
        used = self.columns()
        tree = Tree()
        root = self.sums(tree, [0], used)[0]
        whole = _whole(root[used[0]])
        if whole[2]:
            tree.value[0], tree.rows[0] = self.value(whole), int(whole[2])
            {"depthwise": self._depthwise, "leafwise": self._leafwise, "symmetric": self._symmetric}[self.plan.policy](tree, root, used)
        return tree

    def _apply(self, tree: Tree, node: int, found: tuple[float, int, int, np.ndarray], whole: np.ndarray) -> None:
        gain, feature, at, left = found
        a, b = tree.split(node, feature, float(at), gain)
        for child, sums in ((a, left), (b, whole - left)):
            tree.value[child], tree.rows[child] = self.value(sums), int(sums[2])

    def _depthwise(self, tree: Tree, root: np.ndarray, used: Sequence[int]) -> None:
        level = {0: root}
        for depth in range(self.plan.depth):
            parents = []
            for node, own in level.items():
                found = self.best(own, used)
                if found is not None:
                    self._apply(tree, node, found, _whole(own[used[0]]))
                    parents.append((node, own, found[3]))
            if not parents or depth == self.plan.depth - 1:
                return
            level = self.children(tree, parents, used)

    def _symmetric(self, tree: Tree, root: np.ndarray, used: Sequence[int]) -> None:
        level = {0: root}
        for depth in range(self.plan.depth):
            tables = [self.gain_table(own, used) for own in level.values()]
            total = np.sum([gain for gain, _ in tables], axis=0)
            if not total.size:
                return
            f, b = np.unravel_index(int(total.argmax()), total.shape)
            if total[f, b] <= 1e-9:
                return
            parents = []
            for (node, own), (gain, left) in zip(level.items(), tables):
                self._apply(tree, node, (float(gain[f, b]), used[f], int(b), left[f, b]), _whole(own[used[0]]))
                parents.append((node, own, left[f, b]))
            if depth < self.plan.depth - 1:
                level = self.children(tree, parents, used)

    def _leafwise(self, tree: Tree, root: np.ndarray, used: Sequence[int]) -> None:
        """Best leaf first. Leaves that may be split soon get their children counted together, so that a tree takes about as
        many jobs as it has levels; which leaf is split next does not depend on that."""
        scratch = Tree()
        found = {0: self.best(root, used)}
        # Nodes are known by their place in the scratch tree; ``code`` (root 1, children 2i and 2i + 1) settles equal gains.
        sums, depth, code, real, ready = {0: root}, {0: 0}, {0: 1}, {0: 0}, set()
        queue = [(-found[0][0], 1, 0)] if found[0] else []
        leaves = 1
        while queue and leaves < self.plan.leaves:
            node = heapq.heappop(queue)[2]
            if node not in ready and depth[node] + 1 < self.plan.depth:
                ahead = [node, *[n for *_, n in heapq.nsmallest(self.plan.leaves - leaves - 1, queue)]]
                ahead = [n for n in ahead if n not in ready and depth[n] + 1 < self.plan.depth]
                for n in ahead:
                    scratch.split(n, found[n][1], float(found[n][2]), 0.0)
                for child, own in self.children(scratch, [(n, sums[n], found[n][3]) for n in ahead], used).items():
                    sums[child], found[child] = own, self.best(own, used)
                ready.update(ahead)
            self._apply(tree, real[node], found[node], _whole(sums[node][used[0]]))
            leaves += 1
            if node in ready:
                sides = (scratch.left[node], tree.left[real[node]]), (scratch.right[node], tree.right[real[node]])
                for side, (child, place) in enumerate(sides):
                    depth[child], code[child], real[child] = depth[node] + 1, 2 * code[node] + side, place
                    if found[child]:
                        heapq.heappush(queue, (-found[child][0], code[child], child))


def _whole(own: np.ndarray) -> np.ndarray:
    """Sums over the bins of a feature."""
    return own.sum(axis=0)


def _strength(g: np.ndarray, h: np.ndarray, plan: BoostingPlan) -> np.ndarray:
    return g * g / np.maximum(h + plan.penalty, 1e-12)


def _start(rows: DataFrame, features: int, plan: BoostingPlan, weights: Mapping[int, float] | None) -> tuple[_Grower, list[np.ndarray], float]:
    """Binned rows at the margin of the weighted classes, the cut points, and that margin."""
    if plan.policy not in ("depthwise", "leafwise", "symmetric"):
        raise ValueError(f"POLICY_UNSUPPORTED: {plan.policy}")
    if not 2 <= plan.bins <= 256:
        raise ValueError("BINS_RANGE")
    seen = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    own = [(weights or {}).get(k, 1.0) for k in (0, 1)]
    mass = [own[k] * seen.get(k, 0) for k in (0, 1)]
    base = math.log(mass[1] / mass[0]) if min(mass) > 0 else 0.0
    cuts = cut_points(rows, sum(seen.values()), plan.bins, plan.seed)
    layout = Layout([len(c) + 1 for c in cuts])
    binned = rows.select("x", F.col("y").cast("int"), "key").mapInArrow(_binned(cuts, base, layout, plan.rows < 1.0), BLOCK_SCHEMA)
    # Blocks are dealt in turn, so that every task of a level has about as many of them.
    return _Grower(materialize(binned.repartition(_tasks(rows.sparkSession)), "bins"), layout, own, plan), cuts, base


def first_histogram(rows: DataFrame, features: int, plan: BoostingPlan, weights: Mapping[int, float] | None = None) -> list[tuple]:
    """(feature, bin, rows, gradient, hessian) before the first tree, of all features that vary."""
    grower, cuts, _ = _start(rows, features, plan, weights)
    own = grower.sums(Tree(), [0], range(features))[0]
    grower.close()
    places = [(f, b) for f in range(features) if len(cuts[f]) for b in range(len(cuts[f]) + 1) if own[f, b, 2]]
    return [(f, b, int(own[f, b, 2]), float(own[f, b, 0] / SCALE), float(own[f, b, 1] / SCALE)) for f, b in places]


def grow_boosted(rows: DataFrame, features: int, plan: BoostingPlan, weights: Mapping[int, float] | None = None) -> Ensemble:
    """Boosted trees with Newton leaf values on ``rows`` (x array<double>, y 0/1, key long for row sampling).

    Every round adds a tree on the gradients and hessians of the log loss at the margins so far. Features are cut into at
    most ``plan.bins`` bins. A level of a tree is one job.
    """
    grower, cuts, base = _start(rows, features, plan, weights)
    out = []
    for turn in range(plan.rounds):
        if turn:
            grower.advance(out[-1])
        out.append(grower.tree())
    grower.close()
    for tree in out:
        tree.threshold = [float(cuts[f][int(t)]) if f >= 0 else 0.0 for f, t in zip(tree.feature, tree.threshold)]
    return Ensemble("logit", out, base)


# --- ordered target statistics --------------------------------------------------------------


def ordered_target_codes(df: DataFrame, categories: Sequence[str], label: str, order: Column, prior: float, strength: float = 1.0) -> DataFrame:
    """``df`` with a column ``<c>_code`` for each category column: the label's mean over the rows of the category that come
    earlier in ``order`` (a hexadecimal digest), drawn towards ``prior`` by ``strength`` rows.

    No row's code knows its own label. Earlier rows are counted by the first four digits of the digest, and one by one only
    inside them, so that a category with most of the rows is not ordered in one task.
    """
    out = df.withColumn("__digest", order).withColumn("__prefix", F.substring("__digest", 1, 4))
    for c in categories:
        value = F.col(f"`{c}`")
        keyed = out.withColumn("__category", F.when(value.isNull(), "").otherwise(F.concat(F.lit("="), value.cast("string"))))
        starts = keyed.groupBy("__category", "__prefix").agg(F.sum(label).alias("s"), F.count("*").alias("n"))
        run = Window.partitionBy("__category").orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
        starts = starts.select("__category", "__prefix", F.sum("s").over(run).alias("__s"), F.sum("n").over(run).alias("__n"))
        inside = Window.partitionBy("__category", "__prefix").orderBy("__digest").rowsBetween(Window.unboundedPreceding, -1)
        joined = keyed.withColumn("__si", F.sum(label).over(inside)).withColumn("__ni", F.count("*").over(inside))
        joined = joined.join(starts, ["__category", "__prefix"])
        good = F.coalesce("__s", F.lit(0)) + F.coalesce("__si", F.lit(0))
        rows = F.coalesce("__n", F.lit(0)) + F.col("__ni")
        code = (good + F.lit(strength * prior)) / (rows + F.lit(strength))
        out = joined.withColumn(f"{c}_code", code).drop("__category", "__s", "__n", "__si", "__ni")
    return out.drop("__digest", "__prefix")


def target_codes(df: DataFrame, category: str, label: str, prior: float, strength: float = 1.0) -> DataFrame:
    """(category, code) from all rows, for rows that were not learnt from."""
    code = (F.sum(label) + F.lit(strength * prior)) / (F.count("*") + F.lit(strength))
    return df.groupBy(F.col(f"`{category}`").alias("category")).agg(code.alias("code"))



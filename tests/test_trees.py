"""Tree ensembles against row-level loops with the same draws."""

from __future__ import annotations

import hashlib
import math
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lendwright.operators import trees
from lendwright.operators.order_statistics import hash_order
from lendwright.session import materialize

WEIGHTS = {0: 0.7, 1: 1.9}


def made(n=500, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n).round(2), rng.integers(0, 4, n), rng.random(n) < 0.1, np.full(n, 3.0), rng.exponential(size=n).round(1)])
    y = ((x[:, 0] + x[:, 1] * 0.5 + rng.normal(size=n)) > 1).astype(int)
    return x.astype(float), y


@pytest.fixture(scope="module")
def table(spark):
    x, y = made()
    rows = [([float(v) for v in a], int(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "x array<double>, y int").withColumn("key", F.xxhash64("x", "y"))
    return materialize(df.repartition(5))


def md5(*parts):
    return hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()


def brute_extra(x, y, tree, depth, leaf, width, seed):
    """Nested tuples (feature, cut, left, right) or a probability."""

    def gini(rows):
        w = [WEIGHTS[k] * int((y[rows] == k).sum()) for k in (0, 1)]
        return sum(w) - sum(v * v for v in w) / max(sum(w), 1e-300), w

    def grow(rows, heap, level):
        impurity, w = gini(rows)
        share = w[1] / sum(w)
        if level == depth or min(w) == 0 or len(rows) < 2 * leaf:
            return share
        varying = [f for f in range(x.shape[1]) if x[rows, f].min() < x[rows, f].max()]
        best = None
        for f in sorted(varying, key=lambda f: (md5(seed, tree, heap, f), f))[:width]:
            lo, hi = x[rows, f].min(), x[rows, f].max()
            cut = lo + int(md5(seed, tree, heap, f, "cut")[:13], 16) / 2**52 * (hi - lo)
            cut = cut if cut < hi else lo
            goes = x[rows, f] <= cut
            if min(goes.sum(), (~goes).sum()) < leaf:
                continue
            gain = impurity - gini(rows[goes])[0] - gini(rows[~goes])[0]
            if best is None or gain > best[0]:
                best = gain, f, cut, goes
        if best is None:
            return share
        _, f, cut, goes = best
        return f, cut, grow(rows[goes], 2 * heap, level + 1), grow(rows[~goes], 2 * heap + 1, level + 1)

    return grow(np.arange(len(x)), 1, 0)


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return tree.value[node]
    return tree.feature[node], tree.threshold[node], nested(tree, tree.left[node]), nested(tree, tree.right[node])


def same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-12) and same(a[2], b[2]) and same(a[3], b[3])
    return not isinstance(a, tuple) and not isinstance(b, tuple) and a == pytest.approx(b, abs=1e-9)


def test_extra_trees_equal_loops(table):
    x, y = made()
    grown = trees.grow_extra_trees(table, 5, trees=6, depth=5, leaf=7, per_node=2, weights=WEIGHTS, seed=9)
    for t, tree in enumerate(grown.trees):
        assert same(nested(tree), brute_extra(x, y, t, 5, 7, 2, 9))
    assert {t.rows[0] for t in grown.trees} == {len(x)}
    assert grown.gains(5)[3] == 0 and sum(grown.gains(5)) == pytest.approx(1)


def brute_boosted(x, y, plan, rounds):
    """Margins after ``rounds`` trees, grown by looking at every row for every possible cut."""
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if len(values) > plan.bins:
            values = np.append(np.unique(np.quantile(x[:, f], np.arange(1, plan.bins) / plan.bins)), values[-1])
        cuts.append([c for c in values if c < values[-1]])
    w = np.where(y == 1, WEIGHTS[1], WEIGHTS[0])
    margin = np.full(len(y), math.log(w[y == 1].sum() / w[y == 0].sum()))
    out = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint(w * (p - y) * trees.SCALE) / trees.SCALE, np.rint(w * p * (1 - p) * trees.SCALE) / trees.SCALE

        def strength(rows):
            return g[rows].sum() ** 2 / max(h[rows].sum() + plan.penalty, 1e-12)

        def value(rows):
            return -plan.rate * g[rows].sum() / (h[rows].sum() + plan.penalty)

        def gain(rows, f, c):
            goes = x[rows, f] <= c
            a, b = rows[goes], rows[~goes]
            if plan.policy != "symmetric":
                if min(len(a), len(b)) < plan.least_rows or min(h[a].sum(), h[b].sum()) < plan.least_hessian:
                    return -math.inf, a, b
            return (strength(a) + strength(b) - strength(rows)) / 2, a, b

        def best(rows):
            found = None
            for f in range(x.shape[1]):
                for c in cuts[f]:
                    v, a, b = gain(rows, f, c)
                    if v > 1e-9 and (found is None or v > found[0] + 1e-12):
                        found = v, f, c, a, b
            return found

        leaves = [(np.arange(len(y)), 0, 1)]
        if plan.policy == "leafwise":
            while len(leaves) < plan.leaves:
                able = [(best(rows), d, code, k) for k, (rows, d, code) in enumerate(leaves) if d < plan.depth]
                able = [a for a in able if a[0]]
                if not able:
                    break
                found, d, code, k = min(able, key=lambda a: (-round(a[0][0], 9), a[2]))
                leaves[k : k + 1] = [(found[3], d + 1, 2 * code), (found[4], d + 1, 2 * code + 1)]
        else:
            for _ in range(plan.depth):
                if plan.policy == "symmetric":
                    total = {(f, c): sum(gain(rows, f, c)[0] for rows, *_ in leaves) for f in range(x.shape[1]) for c in cuts[f]}
                    top = max(total.values())
                    if top <= 1e-9:
                        break
                    f, c = next(k for k, v in total.items() if v >= top - 1e-12)
                    leaves = [(part, 0, 0) for rows, *_ in leaves for part in gain(rows, f, c)[1:]]
                else:
                    after = []
                    for rows, *_ in leaves:
                        found = best(rows) if len(rows) else None
                        after += [(rows, 0, 0)] if found is None else [(found[3], 0, 0), (found[4], 0, 0)]
                    leaves = after
        out.append(sorted(len(rows) for rows, *_ in leaves))
        for rows, *_ in leaves:
            if len(rows):
                margin[rows] += value(rows)
    return margin, out


PLANS = [
    trees.BoostingPlan("depthwise", 3, 0.3, 3, penalty=3.0, bins=16),
    trees.BoostingPlan("leafwise", 3, 0.3, 4, leaves=6, penalty=0.0, least_rows=10, least_hessian=0.001, bins=16),
    trees.BoostingPlan("leafwise", 2, 0.3, 2, leaves=20, penalty=1.0, bins=8),
    trees.BoostingPlan("symmetric", 3, 0.3, 3, penalty=3.0, bins=16),
]


@pytest.mark.parametrize("plan", PLANS, ids=lambda p: f"{p.policy}{p.depth}")
def test_boosting_equals_loops(table, plan, monkeypatch):
    monkeypatch.setattr(trees, "REFRESH_ROUNDS", 2)
    x, y = made()
    grown = trees.grow_boosted(table, 5, plan, WEIGHTS)
    margin, sizes = brute_boosted(x, y, plan, plan.rounds)
    for tree, want in zip(grown.trees, sizes):
        assert sorted(r for r, f in zip(tree.rows, tree.feature) if f < 0) == want
    np.testing.assert_allclose(grown.probability(x), 1 / (1 + np.exp(-margin)), atol=1e-9)


def test_sampled_rows_and_columns(table):
    plan = trees.BoostingPlan(rounds=4, rate=0.3, depth=2, rows=0.5, columns=0.4, bins=16)
    grown = trees.grow_boosted(table, 5, plan, WEIGHTS)
    assert all(150 < t.rows[0] < 350 for t in grown.trees) and len({t.rows[0] for t in grown.trees}) > 1
    assert all(len({f for f in t.feature if f >= 0}) <= 2 for t in grown.trees)
    again = trees.grow_boosted(table.repartition(2), 5, plan, WEIGHTS)
    assert [vars(t) for t in again.trees] == [vars(t) for t in grown.trees]


def test_scores_and_storage(table):
    grown = trees.grow_boosted(table, 5, PLANS[0], WEIGHTS)
    back = trees.Ensemble.from_json(grown.to_json())
    rows = trees.score(table, F.col("x"), back, "p").collect()
    np.testing.assert_allclose([r.p for r in rows], grown.probability(np.array([r.x for r in rows])), atol=1e-12)


def test_one_class_and_constant_features(spark):
    one = spark.createDataFrame([([1.0, 2.0], 0, 1), ([2.0, 2.0], 0, 2)], "x array<double>, y int, key long")
    assert trees.grow_extra_trees(one, 2, trees=2).probability(np.ones((1, 2))).tolist() == [0.0]
    flat = spark.createDataFrame([([1.0], k % 2, k) for k in range(40)], "x array<double>, y int, key long")
    assert trees.grow_boosted(flat, 1, PLANS[0]).probability(np.ones((1, 1))).tolist() == [0.5]
    with pytest.raises(ValueError, match="POLICY_UNSUPPORTED"):
        trees.grow_boosted(flat, 1, trees.BoostingPlan("other"))


def test_ordered_codes_equal_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(k, str(rng.choice(["a", "b", "c"])) if k % 9 else None, int(rng.random() < 0.4)) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, c string, y int")
    got = {r.id: r.c_code for r in trees.ordered_target_codes(df, ["c"], "y", hash_order(F.col("id"), 42), 0.4, 2.0).collect()}
    seen = {}
    for i, c, y in sorted(rows, key=lambda r: hashlib.md5(f"{r[0]}|42".encode()).hexdigest()):
        s, n = seen.get(c, (0, 0))
        assert got[i] == pytest.approx((s + 0.8) / (n + 2))
        seen[c] = s + y, n + 1
    full = {r.category: r.code for r in trees.target_codes(df, "c", "y", 0.4, 2.0).collect()}
    assert full == {c: pytest.approx((s + 0.8) / (n + 2)) for c, (s, n) in seen.items()}


def test_boosting_plans_no_query_per_level(table, monkeypatch):
    """Rounds and levels are jobs over blocks in memory; a query for each of them cost more than its rows."""
    calls, arrow = [], type(table).toArrow
    monkeypatch.setattr(type(table), "toArrow", lambda df: calls.append(1) or arrow(df))
    monkeypatch.setattr(trees, "DIRECT_PARTITIONS", 2)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 60)
    plan = trees.BoostingPlan("depthwise", 6, 0.3, 3, rows=0.8, bins=16)
    grown = trees.grow_boosted(table, 5, plan, WEIGHTS)
    assert len(calls) <= 1
    monkeypatch.undo()
    assert [vars(t) for t in grown.trees] == [vars(t) for t in trees.grow_boosted(table.repartition(1), 5, plan, WEIGHTS).trees]


def test_reached_rows_are_those_of_the_leaves(table):
    x, _ = made()
    bins = np.ascontiguousarray(np.clip(np.rint(x * 2) + 6, 0, 40).astype(np.uint8).T)
    tree = trees.Tree()
    a, b = tree.split(0, 0, 6.0, 1.0)
    tree.split(b, 1, 8.0, 1.0)
    want = tree.leaves(bins.T)
    drawn = np.arange(0, len(x), 3)
    for rows in (None, drawn):
        found = dict(trees.reached(tree, bins, rows, [a, tree.left[b]]))
        for node, own in found.items():
            np.testing.assert_array_equal(own, [r for r in (range(len(x)) if rows is None else rows) if want[r] == node])
        assert set(found) == {a, tree.left[b]}


def test_bounds_leave_a_partition_once():
    """Every batch used to send the bounds of all its nodes."""
    x, y = made(400)
    batches = [
        pa.RecordBatch.from_arrays([pa.array(x[at : at + 40].tolist()), pa.array(y[at : at + 40])], names=["x", "y"]) for at in range(0, 400, 40)
    ]
    forest = [trees.Tree(), trees.Tree()]
    a, b = forest[1].split(0, 0, 0.0, 1.0)
    nodes = trees.OpenNodes(np.array([0, 1, 1]), np.array([0, a, b]), np.array([1, 2, 3]), np.zeros((3, 2)))
    shared = SimpleNamespace(value=(forest, nodes.wanted(forest), nodes.tree, nodes.heap))
    found = pa.Table.from_batches(trees._bounds(shared)(iter(batches))).to_pylist()
    assert len(found) == 3 * x.shape[1]
    for r in found:
        own = x if r["node"] == 1 else x[(x[:, 0] <= 0.0) == (r["node"] == 2)]
        assert (r["lo"], r["hi"]) == (own[:, r["feature"]].min(), own[:, r["feature"]].max())


def brute_forest(x, y, key, tree, depth, leaf, width, bins, seed):
    """Nested tuples (feature, cut, left, right) or a probability, from a bootstrap sample made row by row."""
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if len(values) > bins:
            values = np.append(np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)), values[-1])
        cuts.append([c for c in values if c < values[-1]])
    seen, sample = {}, []
    for i in np.lexsort((y, key)):
        place = seen[key[i]] = seen.get(key[i], -1) + 1
        draw = trees._hashed(key[i : i + 1].view(np.uint64) ^ trees._hashed(np.array([place], np.uint64), 0), 1)
        digits = int(trees._hashed(draw, (seed << 20) + tree // 4 + 2)[0]) >> 16 * (tree % 4) & 0xFFFF
        at, times, share = (digits + 0.5) / 65536, 0, math.exp(-1)
        while at > share:
            times += 1
            at, share = at - share, share / times
        sample += [i] * times

    def spread(rows):
        w = [WEIGHTS[k] * int((y[rows] == k).sum()) for k in (0, 1)]
        return sum(w) - sum(v * v for v in w) / max(sum(w), 1e-300), w

    def grow(rows, heap, level):
        impurity, w = spread(rows)
        share = w[1] / sum(w)
        if level == depth or min(w) == 0 or len(rows) < 2 * leaf:
            return share
        nodes = trees.OpenNodes(np.array([tree]), np.array([0]), np.array([heap]), np.zeros((1, 2)))
        best = None
        for f in trees._drawn_features(nodes, x.shape[1], width, seed)[0]:
            for c in cuts[f]:
                goes = x[rows, f] <= c
                if min(goes.sum(), (~goes).sum()) < leaf:
                    continue
                gain = impurity - spread(rows[goes])[0] - spread(rows[~goes])[0]
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = gain, f, c, goes
        if best is None:
            return share
        _, f, c, goes = best
        return f, c, grow(rows[goes], 2 * heap, level + 1), grow(rows[~goes], 2 * heap + 1, level + 1)

    return grow(np.array(sample), 1, 0)


@pytest.mark.parametrize("block, cells", [(1 << 18, 1 << 24), (70, 400)])
def test_random_forest_equals_loops(table, monkeypatch, block, cells):
    monkeypatch.setattr(trees, "FOREST_BLOCK_ROWS", block)
    monkeypatch.setattr(trees, "LEVEL_CELLS", cells)
    monkeypatch.setattr(trees, "CHUNK_NODES", 3)
    monkeypatch.setattr(trees, "TASK_ROWS", 120)
    rows = table.union(table.limit(40))  # some rows come twice
    grown = trees.grow_random_forest(rows, 5, trees=6, depth=4, leaf=8, per_node=2, bins=12, weights=WEIGHTS, seed=9)
    found = rows.collect()
    x, y, key = (np.array(v) for v in zip(*((r.x, r.y, r.key) for r in found)))
    for t, tree in enumerate(grown.trees):
        assert same(nested(tree), brute_forest(x, y, key, t, 4, 8, 2, 12, 9))
    assert grown.gains(5)[3] == 0 and sum(grown.gains(5)) == pytest.approx(1)
    again = trees.grow_random_forest(rows.repartition(2), 5, trees=6, depth=4, leaf=8, per_node=2, bins=12, weights=WEIGHTS, seed=9)
    assert [vars(t) for t in again.trees] == [vars(t) for t in grown.trees]


def test_bootstrap_samples_draw_equal_rows_apart():
    """Copies of a row are drawn on their own, in blocks of any size, and a sample holds about as many rows as there are."""
    n = 40_000
    batches = [pa.RecordBatch.from_arrays([pa.array([b"\x01"] * k, pa.binary()), pa.array([7] * k, pa.int64())], names=["c", "k"]) for k in (n - 9, 9)]
    draws = np.concatenate([np.frombuffer(b.column(1)[0].as_py(), np.uint64) for b in trees._forest_blocks(1)(iter(batches))])
    assert len(set(draws.tolist())) == n
    for tree in (0, 3, 4):
        rows = trees.bagged(trees._tree_hash(draws, tree, 42), tree)
        assert abs(len(rows) - n) < 5 * math.sqrt(n) and abs(len(set(rows.tolist())) - n * (1 - math.exp(-1))) < 5 * math.sqrt(n)


def test_one_class_has_no_forest_split(spark):
    one = spark.createDataFrame([([1.0, 2.0], 0, 1), ([2.0, 2.0], 0, 2)], "x array<double>, y int, key long")
    assert trees.grow_random_forest(one, 2, trees=3).probability(np.ones((1, 2))).tolist() == [0.0]
    assert trees.grow_random_forest(one.limit(0), 2, trees=3).probability(np.ones((1, 2))).tolist() == [0.0]


def test_layout_counts_features_together():
    """Bins of several features are one number; sums per feature and the sides of a split come back from it."""
    rng = np.random.default_rng(4)
    for bins_of, groups in (([64, 2, 7, 64, 2, 2, 9, 1], 3), ([64] * 70, 70)):
        bins = np.stack([rng.integers(0, n, 900) for n in bins_of]).astype(np.uint8)
        layout = trees.Layout(bins_of)
        assert len(layout.groups) <= groups and max(layout.cells) <= trees.GROUP_CELLS
        codes = layout.coded(bins)
        joint = [np.stack([np.bincount(codes[g], minlength=n)] * 2, axis=1) for g, n in enumerate(layout.cells)]
        found = layout.spread(joint, range(len(bins_of)))
        block = trees.Block(codes, np.zeros(900, np.int8), np.zeros(0, np.int64), np.zeros(900))
        for f, n in enumerate(bins_of):
            np.testing.assert_array_equal(found[f, :n, 1], np.bincount(bins[f], minlength=n))
            np.testing.assert_array_equal(block.goes_left(layout)(f, n // 2, None), bins[f] <= n // 2)


def test_boosting_sends_few_bytes_a_row(table, monkeypatch):
    """A level used to send bins, key, gradients and hessians of every row: 51 bytes with 18 features."""
    seen, run = [], trees._Grower.sums
    monkeypatch.setattr(trees._Grower, "sums", lambda self, *args: seen.append(self.table.map(lambda b: (sum(map(len, b.packed())), len(b.y))).collect()) or run(self, *args))
    trees.grow_boosted(table, 5, trees.BoostingPlan("symmetric", 1, 0.3, 1), WEIGHTS)
    size, rows = map(sum, zip(*seen[0]))
    assert rows == 500 and size <= 13 * rows


def test_extra_trees_plan_no_query_per_level(table, monkeypatch):
    """Every level used to turn all rows into Arrow arrays twice and to plan a query for the bounds."""
    calls, arrow = [], type(table).mapInArrow
    monkeypatch.setattr(type(table), "mapInArrow", lambda df, *args, **kwargs: calls.append(1) or arrow(df, *args, **kwargs))
    monkeypatch.setattr(trees, "PACK_ROWS", 70)
    monkeypatch.setattr(trees, "FOREST_BLOCK_ROWS", 150)
    monkeypatch.setattr(trees, "CHUNK_NODES", 3)
    monkeypatch.setattr(trees, "TASK_ROWS", 200)
    grown = trees.grow_extra_trees(table, 5, trees=4, depth=5, leaf=7, per_node=2, weights=WEIGHTS, seed=9)
    assert len(calls) == 1
    monkeypatch.undo()
    again = trees.grow_extra_trees(table.repartition(1), 5, trees=4, depth=5, leaf=7, per_node=2, weights=WEIGHTS, seed=9)
    assert [vars(t) for t in again.trees] == [vars(t) for t in grown.trees]


def test_scores_follow_uneven_trees():
    """All rows of a batch go down a tree at once; leaves at different depths, values at a threshold, NaN and infinite ones."""
    tree = trees.Tree()
    a, b = tree.split(0, 0, 1.0, 1.0)
    tree.split(tree.split(a, 1, 0.0, 1.0)[1], 0, -math.inf, 1.0)
    tree.value = [float(k) for k in range(len(tree.feature))]
    x = np.array([[p, q] for p in (-math.inf, 0.5, 1.0, 1.5, math.inf, math.nan) for q in (-1.0, 0.0, math.nan)])
    def leaf(row, node=0):
        return node if tree.feature[node] < 0 else leaf(row, (tree.left if row[tree.feature[node]] <= tree.threshold[node] else tree.right)[node])
    assert tree.leaves(x).tolist() == [leaf(row) for row in x]
    np.testing.assert_allclose(trees.Ensemble("mean", [tree, trees.Tree(value=[2.0])]).probability(x), [(leaf(r) + 2) / 2 for r in x])

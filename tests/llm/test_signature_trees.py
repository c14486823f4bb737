"""The Jaccard join by signature trees against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lendwright.llm import signature_trees as st
from tests.llm.test_dedup import lower


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    size = min(4, len(found))
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if found else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted([(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)], key=repr)


def got(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, token string, class string, size int")
    return sorted([tuple(r) for r in st.report(docs).collect()], key=repr)


HARD = [
    (1, "One two three four five six seven"),
    (2, "one TWO three four\tfive six seven"),
    (3, "one two three four five six eight"),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (7, "short text"),
    (8, "SHORT text"),
    (9, "short texts"),
    (9, "short texts"),
    (None, "short text"),
    (None, None),
    (None, "only without an id here"),
    (12, "a a a a a a a a"),
    (13, "a a a a"),
    (14, "ÉTÉ été ß straße"),
    (15, "été été ß straße"),
    (16, " ".join(f"w{k}" for k in range(60_000))),
    (17, " ".join(f"w{k}" for k in range(60_000)) + " end"),
]


def test_hard_rows(spark):
    assert got(spark, HARD) == brute(HARD)


def test_empty_table(spark):
    assert got(spark, []) == []


def edited(words, rng, share):
    return [f"e{rng.random()}" if rng.random() < share else w for w in words]


def families(seed):
    """Chains of copies near the threshold, a passage that half of all texts hold, texts that are little else."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for family in range(12):
        base = [f"f{family}x{k}" for k in range(rng.choice([20, 80, 150]))]
        own = base
        for _ in range(rng.randrange(2, 12)):
            rows.append(own)
            own = edited(own if rng.random() < 0.5 else base, rng, rng.choice([0.005, 0.01, 0.02, 0.04]))
    rows += [passage + [f"u{k}n{j}" for j in range(rng.choice([0, 3, 8, 100]))] for k in range(40)]
    rows += [[rng.choice("abc") for _ in range(rng.randrange(1, 40))] for _ in range(40)]
    rng.shuffle(rows)
    return [(k, " ".join(r)) for k, r in enumerate(rows)]


@pytest.mark.parametrize("chunk", [1024, 8])
def test_families(spark, monkeypatch, chunk):
    """Small chunks send pairs of chunks through the join that large trees take."""
    monkeypatch.setattr(st, "CHUNK", chunk)
    rows = families(chunk)
    assert got(spark, rows) == brute(rows)


def test_copies_beyond_one_chunk(spark, monkeypatch):
    monkeypatch.setattr(st, "CHUNK", 16)
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(100)]
    rows += [(1000 + k, " ".join(base[: 50 + k])) for k in range(50)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", range(6))
def test_traversal_keeps_every_link(seed):
    """All pairs of sets at or above the threshold come out of the trees, with an overlap that is not below the true one."""
    rng = np.random.default_rng(seed)
    universe = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = []
    for _ in range(70):
        base = sets[rng.integers(len(sets))] if sets and rng.random() < 0.6 else rng.choice(universe, rng.integers(1, 120), replace=False)
        own = base[rng.random(len(base)) > 0.06]
        sets.append(np.unique(np.append(own, rng.choice(universe, 2))))
    sets.sort(key=len)
    component, size = np.arange(len(sets)), np.array([len(x) for x in sets])
    bits = st.bitmaps(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]))
    i, j, overlap = st._candidates(size, component, np.zeros(len(sets), int), bits)
    found = {(min(a, b), max(a, b)): o for a, b, o in zip(i.tolist(), j.tolist(), overlap.tolist())}
    assert len(found) == len(i)
    i, j, _ = st._candidates(size, component, (component % 2 == 1).astype(int), bits)
    across = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                assert found[a, b] >= both
                assert a % 2 == b % 2 or (a, b) in across


def test_prefix_length_is_exact():
    size = np.arange(1, 2000)
    assert (st.prefix_length(size) == [n - -(-85 * n // 100) + 1 for n in size.tolist()]).all()


def written(monkeypatch, module):
    """Rows of the tables that the module writes, by purpose; filled while it runs."""
    counts = {}
    write = module.materialize

    def counted(df, purpose="table"):
        out = write(df, purpose)
        counts[purpose] = max(counts.get(purpose, 0), out.count())
        return out

    monkeypatch.setattr(module, "materialize", counted)
    return counts


def near_misses(n, words=400, edits=5):
    """Copies of one text that differ in too many places to be linked, but not for their bitmaps; every tenth is linked to the one before."""
    rng = random.Random(n)
    rows = []
    for k in range(n):
        own = [f"w{x}" for x in range(words)] if k % 10 != 1 else list(rows[-1])
        for place in rng.sample(range(words), edits if k % 10 != 1 else 1):
            own[place] = f"x{k}"
        rows.append(own)
    return [(k, " ".join(r)) for k, r in enumerate(rows)]


@pytest.mark.parametrize("chunk,tokens", [(1024, 1 << 20), (32, 1 << 20), (1024, 2000)])
def test_near_misses_make_no_rows_for_their_pairs(spark, monkeypatch, chunk, tokens):
    monkeypatch.setattr(st, "CHUNK", chunk)
    monkeypatch.setattr(st, "CHUNK_TOKENS", tokens, raising=False)
    rows = near_misses(120)
    counts = written(monkeypatch, st)
    want = brute(rows)
    assert got(spark, rows) == want and len({c for _, _, c in want}) > 40
    trees = 1 if chunk > 120 else 16
    assert counts["tree-pairs"] < 10 * trees * len(rows) / 2 and (chunk < 120 or counts["tree-pairs"] < 4 * len(rows))


@pytest.mark.parametrize("seed", range(4))
def test_links_that_join(seed):
    """The pairs kept join what all links join, and are links."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.append(base[rng.random(60) > 0.06], rng.choice(base, 2))) for _ in range(40)]
    component = rng.integers(0, 30, 40)
    i, j = (x[component[np.triu_indices(40, 1)[0]] != component[np.triu_indices(40, 1)[1]]] for x in np.triu_indices(40, 1))
    linked = [100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j)]

    def parts(pairs):
        root = component.copy()
        for a, b in pairs:
            root[root == root[b]] = root[a]
        return [np.flatnonzero(root == r).tolist() for r in np.unique(root)]

    links = {(int(a), int(b)) for a, b, near in zip(i, j, linked) if near}
    kept = list(zip(*st._joining(i, j, [s.tobytes() for s in sets], component, st.LEAST)))
    assert set(kept) <= links and len(kept) < 40 and sorted(parts(kept)) == sorted(parts(links))
    x, y = st._spanning(i, j, rng.integers(0, 5, len(i)), 40)
    assert len(x) == 39 and len({a for pair in zip(x.tolist(), y.tolist()) for a in pair}) == 40

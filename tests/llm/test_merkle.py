"""The Merkle manifest against plain recursion."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lendwright.llm import merkle_manifest as mm

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, rank int, hash string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes, fan_out=16):
    """Top, and for each node the steps (before, after)."""
    steps = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, members = [], []
        for a in range(0, len(nodes), fan_out):
            run = nodes[a : a + fan_out]
            for k, own in enumerate(below[a : a + fan_out]):
                for i in own:
                    steps[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(digest(*run))
            members.append([i for own in below[a : a + fan_out] for i in own])
        nodes, below = above, members
    return nodes[0], steps


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, fan_out=16):
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = own, *climb([leaf(r) for r in own], fan_out)
    root, upper = climb([trees[s][1] for s in order], fan_out)
    out = []
    for s, above in zip(order, upper):
        own, subroot, steps = trees[s]
        for r, path in zip(own, steps):
            path = path + above
            shown = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                shown = (*r[:4], lower(r[4]))
            node = leaf(shown)
            for before, after in path:
                node = digest(before, node, after)
            out.append((r[0], leaf(r), subroot, root, digest(*[x for p in path for x in p]), node, node == root))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)


def got(spark, rows):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return sorted([tuple(r) for r in mm.report(frame(spark, rows), tampered).collect()], key=repr)


HARD = [
    (None, None, None, None, None),
    (None, None, None, None, None),
    (None, "a", "en", 3, "Abc"),
    (0, "a", "en", 0, ""),
    (1, "", None, 2, "É\n"),
    (1, "", None, 2, "other"),
    (5, "ä", "de", 1, "X" * 200_000),
    (5, "ä", "de", 1, "X" * 200_000),
    (7, "-", "-", -4, "-"),
    (9, "z", "en", 4, "Lone"),
    # Ids whose checksum 5 divides, with and without something to lower.
    *[(k, "a", "en", 4, t) for k, t in zip([k for k in range(100, 200) if zlib.crc32(str(k).encode()) % 5 == 0], ["Case", "none", None, "ÉTÉ"])],
]


def test_hard_rows(spark):
    out = got(spark, HARD)
    assert out == brute(HARD)
    assert not all(r[-1] for r in out)


@pytest.mark.parametrize("levels, fan_out", [(1, 16), (2, 2), (3, 16)])
def test_many_segments(spark, monkeypatch, levels, fan_out):
    """Sources of one leaf, of whole runs and beyond; blocks so small that the tree has several segments."""
    monkeypatch.setattr(mm, "LEVELS", levels)
    monkeypatch.setattr(mm, "FAN_OUT", fan_out)
    rows = [(k, f"s{n}", "en", k, f"Text {k}") for n in (1, 15, 16, 17, 33, 273) for k in range(1000 * n, 1001 * n)]
    rows += [(-k, f"single{k}", None, None, None) for k in range(1, 20)]
    assert got(spark, rows) == brute(rows, fan_out)


def test_paths_fold_to_the_root_and_a_changed_row_does_not(spark):
    rows = [(k, "s", "en", k, f"Text {k}") for k in range(40)]
    found = mm.manifest(frame(spark, rows))
    assert found.columns == ["doc_id", "source", "leaf", "subroot", "root", "path"]
    good = found.select((mm.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok")).collect()
    bad = found.select((mm.fold(F.sha2(F.lit("other").cast("binary"), 256), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert all(r.ok for r in good) and not any(r.ok for r in bad)


def test_empty_table(spark):
    assert got(spark, []) == []

"""Line dedup and SimHash near-dedup against plain loops."""

from __future__ import annotations

import hashlib
import re

import pytest
import xxhash

from lendwright.llm import line_dedup, simhash_dedup
from lendwright.llm.components import components

BLANK = " \t\n\x0b\f\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_lines(rows, min_docs):
    keys = [[lower(x).strip(BLANK) for x in (t or "").split("\n")] for _, t in rows]
    count = {}
    for own in keys:
        for k in set(own):
            count[k] = count.get(k, 0) + 1
    out = []
    for (i, t), own in zip(rows, keys):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, own) if not k or count[k] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


LINES = [
    (1, "Same Line\nown one\n\n same line\t"),
    (2, "SAME line\r\nÉTÉ\nété"),
    (3, "same line\nÉTÉ\n"),
    (4, None),
    (5, ""),
    (6, " same line\nKeep\nkeep"),
    (7, "keep\nkeep\n" + "x " * 30000),
    (7, "keep\nkeep\n" + "x " * 30000),
    (None, "keep"),
    (9, "\n\n\n"),
]


@pytest.mark.parametrize("min_docs", [1, 2, 3, 4])
def test_lines(spark, min_docs):
    docs = spark.createDataFrame(LINES, "doc_id long, text string")
    got = sorted([tuple(r) for r in line_dedup.line_report(docs, min_docs).collect()], key=repr)
    assert got == brute_lines(LINES, min_docs)


def test_drop_lines_keeps_columns_and_null(spark):
    docs = spark.createDataFrame([(*r, "n", "h") for r in LINES], "doc_id long, text string, n string, pos string")
    out = line_dedup.drop_lines(docs, 3)
    assert out.columns == docs.columns
    texts = {(r.doc_id, r.text) for r in out.collect()}
    assert (4, None) in texts and (1, "own one\n") in texts and (2, "ÉTÉ\nété") in texts


def test_levels_compact_to_the_same_counts(spark):
    docs = spark.createDataFrame([(i, f"a\nb{i % 3}\nc{i}") for i in range(40)], "doc_id long, text string")
    whole = line_dedup.LineRuns(spark, 12)
    whole.add(docs)
    parts = line_dedup.LineRuns(spark, 12, fan_in=2)
    for k in range(5):
        parts.add(docs.where(f"doc_id % 5 = {k}"))
    assert sum(map(len, parts.levels.values())) < 5
    rows = lambda runs: sorted(map(tuple, runs.decide().collect()))
    assert rows(whole) == rows(parts) and len(rows(parts)) == 4


@pytest.mark.parametrize("operator", [lambda d: line_dedup.line_report(d), simhash_dedup.report])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_fingerprint(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    grams = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    value = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(g.encode(), 42) >> bit & 1 for g in grams) > len(grams):
            value |= 1 << bit
    return value


def brute_components(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted([(i, f"{p:016x}", least.get(find(k))) for k, ((i, _), p) in enumerate(zip(rows, prints))], key=repr)


def near_rows():
    base = [f"w{i * 7919 % 501}" for i in range(400)]
    rows = [(100 + k, " ".join(base[:k] + ["zz"] + base[k + 1 :])) for k in range(0, 400, 20)]
    rows += [(5, "One two three four"), (6, "one  two\tthree FOUR"), (7, "été École"), (None, None), (9, ""), (10, " \x0b"), (11, "x")]
    rows += [(12, "a b c " * 20000), (12, "a b c " * 20000), (13, "a b c " * 20001), (None, "alone in the world")]
    return rows


def test_simhash_against_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in simhash_dedup.report(docs).collect()], key=repr)
    assert got == brute_components(rows)


def test_simhash_on_test_data(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted([tuple(r) for r in simhash_dedup.report(docs).collect()], key=repr)
    assert got == brute_components(rows)


def test_one_row_of_each_component_stays(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, "x", k) for k, r in enumerate(rows)], "doc_id long, text string, fp string, root int")
    out = simhash_dedup.drop_near_copies(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    want = {c for _, _, c in brute_components(rows)}
    assert sorted([r.doc_id for r in kept], key=repr) == sorted(want, key=repr)


def test_byte_sets_hit_every_choice():
    from itertools import combinations

    for shared in (5, 6, 7):
        sets = [set(s) for s in simhash_dedup.byte_sets(shared, 4)]
        assert all(any(s <= set(c) for s in sets) for c in combinations(range(8), shared))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(3, 3), (None, 4)]
    found = components(spark.createDataFrame(chain, "a long, b long"))
    groups = {}
    for r in found.collect():
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(41)), list(range(1000, 1060))]

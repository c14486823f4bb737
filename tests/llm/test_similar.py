"""Near copies by exact five-word Jaccard similarity, against plain loops."""

from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline as cp
from lendwright.llm import shingle_dedup, simhash_dedup
from tests.llm.test_dedup import brute_fingerprint, lower


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    size = min(5, len(found))
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if found else set()


def brute_kept(rows):
    """The smallest id of every component of texts with a similarity of 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted(least.values())


def text(seed, n=200):
    return [f"w{seed}x{k}" for k in range(n)]


def near(seed, *places):
    own = text(seed)
    for p in places:
        own[p] = f"changed{p}"
    return " ".join(own)


CASES = [
    (1, near(1)),
    (2, near(1, 20, 90, 160)),
    (3, near(1, 30, 60, 100, 180)),
    (4, near(2)),
    (5, near(2, *range(0, 200, 9))),
    (6, "Three short words"),
    (7, "three SHORT\twords"),
    (8, "three short wards"),
    (9, None),
    (10, " "),
    (11, near(3) + " and one end"),
    (12, near(3)),
    (12, near(3)),
]


def test_small_cases(spark):
    docs = spark.createDataFrame([(*r, "kept") for r in CASES], "doc_id long, text string, fp string")
    out = shingle_dedup.drop_similar(docs)
    assert out.columns == docs.columns
    got = sorted(r.doc_id for r in out.collect())
    assert got == brute_kept(CASES) == [1, 4, 5, 6, 8, 9, 11]


def test_group_that_only_some_neighbours_join(spark):
    """A chain of copies, each near the next only, and strangers that share half of the text."""
    rows = [(k, near(7, *range(0, 3 * k, 3))) for k in range(12)] + [(100 + k, near(7, *range(k, 200, 8))) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in shingle_dedup.drop_similar(docs).collect()) == brute_kept(rows)


def test_row_without_an_id(spark):
    rows = [(None, near(1)), (5, near(1, 100)), (None, near(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(shingle_dedup.drop_similar(docs).collect(), key=repr)
    assert [tuple(r) for r in got] == [(5, rows[1][1]), (None, rows[2][1])]


def test_pipeline_stage_drops_copies_and_nothing_else(spark, folder):
    """Documents of the smallest table, copies with a few changed words, and texts that share a fingerprint but not the words."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6 + k, near(50, *range(0, 40 * k, 40))) for k in range(5)]
    far = [(brute_fingerprint(a) ^ brute_fingerprint(b)).bit_count() for (_, a), (_, b) in zip(rows[-5:-1], rows[-4:])]
    assert max(far) > 3
    # Every seventh word differs: many three-word runs are shared, few of five words.
    rows += [(2 * 10**6 + k, near(60, *range(k, 200, 7)) + " " + near(61)) for k in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in dict(cp.STAGES)["near_copies"](spark, docs, folder).collect())
    assert kept == brute_kept(rows)
    assert [i for i in kept if 10**6 <= i < 2 * 10**6] == [10**6]


def test_proposals_are_the_pairs_within_the_bits(spark):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for f in fps for _ in range(3)]
    rows = [(bytes([k >> 8, k & 255]), f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)]
    found = spark.createDataFrame(rows, "class binary, fp long")
    got = [(bytes(r.a), bytes(r.b)) for r in simhash_dedup.proposals(found).collect()]
    firsts = {}
    for name, f in rows:
        firsts.setdefault(f, name)
    want = [(firsts[f], name) for name, f in rows if firsts[f] != name]
    want += [
        (min(a, b), max(a, b)) for f, a in firsts.items() for g, b in firsts.items() if f < g and ((f ^ g) & (2**64 - 1)).bit_count() <= 3
    ]
    assert sorted(got) == sorted(want)


def test_columns_with_the_names_of_joins_and_empty_table(spark):
    rows = [(1, near(1), 1, b"x", 2), (2, near(1), 2, b"y", 2), (3, near(2), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long, class binary, a int")
    out = simhash_dedup.drop_verified_copies(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
    assert simhash_dedup.drop_verified_copies(docs.limit(0)).collect() == []


def test_long_text(spark):
    long = " ".join(f"w{k}" for k in range(100_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, long[:400_000])], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_dedup.drop_verified_copies(docs).collect()) == [1, 3]


@pytest.mark.parametrize("similarity, bound", [(0.8, 3e-5), (0.85, 5e-7)])
def test_bound(similarity, bound):
    assert shingle_dedup.miss_bound(similarity) < bound


def test_near_misses_make_no_rows_for_their_pairs(spark, monkeypatch):
    """A bucket of texts just below the threshold: its pairs stay inside a task."""
    rng = random.Random(5)
    rows = []
    for k in range(150):
        own = [f"w{x}" for x in range(400)]
        for place in rng.sample(range(400), 5):
            own[place] = f"x{k}"
        rows.append((k, " ".join(own)))
    counts = {}
    write = shingle_dedup.materialize

    def counted(df, purpose="table"):
        out = write(df, purpose)
        counts[purpose] = out.count()
        return out

    monkeypatch.setattr(shingle_dedup, "materialize", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in shingle_dedup.drop_similar(docs).collect()) == brute_kept(rows)
    assert counts["across"] < 2 * len(rows)

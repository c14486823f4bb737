"""Collocations against counting in plain loops."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from lendwright.llm import phrase_automata as pa_
from tests.llm.test_dedup import lower


def brute(rows, max_words, min_count, top):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, max_words + 1):
                own.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) >= 2 and a >= min_count}
        inner = {}
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inner[p[i : i + m]] = max(a, inner.get(p[i : i + m], 0))
        rows_ = []
        for p, a in candidates.items():
            if 100 * inner.get(p, 0) >= 100 * a:
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], score, a))
        rows_.sort()
        out += [(lang, n, x[2].decode(), x[6], x[3], x[4], total[lang], x[5]) for n, x in enumerate(rows_[:top], 1)]
    return sorted(out)


def got(spark, rows, *options):
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "text string, lang string, phrase string, n int")
    return sorted(tuple(r) for r in pa_.collocations(docs, *options).drop("cut").collect())


HARD = [
    (None, "en"),
    ("", "en"),
    ("...;;\n\t ", None),
    ("a b a b a b a b", "en"),
    ("a b. a b, A B\na\tb", "en"),
    ("a b a b", None),
    ("a b a b", "und"),
    ("x" * 100_000 + " y " * 3, "de"),
    ("New York City new york city NEW YORK", "en"),
    ("New York City new york city NEW YORK", "en"),
    ("été ÉTÉ été été\xa0été", "fr"),
]


@pytest.mark.parametrize("min_count", [1, 2, 3])
def test_hard_rows(spark, min_count):
    assert got(spark, HARD, 5, min_count, 100, 50, 100) == brute(HARD, 5, min_count, 50)


@pytest.mark.parametrize("max_words, top, shard_bytes", [(2, 7, 500), (4, 1000, 2000), (5, 20, 8_000_000)])
def test_random_texts(spark, monkeypatch, max_words, top, shard_bytes):
    """Many shards and many groups; ties in score and count at the cut of the list."""
    monkeypatch.setattr(pa_, "GROUP_BYTES", 3000)
    rng = random.Random(top)
    vocabulary = [f"w{k}" for k in range(25)]
    rows = []
    for _ in range(150):
        words = [vocabulary[min(int(rng.expovariate(0.2)), 24)] + rng.choice(["", "", "", "", "."]) for _ in range(rng.randrange(60))]
        rows.append((" ".join(words) + " fixed set phrase of words", rng.choice(["en", "de", None])))
    assert got(spark, rows, max_words, 5, 100, top, shard_bytes) == brute(rows, max_words, 5, top)


def test_products_beyond_64_bits(spark):
    """Weights of a corpus that no test can hold."""
    paths = spark.createDataFrame(
        [("en", "", 0, 10**14), ("en", "a", 1, 10**13), ("en", "b", 1, 3 * 10**13), ("en", "a b", 2, 7 * 10**12)],
        "lang string, phrase string, depth int, n long",
    )
    row = pa_.scored(paths).first()
    assert row.score == 1000 * 7 * 10**12 * 10**14 // (3 * 10**26)


def test_filter_passes_all_frequent_paths_and_few_others(spark):
    rng = random.Random(3)
    rows = [(" ".join(f"w{rng.randrange(3000)}" for _ in range(200)), "en") for _ in range(100)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    (marks,) = pa_.frequent_marks(docs, 10, 1)
    shard = next(pa_._shards(iter(docs.toArrow().to_batches()), 10**9))
    words = Counter(w for t, _ in rows for w in t.split())
    passed = marks.passes(shard.symbol)
    frequent = sum(n for n in words.values() if n >= 10)
    assert all(passed[i] for i in range(len(passed)) if words[shard.word(i).decode()] >= 10)
    assert passed.sum() < frequent + 0.2 * len(passed)


def test_empty_table(spark):
    assert got(spark, []) == []

"""Benchmark index, substring dedup and license scan against plain loops."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from lendwright.llm import benchmark_index as bi, license_scan as ls, substring_dedup as sd, words as w
from lendwright.llm.license_texts import NOTICES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RUN = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- words -------------------------------------------------------------------------------------------------------


def test_words_of_many_texts():
    texts = ["Ab  c\n", None, "", "é-É x9", "no", "no", " "]
    for table, pattern, fold in ((w.NOT_BLANK, RUN, False), (w.ALPHANUMERIC, WORD, True)):
        found = w.words(pa.array(texts).slice(0), table, lower=fold)
        want = [pattern.findall(lower(t) if fold else t or "") for t in texts]
        assert [s.decode() for s in found.strings()] == [x for own in want for x in own]
        assert found.counts.tolist() == [len(x) for x in want]
        h = found.hashes()
        flat = [x for own in want for x in own]
        assert len(set(h.tolist())) == len(set(flat)) and len(set(zip(h.tolist(), flat))) == len(set(flat))
    part = w.words(pa.array(texts).slice(3, 2), w.NOT_BLANK)
    assert [s.decode() for s in part.strings()] == ["é-É", "x9", "no"]


def test_pieces_cut_at_rows(monkeypatch):
    monkeypatch.setattr(w, "PIECE_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n else None for n in (3, 0, 50, 0, 4, 4, 4)])], names=["text"])
    parts = [p.column(0).to_pylist() for p in w.pieces(batch, "text")]
    assert sum(parts, []) == batch.column(0).to_pylist()
    assert all(len(p) == 1 or sum(len(x or "") for x in p) <= 10 for p in parts)


# ---- benchmark index ---------------------------------------------------------------------------------------------


def brute_hits(docs, items, window=10):
    out = []
    for i, text in docs:
        own = WORD.findall(lower(text))
        hit, ids = set(), set()
        for item_id, item in items:
            asked = WORD.findall(lower(item))
            size = min(window, len(asked))
            grams = {tuple(asked[k : k + size]) for k in range(len(asked) - size + 1)} if asked else set()
            for k in range(len(own) - size + 1) if grams else ():
                if tuple(own[k : k + size]) in grams:
                    hit |= set(range(k, k + size))
                    ids.add(str(item_id))
        names = sorted(x for x in ids if x != "None")
        out.append((i, len(own), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [
    (1, "the a the a the a the a the a the a the a"),
    (2, "Short one"),
    (3, " ".join(f"t{k}" for k in range(25))),
    (10, " ".join(f"t{k}" for k in range(25))),
    (4, None),
    (5, "..."),
    (6, " ".join(f"t{k}" for k in range(5, 17))),
    (7, "never seen words at all"),
]


def index_docs():
    t = [f"t{k}" for k in range(25)]
    rows = [
        (1, "the a " * 9), (2, "The A " * 4), (3, "x SHORT-one y short. one"), (4, None), (5, ""), (6, "..."),
        (7, " ".join(t[:9])), (8, " ".join(t[3:13])), (9, "pre " + " ".join(t) + " mid " + " ".join(t[8:]) + " short"), (9, "one"),
        (11, " ".join(t[:12] + ["gap"] + t[12:])), (12, "short one"), (12, "short one"), (None, "short one"), (13, "filler " * 30000 + "short one"),
    ]
    return rows


def test_index_against_brute_force(spark):
    docs = spark.createDataFrame([(*r, 1, "t") for r in index_docs()], "doc_id long, text string, n long, term string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted([tuple(r) for r in bi.report(docs, items).collect()], key=repr)
    assert got == brute_hits(index_docs(), ITEMS)


def test_large_vocabularies_take_the_join(spark, monkeypatch):
    monkeypatch.setattr(bi, "MAX_SENT_TERMS", 3)
    docs = spark.createDataFrame(index_docs(), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted([tuple(r) for r in bi.report(docs, items).collect()], key=repr)
    assert got == brute_hits(index_docs(), ITEMS)


def test_empty_index_tables(spark):
    docs = spark.createDataFrame(index_docs(), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert bi.report(docs.limit(0), items).collect() == []
    none = bi.report(docs, items.limit(0)).collect()
    assert len(none) == len(index_docs()) and not any(r.contaminated for r in none)


def test_contaminated_rows_go(spark):
    docs = spark.createDataFrame([(*r, 1) for r in index_docs()], "doc_id long, text string, size int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = bi.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    bad = {(r[0], r[1]) for r in brute_hits(index_docs(), ITEMS) if r[-1]}
    want = sorted([r for r in index_docs() if (r[0], len(WORD.findall(lower(r[1])))) not in bad], key=repr)
    assert sorted([tuple(r)[:2] for r in kept.collect()], key=repr) == want


def test_near_matches(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "c b a"), (3, "a b x x x x c"), (4, "a b")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    items = bi.item_terms(queries)
    index = bi.postings(docs, items.select(bi.F.explode("terms").alias("term")))
    keys = bi.with_key(docs)
    for span, want in ((3, {2}), (5, {1, 2}), (7, {1, 2, 3})):
        found = bi.near_matches(items, index, span).join(keys, [bi.K1, bi.K2])
        assert {r.doc_id for r in found.collect()} == want


# ---- substring dedup ---------------------------------------------------------------------------------------------


def brute_repeats(rows, window):
    first = {}
    for i, text in rows:
        own = RUN.findall(text or "")
        for k in range(len(own) - window + 1):
            key = tuple(own[k : k + window])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, text in rows:
        own = RUN.findall(text or "")
        gone = set()
        for k in range(len(own) - window + 1):
            if i is not None and first[tuple(own[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(own), len(gone), sha(" ".join(x for k, x in enumerate(own) if k not in gone))))
    return sorted(out, key=repr)


def repeat_rows():
    rng = np.random.default_rng(3)
    base = [f"v{x}" for x in rng.integers(0, 9, 400)]
    rows = [(k, " ".join(f"v{x}" for x in rng.integers(0, 9, 120))) for k in range(20, 40)]
    rows += [(100 + k, " ".join(base[k * 7 : k * 7 + 90])) for k in range(30)]
    rows += [(50, None), (51, ""), (52, "a b"), (53, "la " * 3000), (54, "la " * 20), (54, "la " * 25), (None, "la " * 40), (55, " ".join(base)), (55, " ".join(base))]
    rows += [(56, "Été\x0b" + "\t".join(base[:14]) + " x"), (57, "tail " + " ".join(base[:14])), (-5, " ".join(base[100:130]))]
    return rows


@pytest.mark.parametrize("window", [1, 4, 13])
def test_repeats_against_brute_force(spark, window):
    rows = repeat_rows()
    docs = spark.createDataFrame([(*r, "p") for r in rows], "doc_id long, text string, part string").repartition(6)
    got = sorted([tuple(r) for r in sd.report(docs, window).collect()], key=repr)
    assert got == brute_repeats(rows, window)


@pytest.mark.parametrize("setting", [{"group_bytes": 2000}, {"filter_bits": 12}])
def test_many_groups_heavy_prefixes_and_full_filter(spark, setting):
    rows = repeat_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted([tuple(r) for r in sd.report(docs, 13, **setting).collect()], key=repr)
    assert got == brute_repeats(rows, 13)


def test_repeats_of_an_empty_table(spark):
    assert sd.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert sd.report(spark.createDataFrame([(None, None)], "doc_id long, text string")).count() == 1


def test_maximal_repeats(spark):
    shared = " ".join(f"s{k}" for k in range(20))
    docs = spark.createDataFrame([(1, "a " + shared + " b"), (2, "c d " + shared + " e")], "doc_id long, text string")
    out = {r.doc_id: r for r in sd.drop_repeats(docs).collect()}
    assert out[2].repeats == [[2, 22]] and out[2].kept == "c d e" and out[1].repeats == []


# ---- license scan ------------------------------------------------------------------------------------------------


def brute_licenses(text, templates):
    own = WORD.findall(lower(text))
    out = {}
    for name, template in templates.items():
        asked = WORD.findall(lower(template))
        size = min(5, len(asked))
        n = len(asked) - size + 1
        wanted = {tuple(asked[k : k + size]) for k in range(n)}
        grams = [tuple(own[k : k + size]) for k in range(len(own) - size + 1)]
        best = max((len(wanted & set(grams[k : k + n])) / len(wanted) for k in range(len(grams) - n + 1)), default=0)
        if best >= ls.THRESHOLD:
            out[name] = best
    return out


def license_docs():
    rng = np.random.default_rng(8)
    rows = [(1, None), (2, ""), (3, "Released under the MIT\nLicense"), (4, "all rights reserved"), (5, "all rights"), (6, "x " * 40000)]
    for k, (name, text) in enumerate(NOTICES.items()):
        own = text.split()
        for changes in (0, 1, 2, 4, 8):
            edited = list(own)
            for at in rng.integers(0, len(own), changes if len(own) > 30 else min(changes, 1)):
                edited[at] = "changed"
            pad = [f"f{x}" for x in rng.integers(0, 500, 60)]
            rows.append((100 * (k + 1) + changes, " ".join(pad + edited + pad[::-1])))
    rows.append((9, " ".join(NOTICES.values())))
    rows.append((9, " ".join(NOTICES.values())))
    return rows


def test_licenses_against_brute_force(spark):
    rows = license_docs()
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, license string")
    got = sorted(((r.doc_id, r.n_words, {m.license: round(m.containment, 9) for m in r.matches}) for r in ls.scan(docs, NOTICES).collect()), key=repr)
    want = sorted(((i, len(WORD.findall(lower(t))), {k: round(v, 9) for k, v in brute_licenses(t, NOTICES).items()}) for i, t in rows), key=repr)
    assert got == want and sum(bool(m) for *_, m in got) > 30


def test_license_settings():
    assert ls.miss_bound() < 1e-9
    with pytest.raises(ValueError, match="TEMPLATE_WITHOUT_WORDS"):
        ls.families({"x": " . "})
    with pytest.raises(ValueError, match="TEMPLATE_NAME_EMPTY"):
        ls.families({"": "some text"})


def test_no_documents_no_matches(spark):
    assert ls.report(spark.createDataFrame([], "doc_id long, text string"), NOTICES).collect() == []

"""Language CRF and quality network: exact parts against brute force, the rest by held-out accuracy."""

from __future__ import annotations

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lendwright.llm import language_crf as crf, quality

SF = "/root/testdata/sf0.01"


def brute_marginals(scores, change, start):
    a = [start + scores[0]]
    for t in range(1, len(scores)):
        a.append(np.logaddexp.reduce(a[-1][:, None] + change, axis=0) + scores[t])
    b = [np.zeros(len(start))]
    for t in range(len(scores) - 1, 0, -1):
        b.append(np.logaddexp.reduce(change + (scores[t] + b[-1])[None, :], axis=1))
    x = np.array(a) + np.array(b[::-1])
    return np.exp(x - np.logaddexp.reduce(x, axis=1, keepdims=True))


@pytest.mark.parametrize("block", [3, 5, 64])
def test_forward_backward(block):
    rng = np.random.default_rng(0)
    sizes = [7, 0, 1, 23, 0]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores, change, start = rng.normal(size=(31, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    found, _ = crf.marginals(scores, first, change, start, block)
    for k, n in enumerate(sizes):
        if n:
            own = slice(first[k], first[k + 1])
            assert np.allclose(found[own], brute_marginals(scores[own], change, start))


def test_grams_do_not_cross_words():
    found = crf.words(pa.array(["ab c", "ab"]), crf.LETTERS, lower=True)
    number, first = crf.grams(found, np.arange(3))
    own = [number[first[k] : first[k + 1]].tolist() for k in range(3)]
    assert own[0] == own[2] and len(own[0]) == 3 + 2 + 1 and len(own[1]) == 2 + 1


@pytest.fixture(scope="module")
def model(spark):
    return crf.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_weights_of_many_words_are_not_held_at_once():
    """The sums equal, to the bit, those of one running sum over all features."""
    rng = np.random.default_rng(4)
    weights = rng.normal(size=(1 << 10, 4))
    first = np.concatenate([[0], np.cumsum(rng.integers(0, 30, 6_149))])
    number = rng.integers(0, 1 << 10, first[-1])
    total = np.concatenate([np.zeros((1, 4)), np.cumsum(weights[number], axis=0)])
    want = (total[first[1:]] - total[first[:-1]]) / np.sqrt(np.maximum(np.diff(first), 1))[:, None]
    tracemalloc.start()
    got = crf.gram_scores(weights, number, first)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, want)
    assert peak < 1.2 * total.nbytes
    assert crf.gram_scores(weights, number[:0], first[:1]).shape == (0, 4)


def test_language_accuracy_on_held_out_rows(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = crf.report(docs).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_words_of_code_switched_text(model, spark):
    docs = {r.lang: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars BETWEEN 600 AND 2000").collect()}
    a, b = docs["de"].split()[:30], docs["es"].split()[:30]
    _, probability = crf.label_words(model, pa.array([" ".join(a + b)]))
    half = len(probability) // 2
    labels = np.array(model.languages)[probability.argmax(axis=1)]
    assert (labels[: half - 5] == "de").mean() > 0.8 and (labels[half + 5 :] == "es").mean() > 0.8


def test_language_edge_cases(spark, model):
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "€ … 🙂"), (None, "the and of to"), (5, "the and of to the " * 60000), (6, "la"), (6, "la")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    out = crf.predict(docs, model).collect()
    und = {r.doc_id for r in out if r[crf.LANG] == crf.UNKNOWN}
    assert len(out) == len(rows) and und == {1, 2, 3, 4}
    assert all(r[crf.SCORE] == 0 for r in out if r.doc_id in und)
    assert {r[crf.LANG] for r in out if r.doc_id in (None, 5)} == {"en"}


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert crf.report(empty).collect() == []
    unknown = spark.createDataFrame([(0, "text", None), (None, "text", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in crf.report(unknown).collect()} == {crf.UNKNOWN}


def test_one_language(spark):
    docs = spark.createDataFrame([(k, "some text", "en") for k in range(8)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in crf.report(docs).collect()} == {("en", 1.0)}


def test_predictions_do_not_read_lang_or_source(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    same = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'other' AS source")
    key = lambda d: sorted((r.doc_id, r[crf.LANG], r[crf.SCORE]) for r in crf.predict(d, model).collect())
    assert key(docs) == key(same)


def test_token_shapes():
    found, h = quality.tokens(pa.array(["The CAPS end!! 123 é", "", None, "NEXT!!", "a\nb"]))
    assert [s.decode() for s in found.strings()] == ["the", "caps", "end", "!!", "123", "é", "next", "!!", "a", "b"]
    assert found.counts.tolist() == [6, 0, 0, 2, 2] and h[1] == h[6] and h[3] == h[7]


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.report(docs, labels).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_neighbour_sums_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    assert np.array_equal(quality.word_vectors(docs.coalesce(1)), quality.word_vectors(docs.repartition(7)))


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, quality.DIMENSIONS + quality.EXTRAS))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    network = quality.fit(x[:3000], y[:3000])
    p = network.probability(x[3000:])
    for low, high in ((0.1, 0.4), (0.4, 0.6), (0.6, 0.9)):
        own = (p >= low) & (p < high)
        assert abs(p[own].mean() - y[3000:][own].mean()) < 0.12


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "text", 0), (3, "x " * 90000, 1), (3, "y", 1)], "doc_id long, text string, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.report(docs, none).collect()} == {0.5}
    nulls = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert quality.report(docs, nulls).count() == 5
    assert quality.report(docs.limit(0), none).collect() == []

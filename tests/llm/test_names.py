"""Columns named like internal ones pass through every function that keeps the columns of documents."""

from __future__ import annotations

import pytest

from lendwright.llm import benchmark_index, language_crf, line_dedup, shingle_dedup, simhash_dedup

ROWS = [(k, f"same line here\nthe text number {k} with words of its own\nsame line here", "en", "a", 1.5, b"x", "y") for k in range(6)]
SCHEMA = "doc_id long, text string, lang string, __llm_k1 string, __LLM_K2 double, __llm_lang binary, `__llm_h1` string"


@pytest.mark.parametrize(
    "stage, n",
    [
        (lambda d, b: line_dedup.drop_lines(d, 3), 6),
        (lambda d, b: simhash_dedup.drop_near_copies(d), None),
        (lambda d, b: simhash_dedup.drop_verified_copies(d), 6),
        (lambda d, b: shingle_dedup.drop_similar(d), 6),
        (lambda d, b: benchmark_index.drop_contaminated(d, b), 5),
        (lambda d, b: language_crf.keep_known(d, 0.1), 6),
    ],
)
def test_columns_named_like_internal_ones(spark, stage, n):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    benchmark = spark.createDataFrame([("i1", "the text number 3 with words of its own")], "item_id string, text string")
    out = stage(docs, benchmark)
    assert out.columns == docs.columns
    rows = out.collect()
    assert n is None or len(rows) == n
    assert all((r[3], r[4], bytes(r[5]), r[6]) == ("a", 1.5, b"x", "y") for r in rows)


def test_heavy_lines_take_the_same_way_out(spark, monkeypatch):
    docs = spark.createDataFrame([(r[0], r[1]) for r in ROWS], "doc_id long, text string")
    want = sorted(map(tuple, line_dedup.line_report(docs, 3).collect()))
    monkeypatch.setattr(line_dedup, "HEAVY_LINE", 1)
    assert sorted(map(tuple, line_dedup.line_report(docs, 3).collect())) == want

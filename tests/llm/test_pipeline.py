"""Every stage of the pipeline against what its operator's definition says about its own input."""

from __future__ import annotations

import pytest
import sentencepiece

import corpus_pipeline as cp
from lendwright.llm import language_crf
from lendwright.llm.queries import PIECE_MODEL
from lendwright.session import materialize
from tests.llm.test_dedup import brute_lines
from tests.llm.test_search import brute_hits
from tests.llm.test_similar import brute_kept


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Input and output rows of all stages on the smallest tables, with a row of hard cases added."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    hard = spark.createDataFrame(
        [(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 !!", "en", "s", 5)], docs.schema
    )
    docs = docs.unionByName(hard).withColumn("fp", cp.F.lit("clash"))
    out = {}
    for name, stage in cp.STAGES:
        after = materialize(stage(spark, docs, folder), f"test-{name}")
        out[name] = docs, after
        docs = after
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_stay_until_the_last_stage(stages):
    for name in list(stages)[:-1]:
        before, after = stages[name]
        assert after.columns == before.columns


def test_language_stage(spark, stages):
    before, after = stages["language"]
    found = language_crf.predict(before, language_crf.train(before)).collect()
    keep = {r.doc_id for r in found if r[language_crf.LANG] != "und" and r[language_crf.SCORE] >= cp.LEAST_LANGUAGE_SCORE}
    assert {i for i, _ in rows(after)} == keep and not keep & {10**6, 10**6 + 1, 10**6 + 2}
    assert len(keep) >= 0.97 * before.count()


def test_line_stage(stages):
    before, after = stages["lines"]
    want = {(i, digest) for i, _, _, digest in brute_lines(rows(before), cp.COMMON_LINE_DOCS)}
    import hashlib

    assert {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows(after)} == want
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_copy_stage(stages):
    """Held against brute force over the stage's input, so that a text dropped wrongly shows."""
    before, after = stages["near_copies"]
    assert sorted(i for i, _ in rows(after)) == brute_kept(rows(before))


def test_decontamination_stage(spark, stages, folder):
    before, after = stages["decontaminated"]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in brute_hits(rows(before), items) if not r[-1]}
    assert {i for i, _ in rows(after)} == clean and len(clean) < before.count()


def test_encoding_stage(stages):
    before, after = stages["encoded"]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    texts = dict(rows(before))
    found = {r.doc_id: r for r in after.collect()}
    assert set(found) == set(texts)
    assert all(list(found[i].ids) == library.encode(t) and found[i].round_trip for i, t in texts.items())


def test_run_on_an_empty_table(spark, tmp_path, folder):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []

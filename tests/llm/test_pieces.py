"""The transducer against the public library, and exact round trips."""

from __future__ import annotations

import hashlib
import tracemalloc

import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from lendwright.llm import piece_transducer as pt
from lendwright.llm.queries import PIECE_MODEL

LIB = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
MACHINE = pt.compile_model(pt.read_model(PIECE_MODEL))

TEXTS = [
    "", " ", "  ", "a", " a  b\n\tc ▁x ", "Hello world, the transducer\nis here.", "été École 梦 ゼ 🙂 a\x00b",
    " " * 77 + "x" + " " * 35, "<s> </s> <unk> <0x0A>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ÉÉÉ 1234567890 !!!???", "no-blank-" * 2000,
    "Ththentionthingestst " * 3000,
]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_and_text_as_the_library(text):
    ids = list(MACHINE.encode(text))
    assert ids == LIB.encode(text)
    assert MACHINE.decode(ids) == LIB.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdehinorst  \n▁éß梦🙂.,0"), max_size=40))
def test_same_ids_as_the_library_on_random_text(text):
    assert list(MACHINE.encode(text)) == LIB.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, LIB.get_piece_size() - 1), max_size=12))
def test_same_text_as_the_library_on_random_ids(ids):
    assert MACHINE.decode(ids) == LIB.decode(ids)


def peak_mb(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_long_text_is_not_held_as_strings():
    text = "ab cd " * 200_000
    want = LIB.encode(text)
    MACHINE.encode("ab cd ab")
    ids, peak = peak_mb(lambda: MACHINE.encode(text))
    assert list(ids) == want
    assert peak < 12


def test_remembered_stretches_are_bounded(monkeypatch):
    monkeypatch.setattr(pt, "REMEMBERED_PATHS", 500, raising=False)
    machine = pt.Transducer(pt.read_model(PIECE_MODEL))
    words = [f"{'abcdefgh'[k % 8]}{'tuvwxyz'[k % 7]}{k}" for k in range(6_000)]
    texts = [" ".join(words[k : k + 60]) for k in range(0, len(words), 20)]
    assert all(list(machine.encode(t)) == LIB.encode(t) for t in texts)
    assert len(machine.paths) <= 500 and len(getattr(machine, "older", {})) <= 500


def test_whole_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("ids", pt.F.lit("clash"))
    out = pt.encode_texts(docs, pt.read_model(PIECE_MODEL))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r.ids) == LIB.encode(texts[r.doc_id])
        assert r.round_trip and r.n_ids == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert {r.doc_id: r.text for r in pt.decode_ids(out, pt.read_model(PIECE_MODEL)).collect()} == texts


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "a ▁")], "doc_id long, text string")
    rows = sorted(map(tuple, pt.encode_texts(docs, pt.read_model(PIECE_MODEL)).collect()), key=repr)
    empty = hashlib.sha256(b"").hexdigest()
    assert rows[:2] == [(1, 0, [], empty, True)] * 2 and rows[3] == (None, 0, [], empty, True)
    assert rows[2][0] == 2 and rows[2][4] is False
    assert pt.encode_texts(docs.limit(0), pt.read_model(PIECE_MODEL)).collect() == []


def unigram_model():
    """A small unigram model, written out by hand: no tokenizer is trained."""

    def number(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    def message(field, data):
        return number(field << 3 | 2) + number(len(data)) + data

    def piece(text, score, kind):
        return message(1, message(1, text.encode()) + b"\x15" + pt.struct.pack("<f", score) + number(3 << 3) + number(kind))

    parts = [piece("<unk>", 0, 2)]
    parts += [piece(p, s, 1) for p, s in [("▁", -3), ("a", -4), ("b", -4.5), ("ab", -5), ("▁a", -4.2), ("bab", -6), ("ba", -7), ("▁ab", -9)]]
    return b"".join(parts) + message(2, number(3 << 3) + number(1)) + message(3, message(1, b"identity"))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab cé"), max_size=12))
def test_unigram_models_take_the_best_path(text):
    model = unigram_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert list(pt.compile_model(model).encode(text)) == library.encode(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab cé"), max_size=24))
def test_runs_of_unknown_characters_join_across_stretches(text):
    model = unigram_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    machine = pt.Transducer(model)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pt, "STRETCHES", 2, raising=False)
        patch.setattr(pt, "REMEMBERED_PATHS", 2, raising=False)
        assert list(machine.encode(text)) == list(machine.encode(text)) == library.encode(text)

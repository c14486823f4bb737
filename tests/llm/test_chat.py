"""Chat formatting: exact reading back, masks against character sets, streaming blocks."""

from __future__ import annotations

import hashlib

import numpy as np
from hypothesis import given, settings, strategies as st

from lendwright.llm import chat_format as cf
from lendwright.llm.queries import BPE_DEFINITION, read_text

DEFINITION = read_text(BPE_DEFINITION)
TOKENIZER = cf.load_tokenizer(DEFINITION)
PARTS = ["a", "\\", "<", "|", ">", "<|end|>", "<|turn|>", "é", "🙂", " ", "\n", "\\|", "<|endoftext|>"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a<|text|>", ""]), TEXT), min_size=1, max_size=5))
def test_round_trip_and_mask(turns):
    formatted, spans = cf.render(turns)
    assert cf.read_back(formatted) == turns
    encoded = TOKENIZER.encode(formatted, add_special_tokens=False)
    assert TOKENIZER.decode(encoded.ids, skip_special_tokens=False) == formatted
    offsets = np.array(encoded.offsets).reshape(-1, 2)
    inside = cf.mask(offsets[:, 0], offsets[:, 1], spans)
    covered = {c for (a, b), m in zip(encoded.offsets, inside) if m for c in range(a, b)}
    assert covered == {c for a, b in spans for c in range(a, b)}


def brute(rows):
    conversations = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        conversations.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = []
    for conv, turns in conversations.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        rendered = cf.render(turns)[0]
        out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(rendered)))
    return sorted(out, key=repr)


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 2, "assistant", ""), (1, 3, "assistant", "b<|"), (1, 4, "user", "|>"),
    (2, 1, None, None), (2, 0, "assistant", None), (None, 0, "assistant", "lost"), (None, None, "user", "é🙂" * 20000),
    (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"), (3, 0, "assistant", "a tie"), (4, 0, "system", ""),
]


def test_small_table(spark):
    table = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "conv_id long, turn long, role string, text string, block string, loss int")
    assert sorted(map(tuple, cf.report(table, DEFINITION).collect()), key=repr) == brute(ROWS)


def test_blocks_of_a_long_conversation(spark, monkeypatch):
    rows = [(7, k, "assistant" if k % 2 else "user", f"turn {k} <|end|> " * 40) for k in range(120)] + [(8, 0, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    run = cf._format(DEFINITION, "assistant")
    batches = table.drop("turn").select("conv_id", "role", "text").toArrow().to_batches()
    monkeypatch.setattr(cf, "BLOCK_CHARS", 5000)
    blocks = list(run(iter(batches)))
    assert len(blocks) > 5
    digests = [tuple(r.values()) for b in cf._digests(iter(blocks)) for r in b.to_pylist()]
    assert sorted(digests, key=repr) == brute(rows)


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cf.report(table, DEFINITION).collect() == []

"""Chat formatting with offset-aligned loss masks.

A conversation is rendered turn by turn as ``<|turn|>role<|text|>text<|end|>``. In roles and texts a backslash is
doubled and ``<|`` becomes ``<\\|``, so that no text can hold a marker, and reading back undoes it. The markers are
tokens of their own and end any token before them; a rendered stretch of whole turns is therefore encoded once, with
character offsets, and stretches of one conversation can be encoded one after another. The spans of the texts to learn
from are sorted, and so are the spans of tokens: binary search finds the tokens inside each span.

Turns are dealt by conversation and sorted there; a task streams over them and holds one stretch of about
``BLOCK_CHARS`` at a time, however long a conversation is.

Defined cases: a NULL role or text is empty; rows of one turn number are ordered by role and text; rows without
conv_id form one conversation; repeated rows are turns of their own; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import AddedToken, Tokenizer

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LEARNT_ROLE = "assistant"
BLOCK_CHARS = 1_000_000
SCHEMA = (
    "conv_id long, block long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
)

_RENDERED = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], learnt: str = LEARNT_ROLE) -> tuple[str, np.ndarray]:
    """The rendered turns, and the spans of the texts to learn from."""
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        at += len(head)
        if role == learnt:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += (head, body, END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered stretch."""
    return [(unescape(role), unescape(text)) for role, text in _RENDERED.findall(formatted)]


def mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie inside a span; both lists of spans are sorted."""
    first = np.searchsorted(starts, spans[:, 0], "left")
    last = np.searchsorted(ends, spans[:, 1], "right")
    step = np.zeros(len(starts) + 1, np.int64)
    some = first < last
    np.add.at(step, first[some], 1)
    np.add.at(step, last[some], -1)
    return np.cumsum(step)[:-1] > 0


def load_tokenizer(definition: str) -> Tokenizer:
    """A public tokenizer with the three markers added to it."""
    tokenizer = Tokenizer.from_str(definition)
    tokenizer.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in (TURN, TEXT, END)])
    return tokenizer


_loaded: dict[int, Tokenizer] = {}


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in range(3)))


def _format(definition: str, learnt: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if hash(definition) not in _loaded:
            _loaded[hash(definition)] = load_tokenizer(definition)
        tokenizer = _loaded[hash(definition)]

        def block(conv, number, turns):
            formatted, spans = render(turns, learnt)
            encoded = tokenizer.encode(formatted, add_special_tokens=False)
            offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
            inside = mask(offsets[:, 0], offsets[:, 1], spans)
            columns = [[conv], [number], [formatted], [encoded.ids], [offsets[:, 0]], [offsets[:, 1]], [inside]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=SCHEMA_NAMES)

        conv, number, turns, chars, some = None, 0, [], 0, False
        for own, role, text in _turns(batches):
            if some and (own != conv or chars >= BLOCK_CHARS):
                yield block(conv, number, turns)
                number = number + 1 if own == conv else 0
                turns, chars = [], 0
            conv, some = own, True
            turns.append((role or "", text or ""))
            chars += len(turns[-1][1])
        if some:
            yield block(conv, number, turns)

    return run


SCHEMA_NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def format_conversations(conversations: DataFrame, definition: str, learnt: str = LEARNT_ROLE) -> DataFrame:
    """Rendered blocks of whole turns with token ids, offsets and loss mask; blocks of a conversation follow each other.

    ``definition`` is the content of a public tokenizer file: its size does not depend on the data.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", F.col("turn").alias("__llm_turn"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "__llm_turn", "role", "text")
    return dealt.drop("__llm_turn").mapInArrow(_format(definition, learnt), SCHEMA)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read formatted blocks back, one after another, and close a conversation when the next begins."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    state = None

    def close(state):
        conv, turns, turn_hash, chars, loss_hash, formatted = state
        row = [conv, turns, turn_hash.hexdigest(), chars, loss_hash.hexdigest(), formatted]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    for batch in batches:
        for k in range(batch.num_rows):
            conv, number, formatted = (batch.column(c)[k].as_py() for c in range(3))
            starts, ends, loss = (np.asarray(batch.column(c)[k].values.to_numpy(zero_copy_only=False)) for c in (4, 5, 6))
            if number == 0:
                if state is not None:
                    yield close(state)
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read_back(formatted):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            edges = np.flatnonzero(np.diff(np.r_[False, loss, False].astype(np.int8)))
            for a, b in edges.reshape(-1, 2).tolist():
                learnt = unescape(formatted[starts[a] : ends[b - 1]])
                state[3] += len(learnt)
                state[4].update(learnt.encode())
            state[5] += len(formatted)
    if state is not None:
        yield close(state)


def report(conversations: DataFrame, definition: str) -> DataFrame:
    """Per conversation what its formatted output says: turns, learnt text, length."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return format_conversations(conversations, definition).mapInArrow(_digests, schema)

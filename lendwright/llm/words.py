"""Words of many texts at once, as arrays.

Texts arrive as an Arrow column; word bounds, words' documents and 64-bit word hashes are computed on
the whole byte buffer with a few array operations, so no Python object is made per word. A batch is
handled in pieces of about ``PIECE_BYTES``; a longer text forms a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1_000_000

#: Odd multiplier of the rolling sum and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)

_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 2**63, size=256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}

#: Every byte but the blanks 09-0D and 20.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Digits, a-z (and A-Z, which are lower-cased first) and every byte of a character beyond ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x41:0x5B] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _power(base: int, n: int) -> np.ndarray:
    """base^0 … base^(n-1) modulo 2^64."""
    name = str(base)
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 1 << 23:
            _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of a piece: byte bounds in ``data``, and for each text the range of its words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[self.data] * _power(BASE, n), out=total[1:])
        return mix((total[self.end] - total[self.start]) * _power(INVERSE, n + 1)[self.start])

    def strings(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start.tolist(), self.end.tolist())]


def words(texts: pa.Array, word_bytes: np.ndarray = NOT_BLANK, lower: bool = False) -> Words:
    """Words of all texts; a NULL text has none."""
    column = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    inside = word_bytes[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    bounds = offsets[(offsets > 0) & (offsets < len(data))]
    opens[bounds] = inside[bounds]
    closes[bounds - 1] = inside[bounds - 1]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def pieces(batch: pa.RecordBatch, *texts: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most PIECE_BYTES in all its text columns, or one row."""
    total = np.zeros(len(batch) + 1, np.int64)
    for text in texts:
        column = batch.column(batch.schema.get_field_index(text)).fill_null("").cast(pa.large_binary())
        if len(column):
            total += np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    begin = 0
    while begin < len(batch):
        stop = int(np.searchsorted(total, total[begin] + PIECE_BYTES, "right")) - 1
        stop = min(max(stop, begin + 1), len(batch))
        yield batch.slice(begin, stop - begin)
        begin = stop


def gram_hashes(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hash of every ``n`` consecutive values; entry i covers i … i+n-1."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size = len(h) - n + 1
    total = np.zeros(size, np.uint64)
    factor = (BASE * (2 * seed + 1)) % 2**64
    weight = 1
    for j in range(n):
        weight = weight * factor % 2**64
        total += h[j : j + size] * np.uint64(weight)
    return mix(total)


def ragged(first: np.ndarray, take: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices take[i] … take[i]+length[i]-1 of all i, one after another. ``first`` is their running start."""
    total = int(length.sum())
    return np.arange(total) - np.repeat(first, length) + np.repeat(take, length)

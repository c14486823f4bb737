"""Where the leaves of substring dedup go."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from lendwright.llm import substring_dedup as sd
from lendwright.llm.rows import K1, K2
from lendwright.llm.words import words

PASSAGE = " ".join(f"p{k}" for k in range(13))
BITS = 6


def sent(n, heavy):
    """(kind, group, leaves) of n documents that all hold one window, in one piece."""
    keys = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, (2, n))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int64()), pa.array([PASSAGE] * n), pa.array(keys[0]), pa.array(keys[1])], names=["doc_id", "text", K1, K2]
    )
    prefix = np.unique(sd._anchored(words(batch.column(1)), 13)[2])
    marks = SimpleNamespace(value=np.full(1 << 13, 255, np.uint8))
    extended = SimpleNamespace(value=prefix if heavy else prefix[:0])
    (out,) = sd._send_leaves(13, BITS, 16, marks, extended)(iter([batch]))
    return [(r["kind"], r["part"], len(r["leaves"]) // sd._LEAF.itemsize) for r in out.to_pylist()]


def test_settled_repeats_of_one_passage_spread_over_all_groups():
    for heavy in (False, True):
        rows = sent(3000, heavy)
        assert [n for kind, _, n in rows if kind == 0] == [1]
        settled = [n for kind, _, n in rows if kind == 1]
        assert sum(settled) == 2999 and len(settled) == 1 << BITS and max(settled) < 3 * 2999 / (1 << BITS)

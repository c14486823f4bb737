"""Order MinHash against a plain version, and the edited texts against plain slicing."""

from __future__ import annotations

import hashlib
import random
import re

import xxhash

from lendwright.llm import order_minhash as om


def spark_hash(values, kind):
    """The chained 64-bit hash over values that are not NULL."""
    seed = 42
    for v in values:
        if v is None:
            continue
        raw = v.encode() if kind == "s" else (v % 2**64).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def brute(text):
    units = [c for u in re.findall(r"[^\x20\x09-\x0D]+", text) for c in (u if len(u) > om.LONG_WORD else [u])]
    n = max(len(units) - 2, 1) if units else 0
    seen, bins = {}, {}
    for i in range(n):
        gram = spark_hash(units[i : i + 3], "s") & om.HASH
        seen[gram] = seen.get(gram, 0) + 1
        number = xxhash.xxh64_intdigest(seen[gram].to_bytes(4, "little"), xxhash.xxh64_intdigest(gram.to_bytes(8, "little"), 42))
        h = (gram if seen[gram] == 1 else number) & om.HASH
        bins.setdefault(h >> (om.HASH_BITS - om.BIN_BITS), []).append((h, i))
    out = ""
    for b in range(om.BINS):
        if b not in bins:
            out += om.EMPTY_BIN
            continue
        least = sorted(bins[b], key=lambda x: (x[0], x[1]))[: om.KEEP]
        out += f"{spark_hash([h for h, _ in sorted(least, key=lambda x: x[1])], 'l') & 0xFFFFFFFF:08x}"
    return out


def like(a, b):
    pairs = [(a[k : k + 8], b[k : k + 8]) for k in range(0, len(a), 8)]
    filled = [p for p in pairs if p != (om.EMPTY_BIN, om.EMPTY_BIN)]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def check(rows, got):
    ordered = sorted({(i, t or "") for i, t in rows if i is not None}, key=lambda r: -r[0])
    texts = [t for _, t in ordered]
    want = {}
    for k, (i, t) in enumerate(ordered):
        nxt = texts[(k + 1) % len(texts)]
        c = len(t) // 3
        edited = t[: len(t) - c] + nxt[:c]
        want[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), brute(t), brute(edited), like(brute(t), brute(edited)), like(brute(t), brute(nxt)))
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:7] == want[r.doc_id], r.doc_id


def test_small_rows(spark):
    rows = [(1, "a b c d e f g"), (2, ""), (3, None), (4, " \t\x0b"), (9, "Été 🙂 ünïcode " * 40), (10, "x"), (10, "x")]
    rows += [(20, "again " * 5000), (21, "one " * 3 + "two " * 3), (22, "z" * 4001), (23, " ".join(f"w{i}" for i in range(20000)))]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, n_chars string")
    check(rows, om.edited_report(docs).collect())


def test_texts_without_blanks_are_sensitive_to_edits(spark):
    """Two thirds of a text without blanks stay: some tuples must stay with them."""
    rng = random.Random(7)
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    rows = [(1, han(900)), (2, han(900)), (3, "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(504))), (4, "🙂🙃" * 30), (5, "n" * 24), (6, "n" * 25)]
    got = om.edited_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, got)
    assert all(r.near_edited > 0.1 > r.near_next for r in got if r.doc_id in (1, 2))


def test_one_document_follows_itself(spark):
    rows = [(5, "abcdefghi jkl")]
    check(rows, om.edited_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_empty_table_and_null_ids(spark):
    assert om.edited_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "a b"), (None, "c d"), (3, "e f g")]
    got = om.edited_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_chars for r in got) == [3, 3, 5]


def test_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = om.edited_report(docs).collect()
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], got)
    assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(got)


def test_moved_passages_lower_the_likeness():
    text = [f"w{i}" for i in range(600)]
    same = brute(" ".join(text))
    moved = brute(" ".join(text[300:] + text[:300]))
    assert like(same, same) == 1.0 and like(same, moved) < 0.9

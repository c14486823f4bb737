"""Texts that are shorter than the template they hold most of."""

from __future__ import annotations

import duckdb

from lendwright.llm import license_scan
from lendwright.llm.license_texts import NOTICES
from lendwright.llm.queries import license_sql


def test_notice_without_its_last_word_is_found(spark):
    long = {k: v for k, v in NOTICES.items() if len(v.split()) > 40}
    names = sorted(long)
    rows = [(i, " ".join(long[n].split()[:-1])) for i, n in enumerate(names)] + [(99, " ".join(long[names[0]].split()[:20]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in license_scan.scan(docs, long).collect()}
    assert found[99].matches == []
    for i, n in enumerate(names):
        (match,) = [m for m in found[i].matches if m.license == n]
        assert 0.9 < match.containment < 1 and (match.first, match.end) == (0, found[i].n_words)


def test_sql_agrees_on_texts_around_the_length_of_a_template(spark):
    rows = [(1, None), (2, ""), (3, "released"), (4, "Released under the MIT License")]
    for name in ("MIT-text", "BSD-2-Clause", "MPL-2.0", "all-rights-reserved"):
        own = NOTICES[name].split()
        for cut in (0, 1, 3, 8, len(own) // 4):
            rows += [(len(rows) + 1, " ".join(own[cut:])), (len(rows) + 2, " ".join(own[: len(own) - cut])), (len(rows) + 3, " ".join(["x", *own[cut:], "y"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_licenses, r.licenses, r.best_containment) for r in license_scan.report(docs, NOTICES).collect())
    connection = duckdb.connect()
    connection.register("documents", docs.toArrow())
    want = sorted(connection.execute(f"SELECT doc_id, n_words, n_licenses, licenses, best_containment FROM ({license_sql(NOTICES)})").fetchall())
    assert got == want
    assert sum(r[2] for r in got) > 20

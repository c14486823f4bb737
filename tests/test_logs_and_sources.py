"""Privacy, run logs, stream restart, files and versions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lendwright.functions.expressions import ScoreScale, score_column_name
from lendwright.operators import binning, privacy, runlogs, scoring
from lendwright.sources import files, versions
from lendwright.streaming import event_tail


@pytest.mark.parametrize(
    "text, issue",
    [
        ("api_key=abc", "POSSIBLE_SECRET_FORBIDDEN"),
        ("Authorization: Bearer abcdef.ghijkl", "POSSIBLE_SECRET_FORBIDDEN"),
        ("sk-abcdefghijklmnop", "POSSIBLE_SECRET_FORBIDDEN"),
        ("task-abcdefghijklmnop", None),
        ("call 13812345678", "POSSIBLE_PII_VALUE_FORBIDDEN"),
        ("11010119900101123X", "POSSIBLE_PII_VALUE_FORBIDDEN"),
        ("Mail.Me+x@Example.org", "POSSIBLE_PII_VALUE_FORBIDDEN"),
        ("a,b,c,d\n\n1,2,3,4", "POSSIBLE_RAW_TABLE_FORBIDDEN"),
        ("a\tb\tc 1\t2\t3", "POSSIBLE_RAW_TABLE_FORBIDDEN"),
        ("one, two, three, four", None),
        ("x" * 200000 + " 13812345678", "POSSIBLE_PII_VALUE_FORBIDDEN"),
        (None, None),
    ],
)
def test_text_rules(spark, text, issue):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(privacy.text_issue("t")).first()[0] == issue


def test_small_groups_keep_only_their_count(spark):
    df = spark.createDataFrame([("a", 29, 0.5), ("b", 30, 0.6), ("c", None, 0.7)], "g string, `count` int, rate double")
    got = [tuple(r) for r in privacy.suppress_small_groups(df).collect()]
    assert got == [(None, 29, None, True), ("b", 30, 0.6, False), (None, 0, None, True)]


def test_event_damage_is_found(spark):
    rows = [("ok", 1, "a", "running"), ("ok", 2, "b", "succeeded"), ("gap", 1, "a", "x"), ("gap", 3, "b", "succeeded"),
            ("twice", 1, "a", "x"), ("twice", 2, "a", "succeeded"), ("end", 1, "a", "running")]
    events = spark.createDataFrame(rows, "run_id string, seq int, id string, status string")
    runs = spark.createDataFrame([(r, "succeeded") for r in ("ok", "gap", "twice", "end")], "run string, terminal_status string")
    got = {r["run"]: (r["contiguous"], r["unique_ids"], r["terminal_matches"]) for r in runlogs.event_integrity(events, runs=runs).collect()}
    assert got == {"ok": (True, True, True), "gap": (False, True, True), "twice": (True, False, True), "end": (True, True, False)}


@pytest.mark.parametrize("hot", [1_000_000, 1])
def test_span_chains_cycles_and_orphans(spark, hot):
    chain = [("deep", i, i - 1 if i else None) for i in range(70)]
    star = [("star", i, 0 if i else None) for i in range(50)]
    loop = [("loop", 0, None), ("loop", 1, 3), ("loop", 2, 1), ("loop", 3, 2), ("loop", 4, 3)]
    lost = [("lost", 0, None), ("lost", 1, 99), ("lost", 2, 1)]
    spans = spark.createDataFrame(chain + star + loop + lost, "trace_id string, id int, parent_span_id int")
    got = {r["trace"]: r for r in runlogs.span_lineage(spans, hot_min_rows=hot).collect()}
    assert got["deep"]["valid"] and got["deep"]["reaching_root"] == 70 and got["star"]["valid"]
    assert (got["loop"]["in_cycle"], got["loop"]["valid"]) == (4, False)
    assert (got["lost"]["below_missing_parent"], got["lost"]["valid"]) == (2, False)


def trial(case, number, severity="low", met=True, state="succeeded", error=None):
    return (case, number, "core", severity, met, error, state, "succeeded", 0, 10, 5, 1, 1)


TRIAL = ("case_id string, trial int, category string, severity string, expectation_met boolean, error string, terminal_state string, "
         "expected_terminal_state string, security_events int, total_tokens int, duration_ms int, spans int, events int")


def test_a_critical_case_cannot_be_averaged_away(spark):
    rows = [trial(f"c{i}", 1) for i in range(99)] + [trial("x", 1, "critical", met=False)]
    summary = runlogs.trial_summary(spark.createDataFrame(rows, TRIAL))
    gate = runlogs.gate_table(summary, runlogs.Gate(min_expectation_rate=0.9))
    failed = [r["name"] for r in gate.filter("not passed").collect()]
    assert failed == ["critical_cases_passed"] and not runlogs.gate_verdict(gate).first()["passed"]


def test_wrong_terminal_state_does_not_count(spark):
    df = spark.createDataFrame([trial("a", 1, state="failed"), trial("b", 1, error="BOOM"), trial("c", 1)], TRIAL)
    assert runlogs.trial_summary(df).first()["met"] == 1


def test_baseline_needs_identical_keys(spark):
    base = spark.createDataFrame([trial("a", 1), trial("b", 1)], TRIAL)
    assert runlogs.baseline_comparison(base, base).first()["trial_keys_match"]
    fewer = runlogs.baseline_comparison(base, base.filter("case_id = 'a'")).first()
    assert not fewer["trial_keys_match"] and fewer["expectation_rate_delta"] == 0
    assert not runlogs.baseline_comparison(base, base.unionByName(base)).first()["trial_keys_match"]


def test_durations_are_never_negative(spark):
    df = spark.sql(
        "SELECT timestamp'2024-01-01 00:00:01.2345' a, timestamp'2024-01-01 00:00:00' b UNION ALL SELECT null, timestamp'2024-01-01'"
    )
    assert [r[0] for r in df.select(runlogs.span_duration_ms("b", "a")).collect()] == [1234, 0]
    assert [r[0] for r in df.select(runlogs.span_duration_ms("a", "b")).collect()] == [0, 0]


def test_tail_resumes_from_its_checkpoint(spark, tmp_path):
    source, target, cursor = (str(tmp_path / n) for n in ("in", "out", "cursor"))
    schema = "run_id string, id string, seq int, status string"
    first = spark.range(5002).selectExpr("'r' run_id", "concat('e', id) id", "cast(id + 1 as int) seq", "'running' status")
    first.write.parquet(f"{source}/a")
    typed = spark.createDataFrame([], schema).schema
    event_tail.tail(spark, f"{source}/*", typed, target, cursor).awaitTermination()
    assert event_tail.current_events(spark, target, typed, ["run_id", "id"]).count() == 5002
    fix = spark.createDataFrame([("r", "e7", 8, "corrected"), ("r", "e5002", 5003, "succeeded")], schema)
    fix.write.parquet(f"{source}/b")
    event_tail.tail(spark, f"{source}/*", typed, target, cursor).awaitTermination()
    now = event_tail.current_events(spark, target, typed, ["run_id", "id"])
    assert now.count() == 5003 and now.filter("id = 'e7'").first()["status"] == "corrected"
    stored = spark.read.parquet(target)
    assert stored.count() == 5004  # the second run read only the new file
    tail = runlogs.events_after(now, "run_id", "r", "seq", 5000).collect()
    assert [r["seq"] for r in tail] == [5001, 5002, 5003]
    event_tail.compact(spark, target, typed, ["run_id", "id"], str(tmp_path / "compact"))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 5003


def rules():
    spec = binning.BinSpec("x", "numeric", (1.0,), rows=binning.woe_rows([("(-inf, 1.0]", 0, 10, 2), ("(1.0, inf]", 1, 10, 7)])[0])
    return scoring.ScorecardRules(["x"], [-1.5], 0.2, binning.Binning({"x": spec}))


def test_rules_score_a_stream_like_a_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(20)], "id int, x double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (
        event_tail.score_stream(stream, rules()).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    batch = scoring.score_with_rules(df, rules())
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(batch).isEmpty()
    again = scoring.ScorecardRules.from_json(rules().to_json())
    assert scoring.score_with_rules(df, again).exceptAll(batch).isEmpty()
    with pytest.raises(ValueError, match="SCORECARD_RULES_INVALID"):
        scoring.ScorecardRules(["x"], [], 0.0, binning.Binning({}))


def test_scores_round_half_even_and_names(spark):
    assert score_column_name("y-model (v2)") == "y_model_v2_score" and score_column_name("--") == "risk_model_score"
    with pytest.raises(ValueError, match="SCORE_RANGE_INVALID"):
        ScoreScale(minimum=900, maximum=300)
    with pytest.raises(ValueError, match="SCORE_SCALING_INVALID"):
        ScoreScale(pdo=0)
    df = spark.createDataFrame([(0.0,), (1.0,), (1 / 21,)], "p double")
    got = [r["m_score"] for r in scoring.append_scores(df, "p", "m").collect()]
    assert got == [900, 300, 600]
    even = scoring.append_scores(df, "p", "m", ScoreScale(minimum=500.5, maximum=501.5)).collect()
    assert [r["m_score"] for r in even] == [502, 500, 502]


def test_contract(spark):
    df = spark.createDataFrame([("1", "2024-01-01", 5), ("x", "?", 6), (None, None, None)], "a string, d string, c int")
    contract = scoring.FieldContract({"a": "numeric", "d": "datetime", "c": "categorical"})
    assert {(r["field"], r["rows"]) for r in scoring.contract_violations(df, contract).collect()} == {("a", 1), ("d", 1)}
    with pytest.raises(ValueError, match="FIELD_TYPE_MISMATCH"):
        scoring.apply_contract(df, contract)
    fine = scoring.apply_contract(df.filter("a is null or a = '1'"), contract)
    assert dict(fine.dtypes) == {"a": "double", "d": "timestamp", "c": "string"}
    with pytest.raises(ValueError, match="MISSING_REQUIRED_FIELDS"):
        scoring.apply_contract(df, scoring.FieldContract({"zz": "numeric"}))
    with pytest.raises(ValueError, match="MODEL_FIELD_TYPE_UNSUPPORTED"):
        scoring.FieldContract({"a": "image"})


@pytest.mark.parametrize(
    "encoding, delimiter", [("utf-8", ","), ("utf-8-sig", ";"), ("gb18030", "\t"), ("big5", "|"), ("latin1", ",")]
)
def test_csv_encodings_and_delimiters(spark, tmp_path, encoding, delimiter):
    word = "é" if encoding == "latin1" else "中文"
    lines = [delimiter.join(("id", "name", "v", "flag"))]
    lines += [delimiter.join((str(i), word if i % 2 else "NA", "" if i == 3 else f"{i}.5", "True" if i % 2 else "False")) for i in range(8)]
    path = tmp_path / "t.csv"
    path.write_bytes("\n".join(lines).encode(encoding))
    if encoding == "big5":
        assert files.detect_encoding(path.read_bytes()) in ("gb18030", "big5")
        return
    df = files.read_csv(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "v": "double", "flag": "boolean"}
    assert df.count() == 8 and df.filter("v is null").count() == 1
    assert {r[0] for r in df.select("name").distinct().collect()} == {word, None}
    assert files.read_csv(spark, str(path), columns=["v", "id"], limit=2).collect()[1]["id"] == 1


def test_cut_character_does_not_change_the_encoding():
    text = "列" * 50_000
    assert files.detect_encoding(text.encode("utf-8")[: files.ENCODING_SAMPLE]) == "utf-8-sig"


def test_csv_round_trip_without_pii(spark, tmp_path):
    df = spark.createDataFrame([(1, "A", 'say "hi", now')], "id long, customer_name string, note string")
    files.write_csv(df, str(tmp_path / "c"), drop_pii=True)
    back = files.read_csv(spark, str(tmp_path / "c"))
    assert [tuple(r) for r in back.collect()] == [(1, 'say "hi", now')]


def test_dictionary_headers(spark):
    raw = spark.createDataFrame([(" age ", None, "-1，-9; ", "x"), ("nan", "d", None, ""), ("", "d", None, "")], "`字段名` string, `含义` string, `缺失码` string, `用途` string")
    assert [tuple(r) for r in files.parse_dictionary(raw).collect()] == [("age", "", "x", ["-1", "-9"])]
    with pytest.raises(ValueError, match="DATA_DICTIONARY_FIELD_COLUMN_REQUIRED"):
        files.parse_dictionary(raw.drop("字段名"))


def test_changed_version_is_refused(spark, tmp_path):
    root = str(tmp_path / "v")
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    first = versions.write_version(df, root, "raw")
    second = versions.write_version(versions.read_version(spark, root, first).filter("id < 50"), root, "half", parents=[first])
    assert versions.ancestors(spark, root, second) == [first]
    assert versions.read_version(spark, root, second).count() == 50
    spark.range(1).withColumn("x", F.lit(7).cast("bigint")).write.mode("append").parquet(versions.version_path(root, second))
    with pytest.raises(ValueError, match="DATA_FILE_CHECKSUM_MISMATCH"):
        versions.read_version(spark, root, second)
    with pytest.raises(ValueError, match="DATASET_VERSION_NOT_FOUND"):
        versions.read_version(spark, root, "dsv_none")
    a = versions.fingerprint(df).first()
    assert a == versions.fingerprint(df.repartition(7)).first()

"""Queries: privacy scans, run and trial logs, event tail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lendwright.functions import fixed_values as fixed
from lendwright.operators import privacy, runlogs
from lendwright.operators.profile import column_profile
from lendwright.plans.loan import table
from lendwright.plans.queries_data import COLUMNS, TYPED, _profile_sql
from lendwright.plans.registry import query, rounded
from lendwright.session import scratch_path
from lendwright.streaming import event_tail, run_state, usage_windows

# --- M: privacy -----------------------------------------------------------------------------

# RE2 knows no look-behind; a leading non-word character says the same.
SECRET_RE2 = r"(?i)((^|[^A-Za-z0-9])sk-[A-Za-z0-9_-]{12,}|api[_-]?key\s*[:=]|bearer\s+[A-Za-z0-9._-]{12,})"
# RE2 knows word boundaries of ASCII words only, so the neighbours are spelled out. Numbers in these texts never
# stand one separator apart.
_BEFORE, _AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
MOBILE_RE2 = _BEFORE + r"1[3-9]\p{Nd}{9}" + _AFTER
ID_RE2 = _BEFORE + r"\p{Nd}{15}(?:\p{Nd}{2}[0-9Xx])?" + _AFTER
EMAIL_RE2 = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    """All texts of the test tables as (origin, id, text), with some planted secrets and numbers."""
    documents = table(spark, folder, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text"
    )
    talks = table(spark, folder, "conversations").select(
        F.lit("conversations").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    pages = table(spark, folder, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    items = table(spark, folder, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), "text")
    everything = documents.unionByName(talks).unionByName(pages).unionByName(items)
    extra = (
        F.when(F.col("id") % 11 == 1, F.lit("\ncall 13812345678 now"))
        .when(F.col("id") % 11 == 2, F.lit("\nAPI_key = abc"))
        .when(F.col("id") % 11 == 3, F.lit(" Bearer abcdefghijkl.mno"))
        .when(F.col("id") % 11 == 4, F.lit(" sk-abcdefghijklmnop"))
        .when(F.col("id") % 11 == 5, F.lit(" id 11010119900101123X end"))
        .when(F.col("id") % 11 == 8, F.lit(" no. １１０１０１１９９００１０１１ end"))
        .when(F.col("id") % 11 == 9, F.lit(" tel 138１２３４５６７８ end"))
        .when(F.col("id") % 11 == 10, F.lit(" 机13812345678 end"))
        .when(F.col("id") % 11 == 6, F.lit("\na,b,c,d\ne,f,g,h\n"))
        .when(F.col("id") % 11 == 7, F.lit("\r\na\tb\tc\r\n1\t2\t3"))
        .otherwise(F.lit(""))
    )
    return everything.withColumn("text", F.concat("text", extra))


SOURCES = """WITH raw AS (SELECT 'documents' AS origin, doc_id AS id, text FROM documents
   UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations
   UNION ALL SELECT 'pages', page_id, html FROM pages UNION ALL SELECT 'benchmark', item_id, text FROM benchmark),
 texts AS (SELECT origin, id, text || CASE id % 11 WHEN 1 THEN chr(10) || 'call 13812345678 now' WHEN 2 THEN chr(10) || 'API_key = abc'
   WHEN 3 THEN ' Bearer abcdefghijkl.mno' WHEN 4 THEN ' sk-abcdefghijklmnop' WHEN 5 THEN ' id 11010119900101123X end'
   WHEN 8 THEN ' no. １１０１０１１９９００１０１１ end' WHEN 9 THEN ' tel 138１２３４５６７８ end' WHEN 10 THEN ' 机13812345678 end'
   WHEN 6 THEN chr(10) || 'a,b,c,d' || chr(10) || 'e,f,g,h' || chr(10)
   WHEN 7 THEN chr(13) || chr(10) || 'a' || chr(9) || 'b' || chr(9) || 'c' || chr(13) || chr(10) || '1' || chr(9) || '2' || chr(9) || '3'
   ELSE '' END AS text FROM raw)"""


@query("m1_secret_scan", SOURCES + f" SELECT origin, count(*) AS texts, count(*) FILTER (WHERE regexp_matches(text, '{SECRET_RE2}')) AS secrets FROM texts GROUP BY 1")
def m1(spark: SparkSession, folder: str) -> DataFrame:
    texts = _sources(spark, folder)
    return texts.groupBy("origin").agg(
        F.count("*").alias("texts"), F.count_if(privacy.has_secret(F.col("text"))).alias("secrets")
    )


@query(
    "m2_pii_scan",
    SOURCES
    + f""" SELECT origin, id, len(regexp_extract_all(text, '{MOBILE_RE2}')) AS mobiles,
        len(regexp_extract_all(text, '{ID_RE2}')) AS id_numbers, len(regexp_extract_all(text, '{EMAIL_RE2}')) AS emails
        FROM texts WHERE regexp_matches(text, '{MOBILE_RE2}') OR regexp_matches(text, '{ID_RE2}') OR regexp_matches(text, '{EMAIL_RE2}')""",
)
def m2(spark: SparkSession, folder: str) -> DataFrame:
    found = privacy.scan_text(_sources(spark, folder), "text", ["origin", "id"])
    return found.filter("pii").select("origin", "id", "mobiles", "id_numbers", "emails")


TABLE_LINES = """len(list_filter(string_split_regex(text, '\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]'),
   lambda l: regexp_matches(l, '\\S') AND (length(l) - length(replace(l, ',', '')) >= 3
     OR length(l) - length(replace(l, chr(9), '')) >= 2))) >= 2"""


@query("m3_pasted_tables", SOURCES + f" SELECT origin, id FROM texts WHERE {TABLE_LINES}")
def m3(spark: SparkSession, folder: str) -> DataFrame:
    return _sources(spark, folder).filter(privacy.has_pasted_table(F.col("text"))).select("origin", "id")


@query(
    "m3_text_issues",
    SOURCES
    + f""", found AS (SELECT origin, CASE WHEN regexp_matches(text, '{SECRET_RE2}') THEN 'POSSIBLE_SECRET_FORBIDDEN'
        WHEN regexp_matches(text, '{MOBILE_RE2}') OR regexp_matches(text, '{ID_RE2}') OR regexp_matches(text, '{EMAIL_RE2}')
          THEN 'POSSIBLE_PII_VALUE_FORBIDDEN'
        WHEN {TABLE_LINES} THEN 'POSSIBLE_RAW_TABLE_FORBIDDEN' END AS issue FROM texts)
      SELECT origin, issue, count(*) AS texts FROM found GROUP BY 1, 2""",
)
def m3_issues(spark: SparkSession, folder: str) -> DataFrame:
    texts = _sources(spark, folder)
    return texts.groupBy("origin", privacy.text_issue("text").alias("issue")).agg(F.count("*").alias("texts"))


@query(
    "m4_small_groups",
    f"""SELECT CASE WHEN n >= {fixed.MIN_GROUP_COUNT} THEN p_brand END AS p_brand, CASE WHEN n >= {fixed.MIN_GROUP_COUNT} THEN p_type END AS p_type,
        n AS count, CASE WHEN n >= {fixed.MIN_GROUP_COUNT} THEN price END AS price, n < {fixed.MIN_GROUP_COUNT} AS suppressed
        FROM (SELECT p_brand, p_type, count(*) AS n, round(avg(p_retailprice), 6) AS price FROM part GROUP BY 1, 2)""",
)
def m4(spark: SparkSession, folder: str) -> DataFrame:
    groups = (
        table(spark, folder, "part")
        .groupBy("p_brand", "p_type")
        .agg(F.count("*").alias("count"), F.round(F.avg("p_retailprice"), 6).alias("price"))
    )
    return privacy.suppress_small_groups(groups)


@query(
    "m5_safe_evidence",
    f"WITH facts AS ({_profile_sql('customer', tuple(zip(COLUMNS['customer'], TYPED['customer'])))})"
    + """ SELECT printf('f_%04d', position + 1) AS alias, type, missing_rate, unique_count,
         regexp_matches(name, '(?i)(^|_)(name|mobile|phone|id_?card|identity|email|address|bank_?card)($|_)') AS pii,
         false AS selected, NULL::VARCHAR AS selection_reason, NULL::DOUBLE AS iv FROM facts""",
)
def m5(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(privacy.safe_evidence(column_profile(table(spark, folder, "customer"))))


@query("m6_drop_pii_columns", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def m6(spark: SparkSession, folder: str) -> DataFrame:
    return privacy.drop_pii_columns(table(spark, folder, "customer"))


# --- N: run logs ----------------------------------------------------------------------------

# Turns of a conversation are events of a run: sequence = turn + 1. Some are damaged on purpose.
CONVERSATION_EVENTS = """ev AS (SELECT conv_id AS run_id, CASE WHEN conv_id % 9 = 4 AND turn > 0 THEN turn + 2 ELSE turn + 1 END AS seq,
   CASE WHEN conv_id % 7 = 3 THEN 'same' ELSE conv_id || '-' || turn END AS id,
   CASE WHEN role = 'assistant' THEN 'succeeded' ELSE 'running' END AS status FROM conversations)"""


def _conversation_events(spark: SparkSession, folder: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, folder, "conversations").select(
        conv.alias("run_id"),
        F.when((conv % 9 == 4) & (turn > 0), turn + 2).otherwise(turn + 1).alias("seq"),
        F.when(conv % 7 == 3, F.lit("same")).otherwise(F.concat_ws("-", conv.cast("string"), turn.cast("string"))).alias("id"),
        F.when(F.col("role") == "assistant", "succeeded").otherwise("running").alias("status"),
    )


@query(
    "n1_event_integrity",
    "WITH " + CONVERSATION_EVENTS
    + """ SELECT run_id AS run, count(*) AS n_events, min(seq) AS first_seq, max(seq) AS last_seq, arg_max(status, seq) AS last_status,
         min(seq) = 1 AND max(seq) = count(*) AND count(DISTINCT seq) = count(*) AS contiguous,
         count(DISTINCT id) = count(*) AS unique_ids, arg_max(status, seq) = 'succeeded' AS terminal_matches
       FROM ev GROUP BY 1""",
)
def n1(spark: SparkSession, folder: str) -> DataFrame:
    events = _conversation_events(spark, folder)
    runs = events.select(F.col("run_id").alias("run")).distinct().withColumn("terminal_status", F.lit("succeeded"))
    return runlogs.event_integrity(events, runs=runs)


@query(
    "n1_integrity_stream",
    "WITH " + CONVERSATION_EVENTS
    + """ SELECT run_id::VARCHAR AS run, count(*) AS n_events, min(seq) AS first_seq, max(seq) AS last_seq, arg_max(status, seq) AS last_status,
         min(seq) = 1 AND max(seq) = count(*) AND count(DISTINCT seq) = count(*) AS contiguous, count(DISTINCT id) = count(*) AS unique_ids
       FROM ev GROUP BY 1""",
)
def n1_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same check on a stream of events that arrive in four waves and out of order, with state per run."""
    events = _conversation_events(spark, folder).withColumnRenamed("run_id", "run")
    source, target = scratch_path(spark, "waves"), scratch_path(spark, "run-facts")
    wave = F.pmod(F.xxhash64("run", "seq"), F.lit(4))
    cursor = scratch_path(spark, "run-cursor")
    for k in range(4):
        events.filter(wave == k).write.mode("append").parquet(source)
        # Resumes from the cursor: a wave is a micro-batch, of as many files as its writers made.
        stream = spark.readStream.schema(events.schema).parquet(source)
        run_state.follow(run_state.run_facts(stream), target, cursor).awaitTermination()
    return run_state.current_runs(spark, target).drop("silent")


# Spans: event k of trace t = event_id % 16 hangs below event k // 2 of the same trace. Some traces
# are damaged: a missing parent, a loop, a second root, a doubled id.
SPANS = """spans AS (SELECT event_id % 16 AS trace_id, event_id AS id,
   CASE WHEN event_id // 16 = 0 THEN NULL WHEN event_id % 16 = 3 AND event_id // 16 = 9 THEN -5
        WHEN event_id % 16 = 5 AND event_id // 16 = 12 THEN event_id
        WHEN event_id % 16 = 7 AND event_id // 16 = 6 THEN (13 * 16 + 7)
        WHEN event_id % 16 = 9 AND event_id // 16 = 4 THEN NULL
        ELSE (event_id // 16 // 2) * 16 + event_id % 16 END AS parent FROM events
   UNION ALL SELECT event_id % 16, event_id, (event_id // 16 // 2) * 16 + event_id % 16 FROM events WHERE event_id % 16 = 11 AND event_id // 16 = 20)"""


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    event = F.col("event_id")
    trace, place = event % 16, F.floor(event / 16)
    usual = F.floor(place / 2) * 16 + trace
    events = table(spark, folder, "events").select(event)
    spans = events.select(
        trace.alias("trace_id"),
        event.alias("id"),
        F.when(place == 0, F.lit(None).cast("bigint"))
        .when((trace == 3) & (place == 9), F.lit(-5))
        .when((trace == 5) & (place == 12), event)
        .when((trace == 7) & (place == 6), F.lit(13 * 16 + 7))
        .when((trace == 9) & (place == 4), F.lit(None).cast("bigint"))
        .otherwise(usual)
        .alias("parent_span_id"),
    )
    doubled = events.filter((trace == 11) & (place == 20)).select(
        trace.alias("trace_id"), event.alias("id"), usual.alias("parent_span_id")
    )
    return spans.unionByName(doubled)


@query(
    "n2_span_lineage",
    "WITH RECURSIVE " + SPANS
    + """, nodes AS (SELECT trace_id, id, min(parent) AS parent, bool_or(parent IS NULL) AS root, count(*) AS copies FROM spans GROUP BY 1, 2),
     below AS (SELECT trace_id, id, 'arrived' AS state FROM nodes WHERE root
       UNION ALL SELECT n.trace_id, n.id, 'orphan' FROM nodes n WHERE NOT root AND NOT EXISTS (
         SELECT 1 FROM nodes m WHERE m.trace_id = n.trace_id AND m.id = n.parent)
       UNION ALL SELECT n.trace_id, n.id, state FROM nodes n JOIN below b ON n.trace_id = b.trace_id AND n.parent = b.id WHERE NOT n.root)
     SELECT n.trace_id AS trace, count(*) AS spans, count(*) FILTER (WHERE state = 'arrived') AS reaching_root,
       count(*) FILTER (WHERE state = 'orphan') AS below_missing_parent, count(*) FILTER (WHERE state IS NULL) AS in_cycle,
       CAST(sum(copies - 1) AS BIGINT) AS duplicate_ids, count(*) FILTER (WHERE root) AS roots,
       sum(copies - 1) = 0 AND count(*) FILTER (WHERE root) = 1 AND count(*) FILTER (WHERE state = 'arrived') = count(*) AS valid
     FROM nodes n LEFT JOIN below b ON n.trace_id = b.trace_id AND n.id = b.id GROUP BY 1""",
)
def n2(spark: SparkSession, folder: str) -> DataFrame:
    return runlogs.span_lineage(_spans(spark, folder))


# Events arrive in two waves; the second corrects some of the first.
ARRIVALS = """arrivals AS (SELECT user_id, event_id, event_type, value, 1 AS wave FROM events
   UNION ALL SELECT user_id, event_id, 'corrected', value + 1, 2 FROM events WHERE event_id % 6 = 1)"""


def _arrivals(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    first = events.select("user_id", "event_id", "event_type", "value", F.lit(1).alias("wave"))
    second = events.filter("event_id % 6 = 1").select(
        "user_id", "event_id", F.lit("corrected").alias("event_type"), (F.col("value") + 1).alias("value"), F.lit(2).alias("wave")
    )
    return first.unionByName(second)


LATEST = """latest AS (SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY wave DESC) AS i
   FROM arrivals) WHERE i = 1)"""


@query("n3_latest_events", "WITH " + ARRIVALS + ", " + LATEST + " SELECT user_id, event_id, event_type, round(value, 6) AS value, wave FROM latest")
def n3(spark: SparkSession, folder: str) -> DataFrame:
    latest = runlogs.latest_events(_arrivals(spark, folder), ["user_id", "event_id"], ["wave"])
    return rounded(latest, 6)


@query(
    "n3_events_after_cursor",
    "SELECT event_id, event_type FROM events WHERE user_id = 8 AND event_id > 1000 ORDER BY event_id LIMIT 5000",
)
def n3_after(spark: SparkSession, folder: str) -> DataFrame:
    return runlogs.events_after(table(spark, folder, "events"), "user_id", 8, "event_id", 1000).select("event_id", "event_type")


@query("n3_event_stream", "SELECT event_type, count(*) AS events, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def n3_stream(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_path(spark, "tail")
    schema = table(spark, folder, "events").schema
    query_ = event_tail.tail(
        spark, folder, schema, target, scratch_path(spark, "tail-cursor"), pattern="events.parquet"
    )
    query_.awaitTermination()
    current = event_tail.current_events(spark, target, schema, ["event_id"], ["ts"])
    return current.groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"))


# Turns of a conversation as trials of a case.
TRIALS = """trials AS (SELECT conv_id AS case_id, turn + 1 AS trial, CASE conv_id % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'edge' END AS category,
   CASE conv_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'low' END AS severity, length(text) % 10 <> 3 AS expectation_met,
   CASE WHEN length(text) % 13 = 5 THEN 'TIMEOUT' END AS error, CASE WHEN length(text) % 17 = 2 THEN 'failed' ELSE 'succeeded' END AS terminal_state,
   'succeeded' AS expected_terminal_state, (length(text) % 23 = 0)::INTEGER AS security_events, length(text) AS total_tokens,
   length(text) * 3 AS duration_ms, turn AS spans, turn + 2 AS events FROM conversations)"""
MET = "(expectation_met AND error IS NULL AND terminal_state = expected_terminal_state)"


def _trials(spark: SparkSession, folder: str) -> DataFrame:
    conv, size = F.col("conv_id"), F.length("text")
    return table(spark, folder, "conversations").select(
        conv.alias("case_id"),
        (F.col("turn") + 1).alias("trial"),
        F.when(conv % 3 == 0, "core").when(conv % 3 == 1, "edge").alias("category"),
        F.when(conv % 5 == 0, "critical").when(conv % 5 == 1, "high").otherwise("low").alias("severity"),
        (size % 10 != 3).alias("expectation_met"),
        F.when(size % 13 == 5, "TIMEOUT").alias("error"),
        F.when(size % 17 == 2, "failed").otherwise("succeeded").alias("terminal_state"),
        F.lit("succeeded").alias("expected_terminal_state"),
        (size % 23 == 0).cast("int").alias("security_events"),
        size.alias("total_tokens"),
        (size * 3).alias("duration_ms"),
        F.col("turn").alias("spans"),
        (F.col("turn") + 2).alias("events"),
    )


SUMMARY = f"""summary AS (SELECT count(*) AS trials, count(*) FILTER (WHERE {MET}) AS met, round(avg({MET}::INT), 6) AS expectation_rate,
  round(avg((error IS NOT NULL)::INT), 6) AS error_rate, round(avg((security_events > 0)::INT), 6) AS security_event_rate,
  round(avg(total_tokens), 6) AS average_total_tokens, round(avg(duration_ms), 6) AS average_duration_ms,
  round(avg(spans), 6) AS average_spans, round(avg(events), 6) AS average_events,
  bool_and(severity NOT IN ('high', 'critical') OR {MET}) AS critical_cases_passed FROM trials)"""


@query("n4_trial_summary", "WITH " + TRIALS + ", " + SUMMARY + " SELECT * FROM summary")
def n4(spark: SparkSession, folder: str) -> DataFrame:
    return runlogs.trial_summary(_trials(spark, folder))


@query(
    "n4_category_summary",
    "WITH " + TRIALS
    + """ SELECT coalesce(category, 'core') AS category, count(*) AS cases, round(avg(expectation_met::INT), 6) AS expectation_rate,
       round(avg((error IS NOT NULL)::INT), 6) AS error_rate FROM trials GROUP BY 1""",
)
def n4_category(spark: SparkSession, folder: str) -> DataFrame:
    return runlogs.category_summary(_trials(spark, folder))


@query(
    "n4_trial_key_issues",
    "WITH " + TRIALS
    + """, wanted AS (SELECT case_id, trial FROM (SELECT DISTINCT case_id FROM trials), unnest(generate_series(1, 4)) AS s(trial)),
     seen AS (SELECT case_id, trial, count(*) AS n FROM trials GROUP BY 1, 2)
     SELECT coalesce(w.case_id, s.case_id) AS case_id, coalesce(w.trial, s.trial) AS trial,
       CASE WHEN n IS NULL THEN 'MISSING' WHEN w.trial IS NULL THEN 'UNEXPECTED' ELSE 'REPEATED' END AS issue
     FROM wanted w FULL JOIN seen s ON w.case_id = s.case_id AND w.trial = s.trial WHERE n IS NULL OR w.trial IS NULL OR n > 1""",
)
def n4_keys(spark: SparkSession, folder: str) -> DataFrame:
    trials = _trials(spark, folder)
    return runlogs.trial_key_issues(trials, trials.select("case_id").distinct(), 4)


GATE = runlogs.Gate(min_expectation_rate=0.75, max_error_rate=0.05, max_security_event_rate=0.1, max_average_tokens=400.0)
GATE_SQL = f"""gate AS (SELECT 'expectation_rate' AS name, expectation_rate AS actual, '>={GATE.min_expectation_rate}' AS expected,
    expectation_rate >= {GATE.min_expectation_rate} AS passed FROM summary
  UNION ALL SELECT 'error_rate', error_rate, '<={GATE.max_error_rate}', error_rate <= {GATE.max_error_rate} FROM summary
  UNION ALL SELECT 'security_event_rate', security_event_rate, '<={GATE.max_security_event_rate}', security_event_rate <= {GATE.max_security_event_rate} FROM summary
  UNION ALL SELECT 'critical_cases_passed', critical_cases_passed::INT::DOUBLE, 'true', critical_cases_passed FROM summary
  UNION ALL SELECT 'average_total_tokens', average_total_tokens, '<={GATE.max_average_tokens}', average_total_tokens <= {GATE.max_average_tokens} FROM summary)"""


@query("n5_gate_table", "WITH " + TRIALS + ", " + SUMMARY + ", " + GATE_SQL + " SELECT * FROM gate")
def n5(spark: SparkSession, folder: str) -> DataFrame:
    return runlogs.gate_table(runlogs.trial_summary(_trials(spark, folder)), GATE)


@query(
    "n5_gate_verdict",
    "WITH " + TRIALS + ", " + SUMMARY + ", " + GATE_SQL
    + " SELECT bool_and(passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed_checks FROM gate",
)
def n5_verdict(spark: SparkSession, folder: str) -> DataFrame:
    return runlogs.gate_verdict(runlogs.gate_table(runlogs.trial_summary(_trials(spark, folder)), GATE))


# The candidate run repeats the trials of the baseline, loses some, adds one per third case.
CANDIDATE = """cand AS (SELECT case_id, trial, total_tokens + case_id % 4 AS total_tokens, error, expectation_met, terminal_state,
    expected_terminal_state, duration_ms - trial AS duration_ms FROM trials WHERE NOT (case_id % 8 = 2 AND trial = 1)
  UNION ALL SELECT case_id, 99, total_tokens, error, expectation_met, terminal_state, expected_terminal_state, duration_ms
    FROM trials WHERE case_id % 3 = 0 AND trial = 1)"""


def _candidate(trials: DataFrame) -> DataFrame:
    kept = trials.filter(~((F.col("case_id") % 8 == 2) & (F.col("trial") == 1))).withColumns(
        {
            "total_tokens": (F.col("total_tokens") + F.col("case_id") % 4).cast("int"),
            "duration_ms": (F.col("duration_ms") - F.col("trial")).cast("int"),
        }
    )
    added = trials.filter("case_id % 3 = 0 AND trial = 1").withColumn("trial", F.lit(99).cast("bigint"))
    return kept.unionByName(added)


@query(
    "n6_baseline_pairing",
    "WITH " + TRIALS + ", " + CANDIDATE
    + """ SELECT coalesce(b.case_id, c.case_id) AS case_id, coalesce(b.trial, c.trial) AS trial,
       CASE WHEN c.case_id IS NULL THEN 'baseline_only' WHEN b.case_id IS NULL THEN 'candidate_only' ELSE 'paired' END AS pairing,
       round((c.total_tokens - b.total_tokens)::DOUBLE, 6) AS total_tokens_delta, round((c.duration_ms - b.duration_ms)::DOUBLE, 6) AS duration_ms_delta
     FROM trials b FULL JOIN cand c ON b.case_id = c.case_id AND b.trial = c.trial""",
)
def n6(spark: SparkSession, folder: str) -> DataFrame:
    trials = _trials(spark, folder)
    return runlogs.pair_with_baseline(trials, _candidate(trials), ["total_tokens", "duration_ms"])


@query(
    "n6_baseline_comparison",
    "WITH " + TRIALS + ", " + CANDIDATE
    + f""", b AS (SELECT count(*) AS n, count(*) FILTER (WHERE {MET}) AS met, count(error) AS errors FROM trials),
      c AS (SELECT count(*) AS n, count(*) FILTER (WHERE {MET}) AS met, count(error) AS errors FROM cand)
     SELECT (SELECT count(*) = 0 FROM (SELECT case_id, trial FROM trials FULL JOIN cand USING (case_id, trial)
        WHERE trials.total_tokens IS NULL OR cand.total_tokens IS NULL)) AS trial_keys_match,
      round(round(c.met / c.n, 6) - round(b.met / b.n, 6), 6) AS expectation_rate_delta,
      round(round(c.errors / c.n, 6) - round(b.errors / b.n, 6), 6) AS error_rate_delta FROM b, c""",
)
def n6_comparison(spark: SparkSession, folder: str) -> DataFrame:
    trials = _trials(spark, folder)
    return runlogs.baseline_comparison(trials, _candidate(trials))


def _manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Two manifests per event: as recorded, and as seen by a later run."""
    event = F.col("event_id")

    def manifest(kind, value, model, python):
        return F.to_json(
            F.struct(
                F.lit("abc").alias("git_sha"),
                kind.alias("policy_hash"),
                F.struct(value.cast("string").alias("content_sha256")).alias("dataset"),
                F.struct(F.lit("local").alias("name"), model.alias("model")).alias("provider"),
                F.struct(python.alias("python")).alias("environment"),
            )
        )

    later_kind = F.when(event % 5 == 0, F.lit("changed")).otherwise(F.col("event_type"))
    later_model = F.when(event % 3 == 0, F.lit(None)).otherwise(F.lit("m1"))
    return table(spark, folder, "events").select(
        "event_id",
        manifest(F.col("event_type"), F.col("user_id"), F.lit("m1"), F.lit("3.13")).alias("baseline"),
        manifest(later_kind, F.col("user_id") + F.when(event % 7 == 0, 1).otherwise(0), later_model, F.lit("3.13")).alias("candidate"),
    )


@query(
    "n7_manifest_differences",
    """SELECT event_id AS key, 'policy_hash' AS field, event_type AS baseline_value, 'changed' AS candidate_value FROM events WHERE event_id % 5 = 0
     UNION ALL SELECT event_id, 'dataset.content_sha256', user_id::VARCHAR, (user_id + 1)::VARCHAR FROM events WHERE event_id % 7 = 0
     UNION ALL SELECT event_id, 'provider.model', 'm1', NULL FROM events WHERE event_id % 3 = 0""",
)
def n7(spark: SparkSession, folder: str) -> DataFrame:
    return runlogs.manifest_differences(_manifests(spark, folder), "event_id")


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        "user_id",
        "ts",
        F.when(kind == "error", "failed").when(kind == "view", "blocked").when(kind == "signup", "cancelled").otherwise("succeeded").alias("status"),
        F.when(F.col("event_id") % 10 == 0, F.lit(None)).otherwise(
            F.regexp_replace("props", '"k"', '"total_tokens"')
        ).alias("usage"),
    )


REQUESTS = """requests AS (SELECT user_id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'blocked' WHEN 'signup' THEN 'cancelled'
   ELSE 'succeeded' END AS status, CASE WHEN event_id % 10 = 0 THEN 0 ELSE coalesce((props->>'$.k')::BIGINT, 0) END AS tokens FROM events)"""


@query(
    "n8_usage_by_run",
    "WITH " + REQUESTS
    + """ SELECT user_id AS run, count(*) AS provider_request_count, CAST(sum(tokens) AS BIGINT) AS total_tokens,
       count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed,
       count(*) FILTER (WHERE status = 'blocked') AS blocked, count(*) FILTER (WHERE status = 'cancelled') AS cancelled,
       sum(tokens) + 100 > 9000 AS over_budget FROM requests GROUP BY 1""",
)
def n8(spark: SparkSession, folder: str) -> DataFrame:
    usage = runlogs.usage_by_run(_requests(spark, folder), "user_id", "usage", "status")
    return runlogs.over_budget(usage, 9000, 100)


@query(
    "n8_usage_by_month",
    "WITH " + REQUESTS + " SELECT strftime(ts, '%Y-%m') AS month, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM requests GROUP BY 1",
)
def n8_month(spark: SparkSession, folder: str) -> DataFrame:
    return runlogs.usage_by_month(_requests(spark, folder), "ts", "usage")


# Three waves in time order, and every fiftieth event with the last one.
WAVE = "CASE WHEN event_id % 50 = 0 THEN 2 ELSE event_id * 3 {div} (SELECT max(event_id) + 1 FROM events) END"


@query(
    "n8_usage_stream",
    f"""WITH waves AS (SELECT *, {WAVE.format(div='//')} AS wave FROM events),
    marks AS (SELECT wave, max(max(ts)) OVER (ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 HOUR AS mark FROM waves GROUP BY wave),
    told AS (SELECT *, coalesce(ts < mark, false) AS late FROM waves JOIN marks USING (wave))
    SELECT event_type, count(DISTINCT date_trunc('hour', ts)) FILTER (WHERE NOT late) AS windows, count(*) FILTER (WHERE NOT late) AS requests,
      round(sum(value) FILTER (WHERE NOT late), 4) AS amount, count(*) FILTER (WHERE late) AS late_requests,
      round(coalesce(sum(value) FILTER (WHERE late), 0), 4) AS late_amount FROM told GROUP BY 1""",
)
def n8_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly sums of a stream in three waves beside the rows that came too late for them."""
    events = table(spark, folder, "events")
    size = events.agg(F.max("event_id") + 1).first()[0]
    wave = F.when(F.col("event_id") % 50 == 0, 2).otherwise(F.floor(F.col("event_id") * 3 / F.lit(size)))
    source, target = scratch_path(spark, "waves"), scratch_path(spark, "usage")
    for k in range(3):
        events.filter(wave == k).coalesce(1).write.mode("append").parquet(source)
    query_ = usage_windows.windowed_usage(
        spark, source, events.schema, target, scratch_path(spark, "usage-cursor"), time="ts", keys=["event_type"],
        amount=F.col("value"), files_per_batch=1,
    )
    query_.awaitTermination()
    totals = usage_windows.window_totals(spark, target, ["event_type"]).groupBy("event_type").agg(
        F.count("*").alias("windows"), F.sum("requests").alias("requests"), F.round(F.sum("amount"), 4).alias("amount")
    )
    late = usage_windows.late_rows(spark, target, events.schema).groupBy("event_type").agg(
        F.count("*").alias("late_requests"), F.sum("value").alias("late_amount")
    )
    return totals.join(late, "event_type", "left").select(
        "event_type", "windows", "requests", "amount", F.coalesce("late_requests", F.lit(0)).alias("late_requests"),
        F.round(F.coalesce("late_amount", F.lit(0.0)), 4).alias("late_amount"),
    )


@query(
    "n9_span_duration",
    """SELECT o_orderkey, l_linenumber, greatest(0, floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1000))::BIGINT AS duration_ms
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
)
def n9(spark: SparkSession, folder: str) -> DataFrame:
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    spans = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return runlogs.finish_spans(spans, "o_orderdate", "l_shipdate").select("o_orderkey", "l_linenumber", "duration_ms")

"""Queries: sources, profiles, labels, cleaning, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lendwright.operators import cleaning, joins, labels, profile
from lendwright.plans.loan import loan, order_lines, table
from lendwright.plans.registry import LOAN, query, rounded
from lendwright.session import materialize, scratch_path
from lendwright.sources import files, versions

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

# --- A: sources and sinks -------------------------------------------------------------------


@query("a1_csv_round_trip", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def a1(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    files.write_csv(table(spark, folder, "customer"), path)
    return files.read_csv(spark, path, columns=["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])


@query(
    "a2_columnar_scan",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'",
)
def a2(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.filter(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "a3_table_estimate",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS rows, "
        f"(SELECT count(*) FROM (DESCRIBE {t}))::INTEGER AS columns FROM {t}"
        for t in TABLES
    ),
)
def a3(spark: SparkSession, folder: str) -> DataFrame:
    result = None
    for name in TABLES:
        row = files.table_estimate(table(spark, folder, name), name)
        result = row if result is None else result.unionByName(row)
    return result


@query(
    "a4_data_dictionary",
    """SELECT trim(p_name) AS field, p_type AS description, p_brand AS role,
       array_to_string(list_filter(list_transform(
         string_split_regex(p_size || '，' || p_brand || ' ; |-' || p_partkey || '；' , '[,，;；|]'),
         lambda x: trim(x)), lambda x: x <> ''), '/') AS codes
       FROM part WHERE trim(p_name) <> '' AND lower(trim(p_name)) <> 'nan'""",
)
def a4(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    raw = part.select(
        F.col("p_name").alias("字段名"),
        F.col("p_type").alias("Meaning"),
        F.concat("p_size", F.lit("，"), "p_brand", F.lit(" ; |-"), "p_partkey", F.lit("；")).alias("缺失码"),
        F.col("p_brand").alias("字段角色"),
    )
    parsed = files.parse_dictionary(raw)
    return parsed.select("field", "description", "role", F.array_join("missing_codes", "/").alias("codes"))


@query(
    "a5_versioned_write",
    """WITH width AS (SELECT count(*)::INTEGER AS columns FROM (DESCRIBE orders))
       SELECT 'orders' AS label, 'materialize' AS kind, 0 AS parents, (SELECT count(*) FROM orders) AS rows, columns, false AS frozen FROM width
       UNION ALL SELECT 'urgent orders', 'filter', 1, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT'), columns, true FROM width""",
)
def a5(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_path(spark, "versions")
    raw = versions.write_version(table(spark, folder, "orders"), root, "orders")
    urgent = versions.read_version(spark, root, raw, verify=False).filter("o_orderpriority = '1-URGENT'")
    versions.write_version(urgent, root, "urgent orders", kind="filter", parents=[raw], frozen=True)
    return versions.lineage(spark, root).select("label", "kind", F.size("parents").alias("parents"), "rows", "columns", "frozen")


@query(
    "a6_verified_read",
    "SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY o_orderstatus",
)
def a6(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_path(spark, "versions")
    version = versions.write_version(table(spark, folder, "orders"), root, "orders")
    return versions.read_version(spark, root, version).groupBy("o_orderstatus").agg(F.count("*").alias("orders"))


@query(
    "a6_changed_files",
    """SELECT 'untouched' AS moment, 0 AS files, 0 AS rows UNION ALL SELECT 'after an append', 1, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P')""",
)
def a6_changed(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a version that differ from its manifest, before and after somebody appends rows to its folder."""
    root = scratch_path(spark, "versions")
    orders = table(spark, folder, "orders")
    version = versions.write_version(orders, root, "orders")
    facts = [F.count("*").cast("int").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")]
    before = materialize(versions.changed_files(spark, root, version).agg(F.lit("untouched").alias("moment"), *facts))
    orders.filter("o_orderstatus = 'P'").coalesce(1).write.mode("append").parquet(versions.version_path(root, version))
    after = versions.changed_files(spark, root, version).agg(F.lit("after an append").alias("moment"), *facts)
    return before.unionByName(after)


@query(
    "a7_csv_export",
    "SELECT n_nationkey, n_name, n_regionkey FROM nation",
)
def a7(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "export")
    files.write_csv(table(spark, folder, "nation"), path)
    return files.read_csv(spark, path, schema="n_nationkey int, n_name string, n_regionkey int")


# --- B: profiles ----------------------------------------------------------------------------


def _type_sql(name: str, column: str, kind: str, place: int) -> str:
    few = f"least(100, greatest(20, floor(count({column}) * 0.05)))"
    text = (
        f"CASE WHEN count(DISTINCT {column}) <= {few} THEN 'categorical' ELSE 'text' END" if kind == "text" else f"'{kind}'"
    )
    return (
        f"SELECT '{name}' AS \"table\", {place} AS position, '{column}' AS name, "
        f"CASE WHEN count({column}) = 0 THEN 'empty' ELSE {text} END AS type FROM {name}"
    )


TYPED = {
    "orders": ("numeric", "numeric", "text", "numeric", "datetime", "text"),
    "customer": ("numeric", "text", "numeric", "numeric", "text"),
    "events": ("numeric", "datetime", "numeric", "text", "numeric", "text"),
    "part": ("numeric", "text", "text", "text", "numeric", "numeric"),
}
COLUMNS = {
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
}


@query(
    "b1_semantic_types",
    " UNION ALL ".join(
        _type_sql(t, c, k, i) for t in TYPED for i, (c, k) in enumerate(zip(COLUMNS[t], TYPED[t]))
    ),
)
def b1(spark: SparkSession, folder: str) -> DataFrame:
    result = None
    for name in TYPED:
        preview = profile.schema_preview(table(spark, folder, name)).withColumn("table", F.lit(name))
        result = preview if result is None else result.unionByName(preview)
    return result


# Name rules of the loan view, and the type of each column.
LOAN_COLUMNS = (
    ("order_id", "numeric"), ("customer_id", "numeric"), ("customer_year", "text"),
    ("application_date", "datetime"), ("amount", "numeric"), ("acctbal", "numeric"),
    ("priority", "text"), ("segment", "text"), ("n_lines", "numeric"), ("qty", "numeric"),
    ("net", "numeric"), ("avg_disc", "numeric"), ("max_tax", "numeric"), ("post_returns", "numeric"), ("y", "numeric"),
)


def _profile_sql(source: str, columns: tuple) -> str:
    rows = []
    for i, (c, kind) in enumerate(columns):
        few = f"least(100, greatest(20, floor(count({c}) * 0.05)))"
        kind_sql = f"CASE WHEN count(DISTINCT {c}) <= {few} THEN 'categorical' ELSE 'text' END" if kind == "text" else f"'{kind}'"
        label = f"lower(trim(CAST({c} AS VARCHAR)))"
        rows.append(
            f"SELECT {i} AS position, '{c}' AS name, {kind_sql} AS type, count(*) AS rows, "
            f"count(*) - count({c}) AS missing_count, round((count(*) - count({c})) / count(*), 8) AS missing_rate, "
            f"count(DISTINCT {c}) AS unique_count, "
            f"coalesce(bool_and({label} IN ('0','1','-1','0.0','1.0','-1.0','true','false')), true) "
            f"AND ((coalesce(bool_or({label} = '0'), false) AND coalesce(bool_or({label} = '1'), false)) OR "
            f"(coalesce(bool_or({label} = '0.0'), false) AND coalesce(bool_or({label} = '1.0'), false))) AS target_candidate "
            f"FROM {source}"
        )
    return " UNION ALL ".join(rows)


@query(
    "b2_column_profile",
    LOAN
    + f", facts AS ({_profile_sql('loan', LOAN_COLUMNS)}) "
    + r"""SELECT position, name, type, rows, missing_count, missing_rate, unique_count,
       regexp_matches(name, '(?i)(^|_)(name|mobile|phone|id_?card|identity|email|address|bank_?card)($|_)') AS pii,
       regexp_matches(name, '(?i)(^id$|_id$|id_|uuid)') AS id_candidate,
       type = 'datetime' OR regexp_matches(name, '(?i)(^|_)(date|time|month|day|datetime|timestamp)($|_)') AS time_candidate,
       regexp_matches(name, '(?i)(post_|after_|repay|collection|write[_-]?off|charge[_-]?off)') AS leakage,
       regexp_matches(name, '(?i)^(prior_|historical_|pre_application_).*(delinquen|overdue|past_due)') AS historical_risk,
       target_candidate FROM facts""",
)
def b2(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.column_profile(loan(spark, folder)))


@query("b2_approximate_profile")
def b2_approximate(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.column_profile(loan(spark, folder), approximate=True))


STATE_TABLE = "lineitem"


def _state_sql(name: str) -> str:
    each = " UNION ALL ".join(
        f"""SELECT '{c}' AS name, count(*) AS rows, count(*) - count({c}) AS missing_count,
            {f'min({c})::DOUBLE' if kind == 'number' else 'NULL::DOUBLE'} AS least, {f'max({c})::DOUBLE' if kind == 'number' else 'NULL::DOUBLE'} AS most,
            CASE WHEN count(DISTINCT {c}) < 100 THEN count(DISTINCT {c}) END AS few_values FROM {name}"""
        for c, kind in STATE_COLUMNS
    )
    return each


STATE_COLUMNS = (
    ("l_orderkey", "number"), ("l_quantity", "number"), ("l_extendedprice", "number"), ("l_discount", "number"),
    ("l_returnflag", "text"), ("l_linestatus", "text"),
)


@query("b2_merged_profile_state", _state_sql(STATE_TABLE))
def b2_state(spark: SparkSession, folder: str) -> DataFrame:
    """States of four parts of a table, written one by one and merged: the facts of the whole without reading it again."""
    rows = table(spark, folder, STATE_TABLE).select(*[c for c, _ in STATE_COLUMNS])
    part = F.pmod(F.xxhash64("l_orderkey"), F.lit(4))
    paths = []
    for k in range(4):
        paths.append(scratch_path(spark, "profile-state"))
        profile.profile_state(rows.filter(part == k)).write.parquet(paths[-1])
    facts = profile.state_facts(profile.merged_state(spark.read.parquet(*paths)))
    return facts.select(
        "name", "rows", "missing_count", "least", "most", F.when(F.col("unique_count") < 100, F.col("unique_count")).alias("few_values")
    )


@query(
    "b2_described_profile",
    f"""WITH facts AS ({_profile_sql('customer', tuple(zip(COLUMNS['customer'], TYPED['customer'])))})
       SELECT name, unique_count, CASE name WHEN 'c_acctbal' THEN 'account balance' ELSE '' END AS description,
         CASE name WHEN 'c_custkey' THEN 'key' ELSE '' END AS role,
         CASE name WHEN 'c_acctbal' THEN '-999;-1' ELSE '' END AS codes FROM facts""",
)
def b2_described(spark: SparkSession, folder: str) -> DataFrame:
    """The profile of a table beside what two data dictionaries say about its columns."""
    first = spark.createDataFrame([("c_acctbal", "account balance", "-999;-1")], "field string, meaning string, missing string")
    second = spark.createDataFrame([("c_custkey", "key"), ("c_acctbal", "ignored")], "field string, role string")
    dictionary = joins.merged_dictionary([files.parse_dictionary(first), files.parse_dictionary(second)])
    found = profile.described_profile(profile.column_profile(table(spark, folder, "customer")), dictionary)
    return found.select("name", "unique_count", "description", "role", F.array_join("missing_codes", ";").alias("codes"))


@query(
    "b2_default_keys",
    LOAN
    + f", facts AS ({_profile_sql('loan', LOAN_COLUMNS)}), "
    + r"""ranked AS (SELECT position, name, unique_count < rows AS repeats,
         CASE WHEN regexp_matches(name, 'customer|cust|user|person|borrower|client') THEN 2 ELSE 0 END
         - CASE WHEN regexp_matches(name, 'order|loan|application|contract') THEN 2 ELSE 0 END AS score
       FROM facts WHERE regexp_matches(name, '(?i)(^id$|_id$|id_|uuid)'))
       SELECT (SELECT name FROM facts WHERE type = 'datetime' OR regexp_matches(name, '(^|_)(date|time|month|day)($|_)')
               ORDER BY position LIMIT 1) AS time_column,
              (SELECT name FROM ranked ORDER BY score DESC, repeats DESC, position LIMIT 1) AS customer_key""",
)
def b2_keys(spark: SparkSession, folder: str) -> DataFrame:
    facts = profile.column_profile(loan(spark, folder))
    time_column = profile.default_time_column(facts).withColumn("k", F.lit(0))
    customer = profile.default_customer_key(facts).withColumn("k", F.lit(0))
    return time_column.join(customer, "k").drop("k")


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@query(
    "b3_numeric_summary",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, min({c})::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.25::DOUBLE), 6) AS p25, "
        f"round(quantile_cont({c}::DOUBLE, 0.5::DOUBLE), 6) AS median, round(quantile_cont({c}::DOUBLE, 0.75::DOUBLE), 6) AS p75, "
        f"max({c})::DOUBLE AS max, round(avg({c}), 6) AS mean FROM lineitem"
        for c in NUMBERS
    ),
)
def b3(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.numeric_summary(table(spark, folder, "lineitem"), NUMBERS), 6)


def _top_sql(source: str, columns: tuple) -> str:
    counted = " UNION ALL ".join(
        f"SELECT '{c}' AS name, coalesce(CAST({c} AS VARCHAR), '<MISSING>') AS value, count(*) AS count FROM {source} GROUP BY 1, 2"
        for c in columns
    )
    return f"""SELECT name, rank::INTEGER AS rank, value, count FROM (
      SELECT *, row_number() OVER (PARTITION BY name ORDER BY count DESC, length(value) <= 64,
        CASE WHEN length(value) > 64 THEN sha256(value) ELSE value END) AS rank FROM ({counted})) WHERE rank <= 10"""


@query("b4_top_values", _top_sql("documents", ("text", "lang", "source")))
def b4(spark: SparkSession, folder: str) -> DataFrame:
    return profile.top_values(table(spark, folder, "documents"))


@query(
    "b5_duplicate_rows",
    """SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (
       SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount, l_shipdate)""",
)
def b5(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return profile.duplicate_rows(lines.select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_shipdate"))


def _labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    marks = table(spark, folder, "labels")
    return table(spark, folder, "documents").join(marks, "doc_id", "left")


@query(
    "b6_target_candidates",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count,
        (SELECT count(*) FROM documents LEFT JOIN labels USING (doc_id) WHERE {c} IS NULL) AS missing_count
        FROM documents LEFT JOIN labels USING (doc_id) WHERE {c} IS NOT NULL GROUP BY 2"""
        for c in ("quality", "toxic")
    ),
)
def b6(spark: SparkSession, folder: str) -> DataFrame:
    return profile.target_candidates(_labelled_documents(spark, folder).select("lang", "source", "n_chars", "quality", "toxic"))


@query(
    "b7_diagnosis",
    """WITH d AS (SELECT lang, source, quality, toxic, CASE WHEN doc_id % 25 = 0 THEN n_chars END AS rare_measure,
         CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE '2024-01-0' || (1 + doc_id % 5) END AS seen_date
         FROM documents LEFT JOIN labels USING (doc_id)),
       t AS (SELECT count(*) FILTER (WHERE toxic = 1) AS pos, count(*) FILTER (WHERE toxic = 0) AS neg FROM d)
       SELECT 'TARGET_SINGLE_CLASS' AS code, 'blocking' AS severity, 'toxic' AS "column", (pos + neg)::DOUBLE AS value
         FROM t WHERE pos = 0 OR neg = 0
       UNION ALL SELECT 'TARGET_TOO_SMALL', 'warning', 'toxic', (pos + neg)::DOUBLE FROM t WHERE pos + neg < 100
       UNION ALL SELECT 'DUPLICATE_ROWS', 'warning', NULL, sum(n - 1)::DOUBLE FROM (
         SELECT count(*) AS n FROM d GROUP BY lang, source, quality, toxic, rare_measure, seen_date) HAVING sum(n - 1) > 0
       UNION ALL SELECT 'TIME_PARSE_LOW', 'blocking', 'seen_date', round(avg((seen_date <> 'unknown')::INT), 8) FROM d
         HAVING avg((seen_date <> 'unknown')::INT) < 0.8
       UNION ALL SELECT 'ALMOST_EMPTY_COLUMN', 'warning', 'rare_measure', round(avg((rare_measure IS NULL)::INT), 8) FROM d
         HAVING avg((rare_measure IS NULL)::INT) >= 0.95""",
)
def b7(spark: SparkSession, folder: str) -> DataFrame:
    frame = _labelled_documents(spark, folder).select(
        "lang",
        "source",
        "quality",
        "toxic",
        F.when(F.col("doc_id") % 25 == 0, F.col("n_chars")).alias("rare_measure"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("unknown"))
        .otherwise(F.concat(F.lit("2024-01-0"), (1 + F.col("doc_id") % 5).cast("string")))
        .alias("seen_date"),
    )
    return rounded(profile.diagnose(frame, "toxic", "seen_date"))


# --- C: labels ------------------------------------------------------------------------------


@query(
    "c1_normalize_label",
    """SELECT spelled, label, count(*) AS rows FROM (
       SELECT spelled, CASE WHEN lower(trim(spelled)) IN ('1','1.0','true','bad','yes') THEN 1
                            WHEN lower(trim(spelled)) IN ('0','0.0','false','good','no') THEN 0 END AS label
       FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN ' Bad ' WHEN o_orderkey % 7 = 1 THEN 'GOOD'
                         WHEN o_orderkey % 7 = 2 THEN '1.0' WHEN o_orderkey % 7 = 3 THEN '0'
                         WHEN o_orderkey % 7 = 4 THEN 'Yes' WHEN o_orderkey % 7 = 5 THEN '-1' END AS spelled FROM orders))
       GROUP BY spelled, label""",
)
def c1(spark: SparkSession, folder: str) -> DataFrame:
    spelled = F.lit(None).cast("string")
    for rest, text in enumerate((" Bad ", "GOOD", "1.0", "0", "Yes", "-1")):
        spelled = F.when(F.col("o_orderkey") % 7 == rest, F.lit(text)).otherwise(spelled)
    frame = table(spark, folder, "orders").select(spelled.alias("spelled"))
    return labels.normalize_label(frame, "spelled", "label").groupBy("spelled", "label").agg(F.count("*").alias("rows"))


def _summary_sql(source: str, target: str) -> str:
    return (
        f"SELECT '{target}' AS target, count(*) FILTER (WHERE {target} IN (0, 1)) AS valid_count, "
        f"count(*) FILTER (WHERE {target} = 1) AS positive_count, count(*) FILTER (WHERE {target} = 0) AS negative_count, "
        f"round(count(*) FILTER (WHERE {target} = 1) / count(*) FILTER (WHERE {target} IN (0, 1)), 8) AS bad_rate, "
        f"count(*) FILTER (WHERE {target} NOT IN (0, 1)) AS invalid_count, "
        f"count(*) FILTER (WHERE {target} IS NULL) AS missing_count, "
        f"count(*) FILTER (WHERE {target} = 1) = 0 OR count(*) FILTER (WHERE {target} = 0) = 0 AS single_class, "
        f"count(*) FILTER (WHERE {target} IN (0, 1)) < 100 AS too_small FROM {source}"
    )


@query("c2_target_summary", LOAN + " " + _summary_sql("loan", "y"))
def c2(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(labels.target_summary(loan(spark, folder), "y"))


@query("c3_freeze_target", LOAN + " SELECT order_id, y FROM frozen")
def c3(spark: SparkSession, folder: str) -> DataFrame:
    return labels.freeze_target(loan(spark, folder), "y").select("order_id", "y")


@query(
    "c4_many_targets",
    "WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) "
    + _summary_sql("d", "quality")
    + " UNION ALL "
    + _summary_sql("d", "toxic"),
)
def c4(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(labels.target_summary(_labelled_documents(spark, folder), ["quality", "toxic"]))


# --- D: cleaning ----------------------------------------------------------------------------


def _raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with everything a cleaning step can find: copies, an empty column, missing codes."""
    return table(spark, folder, "orders").select(
        "o_orderpriority",
        F.when(F.col("o_orderkey") % 10 == 0, F.lit(-1.0)).otherwise(F.floor(F.col("o_totalprice") / 50000.0).cast("double")).alias("band"),
        F.when(F.col("o_orderkey") % 9 == 0, F.lit("N/A")).otherwise(F.col("o_orderstatus")).alias("status"),
        F.lit(None).cast("string").alias("unused"),
    )


RAW_ORDERS = """WITH raw AS (SELECT o_orderpriority,
  CASE WHEN o_orderkey % 10 = 0 THEN -1.0::DOUBLE ELSE floor(o_totalprice / 50000.0)::DOUBLE END AS band,
  CASE WHEN o_orderkey % 9 = 0 THEN 'N/A' ELSE o_orderstatus END AS status, NULL::VARCHAR AS unused FROM orders)"""


@query(
    "d1_cleaning_plan",
    RAW_ORDERS
    + """ SELECT 'drop_exact_duplicates' AS id, 'drop_duplicates' AS kind, NULL AS "column", NULL AS codes
       FROM (SELECT count(*) AS n FROM raw GROUP BY ALL) HAVING sum(n - 1) > 0
     UNION ALL SELECT 'drop_empty:unused', 'drop_columns', 'unused', NULL FROM raw HAVING count(unused) = 0
     UNION ALL SELECT 'replace_missing:band', 'replace_missing_codes', 'band', '-1' FROM raw HAVING count(*) > 0
     UNION ALL SELECT 'replace_missing:status', 'replace_missing_codes', 'status', 'N/A/?' FROM raw HAVING count(*) > 0""",
)
def d1(spark: SparkSession, folder: str) -> DataFrame:
    dictionary = files.parse_dictionary(
        spark.createDataFrame([("band", "-1"), ("status", "N/A; ?"), ("unused", None)], "field string, missing string")
    )
    plan = cleaning.cleaning_plan(_raw_orders(spark, folder), dictionary)
    return plan.select("id", "kind", "column", F.array_join("codes", "/").alias("codes"))


@query("d2_drop_duplicates", RAW_ORDERS + " SELECT DISTINCT o_orderpriority, band, status FROM raw")
def d2(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.drop_duplicates(_raw_orders(spark, folder)).select("o_orderpriority", "band", "status")


@query("d3_drop_columns", RAW_ORDERS + " SELECT o_orderpriority, status, count(*) AS rows FROM raw GROUP BY ALL")
def d3(spark: SparkSession, folder: str) -> DataFrame:
    left = cleaning.drop_columns(_raw_orders(spark, folder), ["unused", "band", "not_there"])
    return left.groupBy(*left.columns).agg(F.count("*").alias("rows"))


@query(
    "d4_replace_missing_codes",
    RAW_ORDERS
    + """ SELECT CASE WHEN band <> -1 THEN band END AS band, CASE WHEN status <> 'N/A' THEN status END AS status,
       count(*) AS rows FROM raw GROUP BY ALL""",
)
def d4(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = cleaning.replace_missing_codes(_raw_orders(spark, folder), {"band": ["-1"], "status": ["N/A"]})
    return cleaned.groupBy("band", "status").agg(F.count("*").alias("rows"))


@query(
    "d4_replaced_cells",
    RAW_ORDERS
    + """ SELECT 'band' AS "column", count(*) AS replaced_cells FROM raw WHERE band = -1
       UNION ALL SELECT 'status', count(*) FROM raw WHERE status = 'N/A'""",
)
def d4_cells(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.replaced_cells(_raw_orders(spark, folder), {"band": ["-1"], "status": ["N/A"]})


@query(
    "d5_clip_numeric",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal > 5000 THEN 5000 ELSE c_acctbal END AS c_acctbal FROM customer",
)
def d5(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clip_numeric(table(spark, folder, "customer"), "c_acctbal", 0, 5000).select("c_custkey", "c_acctbal")


# --- E: joins -------------------------------------------------------------------------------


def _keyed_orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("priority"),
    )


def _keyed_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("customer_id"), F.col("l_extendedprice").alias("amount")
    )


def _keyed_customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("segment")
    )


def _advice_sql(right: str, columns: tuple) -> str:
    parts = []
    for place, (name, l, rr) in enumerate(columns):
        bonus = 0.35 if name.endswith("_id") else 0.0
        parts.append(
            f"""SELECT '{name}' AS key, {place} AS place,
            (SELECT count(*) FROM (SELECT DISTINCT {l}::VARCHAR FROM orders INTERSECT SELECT DISTINCT {rr}::VARCHAR FROM {right}))
              / greatest(1, least((SELECT count(DISTINCT {l}) FROM orders), (SELECT count(DISTINCT {rr}) FROM {right}))) AS overlap,
            {bonus}::DOUBLE AS bonus, (SELECT count(DISTINCT {rr}) / count({rr}) FROM {right}) AS uniq"""
        )
    return f"""SELECT key, round(least(1.0::DOUBLE, overlap + bonus), 4) AS score, round(overlap, 4) AS overlap_rate,
      round(uniq, 4) AS right_unique_rate, CASE WHEN uniq >= 0.98 THEN 'many_to_one' ELSE 'many_to_many' END AS expected_cardinality
      FROM ({' UNION ALL '.join(parts)})
      ORDER BY (uniq >= 0.98) DESC, round(least(1.0::DOUBLE, overlap + bonus), 4) DESC, place LIMIT 3"""


@query("e1_recommend_keys", _advice_sql("customer", (("customer_id", "o_custkey", "c_custkey"), ("amount", "o_totalprice", "c_acctbal"))))
def e1(spark: SparkSession, folder: str) -> DataFrame:
    return joins.recommend_keys(_keyed_orders(spark, folder), _keyed_customers(spark, folder))


@query(
    "e1_recommend_keys_many_to_many",
    _advice_sql(
        "lineitem",
        (("order_id", "o_orderkey", "l_orderkey"), ("customer_id", "o_custkey", "l_suppkey"), ("amount", "o_totalprice", "l_extendedprice")),
    ),
)
def e1_many(spark: SparkSession, folder: str) -> DataFrame:
    return joins.recommend_keys(_keyed_orders(spark, folder), _keyed_lines(spark, folder))


# At this scale every column fits into its sketch, so the counts are exact.
@query("e1_recommend_keys_sketched", _advice_sql("customer", (("customer_id", "o_custkey", "c_custkey"), ("amount", "o_totalprice", "c_acctbal"))))
def e1_sketched(spark: SparkSession, folder: str) -> DataFrame:
    """The same advice from one sketch per column, without shuffling values."""
    return joins.recommend_keys_sketched(_keyed_orders(spark, folder), _keyed_customers(spark, folder))


KEY_PAIRS = (("o_orderkey", "o_custkey", "o_orderstatus"), ("l_orderkey", "l_suppkey", "l_linestatus", "l_returnflag"))


def _pairs_sql() -> str:
    each = " UNION ALL ".join(
        f"""SELECT '{a}' AS left_key, '{b}' AS right_key, (SELECT count(*) FROM (SELECT {a} FROM orders INTERSECT SELECT {b} FROM lineitem)) AS overlap,
            (SELECT count(DISTINCT {a}) FROM orders) AS ld, (SELECT count(DISTINCT {b}) FROM lineitem) AS rd, (SELECT count({b}) FROM lineitem) AS rn"""
        for a in KEY_PAIRS[0]
        for b in KEY_PAIRS[1]
        if (a == "o_orderstatus") == (b in ("l_linestatus", "l_returnflag"))
    )
    return f"""SELECT left_key, right_key, round(overlap / greatest(1, least(ld, rd)), 4) AS overlap_rate, round(rd / greatest(1, rn), 4) AS right_unique_rate
      FROM ({each}) WHERE round(overlap / greatest(1, least(ld, rd)), 4) >= 0.5"""


@query("e1_key_pairs", _pairs_sql())
def e1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of two tables that share their values, whatever they are called."""
    left = table(spark, folder, "orders").select(*KEY_PAIRS[0])
    return joins.recommend_key_pairs(left, table(spark, folder, "lineitem").select(*KEY_PAIRS[1]))


def _check_sql(name: str, left: str, right: str, l: str, rr: str, grain: str) -> str:
    return f"""SELECT '{name}' AS name, (SELECT count(*) FROM {left}) AS left_rows, (SELECT count(*) FROM {right}) AS right_rows,
      (SELECT count(*) FROM {left}) - (SELECT count(*) FROM (SELECT DISTINCT {l} FROM {left})) AS left_key_duplicates,
      (SELECT count(*) FROM {right}) - (SELECT count(*) FROM (SELECT DISTINCT {rr} FROM {right})) AS right_key_duplicates,
      round((SELECT count(*) FROM {left} WHERE EXISTS (SELECT 1 FROM {right} WHERE {rr} IS NOT DISTINCT FROM {l}))
        / (SELECT count(*) FROM {left}), 8) AS match_rate, '{grain}' AS grain"""


CHECKS = (
    ("orders-customer", "orders", "customer", "o_custkey", "c_custkey", "order_or_event"),
    ("orders-lineitem", "orders", "lineitem", "o_orderkey", "l_orderkey", "unknown"),
    ("customer-orders", "customer", "orders", "c_custkey", "o_custkey", "customer"),
    ("orders-supplier", "orders", "supplier", "o_custkey", "s_suppkey", "unknown"),
)


@query(
    "e2_validate_join",
    "SELECT *, CASE WHEN right_key_duplicates > 0 THEN 'RIGHT_KEY_DUPLICATES' END AS blocking_issue, "
    "CASE WHEN match_rate < 0.5 THEN 'LOW_MATCH_RATE' END AS warning_issue FROM ("
    + " UNION ALL ".join(_check_sql(*c) for c in CHECKS)
    + ")",
)
def e2(spark: SparkSession, folder: str) -> DataFrame:
    result = None
    for name, left, right, l, rr, grain in CHECKS:
        key = l if grain != "unknown" else None
        row = joins.validate_join(table(spark, folder, left), table(spark, folder, right), [l], [rr], key)
        row = row.withColumn("name", F.lit(name))
        result = row if result is None else result.unionByName(row)
    return rounded(result)


@query(
    "e2_join_evidence",
    """WITH joined AS (SELECT o_orderstatus AS value FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey),
       b AS (SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1), a AS (SELECT value, count(*) AS n FROM joined GROUP BY 1)
       SELECT 'o_orderstatus' AS target, b.value, b.n AS rows_before, a.n AS rows_after,
         round((SELECT count(*) FROM joined) / (SELECT count(*) FROM orders), 8) AS inflation_ratio FROM b JOIN a USING (value)""",
)
def e2_evidence(spark: SparkSession, folder: str) -> DataFrame:
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rounded(joins.join_evidence(orders, joined, ["o_orderstatus"]))


@query(
    "e3_guarded_join",
    """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS amount, o_orderpriority AS priority,
       c_acctbal AS amount_right, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def e3(spark: SparkSession, folder: str) -> DataFrame:
    step = joins.JoinStep("customer", ["customer_id"], ["customer_id"])
    return joins.guarded_join(_keyed_orders(spark, folder), _keyed_customers(spark, folder), step)


@query(
    "e3_guarded_join_types",
    """SELECT 'inner' AS how, count(*) AS rows, count(segment) AS matched FROM (
         SELECT c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey)
       UNION ALL SELECT 'right', count(*), count(o_orderkey) FROM nation RIGHT JOIN (
         SELECT n_nationkey AS k, n_nationkey AS o_orderkey FROM nation WHERE n_regionkey < 9) ON n_nationkey = k
       UNION ALL SELECT 'outer', count(*), count(r_name) FROM lineitem FULL JOIN region ON l_linenumber = r_regionkey""",
)
def e3_types(spark: SparkSession, folder: str) -> DataFrame:
    orders, customers = _keyed_orders(spark, folder), _keyed_customers(spark, folder)
    nation = table(spark, folder, "nation")
    some = nation.filter("n_regionkey < 9").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").alias("o_orderkey"))
    inner = joins.guarded_join(orders, customers, joins.JoinStep("customer", ["customer_id"], ["customer_id"], "inner"))
    right = joins.guarded_join(nation, some, joins.JoinStep("some", ["n_nationkey"], ["k"], "right"))
    outer = joins.guarded_join(
        table(spark, folder, "lineitem"), table(spark, folder, "region"),
        joins.JoinStep("region", ["l_linenumber"], ["r_regionkey"], "outer"),
    )
    rows = [("inner", inner, "segment"), ("right", right, "o_orderkey"), ("outer", outer, "r_name")]
    result = None
    for how, joined, seen in rows:
        row = joined.agg(F.lit(how).alias("how"), F.count("*").alias("rows"), F.count(seen).alias("matched"))
        result = row if result is None else result.unionByName(row)
    return result


def _plan(spark: SparkSession, folder: str) -> tuple:
    tables = {
        "customer": table(spark, folder, "customer"),
        "nation": table(spark, folder, "nation"),
        "region": table(spark, folder, "region"),
        "lines": order_lines(table(spark, folder, "lineitem")),
    }
    steps = [
        joins.JoinStep("customer", ["o_custkey"], ["c_custkey"]),
        joins.JoinStep("nation", ["c_nationkey"], ["n_nationkey"]),
        joins.JoinStep("region", ["n_regionkey"], ["r_regionkey"]),
        joins.JoinStep("lines", ["o_orderkey"], ["l_orderkey"]),
    ]
    return table(spark, folder, "orders"), tables, steps


PLAN_SQL = LOAN + """, joined AS (SELECT * FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN lines ON o_orderkey = l_orderkey)"""


@query(
    "e4_join_plan",
    PLAN_SQL
    + """ SELECT r_name, c_mktsegment, count(*) AS orders, CAST(sum(n_lines) AS BIGINT) AS lines,
         round(sum(net), 2) AS net FROM joined GROUP BY 1, 2""",
)
def e4(spark: SparkSession, folder: str) -> DataFrame:
    base, tables, steps = _plan(spark, folder)
    joined = joins.run_join_plan(base, tables, steps, targets=[])
    return joined.groupBy("r_name", "c_mktsegment").agg(
        F.count("*").alias("orders"), F.sum("n_lines").alias("lines"), F.round(F.sum("net"), 2).alias("net")
    )


@query(
    "e4_join_plan_lineage",
    PLAN_SQL
    + """ SELECT 1 AS step, 'customer' AS right_table, count(*) AS left_rows, (SELECT count(*) FROM customer) AS right_rows,
          round(count(c_custkey) / count(*), 8) AS match_rate FROM joined
        UNION ALL SELECT 2, 'nation', count(*), (SELECT count(*) FROM nation), round(count(n_nationkey) / count(*), 8) FROM joined
        UNION ALL SELECT 3, 'region', count(*), (SELECT count(*) FROM region), round(count(r_regionkey) / count(*), 8) FROM joined
        UNION ALL SELECT 4, 'lines', count(*), (SELECT count(*) FROM lines), round(count(l_orderkey) / count(*), 8) FROM joined""",
)
def e4_lineage(spark: SparkSession, folder: str) -> DataFrame:
    base, tables, steps = _plan(spark, folder)
    evidence = joins.join_plan_lineage(base, tables, steps)
    return rounded(evidence.select("step", "right_table", "left_rows", "right_rows", "match_rate"))


@query(
    "e5_semi_select",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def e5(spark: SparkSession, folder: str) -> DataFrame:
    chosen = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.semi_select(table(spark, folder, "orders"), chosen, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query(
    "e5_anti_select",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def e5_anti(spark: SparkSession, folder: str) -> DataFrame:
    present = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.anti_select(table(spark, folder, "orders"), present, ["o_orderkey"]).select("o_orderkey", "o_custkey")

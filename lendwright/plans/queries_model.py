"""Queries: splits, screening, binning, metrics, scoring, report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lendwright.functions.expressions import ScoreScale
from lendwright.operators import binning as bins
from lendwright.operators import metrics, order_statistics, privacy, profile, report, scoring, screening, splits
from lendwright.operators.labels import freeze_target
from lendwright.plans.loan import CATEGORICAL_FEATURES, FEATURES, NUMERIC_FEATURES, loan, table
from lendwright.plans.registry import LOAN, SCORED, deciles, query, rounded
from lendwright.session import materialize

EDGE_DIGITS = 6


def frozen(spark: SparkSession, folder: str) -> DataFrame:
    return freeze_target(loan(spark, folder), "y")


def stored(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The frozen loan view written once, for operators that pass over it several times."""
    chosen = frozen(spark, folder)
    return materialize(chosen.select(*columns) if columns else chosen, "loan")


# --- F: splits ------------------------------------------------------------------------------


def _hash_split(source: str, stratum: str, identity: str, size: float = 0.2, seed: int = 42) -> str:
    return (
        f"SELECT *, CASE WHEN row_number() OVER (PARTITION BY {stratum} ORDER BY md5({identity}::VARCHAR || '|{seed}'), "
        f"{identity}::VARCHAR) <= ceil(count(*) OVER (PARTITION BY {stratum}) * {size}::DOUBLE) THEN 'test' ELSE 'train' END AS side FROM {source}"
    )


CUTOFF = """cut AS (SELECT application_date AS cutoff FROM (
    SELECT application_date, row_number() OVER (ORDER BY application_date) - 1 AS i, count(*) OVER () AS n FROM frozen)
  WHERE i = n - greatest(1, ceil(n * 0.2::DOUBLE)))"""

ISOLATED = (
    LOAN
    + ", "
    + CUTOFF
    + """, sides AS (SELECT {key} AS g, bool_or(application_date < cutoff) AS early, bool_or(application_date >= cutoff) AS late
     FROM frozen, cut GROUP BY 1),
  held AS (SELECT frozen.*, CASE WHEN early AND late THEN 'excluded' WHEN late THEN 'oot' ELSE 'development' END AS partition
     FROM frozen JOIN sides ON {key} = g)"""
)


@query("f1_random_stratified", LOAN + " SELECT order_id, y, side AS partition FROM (" + _hash_split("frozen", "y", "order_id") + ")")
def f1(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(spark, folder, "order_id", "y")
    return splits.stratified_split(rows, "y", "order_id").select("order_id", "y", "partition")


@query(
    "f2_group_stratified",
    LOAN
    + ", g AS (SELECT customer_id::VARCHAR AS who, max(y) AS c FROM frozen GROUP BY 1), s AS ("
    + _hash_split("g", "c", "who")
    + ") SELECT order_id, customer_id, side AS partition FROM frozen JOIN s ON who = customer_id::VARCHAR",
)
def f2(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(spark, folder, "order_id", "customer_id", "y")
    return splits.group_stratified_split(rows, "y", "customer_id").select("order_id", "customer_id", "partition")


@query(
    "f3_time_holdout",
    LOAN + ", " + CUTOFF
    + " SELECT order_id, CASE WHEN application_date >= cutoff THEN 'oot' ELSE 'development' END AS partition FROM frozen, cut",
)
def f3(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(spark, folder, "order_id", "application_date")
    return splits.time_holdout(rows, splits.SplitPlan(time_column="application_date")).select("order_id", "partition")


@query(
    "f4_customer_isolated_holdout",
    ISOLATED.format(key="customer_year")
    + " SELECT order_id, partition, CASE WHEN partition = 'excluded' THEN 'cross_boundary_customer' END AS exclusion_reason FROM held",
)
def f4(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(spark, folder, "order_id", "customer_year", "application_date")
    plan = splits.SplitPlan(time_column="application_date", customer_key="customer_year")
    return splits.time_holdout(rows, plan).select("order_id", "partition", "exclusion_reason")


@query(
    "f4_isolation_by_customer",
    ISOLATED.format(key="customer_id") + " SELECT partition, count(*) AS rows FROM held GROUP BY 1",
)
def f4_customer(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(spark, folder, "order_id", "customer_id", "application_date")
    plan = splits.SplitPlan(time_column="application_date", customer_key="customer_id")
    return splits.time_holdout(rows, plan).groupBy("partition").agg(F.count("*").alias("rows"))


SPLIT_SQL = (
    ISOLATED.format(key="customer_year")
    + ", g AS (SELECT customer_year AS who, max(y) AS c FROM held WHERE partition = 'development' GROUP BY 1), s AS ("
    + _hash_split("g", "c", "who")
    + "), split AS (SELECT held.* EXCLUDE (partition), CASE WHEN partition = 'development' THEN side ELSE partition END AS partition"
    " FROM held LEFT JOIN s ON who = customer_year AND partition = 'development')"
)


def split_loan(spark: SparkSession, folder: str) -> DataFrame:
    plan = splits.SplitPlan(time_column="application_date", customer_key="customer_year")
    return splits.split_dataset(stored(spark, folder), "y", "order_id", plan)


@query("f4_whole_split", SPLIT_SQL + " SELECT order_id, partition FROM split")
def f4_split(spark: SparkSession, folder: str) -> DataFrame:
    return split_loan(spark, folder).select("order_id", "partition")


@query(
    "f5_split_violations",
    LOAN
    + ", split AS (" + _hash_split("frozen", "y", "order_id") + """)
     SELECT 'SPLIT_CUSTOMER_OVERLAP' AS code, count(*) AS violations FROM (
       SELECT customer_id FROM split GROUP BY 1 HAVING count(DISTINCT side) > 1) HAVING count(*) > 0""",
)
def f5(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(spark, folder, "order_id", "customer_id", "y", "application_date")
    by_row = splits.stratified_split(rows, "y", "order_id")
    return splits.split_violations(by_row, "order_id", "customer_id", "application_date")


@query(
    "f6_partition_summary",
    SPLIT_SQL
    + """ SELECT partition, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positive_count,
          CAST(count(*) - sum(y) AS BIGINT) AS negative_count, round(avg(y), 8) AS bad_rate FROM split GROUP BY 1""",
)
def f6(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(splits.partition_summary(split_loan(spark, folder), "y"))


@query(
    "f7_exclusion_fingerprint",
    ISOLATED.format(key="customer_year")
    + """ SELECT count(*) AS excluded_rows, coalesce(sum(('0x' || substr(md5(order_id::VARCHAR), 1, 15))::BIGINT::HUGEINT), 0)::HUGEINT::VARCHAR AS fingerprint
       FROM held WHERE partition = 'excluded'""",
)
def f7(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(spark, folder, "order_id", "customer_year", "application_date")
    plan = splits.SplitPlan(time_column="application_date", customer_key="customer_year")
    return splits.exclusion_fingerprint(splits.time_holdout(rows, plan), "order_id")


# --- G: screening ---------------------------------------------------------------------------


def edges_sql(source: str, features: tuple, parts: int = 10) -> str:
    """(feature, edge) rows: distinct inner quantiles of features with more than ten values."""
    each = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, unnest(list_sort(list_distinct(list_transform("
        f"quantile_cont({f}::DOUBLE, {deciles(parts)}), lambda x: round(x, {EDGE_DIGITS})))))"
        f" AS edge FROM {source} HAVING count(DISTINCT {f}) > {parts}"
        for f in features
    )
    return f"""SELECT feature, edge FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY edge) AS i,
      count(*) OVER (PARTITION BY feature) AS n FROM ({each})) WHERE i > 1 AND i < n"""


def iv_sql(source: str, numeric: tuple, categorical: tuple) -> str:
    """CTEs ``edges``, ``bin_counts``, ``iv_bins`` over a source with ``y``."""
    assigned = [
        f"""SELECT '{f}' AS feature, y, CASE WHEN {f} IS NULL THEN '<MISSING>'
            WHEN EXISTS (SELECT 1 FROM edges WHERE feature = '{f}')
            THEN 'q' || lpad(((SELECT count(*) FROM edges WHERE feature = '{f}' AND edge < {f}))::VARCHAR, 2, '0')
            ELSE 'v' || {f}::VARCHAR END AS bin FROM {source}"""
        for f in numeric
    ] + [f"SELECT '{f}' AS feature, y, coalesce('v' || {f}::VARCHAR, '<MISSING>') AS bin FROM {source}" for f in categorical]
    return f"""edges AS ({edges_sql(source, numeric)}),
      raw_bins AS (SELECT feature, bin, count(*) AS count, sum(y) AS bad FROM ({' UNION ALL '.join(assigned)}) GROUP BY 1, 2),
      bin_counts AS (SELECT feature, CASE WHEN bin LIKE 'v%' AND count < greatest(20, floor(n * 0.005)) THEN '<RARE>'
          ELSE ltrim(bin, 'v') END AS bin, CAST(sum(count) AS BIGINT) AS count, CAST(sum(bad) AS BIGINT) AS bad
        FROM (SELECT *, sum(count) OVER (PARTITION BY feature) AS n FROM raw_bins) GROUP BY 1, 2),
      iv_bins AS ({woe_sql('bin_counts', 'feature')})"""


def woe_sql(source: str, keys: str) -> str:
    return f"""SELECT *, (good_share - bad_share) * woe AS iv FROM (SELECT *, ln(good_share / bad_share) AS woe FROM (
      SELECT *, count - bad AS good, bad / count AS bad_rate,
        (count - bad + 0.5::DOUBLE) / (greatest(sum(count - bad) OVER w, 1) + 0.5::DOUBLE * count(*) OVER w) AS good_share,
        (bad + 0.5::DOUBLE) / (greatest(sum(bad) OVER w, 1) + 0.5::DOUBLE * count(*) OVER w) AS bad_share
      FROM {source} WINDOW w AS (PARTITION BY {keys})))"""


BINS = "feature, bin, count, good, bad, round(bad_rate, 8) AS bad_rate, round(woe, 8) AS woe, round(iv, 8) AS iv"
RANKING = "SELECT feature, round(greatest(sum(iv), 0), 8) AS iv, count(*) AS bins FROM iv_bins GROUP BY 1"


def iv_ranking_before_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    """Which features carry information about the bad label before the time cut-off?"""
    rows = stored(spark, folder, "application_date", "y", *FEATURES)
    plan = splits.SplitPlan(time_column="application_date")
    early = splits.time_holdout(rows, plan).filter("partition = 'development'")
    found = screening.iv_bins(early, "y", FEATURES, edge_digits=EDGE_DIGITS)
    return rounded(screening.iv_ranking(found))


@query(
    "entry_iv_ranking",
    LOAN + ", " + CUTOFF + ", early AS (SELECT frozen.* FROM frozen, cut WHERE application_date < cutoff), "
    + iv_sql("early", NUMERIC_FEATURES, CATEGORICAL_FEATURES) + RANKING,
)
def entry_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return iv_ranking_before_cutoff(spark, folder)


@query("g1_iv_edges", LOAN + f" SELECT feature, edge FROM ({edges_sql('frozen', NUMERIC_FEATURES)})")
def g1(spark: SparkSession, folder: str) -> DataFrame:
    edges = screening.iv_edges(stored(spark, folder, "y", *FEATURES), FEATURES, edge_digits=EDGE_DIGITS)
    return spark.createDataFrame([(f, e) for f, es in edges.items() for e in es], "feature string, edge double")


@query("g2_woe_iv", LOAN + ", " + iv_sql("frozen", NUMERIC_FEATURES, CATEGORICAL_FEATURES) + f" SELECT {BINS} FROM iv_bins")
def g2(spark: SparkSession, folder: str) -> DataFrame:
    found = screening.iv_bins(stored(spark, folder, "y", *FEATURES), "y", FEATURES, edge_digits=EDGE_DIGITS)
    return rounded(found)


REASONED = ("customer_id", "customer_year", "application_date", *FEATURES, "post_returns", "constant", "often_missing", "other_y")
REASON_SQL = """CASE WHEN f = 'other_y' THEN 'OTHER_TARGET' WHEN f = 'post_returns' THEN 'LEAKAGE'
  WHEN f = 'customer_id' THEN 'IDENTIFIER' WHEN uniq <= 1 THEN 'CONSTANT' WHEN missing > 0.3 THEN 'MISSING_RATE'
  WHEN f IN ('application_date', 'customer_year') THEN 'UNSUPPORTED_TYPE' WHEN iv < 0.02 THEN 'LOW_IV' END"""
SCREEN_SOURCE = """, src AS (SELECT *, 7 AS constant, CASE WHEN order_id % 5 < 2 THEN NULL ELSE amount END AS often_missing,
  CASE WHEN qty > 100 THEN 1 ELSE 0 END AS other_y FROM frozen)"""


G3_SQL = (
    LOAN + SCREEN_SOURCE + ", "
    + iv_sql("src", (*NUMERIC_FEATURES, "often_missing"), CATEGORICAL_FEATURES)
    + ", ranked AS (" + RANKING + "), facts AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS f, count(DISTINCT {c}) AS uniq, 1 - count({c}) / count(*) AS missing FROM src" for c in REASONED
    )
    + f"), reasons AS (SELECT f, {REASON_SQL} AS reason, iv FROM facts LEFT JOIN ranked ON feature = f), "
    + "ranks AS (SELECT y, "
    + ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}"
        for c in ("n_lines", "qty", "net", "max_tax", "avg_disc")
    )
    + " FROM src), pairs AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS c FROM ranks"
        for i, a in enumerate(("n_lines", "qty", "net", "max_tax", "avg_disc"))
        for b in ("n_lines", "qty", "net", "max_tax", "avg_disc")[i + 1 :]
    )
    + """), dropped AS (SELECT DISTINCT CASE WHEN x.iv >= z.iv THEN b ELSE a END AS f FROM pairs
         JOIN reasons x ON x.f = a AND x.reason IS NULL JOIN reasons z ON z.f = b AND z.reason IS NULL WHERE c > 0.7)
       SELECT f AS "column", CASE WHEN reason IS NULL AND f IN (SELECT f FROM dropped) THEN 'HIGH_CORRELATION' ELSE reason END AS reason
       FROM reasons"""
)


def screening_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The frozen loan rows with a constant, an often missing column and a second label."""
    extra = {
        "constant": F.lit(7),
        "often_missing": F.when(F.col("order_id") % 5 >= 2, F.col("amount")),
        "other_y": (F.col("qty") > 100).cast("int"),
    }
    return materialize(frozen(spark, folder).withColumns(extra), "screening")


@query("g3_screening_reasons", G3_SQL)
def g3(spark: SparkSession, folder: str) -> DataFrame:
    rows = screening_rows(spark, folder)
    limits = screening.ScreeningThresholds(edge_digits=EDGE_DIGITS)
    found = screening.screen_features(rows, "y", REASONED, ["other_y"], limits, row_id="order_id")
    return found.select("column", "reason")


@query(
    "m5_screened_evidence",
    G3_SQL.replace("ELSE reason END AS reason\n       FROM reasons", "ELSE reason END AS reason, iv, uniq, missing FROM reasons JOIN facts USING (f)").replace(
        ", ranks AS (", ", place AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in REASONED) + f"]) AS c, unnest(range({len(REASONED)})) AS p), ranks AS (", 1
    ).replace("""       SELECT f AS "column",""", """ SELECT printf('f_%04d', p + 1) AS alias, uniq AS unique_count, round(missing, 8) AS missing_rate,
         reason IS NULL AS selected, reason AS selection_reason, CASE WHEN reason IS NULL THEN round(iv, 8) END AS iv FROM (SELECT f AS c,""")
    + ") JOIN place USING (c)",
)
def m5_screened(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence under aliases with what the screening decided about every column."""
    rows = screening_rows(spark, folder)
    limits = screening.ScreeningThresholds(edge_digits=EDGE_DIGITS)
    found = screening.screen_features(rows, "y", REASONED, ["other_y"], limits, row_id="order_id")
    evidence = privacy.safe_evidence(profile.column_profile(rows, REASONED), found)
    return rounded(
        evidence.select("alias", "unique_count", "missing_rate", "selected", "selection_reason", F.when(F.col("selected"), F.col("iv")).alias("iv"))
    )


CORRELATED = ("amount", "n_lines", "qty", "net", "avg_disc")


def _spearman_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS "left", '{b}' AS "right", round(corr(ra, rb), 8) AS spearman FROM (
      SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0::DOUBLE AS ra,
             rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0::DOUBLE AS rb
      FROM src WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


SPEARMAN = (
    LOAN
    + ", src AS (SELECT * EXCLUDE (acctbal), CASE WHEN acctbal >= 0 THEN acctbal END AS acctbal FROM frozen), matrix AS ("
    + " UNION ALL ".join(
        _spearman_sql(a, b) for i, a in enumerate((*CORRELATED, "acctbal")) for b in (*CORRELATED, "acctbal")[i + 1 :]
    )
    + ")"
)


def _correlation_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = frozen(spark, folder).withColumn("acctbal", F.when(F.col("acctbal") >= 0, F.col("acctbal")))
    return materialize(rows.select("order_id", "y", "acctbal", *CORRELATED), "correlation")


@query("g4_spearman", SPEARMAN + " SELECT * FROM matrix")
def g4(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(screening.spearman_matrix(_correlation_rows(spark, folder), (*CORRELATED, "acctbal"), "order_id"))


@query(
    "g5_correlation_pruning",
    SPEARMAN
    + ", " + iv_sql("src", (*CORRELATED, "acctbal"), ()) + ", ranked AS (" + RANKING
    + """) SELECT "left", "right", round(abs(spearman), 6) AS correlation, CASE WHEN a.iv >= b.iv THEN "right" ELSE "left" END AS excluded
       FROM matrix JOIN ranked a ON a.feature = "left" JOIN ranked b ON b.feature = "right" WHERE abs(spearman) > 0.7""",
)
def g5(spark: SparkSession, folder: str) -> DataFrame:
    rows = _correlation_rows(spark, folder)
    names = (*CORRELATED, "acctbal")
    iv = screening.iv_ranking(screening.iv_bins(rows, "y", names, edge_digits=EDGE_DIGITS))
    matrix = screening.spearman_matrix(rows, names, "order_id")
    return rounded(screening.prune_correlated(matrix, iv), 6)


TARGET_FEATURES = ("amount", "acctbal", "qty"), ("segment",)
URGENT = "CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 1 WHEN priority = '3-MEDIUM' THEN -1 ELSE 0 END"


def _by_target_sql() -> str:
    each = []
    for target, label in (("y", "y"), ("urgent", URGENT)):
        source = f"SELECT * FROM (SELECT {label} AS y, {', '.join((*TARGET_FEATURES[0], *TARGET_FEATURES[1]))} FROM loan) WHERE y IN (0, 1)"
        each.append(f"SELECT '{target}' AS target, {BINS} FROM (WITH src AS ({source}), {iv_sql('src', *TARGET_FEATURES)} SELECT * FROM iv_bins)")
    return LOAN + " " + " UNION ALL ".join(each)


@query("c4_iv_by_target", _by_target_sql())
def c4_by_target(spark: SparkSession, folder: str) -> DataFrame:
    """WOE and IV of the features for two labels, each over its own rows, from one counting job."""
    rows = loan(spark, folder).withColumn("urgent", F.expr(URGENT))
    names = [*TARGET_FEATURES[0], *TARGET_FEATURES[1]]
    found = screening.iv_bins_by_target(rows.select("y", "urgent", *names), ["y", "urgent"], names, edge_digits=EDGE_DIGITS)
    return rounded(found.select("target", "feature", "bin", "count", "good", "bad", "bad_rate", "woe", "iv"))


# --- H: binning -----------------------------------------------------------------------------


@query(
    "h1_finest_bins",
    LOAN + ", edges AS (" + edges_sql("frozen", ("amount", "acctbal", "qty", "net", "avg_disc")) + ") "
    + " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, bin_index::INTEGER AS bin_index, count(*) AS count, CAST(sum(y) AS BIGINT) AS bad FROM (
        SELECT y, (SELECT count(*) FROM edges WHERE feature = '{f}' AND edge < {f}) AS bin_index FROM frozen) GROUP BY 2"""
        for f in ("amount", "acctbal", "qty", "net", "avg_disc")
    ),
)
def h1(spark: SparkSession, folder: str) -> DataFrame:
    names = ["amount", "acctbal", "qty", "net", "avg_disc"]
    rows = stored(spark, folder, "y", *names)
    return bins.finest_bins(rows, "y", bins.finest_edges(rows, names, edge_digits=EDGE_DIGITS))


# Fine bins as in ``finest_edges``: as many quantiles as there are values, ten at most. The recursion then drops one inner
# edge per step: the one between the closest neighbouring rates, until rates are monotone and no bin is small.
def fitted_sql(numeric: tuple, categorical: tuple = ()) -> str:
    edges = " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, unnest(list_sort(list_distinct(list_transform(quantile_cont({f}::DOUBLE, {deciles(parts)}),
            lambda x: round(x, {EDGE_DIGITS}))))) AS edge FROM frozen HAVING least(10, count(DISTINCT {f})) = {parts}"""
        for f in numeric
        for parts in range(2, 11)
    )
    cells = " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, CASE WHEN {f} IS NULL THEN -1 ELSE (SELECT count(*) FROM edges WHERE feature = '{f}' AND edge < {f}) END AS i,
            count(*) AS n, CAST(sum(y) AS BIGINT) AS bad FROM frozen GROUP BY 2"""
        for f in numeric
    )
    kinds = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, coalesce({f}, '<MISSING>') AS value, count(*) AS n, CAST(sum(y) AS BIGINT) AS bad FROM frozen GROUP BY 2"
        for f in categorical
    )
    grouped = f""" UNION ALL SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY bad / count, value) - 1, NULL, count, bad FROM (
      SELECT feature, CASE WHEN n < greatest(20, floor(total * 0.01)) THEN '<RARE>' ELSE value END AS value,
             CAST(sum(n) AS BIGINT) AS count, CAST(sum(bad) AS BIGINT) AS bad
      FROM ({kinds}), whole GROUP BY 1, 2)""" if categorical else ""
    return LOAN.replace("WITH lines", "WITH RECURSIVE lines", 1) + f""",
whole AS (SELECT count(*) AS total FROM frozen),
edges AS (SELECT feature, edge FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY edge) AS i,
    count(*) OVER (PARTITION BY feature) AS n FROM ({edges})) WHERE i > 1 AND i < n),
cells AS ({cells}),
edge_lists AS (SELECT feature, coalesce(list(edge ORDER BY edge) FILTER (WHERE edge IS NOT NULL), []) AS edges
               FROM (SELECT DISTINCT feature FROM cells) LEFT JOIN edges USING (feature) GROUP BY feature),
slots AS (SELECT feature, edges, unnest(range(len(edges) + 1)) AS i FROM edge_lists),
merged AS (
  SELECT feature, any_value(edges) AS edges, list(coalesce(n, 0) ORDER BY i) AS c, list(coalesce(bad, 0) ORDER BY i) AS b, 0 AS turn
  FROM slots LEFT JOIN cells USING (feature, i) GROUP BY feature
  UNION ALL
  SELECT feature, list_concat(edges[1:d], edges[d + 2:]), list_concat(c[1:d], list_concat([c[d + 1] + c[d + 2]], c[d + 3:])),
         list_concat(b[1:d], list_concat([b[d + 1] + b[d + 2]], b[d + 3:])), turn + 1
  FROM (
    SELECT *, CASE WHEN len(gaps) = 0 THEN 0 ELSE least(list_position(gaps, list_min(gaps)) - 1, len(edges) - 1) END AS d
    FROM (
      SELECT *, list_transform(steps, lambda s: abs(s)) AS gaps FROM (
        SELECT *, list_transform(range(1, len(rates)), lambda i: rates[i + 1] - rates[i]) AS steps FROM (
          SELECT merged.*, total, list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i] > 0), lambda i: b[i] / c[i]) AS rates,
                 list_min(list_filter(c, lambda n: n > 0)) AS smallest FROM merged, whole)))
    WHERE len(edges) >= 2 AND NOT (smallest / total >= 0.03
      AND (len(rates) <= 2 OR list_min(steps) >= -1e-12 OR list_max(steps) <= 1e-12)))),
last AS (SELECT feature, arg_max(edges, turn) AS edges, arg_max(c, turn) AS c, arg_max(b, turn) AS b FROM merged GROUP BY feature),
fitted AS (
  SELECT feature, i AS bin_index, edges[i + 1] AS upper, c[i + 1] AS count, b[i + 1] AS bad
  FROM (SELECT *, unnest(range(len(c))) AS i FROM last) WHERE c[i + 1] > 0
  UNION ALL SELECT feature, -1, NULL, n, bad FROM cells WHERE i = -1{grouped})
SELECT feature, bin_index::INTEGER AS bin_index, upper, count::BIGINT AS count, bad::BIGINT AS bad, round(bad_rate, 8) AS bad_rate,
       round(woe, 8) AS woe, round(iv, 8) AS iv FROM ({woe_sql("fitted", "feature")})"""


def _fitted_table(spark: SparkSession, fitted: bins.Binning) -> DataFrame:
    """Every fitted bin with its upper edge (none for the last one, missing values and groups), counts, rate, WOE and IV."""
    ends = [(f, i, e) for f, s in fitted.specs.items() for i, e in enumerate(s.edges)]
    upper = spark.createDataFrame(ends, "feature string, bin_index int, upper double")
    rows = bins.bin_table(spark, fitted).join(upper, ["feature", "bin_index"], "left")
    return rounded(rows.select("feature", "bin_index", "upper", "count", "bad", "bad_rate", "woe", "iv"))


@query("h1_monotone_bins", fitted_sql(NUMERIC_FEATURES))
def h1_fit(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(spark, folder, "y", *NUMERIC_FEATURES)
    return _fitted_table(spark, bins.Binning(bins.fit_numeric(rows, "y", NUMERIC_FEATURES, edge_digits=EDGE_DIGITS)))


PART_LABEL = "CASE WHEN p_size > 25 THEN 1 ELSE 0 END"


@query(
    "h2_categorical_groups",
    f"""WITH src AS (SELECT p_brand, p_type, p_name, {PART_LABEL} AS y FROM part),
    counts AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f} AS value, count(*) AS count, sum(y) AS bad FROM src GROUP BY 2" for f in ('p_brand', 'p_type', 'p_name'))}),
    folded AS (SELECT feature, CASE WHEN count < greatest(20, floor(n * 0.01)) THEN '<RARE>' ELSE value END AS value,
        CAST(sum(count) AS BIGINT) AS count, CAST(sum(bad) AS BIGINT) AS bad
      FROM (SELECT *, sum(count) OVER (PARTITION BY feature) AS n FROM counts) GROUP BY 1, 2)
    SELECT feature, value, count, bad,
      (CASE WHEN count(*) OVER (PARTITION BY feature) <= 8 THEN row_number() OVER w ELSE ntile(8) OVER w END - 1)::INTEGER AS group_index
    FROM folded WINDOW w AS (PARTITION BY feature ORDER BY bad / count, value)""",
)
def h2(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").withColumn("y", (F.col("p_size") > 25).cast("int"))
    counts = bins.category_counts(part, "y", ["p_brand", "p_type", "p_name"])
    return bins.categorical_groups(bins.folded_categories(counts)).drop("place")


# Half of the parts train, so that names of the other half may be unknown.
RARE_FEATURES = ("p_name", "p_brand", "p_type")


@query(
    "h5_rare_dictionary",
    f"""WITH src AS (SELECT p_partkey, {', '.join(RARE_FEATURES)}, {PART_LABEL} AS y FROM part),
    longer AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f} AS value, y, p_partkey % 2 = 0 AS trains FROM src" for f in RARE_FEATURES)}),
    counts AS (SELECT feature, value, count(*) AS count, sum(y) AS bad, sum(count(*)) OVER (PARTITION BY feature) AS n FROM longer WHERE trains GROUP BY feature, value),
    named AS (SELECT *, CASE WHEN count < greatest(20, floor(n * 0.01)) THEN '<RARE>' ELSE value END AS kind FROM counts),
    folded AS (SELECT feature, kind, sum(bad) / sum(count) AS rate FROM named GROUP BY feature, kind),
    groups AS (SELECT feature, kind, CASE WHEN count(*) OVER (PARTITION BY feature) <= 8 THEN row_number() OVER w ELSE ntile(8) OVER w END AS place
               FROM folded WINDOW w AS (PARTITION BY feature ORDER BY rate, kind))
    SELECT l.feature, coalesce('G' || lpad(place::VARCHAR, 2, '0'), '<OTHER>') AS bin, count(*) AS rows, CAST(sum(y) AS BIGINT) AS bad
    FROM longer l LEFT JOIN named m ON m.feature = l.feature AND m.value = l.value LEFT JOIN groups g ON g.feature = m.feature AND g.kind = m.kind
    GROUP BY ALL""",
)
def h5_rare(spark: SparkSession, folder: str) -> DataFrame:
    """Bins of all parts by rules whose rare categories stand in a dictionary table; unknown values are <OTHER>."""
    part = table(spark, folder, "part").withColumn("y", (F.col("p_size") > 25).cast("int"))
    specs = bins.fit_categorical(part.filter("p_partkey % 2 = 0"), "y", RARE_FEATURES, literal_rare=0)
    binned = bins.apply_bins(part, bins.Binning(specs))
    entries = [(f, [F.col(f"{f}_bin")]) for f in RARE_FEATURES]
    longer = binned.select("y", order_statistics.unpivot_values(entries, ["bin"]))
    return longer.groupBy("feature", "bin").agg(F.count("*").alias("rows"), F.sum("y").cast("long").alias("bad"))


@query("h3_fit_binning", fitted_sql(NUMERIC_FEATURES, CATEGORICAL_FEATURES))
def h3(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(spark, folder, "y", *FEATURES)
    return _fitted_table(spark, bins.fit_binning(rows, "y", FEATURES, edge_digits=EDGE_DIGITS))


AMOUNT_EDGES = (100000.0, 250000.0, 400000.0)
LINE_EDGES = (2.0, 3.0, 5.0)
DISCOUNT_EDGES = (0.02, 0.045, 0.055, 0.08)
PRIORITY_GROUPS = (("1-URGENT", "2-HIGH"), ("3-MEDIUM",), ("5-LOW",))


def manual_specs() -> dict[str, bins.BinSpec]:
    return {
        "amount": bins.BinSpec("amount", "numeric", AMOUNT_EDGES),
        "n_lines": bins.BinSpec("n_lines", "numeric", LINE_EDGES),
        "avg_disc": bins.BinSpec("avg_disc", "numeric", DISCOUNT_EDGES),
        "priority": bins.BinSpec("priority", "categorical", groups=PRIORITY_GROUPS),
    }


def _interval_sql(f: str, edges: tuple) -> str:
    whens = " ".join(f"WHEN {f} <= {e!r} THEN {i}" for i, e in enumerate(edges))
    return f"CASE WHEN {f} IS NULL THEN -1 {whens} ELSE {len(edges)} END"


def _label_sql(f: str, edges: tuple) -> str:
    names = bins.interval_labels(edges)
    whens = " ".join(f"WHEN {f} <= {e!r} THEN '{names[i]}'" for i, e in enumerate(edges))
    return f"CASE WHEN {f} IS NULL THEN '<MISSING>' {whens} ELSE '{names[-1]}' END"


PRIORITY_INDEX = "CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 0 WHEN priority = '3-MEDIUM' THEN 1 WHEN priority = '5-LOW' THEN 2 ELSE 3 END"
PRIORITY_NAME = "CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 'G01' WHEN priority = '3-MEDIUM' THEN 'G02' WHEN priority = '5-LOW' THEN 'G03' ELSE '<OTHER>' END"
NUMERIC_SPECS = (("amount", AMOUNT_EDGES), ("n_lines", LINE_EDGES), ("avg_disc", DISCOUNT_EDGES))


def manual_sql(source: str, keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    each = [
        f"SELECT {lead}'{f}' AS feature, {_interval_sql(f, e)} AS bin_index, {_label_sql(f, e)} AS bin, y FROM {source}"
        for f, e in NUMERIC_SPECS
    ] + [f"SELECT {lead}'priority' AS feature, {PRIORITY_INDEX} AS bin_index, {PRIORITY_NAME} AS bin, y FROM {source}"]
    return f"""manual AS (SELECT {lead}feature, bin_index::INTEGER AS bin_index, bin, count(*) AS count, CAST(sum(y) AS BIGINT) AS bad
      FROM ({' UNION ALL '.join(each)}) GROUP BY ALL), woe AS ({woe_sql('manual', lead + 'feature')})"""


WOE = "feature, bin_index, bin, count, good, bad, round(bad_rate, 8) AS bad_rate, round(woe, 8) AS woe, round(iv, 8) AS iv"


def _manual_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = frozen(spark, folder).select("y", *manual_specs())
    return bins.woe_table(rows, "y", bins.Binning(manual_specs()))


@query("h4_woe_table", LOAN + ", " + manual_sql("frozen") + f" SELECT {WOE} FROM woe")
def h4(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_manual_table(spark, folder))


@query(
    "h5_apply_bins",
    LOAN
    + " SELECT order_id, "
    + ", ".join(f"{_label_sql(f, e)} AS {f}_bin" for f, e in NUMERIC_SPECS)
    + f", {PRIORITY_NAME} AS priority_bin FROM loan",
)
def h5(spark: SparkSession, folder: str) -> DataFrame:
    binned = bins.apply_bins(loan(spark, folder), bins.Binning(manual_specs()))
    return binned.select("order_id", *[f"{f}_bin" for f in manual_specs()])


def fitted_manual(spark: SparkSession, folder: str) -> bins.Binning:
    rows = stored(spark, folder, "y", *manual_specs())
    fitted = bins.Binning({})
    for spec in manual_specs().values():
        excused = bins.replace(spec, business_exception="kept for the regulator")
        fitted = bins.apply_manual_binning(fitted, rows, "y", excused)
    return fitted


@query(
    "h6_woe_transform",
    LOAN + ", " + manual_sql("frozen")
    + " SELECT order_id, "
    + ", ".join(
        f"round(coalesce((SELECT woe FROM woe WHERE feature = '{f}' AND bin_index = {_interval_sql(f, e)}), 0), 8) AS {f}_woe"
        for f, e in NUMERIC_SPECS
    )
    + f", round(coalesce((SELECT woe FROM woe WHERE feature = 'priority' AND bin_index = {PRIORITY_INDEX}), 0), 8) AS priority_woe FROM loan",
)
def h6(spark: SparkSession, folder: str) -> DataFrame:
    mapped = bins.woe_transform(loan(spark, folder), fitted_manual(spark, folder))
    return rounded(mapped.select("order_id", *[f"{f}_woe" for f in manual_specs()]))


@query("h7_manual_bins", LOAN + ", " + manual_sql("frozen") + f" SELECT {WOE} FROM woe")
def h7(spark: SparkSession, folder: str) -> DataFrame:
    fitted = bins.bin_table(spark, fitted_manual(spark, folder))
    return rounded(fitted.drop("kind", "source", "monotonic", "feature_iv"))


MONOTONE_SQL = """mono AS (SELECT feature, count(*) AS bins,
   count(*) <= 2 OR coalesce(bool_and(step >= -1e-12), true) OR coalesce(bool_and(step <= 1e-12), true) AS monotonic
   FROM (SELECT *, bad_rate - lag(bad_rate) OVER (PARTITION BY feature ORDER BY bin <> '<OTHER>', bin_index) AS step FROM woe WHERE bin_index >= 0)
   GROUP BY 1)"""


@query("h8_monotonicity", LOAN + ", " + manual_sql("frozen") + ", " + MONOTONE_SQL + " SELECT * FROM mono")
def h8(spark: SparkSession, folder: str) -> DataFrame:
    return bins.monotonicity(_manual_table(spark, folder))


@query(
    "h9_merge_suggestions",
    LOAN + ", " + manual_sql("frozen") + ", " + MONOTONE_SQL
    + """, paired AS (SELECT feature, bin_index AS left_index, lead(bin_index) OVER w AS right_index,
       round(abs(bad_rate - lead(bad_rate) OVER w), 8) AS distance, count + lead(count) OVER w AS merged_count,
       round((bad + lead(bad) OVER w) / (count + lead(count) OVER w), 8) AS merged_bad_rate
       FROM woe WHERE bin_index >= 0 WINDOW w AS (PARTITION BY feature ORDER BY bin <> '<OTHER>', bin_index))
     SELECT paired.* FROM paired JOIN mono USING (feature) WHERE NOT monotonic AND bins >= 3 AND right_index IS NOT NULL""",
)
def h9(spark: SparkSession, folder: str) -> DataFrame:
    return bins.merge_suggestions(_manual_table(spark, folder))


REPORT = LOAN + """, parts AS (SELECT *, CASE WHEN year(application_date) < 1999 THEN 'train'
  WHEN year(application_date) < 2000 THEN 'test' ELSE 'oot' END AS partition FROM frozen)"""


def _partitioned(spark: SparkSession, folder: str) -> DataFrame:
    year = F.year("application_date")
    return frozen(spark, folder).withColumn(
        "partition", F.when(year < 1999, "train").when(year < 2000, "test").otherwise("oot")
    )


@query(
    "h10_bin_report",
    REPORT + ", " + manual_sql("parts", "partition")
    + f""" SELECT partition, {WOE}, round(sum(bad) OVER w / sum(count) OVER w, 8) AS overall_bad_rate,
        round(sum(iv) OVER w, 8) AS feature_iv, round(bad_rate / (sum(bad) OVER w / sum(count) OVER w), 8) AS lift
        FROM woe WINDOW w AS (PARTITION BY partition, feature)""",
)
def h10(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(bins.bin_report(_partitioned(spark, folder), "y", bins.Binning(manual_specs())))


# --- J: metrics -----------------------------------------------------------------------------


def scored(spark: SparkSession, folder: str) -> DataFrame:
    rows = _partitioned(spark, folder).select("order_id", "partition", "y", "n_lines")
    signal = (F.col("n_lines") * 200 + (F.col("order_id") * 7919) % 1000) / F.lit(4000.0)
    noise = ((F.col("order_id") * 31) % 97 + 1) / F.lit(100.0)
    both = F.array(
        F.struct(F.lit("signal").alias("model"), signal.alias("p")), F.struct(F.lit("noise").alias("model"), noise.alias("p"))
    )
    return rows.select("order_id", "partition", "y", F.inline(both))


def stored_scores(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(scored(spark, folder), "scores")


METRICS_SQL = """points AS (SELECT model, partition, p, count(*) AS n, sum(y) AS bad FROM scored GROUP BY 1, 2, 3),
 curve AS (SELECT *, sum(bad) OVER w AS cum_bad, sum(n) OVER w AS cum_n,
     sum(bad) OVER k AS all_bad, sum(n) OVER k AS all_n FROM points
   WINDOW w AS (PARTITION BY model, partition ORDER BY p DESC), k AS (PARTITION BY model, partition)),
 gaps AS (SELECT *, cum_bad::DOUBLE / all_bad - (cum_n - cum_bad)::DOUBLE / (all_n - all_bad) AS gap FROM curve),
 quality AS (SELECT model, partition, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(bad) AS BIGINT) AS positive_count,
   CAST(sum(n) - sum(bad) AS BIGINT) AS negative_count, round(sum(bad) / sum(n), 8) AS bad_rate,
   round(sum((n - bad)::DOUBLE * ((cum_bad - bad) + bad / 2.0::DOUBLE)) / (sum(bad)::DOUBLE * (sum(n) - sum(bad))), 8) AS roc_auc,
   round(max(gap), 8) AS ks, arg_max(p, gap + p * 1e-15) AS ks_threshold,
   round(sum(bad / all_bad * (cum_bad / cum_n)), 8) AS pr_auc,
   round(sum(bad * (1 - p) * (1 - p) + (n - bad) * p * p) / sum(n), 8) AS brier,
   round(-sum(bad * ln(p) + (n - bad) * ln(1 - p)) / sum(n), 8) AS log_loss FROM gaps GROUP BY 1, 2)"""


@query("j1_j5_binary_metrics", SCORED + ", " + METRICS_SQL + " SELECT * FROM quality")
def j1(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.binary_metrics(stored_scores(spark, folder), "y", "p", ["model", "partition"]))


LIFT_SQL = """ranked AS (SELECT *, row_number() OVER (PARTITION BY model, partition
     ORDER BY p DESC, md5(order_id::VARCHAR || '|'), order_id::VARCHAR) - 1 AS i,
   count(*) OVER (PARTITION BY model, partition) AS n FROM scored),
 bucketed AS (SELECT *, greatest(1, ceil(i * 10 / (n - 1)::DOUBLE))::INTEGER AS bucket FROM ranked),
 lifted AS (SELECT model, partition, bucket, count(*) AS count, CAST(sum(y) AS BIGINT) AS bad,
   min(p) AS min_probability, max(p) AS max_probability FROM bucketed GROUP BY 1, 2, 3),
 lift AS (SELECT model, partition, bucket, count, bad, bad / count AS bad_rate,
   (bad / count) / (sum(bad) OVER k / sum(count) OVER k) AS lift,
   sum(bad) OVER (PARTITION BY model, partition ORDER BY bucket) / sum(bad) OVER k AS cumulative_capture,
   min_probability, max_probability FROM lifted WINDOW k AS (PARTITION BY model, partition))"""
LIFT_COLUMNS = """model, partition, bucket, count, bad, round(bad_rate, 8) AS bad_rate, round(lift, 8) AS lift,
  round(cumulative_capture, 8) AS cumulative_capture, round(min_probability, 8) AS min_probability,
  round(max_probability, 8) AS max_probability"""


@query("j6_lift_table", SCORED + ", " + LIFT_SQL + f" SELECT {LIFT_COLUMNS} FROM lift")
def j6(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.lift_table(stored_scores(spark, folder), "y", "p", "order_id", ["model", "partition"]))


def _bucket_sql(value: str) -> str:
    from lendwright.operators.order_statistics import quantile_grid

    inner = quantile_grid(10)[1:-1]
    return "(CASE " + " ".join(f"WHEN {value} <= {e!r}::DOUBLE THEN {i + 1}" for i, e in enumerate(inner)) + " ELSE 10 END)"


@query(
    "j7_calibration_table",
    SCORED
    + f""" SELECT model, partition, {_bucket_sql('p')}::INTEGER AS bucket, count(*) AS count, round(avg(y), 8) AS actual_rate,
        round(avg(p), 8) AS predicted_rate FROM scored GROUP BY 1, 2, 3""",
)
def j7(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.calibration_table(scored(spark, folder), "y", "p", ["model", "partition"]))


def psi_sql(reference: str, current: str) -> str:
    return f"""SELECT '{reference}' AS reference, '{current}' AS current, round(sum((c - r) * ln(c / r)), 8) AS psi FROM (
      SELECT greatest(count(*) FILTER (WHERE partition = '{reference}') / any_value(nr), 1e-6) AS r,
             greatest(count(*) FILTER (WHERE partition = '{current}') / any_value(nc), 1e-6) AS c
      FROM (SELECT *, (SELECT count(*) FROM signal WHERE partition = '{reference}') AS nr,
                      (SELECT count(*) FROM signal WHERE partition = '{current}') AS nc,
              (SELECT count(*) FROM (SELECT unnest(list_distinct(quantile_cont(p, {deciles()}))) AS e FROM signal WHERE partition = '{reference}')
                WHERE e <= s.p AND e > (SELECT min(p) FROM signal WHERE partition = '{reference}')
                  AND e < (SELECT max(p) FROM signal WHERE partition = '{reference}')) AS bin
            FROM signal s WHERE partition IN ('{reference}', '{current}')) GROUP BY bin)"""


SIGNAL = SCORED + ", signal AS (SELECT * FROM scored WHERE model = 'signal')"


@query("j8_psi", SIGNAL + " " + psi_sql("train", "test") + " UNION ALL " + psi_sql("test", "oot"))
def j8(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(scored(spark, folder).filter("model = 'signal'"), "signal")
    return rounded(metrics.psi(rows, "p", "partition", [("train", "test"), ("test", "oot")]))


@query(
    "j9_score_monotonicity",
    SCORED + ", " + LIFT_SQL
    + """, steps AS (SELECT *, bad_rate - lag(bad_rate) OVER (PARTITION BY model, partition ORDER BY bucket) AS step FROM lift)
     SELECT model, partition, least(count(*) FILTER (WHERE step < -1e-12), count(*) FILTER (WHERE step > 1e-12)) AS violations,
       least(count(*) FILTER (WHERE step < -1e-12), count(*) FILTER (WHERE step > 1e-12)) = 0 AS absolute FROM steps GROUP BY 1, 2""",
)
def j9(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["model", "partition"]
    lift = metrics.lift_table(stored_scores(spark, folder), "y", "p", "order_id", keys)
    return metrics.score_monotonicity(lift, keys)


@query(
    "j10_partition_metrics",
    SIGNAL + ", " + METRICS_SQL + ", moved AS (" + psi_sql("train", "test") + " UNION ALL " + psi_sql("test", "oot")
    + ") SELECT quality.*, psi FROM quality LEFT JOIN moved ON current = partition WHERE model = 'signal'",
)
def j10(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(scored(spark, folder).filter("model = 'signal'"), "signal")
    quality = metrics.binary_metrics(rows, "y", "p", ["model", "partition"])
    moved = metrics.psi(rows, "p", "partition", [("train", "test"), ("test", "oot")])
    joined = quality.join(moved.select(F.col("current").alias("partition"), "psi"), "partition", "left")
    return rounded(joined)


# --- K: scoring -----------------------------------------------------------------------------

SCALE = ScoreScale(minimum=300, maximum=900, base_score=600, base_odds=20, pdo=50)
RAW = "(600 + 50 / ln(2) * ln((1 - p) / p / 20))"


@query(
    "k1_probability_to_score",
    SCORED
    + f""" SELECT model, order_id, round({RAW}, 6) AS raw_score, round(least(900, greatest(300, {RAW})), 6) AS score FROM scored""",
)
def k1(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        scoring.probability_to_score(scored(spark, folder), "p", SCALE).select("model", "order_id", "raw_score", "score"), 6
    )


@query(
    "k1_score_limits",
    SCORED + f" SELECT round(avg(({RAW} < 500)::INT), 8) AS floor_rate, round(avg(({RAW} > 560)::INT), 8) AS cap_rate FROM scored",
)
def k1_limits(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scoring.score_limits(scored(spark, folder), "p", ScoreScale(minimum=500, maximum=560)))


@query(
    "k2_append_scores",
    SCORED
    + f""" SELECT order_id, round_even(least(900, greatest(300, {RAW})), 0)::INTEGER AS y_signal_1_score,
        round({RAW}, 6) AS y_signal_1_score_raw, round(p, 6) AS y_signal_1_score_bad_probability FROM scored WHERE model = 'signal'""",
)
def k2(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored(spark, folder).filter("model = 'signal'").select("order_id", "p")
    return rounded(scoring.append_scores(rows, "p", "y-signal (1)", SCALE).drop("p"), 6)


@query(
    "k3_field_contract",
    """SELECT 'code' AS field, 'FIELD_TYPE_MISMATCH' AS code, count(*) AS rows FROM orders WHERE o_orderkey % 8 = 0
       UNION ALL SELECT 'seen', 'FIELD_TYPE_MISMATCH', count(*) FROM orders WHERE o_orderkey % 5 = 0
       UNION ALL SELECT 'absent', 'MISSING_REQUIRED_FIELD', NULL FROM orders HAVING count(*) > 0""",
)
def k3(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    frame = table(spark, folder, "orders").select(
        F.when(key % 8 == 0, F.lit("x1")).otherwise(key.cast("string")).alias("code"),
        F.when(key % 5 == 0, F.lit("soon")).otherwise(F.lit("2024-02-29")).alias("seen"),
        "o_orderpriority",
        "o_totalprice",
    )
    contract = scoring.FieldContract(
        {"code": "numeric", "seen": "datetime", "o_orderpriority": "categorical", "o_totalprice": "numeric", "absent": "numeric"}
    )
    return scoring.contract_violations(frame, contract)


COEFFICIENTS = {"amount": -0.4, "n_lines": -1.1, "avg_disc": 0.25, "priority": -0.6}


@query(
    "k4_scorecard_rules",
    LOAN + ", " + manual_sql("frozen")
    + " SELECT order_id, round(1 / (1 + exp(-(-0.35 + "
    + " + ".join(
        f"{COEFFICIENTS[f]} * coalesce((SELECT woe FROM woe WHERE feature = '{f}' AND bin_index = {_interval_sql(f, e)}), 0)"
        for f, e in NUMERIC_SPECS
    )
    + f" + {COEFFICIENTS['priority']} * coalesce((SELECT woe FROM woe WHERE feature = 'priority' AND bin_index = {PRIORITY_INDEX}), 0)))), 8) AS probability FROM loan",
)
def k4(spark: SparkSession, folder: str) -> DataFrame:
    fitted = fitted_manual(spark, folder)
    rules = scoring.ScorecardRules(list(COEFFICIENTS), list(COEFFICIENTS.values()), -0.35, fitted)
    return rounded(scoring.score_with_rules(loan(spark, folder), rules).select("order_id", "probability"))


# --- L: report tables -----------------------------------------------------------------------


@query(
    "l1_sample_overview",
    SIGNAL + ", " + METRICS_SQL + ", moved AS (" + psi_sql("train", "test") + " UNION ALL " + psi_sql("test", "oot")
    + """) SELECT upper(partition) AS partition, CASE partition WHEN 'train' THEN 1 WHEN 'test' THEN 2 ELSE 3 END AS position,
       rows, positive_count, negative_count, bad_rate, roc_auc, ks, pr_auc, psi
       FROM quality LEFT JOIN moved ON current = partition WHERE model = 'signal'""",
)
def l1(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(scored(spark, folder).filter("model = 'signal'"), "signal")
    quality = metrics.binary_metrics(rows, "y", "p", ["partition"])
    moved = metrics.psi(rows, "p", "partition", [("train", "test"), ("test", "oot")])
    return rounded(report.sample_overview(quality, moved))


@query(
    "l1_executive_summary",
    SIGNAL + ", " + METRICS_SQL
    + """ SELECT 'signal' AS champion, max(roc_auc) FILTER (WHERE partition = 'test') AS test_auc,
       max(ks) FILTER (WHERE partition = 'test') AS test_ks, max(roc_auc) FILTER (WHERE partition = 'oot') AS oot_auc,
       max(ks) FILTER (WHERE partition = 'oot') AS oot_ks, true AS absolute_ordering, 4 AS selected_feature_count,
       'conditional' AS quality_verdict FROM quality WHERE model = 'signal'""",
)
def l1_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(scored(spark, folder).filter("model = 'signal'"), "signal")
    overview = report.sample_overview(metrics.binary_metrics(rows, "y", "p", ["partition"]))
    return rounded(report.executive_summary(overview, "signal", True, False, 4))


@query(
    "l2_feature_sheet",
    LOAN + ", " + iv_sql("frozen", NUMERIC_FEATURES, CATEGORICAL_FEATURES) + ", ranked AS (" + RANKING + """)
     SELECT feature, CASE WHEN iv >= 0.02 THEN 'included' ELSE 'excluded' END AS status, iv,
       CASE WHEN iv < 0.02 THEN 'LOW_IV' END AS reason FROM ranked""",
)
def l2(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(spark, folder, "order_id", "y", *FEATURES)
    limits = screening.ScreeningThresholds(correlation=1.0, edge_digits=EDGE_DIGITS)
    found = screening.screen_features(rows, "y", FEATURES, (), limits, row_id="order_id")
    return rounded(report.feature_sheet(found).select("feature", "status", "iv", "reason"))


@query(
    "l3_bin_sheet",
    LOAN + ", " + manual_sql("frozen") + ", " + MONOTONE_SQL
    + """ SELECT feature, 'manual' AS source, monotonic, bin, count, good, bad, round(bad_rate, 8) AS bad_rate,
         round(woe, 8) AS woe, round(iv, 8) AS iv FROM woe JOIN mono USING (feature)""",
)
def l3(spark: SparkSession, folder: str) -> DataFrame:
    fitted = fitted_manual(spark, folder)
    return rounded(report.bin_sheet(bins.bin_table(spark, fitted)))


@query("l4_lift_sheet", SCORED + ", " + LIFT_SQL + f" SELECT {LIFT_COLUMNS} FROM lift")
def l4(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.lift_table(stored_scores(spark, folder), "y", "p", "order_id", ["model", "partition"]))


REVIEWS = """reviews AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'deterministic_pass' WHEN o_orderpriority = '2-HIGH' THEN 'fallback_pass'
    WHEN o_orderpriority = '3-MEDIUM' THEN 'revise' WHEN o_orderpriority = '5-LOW' THEN 'blocked' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN 'pass' END AS deterministic_status,
  CASE WHEN o_orderstatus = 'O' THEN 'llm_reviewer_pass' WHEN o_orderkey % 3 = 0 THEN 'fallback_pass' END AS llm_status FROM orders)"""


def _reviews(spark: SparkSession, folder: str) -> DataFrame:
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.when(priority == "1-URGENT", "deterministic_pass")
        .when(priority == "2-HIGH", "fallback_pass")
        .when(priority == "3-MEDIUM", "revise")
        .when(priority == "5-LOW", "blocked")
        .alias("status"),
        F.when(status == "F", "pass").alias("deterministic_status"),
        F.when(status == "O", "llm_reviewer_pass").when(F.col("o_orderkey") % 3 == 0, "fallback_pass").alias("llm_status"),
    )


@query(
    "l6_review_coverage",
    "WITH " + REVIEWS + """, flags AS (SELECT
       deterministic_status IS NOT NULL OR coalesce(status IN ('deterministic_pass', 'fallback_pass'), false) AS d,
       coalesce(llm_status IN ('llm_reviewer_pass', 'revise', 'blocked'), false) AS m,
       coalesce(llm_status = 'fallback_pass', false) OR coalesce(status = 'fallback_pass', false) AS f FROM reviews)
     SELECT count(*) AS total_records, count(*) FILTER (WHERE d) AS deterministic_reviewed, round(avg(d::INT), 6) AS deterministic_coverage,
       count(*) FILTER (WHERE m) AS llm_reviewed, round(avg(m::INT), 6) AS llm_coverage,
       count(*) FILTER (WHERE f) AS fallback_records, round(avg(f::INT), 6) AS fallback_rate FROM flags""",
)
def l6(spark: SparkSession, folder: str) -> DataFrame:
    return report.review_coverage(_reviews(spark, folder))


@query(
    "l6_review_status_counts",
    "WITH " + REVIEWS + " SELECT coalesce(status, 'unknown') AS status, count(*) AS records FROM reviews GROUP BY 1",
)
def l6_status(spark: SparkSession, folder: str) -> DataFrame:
    return report.review_status_counts(_reviews(spark, folder))

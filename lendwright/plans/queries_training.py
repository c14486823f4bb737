"""Queries: model training, calibration, selection, batch scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lendwright.operators import metrics, modeling, report, trees
from lendwright.operators.modeling import PROBABILITY
from lendwright.operators.order_statistics import hash_order
from lendwright.operators.splits import SplitPlan
from lendwright.plans.loan import FEATURES, NUMERIC_FEATURES, loan
from lendwright.plans.modelling_run import modelling_run
from lendwright.plans.queries_model import LIFT_SQL, METRICS_SQL, SCORED, SPLIT_SQL, split_loan, stored, stored_scores
from lendwright.plans.registry import LOAN, query, r, rounded
from lendwright.plans.scoring_run import score_version
from lendwright.session import materialize, scratch_path
from lendwright.sources.versions import read_version, write_version

MODEL_FEATURES = FEATURES
FIELD_TYPES = {f: "numeric" if f in NUMERIC_FEATURES else "categorical" for f in MODEL_FEATURES}

def _train(spark: SparkSession, folder: str) -> DataFrame:
    return split_loan(spark, folder).select("order_id", "y", "partition", *MODEL_FEATURES)


# What holds for every candidate: rows and classes per partition, probabilities in range, no worse than a coin, and
# better than the constant prior on the rows it was fitted on.
def facts_sql(name: str) -> str:
    return SPLIT_SQL + f""" SELECT '{name}' AS model, partition, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positive_count,
      true AS in_range, true AS better_than_chance FROM split WHERE partition <> 'excluded' GROUP BY partition"""


def _facts(spark: SparkSession, folder: str, name: str, method: str = "uncalibrated") -> DataFrame:
    rows = materialize(_train(spark, folder).filter("partition <> 'excluded'"), "model")
    train = rows.filter("partition = 'train'")
    fitted = modeling.fit_calibrated(train, "y", MODEL_FEATURES, name, method, "order_id")
    scores = materialize(fitted.score(rows).select("order_id", "partition", "y", PROBABILITY), "model-scores")
    quality = metrics.binary_metrics(scores, "y", PROBABILITY, ["partition"])
    ranges = scores.groupBy("partition").agg(F.bool_and(F.col(PROBABILITY).between(0, 1)).alias("in_range"))
    floor = F.when(F.col("partition") == "train", 0.6).otherwise(0.5)
    return quality.join(ranges, "partition").select(
        F.lit(name).alias("model"), "partition", "rows", "positive_count", "in_range",
        (F.col("roc_auc") > floor).alias("better_than_chance"),
    )


PREPARED_SQL = LOAN + """, longer AS (
  SELECT unnest(range(7)) AS position, unnest([amount, acctbal, n_lines, qty, net, avg_disc, max_tax]) AS v FROM frozen),
 filled AS (SELECT position, coalesce(v, median(v) OVER (PARTITION BY position)) AS v FROM longer)"""


@query(
    "i1_preprocessing",
    PREPARED_SQL + " SELECT position::INTEGER AS position, 0.0 AS mean, CASE WHEN stddev_pop(v) > 0 THEN 1.0 ELSE 0.0 END AS deviation FROM filled GROUP BY position"
    + """ UNION ALL SELECT (7 + row_number() OVER (ORDER BY kind, value) - 1)::INTEGER, round(n / total, 6), round(sqrt(n / total * (1 - n / total)), 6) FROM (
      SELECT 1 AS kind, priority AS value, count(*)::DOUBLE AS n, (SELECT count(*) FROM frozen) AS total FROM frozen GROUP BY priority
      UNION ALL SELECT 2, segment, count(*)::DOUBLE, (SELECT count(*) FROM frozen) FROM frozen GROUP BY segment)""",
)
def i1(spark: SparkSession, folder: str) -> DataFrame:
    """Standardised numbers have mean 0 and deviation 1; a one-hot column has the share of its category."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    rows = stored(spark, folder, "order_id", "y", *FEATURES)
    model = Pipeline(stages=modeling.preprocessing(rows, FEATURES, scale=True)).fit(rows)
    values = model.transform(rows).select(F.posexplode(vector_to_array("__features")).alias("position", "value"))
    found = values.groupBy("position").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))
    # The columns for rare categories stay empty on this table.
    named = rounded(found, 6).filter((F.col("position") < len(NUMERIC_FEATURES)) | (F.col("mean") > 0))
    order = Window.orderBy("position")
    return named.select(
        (F.row_number().over(order) - 1).alias("position"), (F.col("mean") + 0.0).alias("mean"), "deviation"
    )


@query("i2_dummy_prior", LOAN + " SELECT order_id, round((SELECT avg(y) FROM frozen), 8) AS probability_of_bad FROM frozen")
def i2(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(spark, folder, "order_id", "y")
    return rounded(modeling.fit_candidate(rows, "y", [], "dummy").score(rows).select("order_id", PROBABILITY))


@query("i3_scorecard", facts_sql("scorecard"))
def i3(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder, "scorecard")


@query("i4_regularized_logistic", facts_sql("regularized_logistic"))
def i4(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder, "regularized_logistic")


# Newton steps on two standardised numbers and a penalised constant, weighted by class; the 3 x 3 system is solved by cofactors.
TWO_FEATURES = ("n_lines", "acctbal")
NEWTON_SQL = LOAN.replace("WITH lines", "WITH RECURSIVE lines", 1) + """,
filled AS (SELECT order_id, y, coalesce(n_lines::DOUBLE, median(n_lines::DOUBLE) OVER ()) AS a, coalesce(acctbal, median(acctbal) OVER ()) AS b FROM frozen),
rows_ AS (
  SELECT order_id, y, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS x1, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS x2,
         (SELECT count(*) FROM filled) / (2.0::DOUBLE * count(*) OVER (PARTITION BY y)) AS w FROM filled),
newton AS (
  SELECT 0 AS turn, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b0
  UNION ALL
  SELECT turn + 1, b1 - (g1 * (h22 * h00 - h20 * h20) - g2 * (h12 * h00 - h20 * h10) + g0 * (h12 * h20 - h22 * h10)) / det,
         b2 - (-g1 * (h12 * h00 - h10 * h20) + g2 * (h11 * h00 - h10 * h10) - g0 * (h11 * h20 - h12 * h10)) / det,
         b0 - (g1 * (h12 * h20 - h10 * h22) - g2 * (h11 * h20 - h10 * h12) + g0 * (h11 * h22 - h12 * h12)) / det
  FROM (
    SELECT *, h11 * (h22 * h00 - h20 * h20) - h12 * (h12 * h00 - h20 * h10) + h10 * (h12 * h20 - h22 * h10) AS det FROM (
      SELECT turn, b1, b2, b0, b1 / 0.3 + sum(w * (p - y) * x1) AS g1, b2 / 0.3 + sum(w * (p - y) * x2) AS g2, b0 / 0.3 + sum(w * (p - y)) AS g0,
             1 / 0.3 + sum(w * q * x1 * x1) AS h11, 1 / 0.3 + sum(w * q * x2 * x2) AS h22, 1 / 0.3 + sum(w * q) AS h00,
             sum(w * q * x1 * x2) AS h12, sum(w * q * x1) AS h10, sum(w * q * x2) AS h20
      FROM (SELECT *, p * (1 - p) AS q FROM (SELECT *, 1 / (1 + exp(-(b1 * x1 + b2 * x2 + b0))) AS p FROM newton, rows_ WHERE turn < 12))
      GROUP BY turn, b1, b2, b0)))"""


@query(
    "i4_two_feature_logistic",
    NEWTON_SQL + " SELECT unnest(['n_lines', 'acctbal', 'constant']) AS term, round(unnest([b1, b2, b0]), 3) AS coefficient FROM newton WHERE turn = 12",
)
def i4_two(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficients of the regularised logistic regression on two features; the loss is convex, so any solver meets them."""
    rows = stored(spark, folder, "order_id", "y", *TWO_FEATURES)
    model = modeling.fit_candidate(rows, "y", TWO_FEATURES, "regularized_logistic")
    values = [float(v) for v in model.pipeline.stages[-1].coefficients]
    found = spark.createDataFrame(list(zip([*TWO_FEATURES, "constant"], values)), "term string, coefficient double")
    return rounded(found, 3)


@query("i5_random_forest", facts_sql("random_forest"))
def i5(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder, "random_forest")


@query("i6_forest_nobootstrap", facts_sql("forest_nobootstrap"))
def i6(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder, "forest_nobootstrap")


# Encoded features as in the preprocessing: numbers with their median for missing values, then one column per category, in
# order, and one for rare categories, which stays empty on this table.
ENCODED_SQL = LOAN + f""",
numbers AS (SELECT order_id, y, priority, segment, {', '.join(f'coalesce({f}::DOUBLE, median({f}::DOUBLE) OVER ()) AS {f}' for f in NUMERIC_FEATURES)} FROM frozen),
kinds AS (SELECT 'priority' AS name, priority AS value, {len(NUMERIC_FEATURES)} + row_number() OVER (ORDER BY priority) - 1 AS feature FROM (SELECT DISTINCT priority FROM frozen)
  UNION ALL SELECT 'segment', segment, {len(NUMERIC_FEATURES)} + (SELECT count(DISTINCT priority) + 1 FROM frozen) + row_number() OVER (ORDER BY segment) - 1
    FROM (SELECT DISTINCT segment FROM frozen)),
width AS (SELECT {len(NUMERIC_FEATURES)} + count(DISTINCT priority) + count(DISTINCT segment) + 2 AS features, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1 FROM frozen),
cells AS (SELECT order_id, y, unnest(range({len(NUMERIC_FEATURES)})) AS feature, unnest([{', '.join(NUMERIC_FEATURES)}]) AS v FROM numbers
  UNION ALL SELECT order_id, y, feature, CASE WHEN value = CASE name WHEN 'priority' THEN priority ELSE segment END THEN 1.0 ELSE 0.0 END FROM numbers, kinds)"""

# Every tree draws the root of so many varying features in md5 order, each with an even threshold between its bounds.
ROOTS_SQL = ENCODED_SQL + """,
bounds AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM cells GROUP BY feature HAVING min(v) < max(v)),
drawn AS (
  SELECT tree, feature, draw, lo + ('0x' || substr(md5('42|' || tree || '|1|' || feature || '|cut'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * (hi - lo) AS cut
  FROM (SELECT *, md5('42|' || tree || '|1|' || feature) AS draw FROM bounds, (SELECT unnest(range(240)) AS tree))
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY draw, feature) <= (SELECT floor(sqrt(features)) FROM width)),
counted AS (
  SELECT tree, d.feature, draw, cut, count(*) FILTER (WHERE y = 0) AS l0, count(*) FILTER (WHERE y = 1) AS l1
  FROM drawn d JOIN cells c ON c.feature = d.feature AND v <= cut GROUP BY ALL),
weighted AS (
  SELECT *, (n0 + n1) / (2.0::DOUBLE * n0) AS w0, (n0 + n1) / (2.0::DOUBLE * n1) AS w1 FROM counted, width
  WHERE l0 + l1 >= 15 AND n0 + n1 - l0 - l1 >= 15),
gains AS (
  SELECT *, (w0 * n0 + w1 * n1 - ((w0 * n0) ** 2 + (w1 * n1) ** 2) / (w0 * n0 + w1 * n1))
    - (w0 * l0 + w1 * l1 - ((w0 * l0) ** 2 + (w1 * l1) ** 2) / (w0 * l0 + w1 * l1))
    - (w0 * (n0 - l0) + w1 * (n1 - l1) - ((w0 * (n0 - l0)) ** 2 + (w1 * (n1 - l1)) ** 2) / (w0 * (n0 - l0) + w1 * (n1 - l1))) AS gain FROM weighted)
SELECT tree::INTEGER AS tree, feature::INTEGER AS feature, round(cut, 6) AS threshold, (l0 + l1)::BIGINT AS left_rows,
       round(w1 * l1 / (w0 * l0 + w1 * l1), 8) AS left_share, round(w1 * (n1 - l1) / (w0 * (n0 - l0) + w1 * (n1 - l1)), 8) AS right_share,
       round(gain, 4) AS gain
FROM gains QUALIFY row_number() OVER (PARTITION BY tree ORDER BY gain DESC, draw) = 1"""


def _tree_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, int, dict[int, float], float]:
    """Encoded rows of the whole table, their width, balanced weights and negatives per positive."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    rows = stored(spark, folder, "order_id", "y", *FEATURES)
    encoded = Pipeline(stages=modeling.preprocessing(rows, FEATURES, scale=False)).fit(rows).transform(rows)
    ready = materialize(encoded.select(vector_to_array("__features").alias("x"), "y", F.xxhash64("order_id").alias("key")), "tree-rows")
    classes = {r["class"]: r for r in modeling.class_weights(rows, "y").collect()}
    return ready, ready.select(F.size("x")).first()[0], {k: v["balanced_weight"] for k, v in classes.items()}, classes[1]["positive_scale"]


@query("i6_extra_trees_roots", ROOTS_SQL)
def i6_roots(spark: SparkSession, folder: str) -> DataFrame:
    """The first split of all 240 extremely randomised trees: drawn threshold, rows and weighted shares on both sides, gain."""
    rows, width, weights, _ = _tree_rows(spark, folder)
    grown = trees.grow_extra_trees(rows, width, trees=240, depth=1, leaf=15, weights=weights)
    found = [
        (k, t.feature[0], t.threshold[0], t.rows[1], t.value[1], t.value[2], t.gain[0]) for k, t in enumerate(grown.trees) if t.feature[0] >= 0
    ]
    schema = "tree int, feature int, threshold double, left_rows long, left_share double, right_share double, gain double"
    out = spark.createDataFrame(found, schema)
    # Rounded once: to eight digits and then to six, a threshold just below a half would go up.
    return rounded(out.withColumns({"threshold": r("threshold", 6), "gain": r("gain", 4)}))


# Gradients at the first round are those of equal odds, in fixed point. A bin ends at a distinct value or at a quantile.
FIRST_ROUND_SQL = ENCODED_SQL + f""",
kept AS (SELECT feature, v, y FROM cells),
distinct_values AS (SELECT feature, count(DISTINCT v) AS kinds, max(v) AS most FROM kept GROUP BY feature),
cuts AS (
  SELECT feature, list_sort(list_distinct(list_filter(CASE WHEN kinds <= {trees.MAX_BINS} THEN all_values ELSE quantiles END, lambda c: c < most))) AS cuts
  FROM (SELECT feature, list(DISTINCT v) AS all_values, quantile_cont(v, {[i / trees.MAX_BINS for i in range(1, trees.MAX_BINS)]}) AS quantiles FROM kept GROUP BY feature)
  JOIN distinct_values USING (feature)),
scale AS (SELECT n0 / n1 AS positive FROM width),
binned AS (
  SELECT feature, len(list_filter(cuts, lambda c: c < v)) AS bin, count(*) AS n, count(*) FILTER (WHERE y = 1) AS n1 FROM kept JOIN cuts USING (feature)
  GROUP BY ALL),
sums AS (
  SELECT feature, bin, n, ((n - n1) * 8388608 - n1 * round(positive * 8388608)) / 16777216.0::DOUBLE AS g,
         ((n - n1) * 4194304 + n1 * round(positive * 4194304)) / 16777216.0::DOUBLE AS h FROM binned, scale)"""

SPLIT_COLUMNS = """SELECT s.feature::INTEGER AS feature, round(cuts[bin + 1], 6) AS threshold, round(gain, 4) AS gain, ln_::BIGINT AS left_rows,
  round(-0.035::DOUBLE * gl / (hl + 3), 8) AS left_value, round(-0.035::DOUBLE * (g - gl) / (h - hl + 3), 8) AS right_value"""


@query(
    "i7_gradient_bins",
    FIRST_ROUND_SQL + " SELECT feature::INTEGER AS feature, bin::INTEGER AS bin, n::BIGINT AS n, round(g, 6) AS g, round(h, 6) AS h FROM sums",
)
def i7_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and sums of gradient and hessian of every bin of every encoded feature before the first tree."""
    rows, width, _, positive = _tree_rows(spark, folder)
    found = trees.first_histogram(rows, width, trees.BoostingPlan(), {0: 1.0, 1: positive})
    return rounded(spark.createDataFrame(found, "feature int, bin int, n long, g double, h double"), 6)


@query(
    "i7_first_split",
    FIRST_ROUND_SQL + """,
    run AS (SELECT *, sum(n) OVER w AS ln_, sum(g) OVER w AS gl, sum(h) OVER w AS hl FROM sums WINDOW w AS (PARTITION BY feature ORDER BY bin)),
    totals AS (SELECT feature, sum(g) AS g, sum(h) AS h FROM sums GROUP BY feature),
    gains AS (SELECT run.feature, bin, ln_, gl, hl, t.g, t.h, (gl * gl / (hl + 3) + (t.g - gl) ** 2 / (t.h - hl + 3) - t.g ** 2 / (t.h + 3)) / 2 AS gain
              FROM run JOIN totals t ON t.feature = run.feature WHERE hl >= 1 AND t.h - hl >= 1) """
    + SPLIT_COLUMNS + " FROM gains s JOIN cuts ON cuts.feature = s.feature WHERE bin < len(cuts) QUALIFY row_number() OVER (ORDER BY round(gain, 6) DESC, s.feature, bin) = 1",
)
def i7_split(spark: SparkSession, folder: str) -> DataFrame:
    """The first split of second-order boosting: place, gain and Newton values of its leaves."""
    rows, width, _, positive = _tree_rows(spark, folder)
    tree = trees.grow_boosted(rows, width, trees.BoostingPlan(rounds=1, depth=1), {0: 1.0, 1: positive}).trees[0]
    found = [(tree.feature[0], tree.threshold[0], tree.gain[0], tree.rows[1], tree.value[1], tree.value[2])]
    schema = "feature int, threshold double, gain double, left_rows long, left_value double, right_value double"
    out = spark.createDataFrame(found, schema)
    return rounded(out).withColumns({"threshold": r("threshold", 6), "gain": r("gain", 4)})


def _codes_sql(name: str) -> str:
    earlier = f"OVER (PARTITION BY {name} ORDER BY md5(order_id::VARCHAR || '|42') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"round((coalesce(sum(y) {earlier}, 0) + p) / (count(*) {earlier} + 1.0::DOUBLE), 8) AS {name}_code"


@query(
    "i7_ordered_target_codes",
    LOAN + f" SELECT order_id, {_codes_sql('priority')}, {_codes_sql('segment')} FROM frozen, (SELECT avg(y) AS p FROM frozen)",
)
def i7_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Categories coded by the label's mean over earlier rows of the category, in hashed order."""
    rows = stored(spark, folder, "order_id", "y", "priority", "segment")
    prior = float(rows.agg(F.avg("y")).first()[0])
    coded = trees.ordered_target_codes(rows, ["priority", "segment"], "y", hash_order(F.col("order_id"), 42), prior)
    return rounded(coded.select("order_id", "priority_code", "segment_code"))


@query("i7_boosted_depth4", facts_sql("boosted_depth4"))
def i7(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder, "boosted_depth4")


@query("i7_boosted_depth6", facts_sql("boosted_depth6"))
def i7_six(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder, "boosted_depth6")


@query("i7_boosted_balanced", facts_sql("boosted_balanced"))
def i7_balanced(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder, "boosted_balanced")


@query(
    "i8_class_weights",
    LOAN
    + """ SELECT y AS class, count(*) AS rows, round((SELECT count(*) FROM frozen) / (2.0::DOUBLE * count(*)), 8) AS balanced_weight,
       round(CASE WHEN y = 1 THEN (SELECT count(*) FROM frozen WHERE y = 0) / count(*) ELSE 1 END, 8) AS positive_scale FROM frozen GROUP BY y""",
)
def i8(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(modeling.class_weights(stored(spark, folder, "y"), "y"))


@query(
    "i9_stratified_folds",
    LOAN
    + """ SELECT order_id, ((row_number() OVER (PARTITION BY y ORDER BY md5(order_id::VARCHAR || '|42'), order_id::VARCHAR) - 1) % 5)::INTEGER AS fold
       FROM frozen""",
)
def i9(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(spark, folder, "order_id", "y")
    folds = modeling.fold_count(rows, "y")
    return modeling.stratified_folds(rows, "y", "order_id", folds).select("order_id", "fold")


# Newton steps for every held-out fold and strength; missing values and scale come from the fold's training rows.
FOLDS_SQL = LOAN.replace("WITH lines", "WITH RECURSIVE lines", 1) + """,
dealt AS (SELECT order_id, y, n_lines::DOUBLE AS a, acctbal AS b,
  ((row_number() OVER (PARTITION BY y ORDER BY md5(order_id::VARCHAR || '|42'), order_id::VARCHAR) - 1) % 5)::INTEGER AS fold FROM frozen),
filled AS (
  SELECT k, order_id, y, fold = k AS held, coalesce(a, median(a) FILTER (WHERE fold <> k) OVER own) AS a, coalesce(b, median(b) FILTER (WHERE fold <> k) OVER own) AS b
  FROM dealt, (SELECT unnest(range(5)) AS k) WINDOW own AS (PARTITION BY k)),
rows_ AS (
  SELECT k, order_id, y, held, (a - avg(a) FILTER (WHERE NOT held) OVER own) / stddev_pop(a) FILTER (WHERE NOT held) OVER own AS x1,
         (b - avg(b) FILTER (WHERE NOT held) OVER own) / stddev_pop(b) FILTER (WHERE NOT held) OVER own AS x2,
         count(*) FILTER (WHERE NOT held) OVER own / (2.0::DOUBLE * count(*) FILTER (WHERE NOT held) OVER (PARTITION BY k, y)) AS w
  FROM filled WINDOW own AS (PARTITION BY k)),
newton AS (
  SELECT 0 AS turn, k, c, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b0 FROM (SELECT unnest(range(5)) AS k), (SELECT unnest([STRENGTHS]) AS c)
  UNION ALL
  SELECT turn + 1, k, c, b1 - (g1 * (h22 * h00 - h20 * h20) - g2 * (h12 * h00 - h20 * h10) + g0 * (h12 * h20 - h22 * h10)) / det,
         b2 - (-g1 * (h12 * h00 - h10 * h20) + g2 * (h11 * h00 - h10 * h10) - g0 * (h11 * h20 - h12 * h10)) / det,
         b0 - (g1 * (h12 * h20 - h10 * h22) - g2 * (h11 * h20 - h10 * h12) + g0 * (h11 * h22 - h12 * h12)) / det
  FROM (
    SELECT *, h11 * (h22 * h00 - h20 * h20) - h12 * (h12 * h00 - h20 * h10) + h10 * (h12 * h20 - h22 * h10) AS det FROM (
      SELECT turn, k, c, b1, b2, b0, b1 / c + sum(w * (p - y) * x1) AS g1, b2 / c + sum(w * (p - y) * x2) AS g2, b0 / c + sum(w * (p - y)) AS g0,
             1 / c + sum(w * q * x1 * x1) AS h11, 1 / c + sum(w * q * x2 * x2) AS h22, 1 / c + sum(w * q) AS h00,
             sum(w * q * x1 * x2) AS h12, sum(w * q * x1) AS h10, sum(w * q * x2) AS h20
      FROM (SELECT *, p * (1 - p) AS q FROM (
        SELECT newton.*, y, w, x1, x2, 1 / (1 + exp(-(b1 * x1 + b2 * x2 + b0))) AS p FROM newton JOIN rows_ ON rows_.k = newton.k AND NOT held WHERE turn < 12))
      GROUP BY turn, k, c, b1, b2, b0))),
held_scores AS (
  SELECT n.k, c, y, 1 / (1 + exp(-(b1 * x1 + b2 * x2 + b0))) AS p FROM newton n JOIN rows_ ON rows_.k = n.k AND held WHERE turn = 12),
quality AS (
  SELECT k, c, count(*) AS rows, avg(p) AS mean_probability,
         (sum(place) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0::DOUBLE)
           / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS roc_auc
  FROM (SELECT *, rank() OVER (PARTITION BY k, c ORDER BY p) + (count(*) OVER (PARTITION BY k, c, p) - 1) / 2.0::DOUBLE AS place FROM held_scores) GROUP BY k, c)"""


@query(
    "i10_out_of_fold",
    FOLDS_SQL.replace("STRENGTHS", "0.3")
    + " SELECT k::INTEGER AS fold, rows, round(mean_probability, 4) AS mean_probability, round(roc_auc, 4) AS roc_auc FROM quality",
)
def i10(spark: SparkSession, folder: str) -> DataFrame:
    """Every row scored in the fold it was held out in: rows, mean probability and AUC of each fold."""
    rows = stored(spark, folder, "order_id", "y", *TWO_FEATURES)
    scores = modeling.out_of_fold(rows, "y", TWO_FEATURES, "regularized_logistic", "order_id")
    quality = metrics.binary_metrics(materialize(scores), "y", PROBABILITY, ["fold"]).select("fold", "rows", "roc_auc")
    means = scores.groupBy("fold").agg(F.avg(PROBABILITY).alias("mean_probability"))
    return rounded(quality.join(means, "fold").select("fold", "rows", "mean_probability", "roc_auc"), 4)


@query(
    "i11_tuning",
    FOLDS_SQL.replace("STRENGTHS", "0.1, 0.3, 1.0")
    + """ SELECT 'regularized_logistic' AS candidate, row_number() OVER (ORDER BY c)::INTEGER AS trial, '{"C": ' || c::DOUBLE || '}' AS parameters,
       count(*)::INTEGER AS folds, round(avg(roc_auc), 4) AS roc_auc FROM quality GROUP BY c""",
)
def i11(spark: SparkSession, folder: str) -> DataFrame:
    """The grid of the candidate in order, every point scored on all folds."""
    rows = stored(spark, folder, "order_id", "y", *TWO_FEATURES)
    _, trials = modeling.tune(rows, "y", TWO_FEATURES, "regularized_logistic", "order_id", 3)
    found = spark.createDataFrame(trials, modeling.TRIAL_SCHEMA)
    return rounded(found.select("candidate", "trial", "parameters", F.size("fold_scores").alias("folds"), "roc_auc"), 4)


@query("i12_platt", facts_sql("regularized_logistic"))
def i12(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder, "regularized_logistic", "platt")


@query("i13_isotonic", facts_sql("regularized_logistic"))
def i13(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder, "regularized_logistic", "isotonic")


# The two deterministic scores stand in for two calibrations and two candidates.
@query(
    "i14_calibration_choice",
    SCORED + ", " + METRICS_SQL
    + """ SELECT partition, method FROM (SELECT partition, model AS method, row_number() OVER (PARTITION BY partition
        ORDER BY coalesce(brier, 99), coalesce(log_loss, 99), model) AS i FROM quality) WHERE i = 1""",
)
def i14(spark: SparkSession, folder: str) -> DataFrame:
    quality = metrics.binary_metrics(stored_scores(spark, folder), "y", "p", ["model", "partition"])
    return modeling.choose_calibration(quality.withColumnRenamed("model", "method"), ["partition"])


CANDIDATES = """candidates AS (SELECT model AS candidate, 'trained' AS status,
   roc_auc + 0.55 * ks - 0.12 * brier - 0.05 * violations AS selection_score FROM quality JOIN (
     SELECT model, partition, least(count(*) FILTER (WHERE step < -1e-12), count(*) FILTER (WHERE step > 1e-12)) AS violations
     FROM (SELECT *, bad_rate - lag(bad_rate) OVER (PARTITION BY model, partition ORDER BY bucket) AS step FROM lift) GROUP BY 1, 2)
   USING (model, partition) WHERE partition = 'test')"""


def _selection_sql(tail: str) -> str:
    from lendwright.plans.queries_model import LIFT_SQL

    return SCORED + ", " + METRICS_SQL + ", " + LIFT_SQL + ", " + CANDIDATES + tail


def _selected(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored_scores(spark, folder).filter("partition = 'test'")
    quality = rounded(metrics.binary_metrics(rows, "y", "p", ["model"]))
    order = metrics.score_monotonicity(metrics.lift_table(rows, "y", "p", "order_id", ["model"]), ["model"])
    score = modeling.selection_score(F.col("roc_auc"), F.col("ks"), F.col("brier"), F.col("violations"))
    return quality.join(order, "model").select(
        F.col("model").alias("candidate"), F.lit("trained").alias("status"), score.alias("selection_score")
    )


@query("i15_selection_score", _selection_sql(" SELECT candidate, status, round(selection_score, 6) AS selection_score FROM candidates"))
def i15(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_selected(spark, folder), 6)


@query("i15_champion", _selection_sql(" SELECT arg_max(candidate, selection_score) AS champion FROM candidates"))
def i15_champion(spark: SparkSession, folder: str) -> DataFrame:
    return modeling.choose_champion(_selected(spark, folder))


NUMERIC_LIST = ", ".join(f"'{f}'" for f in NUMERIC_FEATURES)


@query(
    "i16_feature_importance",
    LOAN + f""", named AS (SELECT unnest([{NUMERIC_LIST}]) AS feature UNION ALL SELECT DISTINCT 'priority_' || priority FROM frozen
       UNION ALL SELECT 'priority_<RARE>' UNION ALL SELECT DISTINCT 'segment_' || segment FROM frozen UNION ALL SELECT 'segment_<RARE>')
     SELECT feature, true AS in_range, true AS sums_to_one FROM named""",
)
def i16(spark: SparkSession, folder: str) -> DataFrame:
    """Gains of all encoded columns; they are shares of one whole."""
    rows = stored(spark, folder, "order_id", "y", *MODEL_FEATURES)
    fitted = modeling.fit_candidate(rows, "y", MODEL_FEATURES, "random_forest")
    gains = modeling.feature_importance(fitted, rows)
    total = gains.agg(F.sum("importance").alias("total"))
    return gains.crossJoin(F.broadcast(total)).select(
        "feature", F.col("importance").between(0, 1).alias("in_range"), (F.abs(F.col("total") - 1) < 1e-6).alias("sums_to_one")
    )


@query(
    "k5_batch_scoring",
    LOAN + " SELECT order_id, true AS in_range, true AS score_follows_probability FROM loan",
)
def k5(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of the version is scored, and the score is the one of its written probability."""
    from lendwright.functions.expressions import ScoreScale

    rows = stored(spark, folder, "order_id", "y", *MODEL_FEATURES)
    model = modeling.fit_calibrated(rows, "y", MODEL_FEATURES, "scorecard", "uncalibrated", "order_id")
    path, root = scratch_path(spark, "package"), scratch_path(spark, "versions")
    modeling.save_model(spark, model, path, FIELD_TYPES)
    version = write_version(loan(spark, folder).select("order_id", *MODEL_FEATURES), root, "loan")
    created, _ = score_version(spark, path, root, version, "y scorecard")
    written = read_version(spark, root, created)
    p, score = F.col("y_scorecard_score_bad_probability"), F.col("y_scorecard_score")
    return written.select(
        "order_id", p.between(0, 1).alias("in_range"), (F.abs(ScoreScale().clipped(p) - score) <= 0.5 + 1e-3).alias("score_follows_probability")
    )


@query(
    "k6_model_round_trip",
    """SELECT unnest(['regularized_logistic', 'scorecard']) AS model, 0.0::DOUBLE AS largest_difference, 9 AS fields, 2 AS categorical
       FROM (SELECT count(*) FROM orders)""",
)
def k6(spark: SparkSession, folder: str) -> DataFrame:
    """Largest difference between the scores of a model before saving and after loading, and the loaded contract."""
    rows = stored(spark, folder, "order_id", "y", *MODEL_FEATURES)
    result = None
    for name, method in (("regularized_logistic", "platt"), ("scorecard", "uncalibrated")):
        model = modeling.fit_calibrated(rows, "y", MODEL_FEATURES, name, method, "order_id")
        path = scratch_path(spark, "package")
        modeling.save_model(spark, model, path, FIELD_TYPES)
        loaded, types, _ = modeling.load_model(spark, path)
        both = loaded.score(model.score(rows, "before"), "after")
        row = both.agg(
            F.lit(name).alias("model"),
            r(F.max(F.abs(F.col("before") - F.col("after"))), 12).alias("largest_difference"),
            F.lit(len(types)).alias("fields"),
            F.lit(sum(t == "categorical" for t in types.values())).alias("categorical"),
        )
        result = row if result is None else result.unionByName(row)
    return result


CANDIDATE_MODELS = ("dummy", "scorecard", "regularized_logistic", "random_forest", "not_a_model")


@query(
    "l5_candidate_comparison",
    """SELECT candidate, status, error_code, status = 'trained' AS scored FROM (SELECT unnest(['dummy', 'scorecard', 'regularized_logistic',
       'random_forest', 'not_a_model']) AS candidate, unnest(['trained', 'trained', 'trained', 'trained', 'failed']) AS status,
       unnest([NULL, NULL, NULL, NULL, 'MODEL_UNSUPPORTED']) AS error_code FROM (SELECT count(*) FROM orders))""",
)
def l5(spark: SparkSession, folder: str) -> DataFrame:
    result = modeling.train_candidates(
        _train(spark, folder), "y", MODEL_FEATURES, "order_id", CANDIDATE_MODELS, calibrate=False, out_of_fold_metrics=False
    )
    sheet = report.comparison_sheet(result.candidates)
    return sheet.select("candidate", "status", "error_code", F.col("selection_score").isNotNull().alias("scored"))


def _run(spark: SparkSession, folder: str):
    return modelling_run(
        loan(spark, folder).drop("customer_id"), "y", "order_id",
        SplitPlan(time_column="application_date", customer_key="customer_year"), review_passed=True,
    )


@query("run_modelling")
def run(spark: SparkSession, folder: str) -> DataFrame:
    """The whole modelling run on the loan view, with calibration and out-of-fold metrics; returns the executive summary."""
    return rounded(_run(spark, folder).sheets["summary"], 6)


@query(
    "l1_run_overview",
    SPLIT_SQL
    + """ SELECT upper(partition) AS partition, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positive_count, partition <> 'train' AS has_psi
        FROM split WHERE partition <> 'excluded' GROUP BY partition""",
)
def l1_run(spark: SparkSession, folder: str) -> DataFrame:
    """The overview that the run writes from its own champion."""
    sheet = _run(spark, folder).sheets["overview"]
    return sheet.select("partition", "rows", "positive_count", F.col("psi").isNotNull().alias("has_psi"))


@query(
    "a8_report_tables",
    SCORED + ", " + METRICS_SQL + ", " + LIFT_SQL + """, buckets AS (SELECT DISTINCT model, partition, greatest(1, ceil(p * 10))::INTEGER AS b FROM scored WHERE p BETWEEN 0 AND 1)
     SELECT 'metrics' AS sheet, count(*) AS rows, count(*) AS json_lines FROM quality
     UNION ALL SELECT 'lift', count(*), count(*) FROM lift UNION ALL SELECT 'calibration', count(*), count(*) FROM buckets""",
)
def a8(spark: SparkSession, folder: str) -> DataFrame:
    """Report sheets written as Parquet and JSON lines, counted on the way back."""
    path = scratch_path(spark, "report")
    scores = stored_scores(spark, folder)
    keys = ["model", "partition"]
    sheets = {
        "metrics": metrics.binary_metrics(scores, "y", "p", keys),
        "lift": metrics.lift_table(scores, "y", "p", "order_id", keys),
        "calibration": metrics.calibration_table(scores, "y", "p", keys),
    }
    report.write_report(sheets, path)
    result = None
    for name in sheets:
        row = spark.read.parquet(f"{path}/{name}/parquet").agg(F.count("*").alias("rows"))
        lines = spark.read.text(f"{path}/{name}/json").agg(F.count("*").alias("json_lines"))
        both = row.withColumn("sheet", F.lit(name)).join(lines.withColumn("sheet", F.lit(name)), "sheet")
        result = both if result is None else result.unionByName(both)
    return result

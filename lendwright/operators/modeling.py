"""Candidate models: fit, calibrate, compare, choose, keep."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, fields, replace
from itertools import product

from pyspark import StorageLevel
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (
    OneHotEncoder,
    OneHotEncoderModel,
    SQLTransformer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from lendwright.functions import fixed_values as fixed
from lendwright.functions.expressions import (
    ScoreScale,
    as_double,
    clip_probability,
    column,
    double_sql,
    is_numeric,
    sigmoid,
    text_sql,
)
from lendwright.operators import trees
from lendwright.operators.binning import fit_binning, woe_transform
from lendwright.operators.metrics import binary_metrics, calibration_table, lift_table, psi, score_monotonicity
from lendwright.operators.order_statistics import exact_quantiles, hash_order, unpivot_values
from lendwright.operators.scoring import ScorecardRules, score_with_rules
from lendwright.operators.splits import OOT, TEST, TRAIN
from lendwright.session import cut_lineage, materialize

PROBABILITY = "probability_of_bad"
MODEL_ERRORS = (ValueError, ArithmeticError, AnalysisException, IllegalArgumentException)
RARE_SHARE = 0.005
MIN_ISOTONIC_ROWS, MIN_ISOTONIC_POSITIVES = 500, 50
MAX_TRIALS = 12
CALIBRATION_FOLDS = 3
#: Sums of the solvers depend on the order of rows, so training rows are dealt to partitions by their content, one for so
#: many rows: the same rows and seed give the same model on any number of cores. The option ``partitions`` overrides it.
ROWS_PER_PARTITION = 20_000
#: Beyond so many partitions they grow to LARGE_PARTITION_ROWS first: every partition sends partial sums of all open nodes.
SMALL_PARTITIONS = 32
LARGE_PARTITION_ROWS = 200_000


# --- class weights and folds ----------------------------------------------------------------


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class: rows, balanced weight n/(2·n_class), and negatives per positive."""
    counts = df.groupBy(column(label).alias("class")).agg(F.count("*").alias("rows"))
    whole = Window.partitionBy(F.lit(0))  # two rows
    total = F.sum("rows").over(whole)
    negatives = F.sum(F.when(F.col("class") == 0, F.col("rows"))).over(whole)
    positives = F.sum(F.when(F.col("class") == 1, F.col("rows"))).over(whole)
    return counts.select(
        "class",
        "rows",
        (total / (F.lit(2.0) * F.col("rows"))).alias("balanced_weight"),
        F.when(F.col("class") == 1, negatives / F.greatest(positives, F.lit(1)))
        .otherwise(F.lit(1.0))
        .alias("positive_scale"),
    )


def fold_count(df: DataFrame, label: str) -> int:
    """2 to 5 folds, as many as the smaller class allows."""
    rows = df.groupBy(label).count().collect()
    smallest = min((r["count"] for r in rows), default=0)
    if smallest < 2 or len(rows) < 2:
        raise ValueError("TRAIN_CLASS_COUNT_TOO_SMALL")
    return max(2, min(5, smallest))


def stratified_folds(
    df: DataFrame, label: str, row_id: str, folds: int, seed: int = 42, output: str = "fold"
) -> DataFrame:
    """Fold = rank within the class in md5 order, modulo ``folds``; exact and without a two-task window.

    The rank is the count of all smaller 4-digit digest prefixes plus the place inside the prefix, so
    a window never holds more than about 1/65,536 of a class.
    """
    prefix = F.substring("__digest", 1, 4)
    hashed = df.withColumn("__digest", hash_order(column(row_id), seed)).withColumn("__prefix", prefix)
    run = Window.partitionBy(label).orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        hashed.groupBy(label, "__prefix")
        .agg(F.count("*").alias("n"))
        .withColumn("__start", F.coalesce(F.sum("n").over(run), F.lit(0)))
        .drop("n")
    )
    inside = Window.partitionBy(label, "__prefix").orderBy("__digest", column(row_id).cast("string"))
    return (
        hashed.join(starts, [label, "__prefix"])
        .withColumn(output, ((F.col("__start") + F.row_number().over(inside) - 1) % folds).cast("int"))
        .select(*df.columns, output)
    )


# --- preprocessing --------------------------------------------------------------------------


def _name(c: str) -> str:
    return f"`{c}`"


def preprocessing(
    train: DataFrame, features: Sequence[str], *, scale: bool, rare_share: float = RARE_SHARE
) -> list:
    """Pipeline stages: median / mode imputation, rare grouping, one-hot, optional standardising.

    The statistics are exact and end up as literals of one SQL projection, so the saved pipeline
    needs no fitted state beyond its own text. A category seen nowhere in training counts as rare. An infinite number
    counts as missing, since no mean and no penalised loss exists with it.
    """
    numeric = [f for f in features if is_numeric(train.schema[f].dataType)]
    categorical = [f for f in features if f not in numeric]
    finite = train.select(
        *[
            F.when(F.abs(as_double(f, train.schema[f].dataType)) < math.inf, as_double(f, train.schema[f].dataType)).alias(f)
            for f in numeric
        ],
        *[column(f) for f in categorical],
    )
    medians = exact_quantiles(finite, numeric, [0.5])
    parts, inputs, stages = [], [], []
    filled = {f: (medians[f] or [0.0])[0] for f in numeric}
    spread = {f: (0.0, 1.0) for f in numeric}
    if scale and numeric:
        seen = finite.select(
            *[F.coalesce(column(f), F.lit(filled[f])).alias(f"v{i}") for i, f in enumerate(numeric)]
        ).agg(
            *[F.avg(f"v{i}").alias(f"m{i}") for i in range(len(numeric))],
            *[F.stddev_pop(f"v{i}").alias(f"s{i}") for i in range(len(numeric))],
        ).first()
        spread = {f: (seen[f"m{i}"], seen[f"s{i}"] or 1.0) for i, f in enumerate(numeric)}
    for i, f in enumerate(numeric):
        mean, deviation = spread[f]
        number = f"nullif(try_cast({_name(f)} AS DOUBLE), double('NaN'))"
        value = f"coalesce(CASE WHEN abs({number}) < double('Infinity') THEN {number} END, {double_sql(filled[f])})"
        parts.append(f"({value} - {double_sql(mean)}) / {double_sql(deviation)} AS __n{i}")
        inputs.append(f"__n{i}")
    if categorical:
        total = train.count()
        # Counted once; mode, known values and kept categories come from this small table.
        counts = materialize(
            train.select(unpivot_values([(f, [column(f).cast("string")]) for f in categorical], ["value"]))
            .filter(F.col("value").isNotNull())
            .groupBy("feature", "value")
            .agg(F.count("*").alias("n")),
            "categories",
        )
        # Categories above the share: at most 1/share per feature. The mode is among the most frequent.
        modes = {
            r["feature"]: r["mode"]
            for r in counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode")).collect()
        }
        present = counts.groupBy("feature").agg(F.sum("n").alias("known"))
        known = {r["feature"]: r["known"] for r in present.collect()}
        kept: dict[str, list[str]] = {f: [] for f in categorical}
        for r in counts.filter(F.col("n") >= rare_share * total).collect():
            kept[r["feature"]].append(r["value"])
        for f in categorical:
            mode = modes.get(f, fixed.MISSING)
            if mode not in kept[f] and total - known.get(f, 0) + 1 >= rare_share * total:
                kept[f].append(mode)
        for i, f in enumerate(categorical):
            labels = sorted(kept[f])
            text = f"coalesce(CAST({_name(f)} AS STRING), {text_sql(modes.get(f, fixed.MISSING))})"
            listed = ", ".join(text_sql(v) for v in labels) or "NULL"
            parts.append(f"CASE WHEN {text} IN ({listed}) THEN {text} ELSE {text_sql(fixed.RARE)} END AS __t{i}")
        stages = [
            StringIndexerModel.from_arrays_of_labels(
                [[*sorted(kept[f]), fixed.RARE] for f in categorical],
                inputCols=[f"__t{i}" for i in range(len(categorical))],
                outputCols=[f"__i{i}" for i in range(len(categorical))],
                handleInvalid="keep",
            ),
            OneHotEncoder(
                inputCols=[f"__i{i}" for i in range(len(categorical))],
                outputCols=[f"__o{i}" for i in range(len(categorical))],
                dropLast=True,
            ),
        ]
        inputs += [f"__o{i}" for i in range(len(categorical))]
    projection = SQLTransformer(statement=f"SELECT *, 1.0D AS __one, {', '.join(parts)} FROM __THIS__")
    return [projection, *stages, VectorAssembler(inputCols=inputs, outputCol="__features")]


# --- candidate definitions ------------------------------------------------------------------

# Presets of the candidates; anything here can be overridden per run. Fixed values.
PRESETS: dict[str, dict] = {
    "dummy": {},
    "scorecard": {"C": 1.0, "max_iter": 800},
    "regularized_logistic": {"C": 0.3, "max_iter": 1000},
    "random_forest": {"trees": 240, "depth": 8, "leaf": 20},
    "forest_nobootstrap": {"trees": 240, "depth": 9, "leaf": 15},
    "boosted_depth4": {
        "policy": "depthwise", "rounds": 300, "rate": 0.035, "depth": 4, "rows": 0.85, "columns": 0.8, "penalty": 3.0
    },
    "boosted_depth6": {
        "policy": "leafwise", "rounds": 300, "rate": 0.035, "depth": 6, "leaves": 20, "penalty": 0.0,
        "least_rows": 20, "least_hessian": 0.001,
    },
    "boosted_balanced": {"policy": "symmetric", "rounds": 300, "rate": 0.035, "depth": 6, "penalty": 3.0},
}

# Bounded search spaces. Fixed values.
SEARCH: dict[str, dict[str, list]] = {
    "regularized_logistic": {"C": [0.1, 0.3, 1.0]},
    "random_forest": {"depth": [5, 8, 12], "leaf": [10, 20]},
    "forest_nobootstrap": {"depth": [6, 9, 12], "leaf": [10, 15]},
    "boosted_depth4": {"depth": [3, 4], "rate": [0.025, 0.05]},
    "boosted_depth6": {"depth": [4, 6], "rate": [0.025, 0.05]},
    "boosted_balanced": {"depth": [4, 6], "rate": [0.025, 0.05]},
}


@dataclass
class Fitted:
    """A fitted candidate: a pipeline, a pipeline that prepares the features of a tree ensemble, scorecard rules, or a constant."""

    name: str
    features: list[str]
    pipeline: PipelineModel | None = None
    rules: ScorecardRules | None = None
    constant: float | None = None
    ensemble: trees.Ensemble | None = None

    def score(self, df: DataFrame, output: str = PROBABILITY) -> DataFrame:
        if self.constant is not None:
            return df.withColumn(output, F.lit(self.constant))
        if self.rules is not None:
            return score_with_rules(df, self.rules, output)
        scored = self.pipeline.transform(df)
        if self.ensemble is not None:
            return trees.score(scored, vector_to_array("__features"), self.ensemble, output).select(*df.columns, output)
        return scored.select(*df.columns, vector_to_array("probability")[1].alias(output))


def fit_candidate(
    train: DataFrame, label: str, features: Sequence[str], name: str, options: Mapping | None = None
) -> Fitted:
    return fit_grid(train, label, features, name, [options or {}])[0]


def fit_grid(train: DataFrame, label: str, features: Sequence[str], name: str, grid: Sequence[Mapping]) -> list[Fitted]:
    """The candidate fitted with each of the options on the same rows; the logistic regression prepares them once."""
    if name not in PRESETS:
        raise ValueError(f"MODEL_UNSUPPORTED: {name}")
    features = list(features)
    if name == "dummy":
        return [Fitted(name, features, constant=float(train.agg(F.avg(label)).first()[0])) for _ in grid]
    counts = {r["class"]: r for r in class_weights(train, label).collect()}
    if len(counts) < 2:
        raise ValueError("TRAIN_SINGLE_CLASS")
    points = [{**PRESETS[name], **options} for options in grid]
    if name == "regularized_logistic" and len({p.get("partitions") for p in points}) == 1:
        return _fit_regularized(train, label, features, points, counts)
    return [_fit_with(train, label, features, name, settings, counts) for settings in points]


def _fit_with(
    train: DataFrame, label: str, features: list[str], name: str, settings: Mapping, counts: Mapping[int, Row]
) -> Fitted:
    if name == "regularized_logistic":
        return _fit_regularized(train, label, features, [settings], counts)[0]
    if name == "boosted_depth4":
        weights = {0: 1.0, 1: counts[1]["positive_scale"]}
    else:
        weights = _balanced(counts)
    if name in ("random_forest", "forest_nobootstrap") or name.startswith("boosted"):  # sums of whole numbers need no dealing
        return _fit_trees(train.select(*[column(c) for c in dict.fromkeys([label, *features])]), label, features, name, settings, weights)
    return _fit_scorecard(train, _weighted(train, label, features, settings, counts), label, features, settings, _rows(counts))


def _rows(counts: Mapping[int, Row]) -> int:
    return sum(r["rows"] for r in counts.values())


def _balanced(counts: Mapping[int, Row]) -> dict[int, float]:
    return {k: counts[k]["balanced_weight"] for k in (0, 1)}


def _weighted(train: DataFrame, label: str, features: Sequence[str], settings: Mapping, counts: Mapping[int, Row]) -> DataFrame:
    weights = _balanced(counts)
    partitions = settings.get("partitions") or training_partitions(_rows(counts))
    return _dealt(train, features, label, partitions).withColumn(
        "__weight", F.when(F.col(label) == 1, F.lit(float(weights[1]))).otherwise(F.lit(float(weights[0])))
    ).withColumn("__label", F.col(label).cast("double"))


BOOSTING_SETTINGS = tuple(f.name for f in fields(trees.BoostingPlan))


def _fit_trees(
    train: DataFrame, label: str, features: Sequence[str], name: str, settings: Mapping, weights: Mapping[int, float]
) -> Fitted:
    """Ensembles of ``trees``. The pipeline only prepares the features, so that scoring is a projection."""
    key = F.xxhash64(*[column(c) for c in (label, *features)]).alias("key")
    y = F.col(label).cast("int").alias("y")
    if settings.get("policy") == "symmetric":
        stages, ready, values = _coded(train, label, features)
    else:
        stages = preprocessing(train, features, scale=False)
        ready, values = None, vector_to_array("__features")
    prepared = Pipeline(stages=stages).fit(train)
    ready = prepared.transform(train) if ready is None else ready
    rows = materialize(ready.select(values.alias("x"), y, key), "tree-rows")
    first = rows.select(F.size("x")).first()
    width = first[0] if first else 0
    if name in ("random_forest", "forest_nobootstrap"):
        sizes = {k: settings[k] for k in ("trees", "depth", "leaf")}
        grow = trees.grow_random_forest if name == "random_forest" else trees.grow_extra_trees
        grown = grow(rows, width, weights=weights, **sizes)
    else:
        plan = trees.BoostingPlan(**{k: settings[k] for k in BOOSTING_SETTINGS if k in settings})
        grown = trees.grow_boosted(rows, width, plan, weights)
    return Fitted(name, list(features), pipeline=prepared, ensemble=grown)


def _coded(train: DataFrame, label: str, features: Sequence[str]) -> tuple[list, DataFrame, Column]:
    """Stages that code categories by the label's mean, and training rows whose codes know earlier rows only.

    Rare categories were grouped before, so a feature has at most 1 / ``RARE_SHARE`` codes.
    """
    projection = preprocessing(train, features, scale=False)[0]
    numeric = [f for f in features if is_numeric(train.schema[f].dataType)]
    groups = [f"__t{i}" for i in range(len(features) - len(numeric))]
    grouped = materialize(projection.transform(train), "grouped")
    prior = float(grouped.agg(F.avg(label)).first()[0])
    order = F.md5(F.xxhash64(*[column(c) for c in (label, *features)]).cast("string"))
    ordered = trees.ordered_target_codes(grouped, groups, label, order, prior)
    parts = []
    for i, group in enumerate(groups):
        codes = sorted(trees.target_codes(grouped, group, label, prior).collect(), key=lambda r: r["category"])
        listed = " ".join(f"WHEN {text_sql(r['category'])} THEN {double_sql(r['code'])}" for r in codes)
        parts.append(f"CASE {group} {listed} ELSE {double_sql(prior)} END AS __c{i}")
    inputs = [f"__n{i}" for i in range(len(numeric))] + [f"__c{i}" for i in range(len(groups))]
    stages = [projection]
    if parts:
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__"))
    stages.append(VectorAssembler(inputCols=inputs, outputCol="__features"))
    values = F.array(*[F.col(f"__n{i}") for i in range(len(numeric))], *[F.col(f"{g}_code") for g in groups])
    return stages, ordered, values


def training_partitions(rows: int) -> int:
    """Depends on the number of rows alone, so that a model does, too."""
    return max(min(math.ceil(rows / ROWS_PER_PARTITION), SMALL_PARTITIONS), math.ceil(rows / LARGE_PARTITION_ROWS))


def _dealt(train: DataFrame, features: Sequence[str], label: str, partitions: int) -> DataFrame:
    """The needed columns in partitions and an order that depend on the rows' content alone."""
    key = F.xxhash64(*[column(c) for c in (label, *features)])
    rows = train.select(*[column(c) for c in dict.fromkeys([label, *features])]).withColumn("__deal", key)
    dealt = rows.repartition(partitions, "__deal").sortWithinPartitions("__deal", *[column(c) for c in (label, *features)])
    return dealt.drop("__deal")


def _logistic(inputs: str, settings: Mapping, rows: int) -> LogisticRegression:
    """L2 logistic regression whose constant is one more penalised coefficient.

    The loss is a weighted mean here, so strength C over n rows becomes 1 / (C · Σ weights); balanced
    weights add up to n. A constant column would be dropped by the solver, so callers mirror half of
    the rows: (x, 1, y) and (−x, −1, 1−y) have the same loss, and the column is no longer constant.
    """
    return LogisticRegression(
        featuresCol=inputs, labelCol="__label", weightCol="__weight", regParam=1.0 / (settings["C"] * rows),
        elasticNetParam=0.0, standardization=False, fitIntercept=False, maxIter=settings["max_iter"], tol=1e-7,
    )


@contextmanager
def _kept(ready: DataFrame) -> Iterator[DataFrame]:
    """Prepared rows on local disks, in the partitions and order they were dealt to.

    The solver passes over its input twice before it keeps blocks of its own; without this every pass deals, sorts and
    prepares all rows again.
    """
    rows = ready.persist(StorageLevel.DISK_ONLY)
    try:
        yield rows
    finally:
        rows.unpersist()


def _fit_regularized(
    train: DataFrame, label: str, features: list[str], points: Sequence[Mapping], counts: Mapping[int, Row]
) -> list[Fitted]:
    """One model for each of the settings, over rows that are prepared once."""
    weighted = _weighted(train, label, features, points[0], counts)
    stages = preprocessing(train, features, scale=True)
    stages.append(VectorAssembler(inputCols=["__features", "__one"], outputCol="__with_constant"))
    prepared = Pipeline(stages=stages).fit(weighted)
    signed = prepared.stages[0].transform(weighted).withColumn("__sign", _sign(features))
    values = F.expr(f"array({', '.join(f'{c} * __sign' for c in _encoded_values(prepared, features, train))}, __one * __sign)")
    mirrored = signed.select(array_to_vector(values).alias("__mirrored"), _mirrored_label().alias("__label"), "__weight")
    fitted = []
    with _kept(mirrored) as kept:
        for settings in points:
            model = _logistic("__mirrored", settings, _rows(counts)).fit(kept).setFeaturesCol("__with_constant")
            fitted.append(Fitted("regularized_logistic", features, pipeline=PipelineModel(stages=[*prepared.stages, model])))
    return fitted


def _encoded_values(pipeline: PipelineModel, features: Sequence[str], df: DataFrame) -> list[str]:
    """SQL texts of the numbers that the pipeline assembles, from the columns of its projection."""
    numeric = [f for f in features if is_numeric(df.schema[f].dataType)]
    indexer = next((s for s in pipeline.stages if isinstance(s, StringIndexerModel)), None)
    kinds = indexer.labelsArray if indexer is not None else []
    ones = [f"CASE WHEN __t{i} = {text_sql(v)} THEN 1.0D ELSE 0.0D END" for i, labels in enumerate(kinds) for v in labels]
    return [f"__n{i}" for i in range(len(numeric))] + ones


def _sign(features: Sequence[str]) -> Column:
    """+1 or −1 by a hash of the row, so that a repeated task mirrors the same rows."""
    even = F.pmod(F.xxhash64(*[column(f) for f in features], F.col("__label")), F.lit(2)) == 0
    return F.when(even, F.lit(1.0)).otherwise(F.lit(-1.0))


def _mirrored_label() -> Column:
    return F.when(F.col("__sign") > 0, F.col("__label")).otherwise(F.lit(1.0) - F.col("__label"))


def _fit_scorecard(
    train: DataFrame, dealt: DataFrame, label: str, features: Sequence[str], settings: Mapping, rows: int
) -> Fitted:
    binning = fit_binning(train, label, features)
    woe = woe_transform(dealt, binning).withColumn("__sign", _sign(features))
    mirrored = woe.select(
        *[(F.col(f"`{f}_woe`") * F.col("__sign")).alias(f"__x{i}") for i, f in enumerate(features)],
        F.col("__sign").alias("__constant"),
        _mirrored_label().alias("__label"),
        "__weight",
    )
    inputs = [*[f"__x{i}" for i in range(len(features))], "__constant"]
    ready = VectorAssembler(inputCols=inputs, outputCol="__features").transform(mirrored)
    with _kept(ready.select("__features", "__label", "__weight")) as kept:
        values = [float(v) for v in _logistic("__features", settings, rows).fit(kept).coefficients]
    return Fitted("scorecard", list(features), rules=ScorecardRules(list(features), values[:-1], values[-1], binning))


# --- calibration ----------------------------------------------------------------------------


@dataclass
class Calibrated:
    """One candidate with its calibration: the average over fold models, or the plain model."""

    name: str
    method: str
    members: list[tuple[Fitted, object]] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return self.members[0][0].features

    def score(self, df: DataFrame, output: str = PROBABILITY) -> DataFrame:
        scored, parts = df, []
        for i, (fitted, curve) in enumerate(self.members):
            raw = f"__raw{i}"
            scored = fitted.score(scored, raw)
            if curve is None:
                parts.append(F.col(raw))
            elif isinstance(curve, tuple):
                slope, shift = curve
                parts.append(sigmoid(F.lit(slope) * _log_odds(F.col(raw)) + F.lit(shift)))
            else:
                scored = _isotonic(curve, scored, raw, f"__iso{i}")
                parts.append(F.col(f"__iso{i}"))
        mean = parts[0]
        for part in parts[1:]:
            mean = mean + part
        return scored.select(*df.columns, (mean / F.lit(float(len(parts)))).alias(output))


def _log_odds(p: Column) -> Column:
    safe = clip_probability(p)
    return F.log(safe / (F.lit(1.0) - safe))


def _isotonic(model: IsotonicRegressionModel, df: DataFrame, raw: str, output: str) -> DataFrame:
    return model.copy({model.featuresCol: raw, model.predictionCol: output}).transform(df)


def folded_rows(train: DataFrame, label: str, row_id: str, folds: int) -> DataFrame:
    """Training rows with their fold, written once."""
    return cut_lineage(stratified_folds(train, label, row_id, folds, output="__fold"))


def fold_fits(
    folded: DataFrame, label: str, features: Sequence[str], name: str, options: Mapping | None = None,
    folds: int = CALIBRATION_FOLDS,
) -> list[tuple[Fitted, DataFrame]]:
    """A model for each held-out fold of ``folded_rows``, and the label and raw score of the rows it has not seen."""
    out = []
    for k in range(folds):
        fitted = fit_candidate(folded.filter(F.col("__fold") != k), label, features, name, options)
        held = fitted.score(folded.filter(F.col("__fold") == k), "__raw")
        out.append((fitted, held.select(F.col(label).cast("double").alias("__label"), "__raw")))
    return out


def fit_calibrated(
    train: DataFrame,
    label: str,
    features: Sequence[str],
    name: str,
    method: str,
    row_id: str,
    options: Mapping | None = None,
    folds: int = CALIBRATION_FOLDS,
    fits: Sequence[tuple[Fitted, DataFrame]] | None = None,
) -> Calibrated:
    """``platt`` and ``isotonic`` average over fold models, each calibrated on its held-out fold; ``fits`` are such models
    of ``fold_fits``, which do not depend on the method."""
    if method == "uncalibrated":
        return Calibrated(name, method, [(fit_candidate(train, label, features, name, options), None)])
    members = []
    for fitted, held in fits or fold_fits(folded_rows(train, label, row_id, folds), label, features, name, options, folds):
        if method == "platt":
            vector = VectorAssembler(inputCols=["__z"], outputCol="__v").transform(
                held.withColumn("__z", _log_odds(F.col("__raw")))
            )
            curve = LogisticRegression(featuresCol="__v", labelCol="__label", standardization=False).fit(vector)
            members.append((fitted, (float(curve.coefficients[0]), float(curve.intercept))))
        elif method == "isotonic":
            members.append(
                (fitted, IsotonicRegression(featuresCol="__raw", labelCol="__label").fit(held))
            )
        else:
            raise ValueError(f"CALIBRATION_UNSUPPORTED: {method}")
    return Calibrated(name, method, members)


def calibration_methods(name: str, rows: int, positives: int) -> list[str]:
    if name == "scorecard":
        return ["uncalibrated"]
    methods = ["uncalibrated", "platt"]
    if rows >= MIN_ISOTONIC_ROWS and positives >= MIN_ISOTONIC_POSITIVES:
        methods.append("isotonic")
    return methods


def choose_calibration(comparison: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Lowest Brier score, then log loss; a missing value counts as 99."""
    order = F.struct(F.coalesce("brier", F.lit(99.0)), F.coalesce("log_loss", F.lit(99.0)), F.col("method"))
    return comparison.groupBy(*keys).agg(F.min_by("method", order).alias("method"))


# --- selection ------------------------------------------------------------------------------


def selection_score(auc: Column, ks: Column, brier: Column, violations: Column) -> Column:
    """AUC + 0.55·KS − 0.12·Brier − 0.05 per ordering violation.

    A Brier score of exactly 0 counts as 1 and an unknown violation count as one violation.
    """
    safe_brier = F.when(F.coalesce(brier, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(brier)
    penalty = F.lit(0.05) * F.coalesce(violations, F.lit(1))
    return (
        F.coalesce(auc, F.lit(0.0)) + F.lit(0.55) * F.coalesce(ks, F.lit(0.0)) - F.lit(0.12) * safe_brier - penalty
    )


def choose_champion(candidates: DataFrame) -> DataFrame:
    """Highest selection score among trained candidates; the dummy only when it is alone."""
    trained = candidates.filter(F.col("status") == "trained")
    return trained.agg(
        F.max_by(
            "candidate",
            F.struct(F.col("candidate") != "dummy", F.col("selection_score"), F.col("candidate")),
        ).alias("champion")
    )


CANDIDATE_SCHEMA = (
    "candidate string, status string, error_code string, calibration string, test_auc double, test_ks double, "
    "test_brier double, test_log_loss double, oof_auc double, violations long, train_test_psi double, "
    "selection_score double, champion boolean"
)


@dataclass
class TrainingResult:
    candidates: DataFrame
    champion: str
    models: dict[str, Calibrated]
    metrics: DataFrame
    calibrations: DataFrame
    trials: DataFrame
    scores: DataFrame
    lift: DataFrame
    ordering: DataFrame
    stability: DataFrame
    calibration: DataFrame
    importance: DataFrame


def out_of_fold(
    train: DataFrame, label: str, features: Sequence[str], name: str, row_id: str, options: Mapping | None = None,
    folds: int | None = None, folded: DataFrame | None = None,
) -> DataFrame:
    """Every training row scored by a model that has not seen its fold; ``folded`` are the ``folded_rows`` if they exist."""
    k = folds or fold_count(train, label)
    folded = folded_rows(train, label, row_id, k) if folded is None else folded
    result = None
    for fold in range(k):
        fitted = fit_candidate(folded.filter(F.col("__fold") != fold), label, features, name, options)
        part = fitted.score(folded.filter(F.col("__fold") == fold))
        result = part if result is None else result.unionByName(part)
    return result.withColumnRenamed("__fold", "fold")


def search_space(name: str) -> list[dict]:
    """All combinations of the candidate's bounded grid."""
    space = SEARCH.get(name, {})
    names = sorted(space)
    return [dict(zip(names, values)) for values in product(*[space[n] for n in names])] if names else []


TRIAL_SCHEMA = "candidate string, trial int, parameters string, roc_auc double, fold_scores array<double>"


def tune(
    train: DataFrame, label: str, features: Sequence[str], name: str, row_id: str, budget: int,
    options: Mapping | None = None,
) -> tuple[dict, list[tuple]]:
    """Best options by mean cross-validated AUC over at most ``budget`` grid points; training rows only."""
    base = dict(options or {})
    if budget > MAX_TRIALS:
        raise ValueError(f"SEARCH_BUDGET_TOO_LARGE: {budget}")
    if budget <= 0 or name in ("dummy", "scorecard"):
        return base, []
    trials, best, best_score = [], base, -math.inf
    k = fold_count(train, label)
    folded = folded_rows(train, label, row_id, k)
    # numBins=0 keeps every distinct score: the exact area.
    area = BinaryClassificationEvaluator(rawPredictionCol=PROBABILITY, labelCol="__label", numBins=0)
    points = search_space(name)[:budget]
    areas: list[list[float]] = [[] for _ in points]
    for fold in range(k):
        fits = fit_grid(folded.filter(F.col("__fold") != fold), label, features, name, [{**base, **p} for p in points])
        for scores, fitted in zip(areas, fits):
            held = fitted.score(folded.filter(F.col("__fold") == fold)).withColumn(
                "__label", F.col(label).cast("double")
            )
            scores.append(float(area.evaluate(held)))
    for number, (point, scores) in enumerate(zip(points, areas), 1):
        settings = {**base, **point}
        mean = sum(scores) / len(scores)
        trials.append((name, number, json.dumps(point, sort_keys=True), mean, scores))
        if mean > best_score:
            best, best_score = settings, mean
    return best, trials


def train_candidates(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    row_id: str,
    models: Sequence[str] = ("dummy", "scorecard", "regularized_logistic", "boosted_depth4"),
    *,
    options: Mapping[str, Mapping] | None = None,
    search_budget: int = 0,
    partition: str = "partition",
    calibrate: bool = True,
    out_of_fold_metrics: bool = True,
) -> TrainingResult:
    """Fit all candidates on train, calibrate and choose on test; out-of-time rows are only reported.

    A candidate that fails stays in the table with an error code.
    """
    spark = df.sparkSession
    features = list(features)
    requested = list(dict.fromkeys(models))
    if not any(m in PRESETS for m in requested):
        raise ValueError("NO_AVAILABLE_MODELS")
    frozen = cut_lineage(df.select(*dict.fromkeys([row_id, label, partition, *features])))
    train = frozen.filter(F.col(partition) == TRAIN)
    held = frozen.filter(F.col(partition).isin(TRAIN, TEST))
    sizes = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    rows, positives = sum(sizes.values()), sizes.get(1, 0)
    k = fold_count(train, label)
    dealt: dict[int, DataFrame] = {}  # by the number of folds, for all candidates

    def folded(count: int) -> DataFrame:
        if count not in dealt:
            dealt[count] = folded_rows(train, label, row_id, count)
        return dealt[count]

    table, chosen, comparison, trials = [], {}, [], []
    for name in requested:
        if name not in PRESETS:
            table.append((name, "failed", "MODEL_UNSUPPORTED", *[None] * 9, False))
            continue
        try:
            settings, tried = tune(
                train, label, features, name, row_id, search_budget, (options or {}).get(name)
            )
            trials += tried
            oof = None
            if out_of_fold_metrics:
                scored = out_of_fold(train, label, features, name, row_id, settings, k, folded(k))
                oof = binary_metrics(scored, label, PROBABILITY).first()["roc_auc"]
            methods = calibration_methods(name, rows, positives) if calibrate else ["uncalibrated"]
            tested, fits = [], None
            for method in methods:
                if method != "uncalibrated" and fits is None:
                    fits = fold_fits(folded(CALIBRATION_FOLDS), label, features, name, settings, CALIBRATION_FOLDS)
                model = fit_calibrated(train, label, features, name, method, row_id, settings, CALIBRATION_FOLDS, fits)
                scored = cut_lineage(model.score(held).select(row_id, label, partition, PROBABILITY))
                metrics = {r[partition]: r for r in binary_metrics(scored, label, PROBABILITY, [partition]).collect()}
                test = metrics[TEST]
                tested.append((method, model, scored, metrics))
                comparison.append((name, method, test["brier"], test["log_loss"], test["roc_auc"]))
            quality = spark.createDataFrame(
                [(t[0], t[3][TEST]["brier"], t[3][TEST]["log_loss"]) for t in tested], "method string, brier double, log_loss double"
            )
            best_method = choose_calibration(quality).first()["method"]
            method, model, scored, metrics = next(t for t in tested if t[0] == best_method)
            lift = lift_table(scored.filter(F.col(partition) == TEST), label, PROBABILITY, row_id)
            order = score_monotonicity(lift).first()
            moved = psi(scored, PROBABILITY, partition, [(TRAIN, TEST)]).first()["psi"]
            test = metrics[TEST]
            table.append(
                (
                    name, "trained", None, method, test["roc_auc"], test["ks"], test["brier"], test["log_loss"], oof,
                    order["violations"], moved, None, False,
                )
            )
            chosen[name] = model
        except MODEL_ERRORS as error:  # a failing candidate must not end the comparison, a failing cluster must
            table.append((name, "failed", f"MODEL_FIT_FAILED_{type(error).__name__.upper()}", *[None] * 9, False))
    if not chosen:
        raise ValueError("NO_SUCCESSFUL_MODELS")
    score = selection_score(F.col("test_auc"), F.col("test_ks"), F.col("test_brier"), F.col("violations"))
    compared = spark.createDataFrame(table, CANDIDATE_SCHEMA).withColumn(
        "selection_score", F.when(F.col("status") == "trained", score)
    )
    best = choose_champion(compared).first()["champion"]
    compared = compared.withColumn("champion", F.col("candidate") == best)
    final = cut_lineage(chosen[best].score(frozen).select(row_id, label, partition, PROBABILITY))
    parts = final.filter(F.col(partition).isin(TRAIN, TEST, OOT))
    present = {r[0] for r in parts.select(partition).distinct().collect()}
    pairs = [(a, b) for a, b in ((TRAIN, TEST), (TEST, OOT)) if {a, b} <= present]
    lift = lift_table(parts, label, PROBABILITY, row_id, [partition])
    return TrainingResult(
        compared,
        best,
        chosen,
        binary_metrics(parts, label, PROBABILITY, [partition]),
        spark.createDataFrame(
            comparison, "candidate string, method string, brier double, log_loss double, roc_auc double"
        ),
        spark.createDataFrame(trials, TRIAL_SCHEMA),
        scores=final,
        lift=lift,
        ordering=score_monotonicity(lift, [partition]),
        stability=psi(final, PROBABILITY, partition, pairs),
        calibration=calibration_table(parts, label, PROBABILITY, [partition]),
        importance=feature_importance(chosen[best], frozen),
    )


# --- importance and persistence -------------------------------------------------------------


def feature_importance(model: Calibrated | Fitted, df: DataFrame) -> DataFrame:
    """Tree gain, absolute coefficients, or signed scorecard coefficients; strongest first."""
    fitted = model.members[0][0] if isinstance(model, Calibrated) else model
    spark = df.sparkSession
    schema = "feature string, importance double"
    if fitted.rules is not None:
        rows = list(zip(fitted.features, fitted.rules.coefficients))
    elif fitted.pipeline is None:
        rows = []
    else:
        last: Transformer = fitted.pipeline.stages[-1]
        names = _encoded_names(fitted.pipeline, fitted.features, df)
        if fitted.ensemble is not None:
            values = fitted.ensemble.gains(len(names))
        elif hasattr(last, "featureImportances"):
            values = last.featureImportances.toArray()
        else:
            values = [abs(v) for v in last.coefficients.toArray()[: len(names)]]
        rows = [(n, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, schema).orderBy(F.col("importance").desc(), "feature")


def _encoded_names(pipeline: PipelineModel, features: Sequence[str], df: DataFrame) -> list[str]:
    numeric = [f for f in features if is_numeric(df.schema[f].dataType)]
    names = list(numeric)
    indexer = next((s for s in pipeline.stages if isinstance(s, StringIndexerModel)), None)
    if indexer is not None:
        categorical = [f for f in features if f not in numeric]
        for f, labels in zip(categorical, indexer.labelsArray):
            names += [f"{f}_{v}" for v in labels]
    elif not any(isinstance(s, OneHotEncoderModel) for s in pipeline.stages):
        names += [f for f in features if f not in numeric]
    return names


def _write_text(spark: SparkSession, path: str, value: Mapping) -> None:
    text = json.dumps(value, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))


def save_model(
    spark: SparkSession, model: Calibrated, path: str, field_types: Mapping[str, str], scale: ScoreScale = ScoreScale()
) -> None:
    """Folder with the fold pipelines, calibration curves, field contract and score scale."""
    path = path.rstrip("/")
    members = []
    for i, (fitted, curve) in enumerate(model.members):
        if fitted.pipeline is not None:
            fitted.pipeline.write().overwrite().save(f"{path}/member={i}/pipeline")
        if fitted.ensemble is not None:
            _write_text(spark, f"{path}/member={i}/ensemble", fitted.ensemble.to_json())
        for k, spec in enumerate(fitted.rules.binning.specs.values() if fitted.rules else ()):
            if spec.rare_table:
                spark.read.parquet(spec.rare_table).write.mode("overwrite").parquet(f"{path}/member={i}/rare={k}")
        isotonic = isinstance(curve, IsotonicRegressionModel)
        if isotonic:
            curve.write().overwrite().save(f"{path}/member={i}/isotonic")
        members.append(
            {
                "constant": fitted.constant,
                "rules": fitted.rules.to_json() if fitted.rules else None,
                "pipeline": fitted.pipeline is not None,
                "ensemble": fitted.ensemble is not None,
                "platt": list(curve) if isinstance(curve, tuple) else None,
                "isotonic": isotonic,
            }
        )
    _write_text(
        spark,
        f"{path}/model",
        {
            "name": model.name, "method": model.method, "features": model.features, "members": members,
            "field_types": dict(field_types), "scale": asdict(scale),
        },
    )


def _with_dictionaries(rules: ScorecardRules, path: str) -> ScorecardRules:
    """The rules with the dictionary tables that were saved beside them."""
    specs = rules.binning.specs
    own = {f: replace(s, rare_table=f"{path}/rare={k}") if s.rare_table else s for k, (f, s) in enumerate(specs.items())}
    return replace(rules, binning=replace(rules.binning, specs=own))


def load_model(spark: SparkSession, path: str) -> tuple[Calibrated, dict[str, str], ScoreScale]:
    path = path.rstrip("/")
    stored = _read_text(spark, f"{path}/model")
    members = []
    for i, m in enumerate(stored["members"]):
        fitted = Fitted(
            stored["name"],
            stored["features"],
            pipeline=PipelineModel.load(f"{path}/member={i}/pipeline") if m["pipeline"] else None,
            rules=_with_dictionaries(ScorecardRules.from_json(m["rules"]), f"{path}/member={i}") if m["rules"] else None,
            constant=m["constant"],
            ensemble=trees.Ensemble.from_json(_read_text(spark, f"{path}/member={i}/ensemble")) if m.get("ensemble") else None,
        )
        curve = tuple(m["platt"]) if m["platt"] else None
        if m["isotonic"]:
            curve = IsotonicRegressionModel.load(f"{path}/member={i}/isotonic")
        members.append((fitted, curve))
    return Calibrated(stored["name"], stored["method"], members), stored["field_types"], ScoreScale(**stored["scale"])

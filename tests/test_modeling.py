"""Models are checked by their properties and against a Newton solver."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendwright.operators import metrics, modeling
from lendwright.operators.modeling import PROBABILITY
from lendwright.session import materialize

FAST = {"random_forest": {"trees": 5, "depth": 4}, "boosted_depth4": {"rounds": 3, "rate": 0.3}}


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    n = 600
    income = rng.normal(8000, 1500, n)
    segment = rng.choice(["A", "B", "C"], n)
    noise = rng.random(n)
    y = ((income < 7500) | ((segment == "C") & (noise < 0.7))).astype(int)
    income[rng.random(n) < 0.05] = np.nan
    part = np.where(np.arange(n) % 6 == 0, "test", np.where(np.arange(n) % 6 == 1, "oot", "train"))
    rows = [(i, float(a), str(b) if i % 40 else None, int(c), str(d)) for i, (a, b, c, d) in enumerate(zip(income, segment, y, part))]
    return materialize(spark.createDataFrame(rows, "id int, income double, segment string, y int, partition string"))


def auc(df):
    return metrics.binary_metrics(df, "y", PROBABILITY).first()["roc_auc"]


@pytest.mark.parametrize("name", ["scorecard", "regularized_logistic", "random_forest", "boosted_depth4"])
def test_models_rank(sample, name):
    train, test = sample.filter("partition = 'train'"), sample.filter("partition = 'test'")
    model = modeling.fit_candidate(train, "y", ["income", "segment"], name, FAST.get(name))
    scored = materialize(model.score(test))
    assert scored.count() == test.count() and scored.filter(F.col(PROBABILITY).between(0, 1)).count() == test.count()
    assert auc(scored) > 0.8
    assert modeling.feature_importance(model, train).count() >= 2


def newton(x, y, w, strength):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = beta / strength + x.T @ (w * (p - y))
        hessian = np.eye(len(beta)) / strength + (x * (w * p * (1 - p))[:, None]).T @ x
        beta = beta - np.linalg.solve(hessian, gradient)
    return beta


def test_scorecard_equals_newton(spark, sample):
    from lendwright.operators.binning import woe_transform

    train = sample.filter("partition = 'train'")
    model = modeling.fit_candidate(train, "y", ["income", "segment"], "scorecard")
    woe = woe_transform(train, model.rules.binning).select("income_woe", "segment_woe", "y").toPandas()
    y = woe["y"].to_numpy(float)
    weights = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    x = np.column_stack([woe["income_woe"], woe["segment_woe"], np.ones(len(y))])
    want = newton(x, y, weights, 1.0)
    np.testing.assert_allclose([*model.rules.coefficients, model.rules.intercept], want, atol=1e-4)


def test_logistic_equals_newton(spark, sample):
    from pyspark.ml.functions import vector_to_array

    train = sample.filter("partition = 'train'")
    model = modeling.fit_candidate(train, "y", ["income", "segment"], "regularized_logistic")
    rows = model.pipeline.transform(train).select(vector_to_array("__with_constant").alias("x"), "y").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
    weights = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    got = model.pipeline.stages[-1].coefficients.toArray()
    np.testing.assert_allclose(got, newton(x, y, weights, 0.3), atol=1e-4)


def test_class_weights_and_folds(sample):
    train = sample.filter("partition = 'train'")
    rows = {r["class"]: r for r in modeling.class_weights(train, "y").collect()}
    total = rows[0]["rows"] + rows[1]["rows"]
    assert rows[1]["balanced_weight"] == pytest.approx(total / (2 * rows[1]["rows"]))
    assert rows[1]["positive_scale"] == pytest.approx(rows[0]["rows"] / rows[1]["rows"])
    folds = modeling.stratified_folds(train, "y", "id", 5).groupBy("y", "fold").count().toPandas()
    for _, part in folds.groupby("y"):
        assert len(part) == 5 and part["count"].max() - part["count"].min() <= 1
    with pytest.raises(ValueError, match="TRAIN_CLASS_COUNT_TOO_SMALL"):
        modeling.fold_count(train.filter("y = 0"), "y")


def test_training_keeps_failures_and_never_selects_on_oot(spark, sample):
    spoiled = sample.withColumn("y", F.when(F.col("partition") == "oot", 1 - F.col("y")).otherwise(F.col("y")))
    models = ("dummy", "scorecard", "regularized_logistic", "unknown_model")
    a = modeling.train_candidates(sample, "y", ["income", "segment"], "id", models, calibrate=False, out_of_fold_metrics=False)
    b = modeling.train_candidates(spoiled, "y", ["income", "segment"], "id", models, calibrate=False, out_of_fold_metrics=False)
    rows = {r["candidate"]: r for r in a.candidates.collect()}
    assert rows["unknown_model"]["error_code"] == "MODEL_UNSUPPORTED" and rows["unknown_model"]["status"] == "failed"
    assert a.champion == b.champion != "dummy" and sum(r["champion"] for r in rows.values()) == 1
    for r in b.candidates.collect():
        same = rows[r["candidate"]]
        assert (r["calibration"], r["violations"]) == (same["calibration"], same["violations"])
        assert r["selection_score"] == pytest.approx(same["selection_score"], abs=1e-9)
    assert {r["partition"] for r in a.metrics.collect()} == {"train", "test", "oot"}
    with pytest.raises(ValueError, match="NO_AVAILABLE_MODELS"):
        modeling.train_candidates(sample, "y", ["income"], "id", ["nothing"])
    alone = modeling.train_candidates(sample, "y", ["income"], "id", ["dummy"], calibrate=False, out_of_fold_metrics=False)
    assert alone.champion == "dummy"


def test_calibrated_models_survive_saving(spark, sample, tmp_path):
    train = sample.filter("partition = 'train'")
    for method in ("platt", "isotonic"):
        model = modeling.fit_calibrated(train, "y", ["income", "segment"], "regularized_logistic", method, "id")
        assert len(model.members) == 3
        path = str(tmp_path / method)
        modeling.save_model(spark, model, path, {"income": "numeric", "segment": "categorical"})
        loaded, types, scale = modeling.load_model(spark, path)
        both = loaded.score(model.score(sample, "before"), "after")
        assert both.filter(F.abs(F.col("before") - F.col("after")) > 1e-12).isEmpty()
        assert types == {"income": "numeric", "segment": "categorical"} and scale.pdo == 50


def test_tuning_logs_its_trials(sample):
    train = sample.filter("partition = 'train'")
    best, trials = modeling.tune(train, "y", ["income"], "regularized_logistic", "id", 2)
    assert len(trials) == 2 and best["C"] in (0.1, 0.3) and all(len(t[4]) == 5 for t in trials)
    assert modeling.tune(train, "y", ["income"], "scorecard", "id", 5) == ({}, [])
    assert len(modeling.search_space("random_forest")) == 6


def test_selection_rules(spark):
    rows = [("dummy", "trained", 9.0), ("a", "trained", 0.5), ("b", "trained", 0.7), ("c", "failed", None)]
    df = spark.createDataFrame(rows, "candidate string, status string, selection_score double")
    assert modeling.choose_champion(df).first()[0] == "b"
    score = modeling.selection_score(F.col("a"), F.col("k"), F.col("b"), F.col("v"))
    values = spark.createDataFrame([(0.8, 0.4, 0.1, 2), (None, None, 0.0, None)], "a double, k double, b double, v int")
    assert [r[0] for r in values.select(score).collect()] == pytest.approx([0.8 + 0.22 - 0.012 - 0.1, -0.12 - 0.05])


def test_preprocessing_treats_rare_missing_and_unseen(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    rows = [(float(i), "a" if i % 2 else "b'x", i % 2) for i in range(996)] + [(None, None, 0), (1.0, "rare", 1), (2.0, "odd", 0), (3.0, "a", 1)]
    train = spark.createDataFrame(rows, "v double, c string, y int")
    model = Pipeline(stages=modeling.preprocessing(train, ["v", "c"], scale=False)).fit(train)
    new = spark.createDataFrame([(None, "a"), (5.0, "b'x"), (5.0, "rare"), (5.0, None)], "v double, c string")
    got = [r[0] for r in model.transform(new).select(vector_to_array("__features")).collect()]
    median = float(np.median([r[0] for r in rows if r[0] is not None]))
    assert got == [[median, 1.0, 0.0, 0.0], [5.0, 0.0, 1.0, 0.0], [5.0, 0.0, 0.0, 1.0], [5.0, 1.0, 0.0, 0.0]]


def test_models_do_not_depend_on_partitions(sample):
    """The same rows in 1, 4 and 16 partitions give the same forest and boosting."""
    train = sample.filter("partition = 'train'")
    for name in ("random_forest", "boosted_depth4"):
        seen = set()
        for parts in (1, 4, 16):
            model = modeling.fit_candidate(train.repartition(parts), "y", ["income", "segment"], name, FAST[name])
            row = model.score(train).agg(F.sum(F.round(PROBABILITY, 9))).first()[0]
            seen.add(round(row, 6))
        assert len(seen) == 1


def test_a_larger_budget_is_refused(sample):
    with pytest.raises(ValueError, match="SEARCH_BUDGET_TOO_LARGE"):
        modeling.tune(sample, "y", ["income"], "regularized_logistic", "id", 13)


def test_run_takes_the_reviewers_decisions(spark):
    from lendwright.operators.binning import BinSpec
    from lendwright.operators.screening import ScreeningThresholds
    from lendwright.operators.splits import SplitPlan
    from lendwright.plans.modelling_run import modelling_run

    rng = np.random.default_rng(2)
    rows = []
    for k in range(900):
        x = float(rng.normal())
        rows.append((k, f"c{k}", f"20{20 + k // 300}-0{1 + k % 9}-01", x, float(rng.normal()), -9.0 if k % 50 == 0 else float(rng.normal()), int(x + rng.normal() > 0.5)))
    raw = spark.createDataFrame(rows, "id int, who string, day string, strong double, weak double, coded double, y int").withColumn("day", F.to_timestamp("day"))
    found = modelling_run(
        raw, "y", "id", SplitPlan(time_column="day", customer_key="who"),
        cleaning=[{"id": "c1", "kind": "replace_missing_codes", "column": "coded", "codes": ["-9"]}], accepted=["c1"],
        thresholds=ScreeningThresholds(iv=0.3), restored={"weak": "wanted by the regulator"},
        manual_bins=[BinSpec("strong", "numeric", (0.0,))], models=("dummy", "scorecard"), calibrate=False, review_passed=True,
    )
    features = {r["feature"]: r for r in found.sheets["features"].collect()}
    assert features["weak"]["restored"] and features["weak"]["status"] == "included"
    assert found.binning.specs["strong"].edges == (0.0,)
    overview = {r["partition"]: r for r in found.sheets["overview"].collect()}
    assert overview["TEST"]["psi"] is not None and overview["OOT"]["psi"] is not None
    summary = found.sheets["summary"].first()
    assert summary["quality_verdict"] == ("pass" if summary["absolute_ordering"] else "conditional")
    assert found.sheets["lift"].filter("partition = 'oot'").count() > 0 and found.sheets["calibration"].count() > 0


def test_training_partitions_grow_slower_than_small_ones():
    """Partial sums of all open nodes leave every partition, so many small ones cost more than their rows."""
    sizes = [modeling.training_partitions(n) for n in (1, 20_000, 20_001, 640_000, 5_000_000, 30_000_000)]
    assert sizes == [1, 1, 2, 32, 32, 150]


def _passes(monkeypatch):
    """Counts how often training rows are dealt and prepared."""
    seen = {"dealt": 0, "prepared": 0, "fits": 0}

    def counted(name, key):
        plain = getattr(modeling, name)

        def run(*args, **kwargs):
            seen[key] += 1
            return plain(*args, **kwargs)

        monkeypatch.setattr(modeling, name, run)

    counted("_dealt", "dealt")
    counted("preprocessing", "prepared")
    counted("_logistic", "fits")
    return seen


def test_tuning_prepares_a_fold_once(sample, monkeypatch):
    """Three strengths over five folds are fifteen fits on five preparations, and each is the fit of its own options."""
    train = sample.filter("partition = 'train'")
    seen = _passes(monkeypatch)
    best, trials = modeling.tune(train, "y", ["income", "segment"], "regularized_logistic", "id", 3)
    assert seen == {"dealt": 5, "prepared": 5, "fits": 15}
    assert [t[1:3] for t in trials] == [(1, '{"C": 0.1}'), (2, '{"C": 0.3}'), (3, '{"C": 1.0}')]
    assert f'{{"C": {best["C"]}}}' == max(trials, key=lambda t: t[3])[2]
    grid = modeling.fit_grid(train, "y", ["income", "segment"], "regularized_logistic", [{"C": 0.1}, {"C": 1.0}])
    for model, c in zip(grid, (0.1, 1.0)):
        alone = modeling.fit_candidate(train, "y", ["income", "segment"], "regularized_logistic", {"C": c})
        assert np.allclose(model.pipeline.stages[-1].coefficients, alone.pipeline.stages[-1].coefficients, rtol=1e-9)


@pytest.mark.parametrize("name", ["scorecard", "regularized_logistic"])
def test_solver_reads_rows_that_are_kept(spark, sample, monkeypatch, name):
    """The solver's passes read prepared rows from disk, and nothing stays there after the fit."""
    levels = []
    solver = modeling._logistic

    def watched(*args):
        model = solver(*args)
        fit = model.fit
        model.fit = lambda df: levels.append(df.storageLevel) or fit(df)
        return model

    monkeypatch.setattr(modeling, "_logistic", watched)
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    modeling.fit_candidate(sample.filter("partition = 'train'"), "y", ["income", "segment"], name)
    assert [(s.useDisk, s.useMemory) for s in levels] == [(True, False)]
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_candidates_share_folds_and_fold_models(sample, monkeypatch):
    """Folds were dealt for every candidate and method, and both calibrations fitted the same models."""
    dealt, fits, folds, fit = [], [], modeling.stratified_folds, modeling.fit_candidate
    monkeypatch.setattr(modeling, "stratified_folds", lambda *args, **kwargs: dealt.append(args[3]) or folds(*args, **kwargs))
    monkeypatch.setattr(modeling, "fit_candidate", lambda *args, **kwargs: fits.append(args[3]) or fit(*args, **kwargs))
    monkeypatch.setattr(modeling, "MIN_ISOTONIC_ROWS", 10)
    found = modeling.train_candidates(sample, "y", ["income"], "id", ("dummy",))
    assert sorted(dealt) == [3, 5] and len(fits) == 5 + 1 + 3
    assert {r["method"] for r in found.calibrations.collect()} == {"uncalibrated", "platt", "isotonic"}


def test_run_writes_the_frozen_rows_before_it_splits(spark, sample, monkeypatch):
    """The passes of the split evaluated the whole input view again each time."""
    from lendwright.operators.splits import SplitPlan
    from lendwright.plans import modelling_run as run

    seen, written, split = [], run.materialize, run.split_dataset
    monkeypatch.setattr(run, "materialize", lambda df, purpose: seen.append(purpose) or written(df, purpose))
    monkeypatch.setattr(run, "split_dataset", lambda df, *args: seen.append(f"from {df.inputFiles()[0].split('/')[-2]}") or split(df, *args))
    rows = sample.filter("y IS NOT NULL").select("id", "income", "segment", "y", F.expr("timestamp'2020-01-01' + make_interval(0, 0, 0, id)").alias("day"))
    run.modelling_run(rows, "y", "id", SplitPlan(time_column="day"), models=("dummy",), calibrate=False, out_of_fold_metrics=False)
    assert [name.split("-")[0] for name in seen] == ["frozen", "from frozen", "split"]

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lendwright.operators import metrics


def frame(spark, y, p):
    return spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "id long, y int, p double")


def brute(y, p):
    y, p = np.asarray(y), np.clip(np.asarray(p, float), 1e-8, 1 - 1e-8)
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > neg).mean() + 0.5 * (a == neg).mean() for a in pos])
    cuts = [math.inf, *sorted(set(p), reverse=True)]
    gaps = [(pos >= c).mean() - (neg >= c).mean() for c in cuts]
    best = int(np.argmax(gaps))
    recall = [(pos >= c).mean() for c in cuts]
    precision = [1.0] + [(y[p >= c] == 1).mean() for c in cuts[1:]]
    ap = sum((recall[i] - recall[i - 1]) * precision[i] for i in range(1, len(cuts)))
    return auc, max(gaps), cuts[best], ap, np.mean((p - y) ** 2), -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))


@pytest.mark.parametrize("splits", [None, [0.2, 0.4, 0.41, 0.8]])
@pytest.mark.parametrize("digits", [1, 2, 6])
def test_metrics_equal_brute_force(spark, digits, splits):
    rng = np.random.default_rng(digits)
    p = np.round(rng.random(400), digits)
    y = (rng.random(400) < p).astype(int)
    row = metrics.binary_metrics(frame(spark, y, p), "y", "p", splits=splits).first()
    auc, ks, threshold, ap, brier, loss = brute(y, p)
    got = [row[c] for c in ("roc_auc", "ks", "ks_threshold", "pr_auc", "brier", "log_loss")]
    np.testing.assert_allclose(got, [auc, ks, threshold, ap, brier, loss], rtol=1e-9)


def test_perfect_order(spark):
    y, p = [0, 0, 0, 1, 1, 1], [0.02, 0.1, 0.2, 0.7, 0.8, 0.95]
    df = frame(spark, y, p)
    row = metrics.binary_metrics(df, "y", "p").first()
    assert row["roc_auc"] == 1 and row["ks"] == 1
    assert metrics.lift_table(df, "y", "p", "id").orderBy("bucket").first()["bad_rate"] == 1
    doubled = df.withColumn("g", F.lit("a")).unionByName(df.withColumn("g", F.lit("b")))
    assert metrics.psi(doubled, "p", "g", [("a", "b")]).first()["psi"] == 0


def test_worst_order_has_no_threshold(spark):
    row = metrics.binary_metrics(frame(spark, [1, 1, 0, 0], [0.1, 0.2, 0.3, 0.4]), "y", "p").first()
    assert row["ks"] == 0 and row["ks_threshold"] is None and row["roc_auc"] == 0


def test_all_scores_tied(spark):
    row = metrics.binary_metrics(frame(spark, [1, 0, 1, 0], [0.5] * 4), "y", "p").first()
    assert (row["roc_auc"], row["ks"], row["pr_auc"]) == (0.5, 0.0, 0.5)


def test_single_class_gives_null(spark):
    row = metrics.binary_metrics(frame(spark, [1, 1], [0.2, 0.3]), "y", "p").first()
    assert row["rows"] == 2 and row["bad_rate"] == 1
    assert all(row[c] is None for c in ("roc_auc", "ks", "ks_threshold", "pr_auc", "brier", "log_loss"))


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 203])
@pytest.mark.parametrize("tied", [False, True])
def test_lift_buckets(spark, n, tied):
    rng = np.random.default_rng(n)
    p = np.full(n, 0.3) if tied else np.round(rng.random(n), 2)
    y = rng.integers(0, 2, n)
    df = frame(spark, y, p)
    rows = metrics.lift_table(df, "y", "p", "id", splits=[0.2, 0.35]).orderBy("bucket").toPandas()
    order = df.select("id", "y", "p", F.md5(F.concat(F.col("id").cast("string"), F.lit("|"))).alias("d")).toPandas()
    order = order.sort_values(["p", "d"], ascending=[False, True]).reset_index(drop=True)
    q = min(10, n)
    order["bucket"] = [max(1, -(-(i * q) // (n - 1))) if n > 1 else 1 for i in range(n)]
    want = order.groupby("bucket").agg(count=("y", "size"), bad=("y", "sum"))
    assert list(rows["count"]) == list(want["count"]) and list(rows["bad"]) == list(want["bad"])
    total = max(int(y.sum()), 1)
    np.testing.assert_allclose(rows["cumulative_capture"], want["bad"].cumsum() / total)


def psi_of(spark, reference, current):
    rows = [("r", v) for v in reference] + [("c", v) for v in current]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double")
    return metrics.psi(df, "v", "g", [("r", "c")]).first()["psi"]


def test_psi_edges(spark):
    assert psi_of(spark, [0.2] * 30, [0.2] * 30) == 0
    assert psi_of(spark, [0.2] * 30, [0.8] * 30) > 1
    assert psi_of(spark, [0, 1] * 30, [1] * 60) > 1
    assert psi_of(spark, [0.1, float("nan")], [0.1]) is None
    assert psi_of(spark, [0.1, 0.2], [None]) is None
    assert psi_of(spark, [0.1, 0.2], []) is None


def test_psi_equals_histogram(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=500), rng.normal(0.3, 1.2, size=400)
    edges = np.unique(np.quantile(a, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    r = np.clip(np.histogram(a, edges)[0] / 500, 1e-6, None)
    c = np.clip(np.histogram(b, edges)[0] / 400, 1e-6, None)
    assert math.isclose(psi_of(spark, a, b), float(np.sum((c - r) * np.log(c / r))), rel_tol=1e-9)


def test_monotonicity_counts_the_cheaper_direction(spark):
    rows = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.6), (4, 0.1)], "bucket int, bad_rate double")
    assert tuple(metrics.score_monotonicity(rows).first()) == (1, False)
    assert tuple(metrics.score_monotonicity(rows.filter("bucket <> 3")).first()) == (0, True)
    assert tuple(metrics.score_monotonicity(rows.filter("bucket = 1")).first()) == (None, False)


def test_calibration_boundaries(spark):
    df = frame(spark, [0, 1, 1, 0, 1], [0.0, 0.1, 0.1000001, 1.0, 0.95])
    rows = {r["bucket"]: (r["count"], r["actual_rate"]) for r in metrics.calibration_table(df, "y", "p").collect()}
    assert rows == {1: (2, 0.5), 2: (1, 1.0), 10: (2, 0.5)}
    want = pd.cut(pd.Series([0.0, 0.1, 0.1000001, 1.0, 0.95]), np.linspace(0, 1, 11), include_lowest=True, labels=False)
    assert sorted(want + 1) == [1, 1, 2, 10, 10]

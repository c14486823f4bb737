from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lendwright.functions.expressions import interval_sql
from lendwright.operators import binning as b
from lendwright.operators import screening
from lendwright.operators.order_statistics import unpivot_values


def slow_merge(x: pd.Series, y: pd.Series, max_bins: int = 10):
    """Row-level reference: relabel all rows after every dropped edge."""
    known = x.dropna()
    edges = np.unique(known.quantile(np.linspace(0, 1, min(max_bins, known.nunique()) + 1)))
    inner = list(edges[1:-1])
    while True:
        place = pd.cut(x, [-np.inf, *inner, np.inf], labels=False)
        table = pd.DataFrame({"b": place, "y": y}).dropna().groupby("b")["y"].agg(["count", "mean"])
        rates = list(table["mean"])
        steps = np.diff(rates)
        ordered = len(rates) <= 2 or (steps >= -1e-12).all() or (steps <= 1e-12).all()
        if (ordered and (table["count"] / len(x) >= 0.03).all()) or len(inner) + 1 <= 2 or not inner:
            return inner
        gaps = np.abs(steps)
        inner.pop(min(int(np.argmin(gaps)) if len(gaps) else 0, len(inner) - 1))


@pytest.mark.parametrize("seed", range(4))
def test_merge_equals_row_level_loop(spark, seed):
    rng = np.random.default_rng(seed)
    n = 600
    x = {
        "smooth": rng.normal(size=n),
        "tied": np.where(rng.random(n) < 0.5, 1.0, rng.integers(0, 30, n).astype(float)),
        "few": rng.integers(0, 6, n).astype(float),
        "holes": np.where(rng.random(n) < 0.3, np.nan, rng.exponential(size=n)),
    }
    frame = pd.DataFrame(x)
    frame["y"] = (rng.random(n) < 0.2 + 0.3 * np.abs(np.sin(frame["smooth"]))).astype(int)
    df = spark.createDataFrame(frame)
    specs = b.fit_numeric(df, "y", list(x))
    for name in x:
        np.testing.assert_allclose(specs[name].edges, slow_merge(frame[name], frame["y"]), atol=1e-9)
        assert sum(r.count for r in specs[name].rows) == n


def test_empty_interval_keeps_observed_positions():
    # The second interval is empty: positions of gaps count observed bins only.
    edges = b.merge_bins([1.0, 2.0, 3.0], {0: (50, 10), 2: (50, 40), 3: (50, 12)}, 150)
    assert edges == [1.0]


def test_non_monotone_data_becomes_monotone(spark):
    df = spark.createDataFrame([(float(i), int(40 <= i < 80)) for i in range(120)], "x double, y int")
    spec = b.fit_numeric(df, "y", ["x"])["x"]
    assert spec.monotonic and spec.source == "auto_monotonic"
    raw = b.woe_table(df, "y", b.Binning({"x": b.BinSpec("x", "numeric", (39.0, 79.0))}))
    assert not b.monotonicity(raw).first()["monotonic"]
    assert b.merge_suggestions(raw).count() == 2


def test_constant_column_is_refused(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (None, 0)], "x double, y int")
    with pytest.raises(ValueError, match="NUMERIC_BINNING_CONSTANT"):
        b.fit_numeric(df, "y", ["x"])


def lexical(spark, bads):
    rows = [(float(x), int(i < bad)) for x, bad in zip((0, 5, 50, 500), bads) for i in range(10)]
    return spark.createDataFrame(rows, "x double, y int")


def test_bins_are_ordered_by_number_not_text(spark):
    spec = b.BinSpec("x", "numeric", (2.0, 10.0, 100.0))
    fitted = b.apply_manual_binning(b.Binning(), lexical(spark, (1, 2, 3, 4)), "y", spec).specs["x"]
    assert [r.bad for r in fitted.rows] == [1, 2, 3, 4] and fitted.monotonic
    with pytest.raises(ValueError, match="MANUAL_BIN_NOT_MONOTONIC"):
        b.apply_manual_binning(b.Binning(), lexical(spark, (1, 4, 2, 3)), "y", spec)
    excused = b.replace(spec, business_exception="agreed with risk committee")
    result = b.apply_manual_binning(b.Binning(), lexical(spark, (1, 4, 2, 3)), "y", excused)
    assert not result.specs["x"].monotonic and result.invalidates == ("training", "review", "report")


@pytest.mark.parametrize(
    "spec, code",
    [
        (b.BinSpec("x", "numeric", (2.0, 1.0)), "MANUAL_NUMERIC_EDGES_INVALID"),
        (b.BinSpec("x", "categorical", groups=(("a",), ("a", "b"))), "MANUAL_CATEGORY_OVERLAP"),
        (b.BinSpec("x", "other"), "MANUAL_BIN_KIND_INVALID"),
    ],
)
def test_manual_specs_are_checked(spec, code):
    with pytest.raises(ValueError, match=code):
        b.validate_manual_spec(spec)


def categories(spark):
    rows = []
    for i, (value, n, bad) in enumerate([("a", 300, 30), ("b", 200, 90), (None, 100, 50), ("r1", 5, 1), ("r2", 3, 3)]):
        rows += [(value, int(k < bad)) for k in range(n)]
    return spark.createDataFrame(rows, "c string, y int")


def test_categorical_rare_missing_and_unseen(spark):
    df = categories(spark)
    spec = b.fit_categorical(df, "y", ["c"])["c"]
    assert spec.groups == (("a",), ("b",), ("<MISSING>",), ("<RARE>",))
    new = spark.createDataFrame([("a",), ("r2",), (None,), ("never",)], "c string")
    binned = {r["c"]: r["c_bin"] for r in b.apply_bins(new, b.Binning({"c": spec})).collect()}
    names = {g[0]: b.group_label(i) for i, g in enumerate(spec.groups)}
    assert binned == {"a": names["a"], "r2": names["<RARE>"], None: names["<MISSING>"], "never": "<OTHER>"}
    woe = {r["c"]: r["c_woe"] for r in b.woe_transform(new, b.Binning({"c": spec})).collect()}
    assert woe["never"] == 0.0 and woe["a"] == spec.rows[[g[0] for g in spec.groups].index("a")].woe


def test_spec_version_and_json_round_trip(spark):
    spec = b.fit_categorical(categories(spark), "y", ["c"])["c"]
    again = b.BinSpec.from_json(spec.to_json())
    assert again == spec and b.Binning({"c": spec}).version == b.Binning({"c": again}).version
    assert b.Binning({"c": b.replace(spec, iv=0.0)}).version != b.Binning({"c": spec}).version


def test_more_than_eight_categories_share_groups(spark):
    rows = [(f"v{k:02d}", int(i < k)) for k in range(11) for i in range(40)]
    spec = b.fit_categorical(spark.createDataFrame(rows, "c string, y int"), "y", ["c"])["c"]
    assert [len(g) for g in spec.groups] == [len(g) for g in np.array_split(range(11), 8)]
    assert spec.groups[0] == ("v00", "v01")


def test_interval_ends_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0000001,), (None,), (float("nan"),)], "x double")
    spec = b.BinSpec("x", "numeric", (2.0,))
    assert [r[0] for r in df.select(b.bin_index(df, spec)).collect()] == [0, 0, 1, -1, -1]


def test_iv_counts_ten_and_eleven_values(spark):
    rows = [(float(i % 10), float(i % 11), i % 2) for i in range(1100)]
    df = spark.createDataFrame(rows, "ten double, eleven double, y int")
    assert set(screening.iv_edges(df, ["ten", "eleven"])) == {"eleven"}
    found = screening.iv_bins(df, "y", ["ten", "eleven"]).groupBy("feature").agg(F.sum("count").alias("n")).collect()
    assert {r["feature"]: r["n"] for r in found} == {"ten": 1100, "eleven": 1100}


def test_many_rare_categories_stay_inside_the_rules(spark, tmp_path):
    """5,000 rare categories are saved with the model; scoring reads no other file and needs no shuffle."""
    from lendwright.operators import modeling

    rows = [(f"rare '{k}' \\\\", k % 2) for k in range(5000)] + [(f"big{k % 2}", int(k % 7 < 2 + k % 2)) for k in range(5000)]
    train = spark.createDataFrame(rows, "c string, y int")
    model = modeling.fit_calibrated(train, "y", ["c"], "scorecard", "uncalibrated", "c")
    spec = model.members[0][0].rules.binning.specs["c"]
    assert len(spec.rare_values) == 5000 and b.Binning({"c": spec}).version == b.fit_binning(train, "y", ["c"]).version
    modeling.save_model(spark, model, str(tmp_path / "m"), {"c": "categorical"})
    loaded, _, _ = modeling.load_model(spark, str(tmp_path / "m"))
    scored = loaded.score(train.distinct(), "p")
    assert "Exchange" not in loaded.score(train, "p")._jdf.queryExecution().executedPlan().toString()
    rare = {r["p"] for r in scored.filter("c LIKE 'rare%'").collect()}
    never = loaded.score(spark.createDataFrame([("never",)], "c string"), "p").first()["p"]
    assert len(rare) == 1 and never not in rare


def test_rare_categories_beyond_the_limit_go_to_a_dictionary(spark, tmp_path):
    """The same labels, weights and scores as with literals, also after saving, and no value is refused."""
    from lendwright.operators import modeling

    rows = [(f"rare '{k}' \\\\", k % 2) for k in range(3000)] + [(f"big{k % 2}", int(k % 7 < 2 + k % 2)) for k in range(3000)] + [(None, 1)] * 30
    train = spark.createDataFrame(rows, "c string, y int")
    few = b.fit_categorical(train, "y", ["c"])["c"]
    many = b.fit_categorical(train, "y", ["c"], literal_rare=100)["c"]
    assert many.rare_values == () and spark.read.parquet(many.rare_table).count() == len(few.rare_values) == 3000
    assert (many.groups, many.rows) == (few.groups, few.rows)
    again = b.fit_categorical(train, "y", ["c"], literal_rare=100)["c"]
    assert again.rare_table != many.rare_table and b.Binning({"c": again}).version == b.Binning({"c": many}).version
    new = train.distinct().unionByName(spark.createDataFrame([("never", 0)], "c string, y int"))
    for change in (b.apply_bins, b.woe_transform):
        a, z = change(new, b.Binning({"c": few})), change(new, b.Binning({"c": many}))
        assert a.columns == z.columns and a.exceptAll(z).isEmpty() and z.exceptAll(a).isEmpty()
    assert b.woe_table(new, "y", b.Binning({"c": many})).filter("bin = '<OTHER>'").first()["count"] == 1
    rules = modeling.ScorecardRules(["c"], [0.7], 0.1, b.Binning({"c": many}))
    model = modeling.Calibrated("scorecard", "uncalibrated", [(modeling.Fitted("scorecard", ["c"], rules=rules), None)])
    modeling.save_model(spark, model, str(tmp_path / "m"), {"c": "categorical"})
    loaded, _, _ = modeling.load_model(spark, str(tmp_path / "m"))
    assert loaded.members[0][0].rules.binning.specs["c"].rare_table.startswith(str(tmp_path))
    left, right = model.score(new, "p"), loaded.score(new, "p")
    assert left.exceptAll(right).isEmpty() and right.count() == new.count()


def test_values_outside_all_groups_have_the_weight_of_other(spark):
    df = categories(spark).filter("c IS NOT NULL")
    spec = b.BinSpec("c", "categorical", groups=(("a",),), business_exception="by hand")
    fitted = b.apply_manual_binning(b.Binning({}), df, "y", spec)
    rows = {r.bin: r for r in fitted.specs["c"].rows}
    assert [r.bin for r in fitted.specs["c"].rows] == ["<OTHER>", "G01"] and rows["<OTHER>"].woe != 0
    woe = {r["c"]: r["c_woe"] for r in b.woe_transform(df.distinct(), fitted).collect()}
    assert woe["a"] == rows["G01"].woe and woe["b"] == woe["r1"] == rows["<OTHER>"].woe


def test_other_comes_first_in_the_monotone_check(spark):
    rows = [("o", k < 10) for k in range(100)] + [("a", k < 20) for k in range(100)] + [("b", k < 30) for k in range(100)]
    df = spark.createDataFrame([(c, int(y)) for c, y in rows], "c string, y int")
    fitted = b.apply_manual_binning(b.Binning({}), df, "y", b.BinSpec("c", "categorical", groups=(("a",), ("b",))))
    assert fitted.specs["c"].monotonic
    assert b.monotonicity(b.bin_table(spark, fitted)).first()["monotonic"]


def test_infinite_values_everywhere(spark):
    inf = float("inf")
    rows = [(float(k % 50), k % 2) for k in range(500)] + [(inf, 1)] * 60 + [(-inf, 0)] * 60 + [(None, 1)] * 5
    df = spark.createDataFrame(rows, "x double, y int")
    from lendwright.operators import order_statistics as o, profile

    found = o.exact_quantiles(df, ["x"], [0.0, 0.5, 1.0], bracket_rows=3)["x"]
    assert found[0] == -inf and found[2] == inf and 0 <= found[1] <= 49
    assert all(map(np.isfinite, screening.iv_edges(df, ["x"])["x"]))
    spec = b.fit_binning(df, "y", ["x"]).specs["x"]
    assert all(map(np.isfinite, spec.edges)) and sum(r.count for r in spec.rows) == len(rows)
    assert profile.numeric_summary(df, ["x"]).count() >= 1
    from lendwright.operators import modeling

    model = modeling.fit_candidate(df, "y", ["x"], "regularized_logistic")
    assert model.score(df).filter(F.col(modeling.PROBABILITY).between(0, 1)).count() == len(rows)


def test_bins_of_odd_numbers(spark):
    """Bins, labels and WOE at edges, of NaN, NULL, infinite numbers and both zeros, for every kind of number."""
    inf, nan = float("inf"), float("nan")
    rows = [(v,) for v in (None, nan, -inf, -1.0, -0.0, 0.0, 0.5, 1.0, 2.0, inf)]
    df = spark.createDataFrame(rows, "d double").select("d", F.col("d").cast("float").alias("f"), F.col("d").cast("string").alias("t"))
    want = [-1, -1, 0, 0, 0, 0, 1, 1, 2, 2]
    cells = tuple(b.BinRow(str(i), i, 1, 0, 1, 0.0, w, 0.0) for i, w in ((-1, 9.0), (0, 1.5), (2, -2.5)))
    for name in df.columns:
        spec = b.BinSpec(name, "numeric", edges=(0.0, 1.0), rows=cells)
        found = df.select(b.bin_index(df, spec), b.bin_label(df, spec), b.woe_value(df, spec)).collect()
        labels = {-1: "<MISSING>", **dict(enumerate(b.interval_labels(spec.edges)))}
        assert [r[0] for r in found] == want
        assert [r[1] for r in found] == [labels[i] for i in want]
        assert [r[2] for r in found] == [{-1: 9.0, 0: 1.5, 1: 0.0, 2: -2.5}[i] for i in want]
        no_edges = df.select(F.expr(interval_sql(name, df.schema[name].dataType, [], ["0"], "NULL"))).collect()
        assert [r[0] for r in no_edges] == [None, None, *[0] * 8]


def test_expressions_of_many_bins_are_compiled(spark, capsys):
    """The JVM interprets methods above 8,000 bytes; seven features of ten bins stay below, as indices and as WOE."""
    names = [f"x{i}" for i in range(7)]
    df = spark.range(1).select(*[F.rand(i).alias(n) for i, n in enumerate(names)], F.lit(1).alias("y"))
    edges = [i / 10 for i in range(1, 10)]
    cells = tuple(b.BinRow(str(i), i, 1, 0, 1, 0.0, i / 7, 0.0) for i in range(10))
    binning = b.Binning({n: b.BinSpec(n, "numeric", edges=tuple(edges), rows=cells) for n in names})
    places = unpivot_values([(n, [b.bin_index(df, binning.specs[n])]) for n in names], ["place"])
    for frame in (df.select("y", places), b.woe_transform(df, binning)):
        frame.explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert sizes and max(sizes) < 8000

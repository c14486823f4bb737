"""Weight-of-evidence binning: fit on the training rows, apply anywhere as one expression.

A feature with very many rare categories keeps them in a dictionary table, which is joined before the expression.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lendwright.functions import fixed_values as fixed
from lendwright.functions.expressions import (
    column,
    double_sql,
    interval_sql,
    is_numeric,
    lookup,
    quoted,
    text_sql,
)
from lendwright.operators.order_statistics import (
    exact_quantiles,
    join_unique,
    quantile_grid,
    unpivot_values,
)
from lendwright.operators.screening import distinct_up_to, inner_edges, woe_columns
from lendwright.session import materialize, scratch_path

MISSING_INDEX = -1
TOLERANCE = 1e-12
#: So many rare categories of a feature travel inside the rules; more are looked up in a written dictionary.
LITERAL_RARE_VALUES = 20_000


@dataclass(frozen=True)
class BinRow:
    bin: str
    index: int
    count: int
    bad: int
    good: int
    bad_rate: float
    woe: float
    iv: float


@dataclass(frozen=True)
class BinSpec:
    """How one feature is binned, with its training WOE table.

    ``rare_values`` are all categories that training folded; a value outside the groups is looked up there. If they are
    many, they stand in the Parquet table ``rare_table`` (column value) instead, and ``rare_digest`` tells its contents.
    """

    feature: str
    kind: str
    edges: tuple[float, ...] = ()
    groups: tuple[tuple[str, ...], ...] = ()
    rare_values: tuple[str, ...] = ()
    rare_table: str = ""
    rare_digest: str = ""
    rows: tuple[BinRow, ...] = ()
    iv: float = 0.0
    monotonic: bool = True
    source: str = "manual"
    business_exception: str = ""

    def to_json(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_json(value: Mapping) -> "BinSpec":
        return BinSpec(
            **{
                **value,
                "edges": tuple(value["edges"]),
                "groups": tuple(tuple(g) for g in value["groups"]),
                "rare_values": tuple(value["rare_values"]),
                "rows": tuple(BinRow(**r) for r in value["rows"]),
            }
        )


@dataclass(frozen=True)
class Binning:
    specs: Mapping[str, BinSpec] = field(default_factory=dict)
    invalidates: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        # Where a dictionary lies does not change the rules; its digest stands for its contents.
        rules = {k: replace(v, rare_table="").to_json() for k, v in self.specs.items()}
        text = json.dumps(rules, sort_keys=True, ensure_ascii=False)
        return "bin_" + hashlib.sha256(text.encode("utf-8")).hexdigest()[:12]


# --- labels and WOE values as expressions ---------------------------------------------------


def interval_labels(edges: Sequence[float]) -> list[str]:
    ends = ["-inf", *[repr(float(e)) for e in edges], "inf"]
    return [f"({low}, {high}]" for low, high in zip(ends, ends[1:])]


def group_label(index: int) -> str:
    return f"G{index + 1:02d}"


def _category(name: str | Column) -> Column:
    return F.coalesce(column(name).cast("string"), F.lit(fixed.MISSING))


def _is_rare(spec: BinSpec) -> Column:
    """Is the category among the folded ones? One SQL text, which the engine turns into a hash set, or the mark that
    ``with_rare_marks`` has looked up."""
    if spec.rare_table:
        return F.coalesce(F.col(f"`{_rare_mark(spec)}`"), F.lit(False))
    wanted = [v for v in spec.rare_values if v != fixed.MISSING]
    if not wanted:
        return F.lit(False)
    listed = ", ".join(text_sql(v) for v in wanted)
    return F.expr(f"CAST({quoted(spec.feature)} AS STRING) IN ({listed})")


def _rare_mark(spec: BinSpec) -> str:
    return f"__rare_{spec.feature}"


def with_rare_marks(df: DataFrame, specs: Iterable[BinSpec]) -> DataFrame:
    """``df`` with a mark for every feature whose rare categories stand in a dictionary table.

    Only values that no group names are looked up; a value that fills much of the table does not make a hot key.
    """
    for spec in specs:
        if spec.rare_table:
            mark, key = _rare_mark(spec), f"__key_{spec.feature}"
            named = [v for group in spec.groups for v in group if v not in (fixed.RARE, fixed.MISSING)]
            value = column(spec.feature).cast("string")
            keyed = df.withColumn(key, F.when(value.isin(*named), None).otherwise(value) if named else value)
            known = df.sparkSession.read.parquet(spec.rare_table).select(F.col("value").alias(key), F.lit(True).alias(mark))
            joined = keyed.join(known, key, "left") if df.isStreaming else join_unique(keyed, known, [key])
            df = joined.select(*[F.col(f"`{c}`") for c in df.columns], mark)
    return df


def without_marks(df: DataFrame, specs: Iterable[BinSpec]) -> DataFrame:
    return df.drop(*[_rare_mark(s) for s in specs if s.rare_table])


def bin_index(df: DataFrame, spec: BinSpec) -> Column:
    """0-based bin number, -1 for missing numbers, NULL for unseen categories.

    A spec with a dictionary needs a ``df`` from ``with_rare_marks``.
    """
    if spec.kind == "numeric":
        return _by_interval(df, spec, [str(i) for i in range(len(spec.edges) + 1)], str(MISSING_INDEX))
    value = _category(spec.feature)
    places = {v: i for i, group in enumerate(spec.groups) for v in group}
    folded = places.get(fixed.RARE)
    known = set(spec.rare_values)
    # A rare value that a hand-made group names is folded all the same.
    named = {v: folded if v in known and v != fixed.MISSING else i for v, i in places.items()}
    other = F.when(_is_rare(spec), F.lit(folded)) if folded is not None else F.lit(None)
    if not named:
        return other.cast("int")
    # Only values outside the groups are looked for among the rare ones.
    return F.when(value.isin(*named), lookup(value, named, None)).otherwise(other).cast("int")


def _by_interval(df: DataFrame, spec: BinSpec, results: Sequence[str], missing: str) -> Column:
    """The SQL text that stands for the row's interval."""
    return F.expr(interval_sql(spec.feature, df.schema[spec.feature].dataType, spec.edges, results, missing))


def bin_label(df: DataFrame, spec: BinSpec) -> Column:
    if spec.kind == "numeric":
        return _by_interval(df, spec, [text_sql(name) for name in interval_labels(spec.edges)], text_sql(fixed.MISSING))
    index = bin_index(df, spec)
    labels = {i: group_label(i) for i in range(len(spec.groups))}
    return lookup(index, labels, fixed.OTHER) if labels else F.lit(fixed.OTHER)


def woe_value(df: DataFrame, spec: BinSpec) -> Column:
    """WOE of the row's bin. Values outside all groups have the WOE of <OTHER> if training saw such rows;
    a bin without training rows scores 0."""
    values = {r.index: r.woe for r in spec.rows}
    if spec.kind == "numeric":
        found = [double_sql(values.get(i, 0.0)) for i in range(len(spec.edges) + 1)]
        return _by_interval(df, spec, found, double_sql(values.get(MISSING_INDEX, 0.0)))
    return lookup(F.coalesce(bin_index(df, spec), F.lit(len(spec.groups))), values, 0.0)


def apply_bins(df: DataFrame, binning: Binning, suffix: str = "_bin") -> DataFrame:
    specs = list(binning.specs.values())
    marked = with_rare_marks(df, specs)
    return without_marks(marked.withColumns({f"{s.feature}{suffix}": bin_label(marked, s) for s in specs}), specs)


def woe_transform(df: DataFrame, binning: Binning, suffix: str = "_woe") -> DataFrame:
    """One WOE column per feature: a projection, after a lookup for features with a dictionary."""
    specs = list(binning.specs.values())
    marked = with_rare_marks(df, specs)
    return without_marks(marked.withColumns({f"{s.feature}{suffix}": woe_value(marked, s) for s in specs}), specs)


# --- fitting -------------------------------------------------------------------------------


def woe_rows(cells: Sequence[tuple[str, int, int, int]]) -> tuple[tuple[BinRow, ...], float]:
    """WOE rows of one feature from its ``(label, index, count, bad)`` cells."""
    k = len(cells)
    bads = max(sum(c[3] for c in cells), 1) + 0.5 * k
    goods = max(sum(c[2] - c[3] for c in cells), 1) + 0.5 * k
    rows = []
    for label, index, count, bad in cells:
        good = count - bad
        b, g = (bad + 0.5) / bads, (good + 0.5) / goods
        woe = math.log(g / b)
        rows.append(BinRow(label, index, count, bad, good, bad / count, woe, (g - b) * woe))
    return tuple(rows), sum(r.iv for r in rows)


def is_monotonic(rates: Sequence[float]) -> bool:
    if len(rates) <= 2:
        return True
    steps = [b - a for a, b in zip(rates, rates[1:])]
    return all(s >= -TOLERANCE for s in steps) or all(s <= TOLERANCE for s in steps)


def finest_edges(
    df: DataFrame, features: Sequence[str], max_bins: int = 10, edge_digits: int | None = None
) -> dict[str, list[float]]:
    """Inner quantile edges for ``min(max_bins, distinct)`` bins; constants are refused."""
    distinct = distinct_up_to(df, features, max_bins)
    constant = [f for f in features if distinct[f] is not None and distinct[f] <= 1]
    if constant:
        raise ValueError(f"NUMERIC_BINNING_CONSTANT: {constant}")
    grids = {f: quantile_grid(distinct[f] if distinct[f] is not None else max_bins) for f in features}
    quantiles = exact_quantiles(df, features, grids)
    return {f: inner_edges(quantiles[f], edge_digits) for f in features}


def finest_bins(df: DataFrame, label: str, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """``(feature, bin_index, count, bad)`` for the given edges, all features in one aggregation."""
    specs = [BinSpec(f, "numeric", tuple(e)) for f, e in edges.items()]
    return (
        df.select(
            F.col(label).alias("y"), unpivot_values([(s.feature, [bin_index(df, s)]) for s in specs], ["bin_index"])
        )
        .groupBy("feature", "bin_index")
        .agg(F.count("*").alias("count"), F.sum("y").cast("long").alias("bad"))
    )


def merge_bins(
    edges: Sequence[float],
    cells: Mapping[int, tuple[int, int]],
    rows: int,
    min_bins: int = 2,
    min_share: float = 0.03,
) -> list[float]:
    """Drop inner edges, closest neighbouring bad rates first, until rates are monotone and no bin is
    small. Works on the finest bins' counts only: merging neighbours just adds them up."""
    edges = list(edges)
    parts = [list(cells.get(i, (0, 0))) for i in range(len(edges) + 1)]
    while edges and len(edges) + 1 > min_bins:
        seen = [p for p in parts if p[0]]
        rates = [bad / count for count, bad in seen]
        if is_monotonic(rates) and all(count / rows >= min_share for count, _ in seen):
            break
        gaps = [abs(b - a) for a, b in zip(rates, rates[1:])]
        # Only observed bins are compared, so with an empty interval the position is that of the gap.
        drop = min(gaps.index(min(gaps)) if gaps else 0, len(edges) - 1)
        edges.pop(drop)
        absorbed = parts.pop(drop + 1)
        parts[drop] = [parts[drop][0] + absorbed[0], parts[drop][1] + absorbed[1]]
    return edges


def fit_numeric(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    *,
    max_bins: int = 10,
    min_bins: int = 2,
    min_share: float = 0.03,
    edge_digits: int | None = None,
) -> dict[str, BinSpec]:
    """Monotone numeric bins of all features from one counting job over the finest bins."""
    if not features:
        return {}
    edges = finest_edges(df, features, max_bins, edge_digits)
    counted: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in features}
    for r in finest_bins(df, label, edges).collect():
        counted[r["feature"]][r["bin_index"]] = (r["count"], r["bad"])
    specs = {}
    for f in features:
        total = sum(n for n, _ in counted[f].values())
        kept = merge_bins(edges[f], counted[f], total, min_bins, min_share)
        specs[f] = _numeric_spec(f, edges[f], kept, counted[f])
    return specs


def _numeric_spec(
    feature: str, fine: Sequence[float], kept: Sequence[float], counted: Mapping[int, tuple[int, int]]
) -> BinSpec:
    merged: dict[int, list[int]] = {}
    for index, (count, bad) in counted.items():
        place = index if index == MISSING_INDEX else sum(1 for e in kept if index > fine.index(e))
        cell = merged.setdefault(place, [0, 0])
        cell[0] += count
        cell[1] += bad
    names = interval_labels(kept)
    cells = [
        (names[i] if i != MISSING_INDEX else fixed.MISSING, i, *merged[i])
        for i in sorted(merged, key=lambda i: (i == MISSING_INDEX, i))
    ]
    rows, iv = woe_rows(cells)
    rates = [r.bad_rate for r in rows if r.index != MISSING_INDEX]
    return BinSpec(
        feature, "numeric", edges=tuple(kept), rows=rows, iv=iv, monotonic=is_monotonic(rates),
        source="auto_monotonic",
    )


def category_counts(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    return (
        df.select(F.col(label).alias("y"), unpivot_values([(f, [_category(f)]) for f in features], ["value"]))
        .groupBy("feature", "value")
        .agg(F.count("*").alias("count"), F.sum("y").cast("long").alias("bad"))
    )


def _rare(rare_fraction: float) -> Column:
    floor = F.greatest(F.lit(20), F.floor(F.col("n") * F.lit(rare_fraction)))
    return (F.col("value") != fixed.MISSING) & (F.col("count") < floor)


def folded_categories(counts: DataFrame, rare_fraction: float = 0.01) -> DataFrame:
    """Categories after rare ones are folded: at most 1/rare_fraction + 2 rows per feature."""
    totals = counts.groupBy("feature").agg(F.sum("count").alias("n"))
    return (
        counts.join(totals, "feature")
        .withColumn("value", F.when(_rare(rare_fraction), F.lit(fixed.RARE)).otherwise(F.col("value")))
        .groupBy("feature", "value")
        .agg(F.sum("count").alias("count"), F.sum("bad").alias("bad"))
    )


def categorical_groups(folded: DataFrame, max_bins: int = 8) -> DataFrame:
    """Group number per folded category: bad-rate order cut into equally many categories per group."""
    order = Window.partitionBy("feature").orderBy(F.col("bad") / F.col("count"), "value")
    whole = Window.partitionBy("feature")
    numbered = folded.withColumn("kinds", F.count("*").over(whole)).withColumn("place", F.row_number().over(order))
    cut = F.ntile(max_bins).over(order)
    return numbered.withColumn(
        "group_index", F.when(F.col("kinds") <= max_bins, F.col("place")).otherwise(cut) - 1
    ).drop("kinds")


def fit_categorical(
    df: DataFrame, label: str, features: Sequence[str], *, max_bins: int = 8, rare_fraction: float = 0.01,
    literal_rare: int = LITERAL_RARE_VALUES,
) -> dict[str, BinSpec]:
    """Groups in bad-rate order. Rare categories beyond ``literal_rare`` go to a dictionary table in the shared folder."""
    if not features:
        return {}
    # Counted once: groups, totals and rare values all come from this table.
    counts = materialize(category_counts(df, label, features), "categories")
    grouped = categorical_groups(folded_categories(counts, rare_fraction), max_bins).collect()
    totals = counts.groupBy("feature").agg(F.sum("count").alias("n"))
    rare = counts.join(totals, "feature").filter(_rare(rare_fraction)).select("feature", "value")
    sizes = {
        r["feature"]: (r["n"], f"{r['x'] & (2**64 - 1):016x}")
        for r in rare.groupBy("feature").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("value")).alias("x")).collect()
    }
    crowded = [f for f in features if sizes.get(f, (0, ""))[0] > literal_rare]
    dictionaries = {}
    for f in crowded:
        dictionaries[f] = scratch_path(df.sparkSession, "rare-values")
        rare.filter(F.col("feature") == f).select("value").write.parquet(dictionaries[f])
    listed: dict[str, list[str]] = {f: [] for f in features}
    for r in rare.filter(~F.col("feature").isin(*crowded)).collect():
        listed[r["feature"]].append(r["value"])
    specs = {}
    for f in features:
        rows = sorted((r for r in grouped if r["feature"] == f), key=lambda r: r["place"])
        size = max(r["group_index"] for r in rows) + 1
        members = [[r for r in rows if r["group_index"] == g] for g in range(size)]
        cells = [
            (group_label(g), g, sum(r["count"] for r in m), sum(r["bad"] for r in m))
            for g, m in enumerate(members)
        ]
        woe, iv = woe_rows(cells)
        specs[f] = BinSpec(
            f,
            "categorical",
            groups=tuple(tuple(r["value"] for r in m) for m in members),
            rare_values=tuple(sorted(listed[f])),
            rare_table=dictionaries.get(f, ""),
            rare_digest=sizes[f][1] if f in dictionaries else "",
            rows=woe,
            iv=iv,
            monotonic=is_monotonic([r.bad_rate for r in woe]),
            source="auto_bad_rate_order",
        )
    return specs


def fit_binning(
    df: DataFrame, label: str, features: Sequence[str], *, edge_digits: int | None = None
) -> Binning:
    numeric = [f for f in features if is_numeric(df.schema[f].dataType)]
    other = [f for f in features if f not in numeric]
    found = {**fit_numeric(df, label, numeric, edge_digits=edge_digits), **fit_categorical(df, label, other)}
    return Binning({f: found[f] for f in features})


def validate_manual_spec(spec: BinSpec) -> None:
    if spec.kind == "numeric":
        if list(spec.edges) != sorted(set(spec.edges)):
            raise ValueError("MANUAL_NUMERIC_EDGES_INVALID")
    elif spec.kind == "categorical":
        values = [v for g in spec.groups for v in g]
        if len(values) != len(set(values)):
            raise ValueError("MANUAL_CATEGORY_OVERLAP")
    else:
        raise ValueError("MANUAL_BIN_KIND_INVALID")


def apply_manual_binning(binning: Binning, df: DataFrame, label: str, spec: BinSpec) -> Binning:
    """Replace one feature's bins by hand-made ones and recompute their WOE on the training rows."""
    if spec.feature not in df.columns:
        raise ValueError("MANUAL_BIN_COLUMN_NOT_FOUND")
    validate_manual_spec(spec)
    if spec.kind == "numeric":
        places = {MISSING_INDEX: fixed.MISSING, **dict(enumerate(interval_labels(spec.edges)))}
    else:
        places = {None: fixed.OTHER, **{i: group_label(i) for i in range(len(spec.groups))}}
    marked = with_rare_marks(df, [spec])
    counted = (
        marked.groupBy(bin_index(marked, spec).alias("i"))
        .agg(F.count("*").alias("count"), F.sum(label).cast("long").alias("bad"))
        .collect()
    )
    # Labels of groups are ordered as text, where <OTHER> comes first; missing numbers come last.
    last = len(places)
    ordered = sorted(counted, key=lambda r: -1 if r["i"] is None else last if r["i"] == MISSING_INDEX else r["i"])
    rows, iv = woe_rows(
        [(places[r["i"]], len(spec.groups) if r["i"] is None else r["i"], r["count"], r["bad"]) for r in ordered]
    )
    monotonic = is_monotonic([r.bad_rate for r in rows if r.bin != fixed.MISSING])
    excuse = spec.business_exception.strip()
    if not monotonic and len(excuse) < 8:
        raise ValueError("MANUAL_BIN_NOT_MONOTONIC")
    updated = replace(
        spec, rows=rows, iv=iv, monotonic=monotonic, source="manual",
        business_exception="" if monotonic else excuse,
    )
    return Binning({**binning.specs, spec.feature: updated}, ("training", "review", "report"))


# --- tables --------------------------------------------------------------------------------

TABLE_SCHEMA = (
    "feature string, kind string, source string, monotonic boolean, bin_index int, bin string, `count` long, "
    "bad long, good long, bad_rate double, woe double, iv double, feature_iv double"
)


def bin_table(spark: SparkSession, binning: Binning) -> DataFrame:
    """The specs' WOE tables as rows: bins × features, never more."""
    rows = [
        (s.feature, s.kind, s.source, s.monotonic, r.index, r.bin, r.count, r.bad, r.good, r.bad_rate, r.woe, r.iv, s.iv)
        for s in binning.specs.values()
        for r in s.rows
    ]
    return spark.createDataFrame(rows, TABLE_SCHEMA)


def woe_table(df: DataFrame, label: str, binning: Binning, keys: Sequence[str] = ()) -> DataFrame:
    """Counts, rates, WOE and IV per bin of the given rows, all features (and keys) in one job."""
    specs = list(binning.specs.values())
    marked = with_rare_marks(df, specs)
    long = marked.select(
        *keys,
        F.col(label).alias("y"),
        unpivot_values(
            [(s.feature, [F.coalesce(bin_index(marked, s), F.lit(len(s.groups))), bin_label(marked, s)]) for s in specs],
            ["bin_index", "bin"],
        ),
    )
    counted = long.groupBy(*keys, "feature", "bin_index", "bin").agg(
        F.count("*").alias("count"), F.sum("y").cast("long").alias("bad")
    )
    return woe_columns(counted, [*keys, "feature"])


def bin_report(df: DataFrame, label: str, binning: Binning, partition: str = "partition") -> DataFrame:
    """Training bins applied to every partition, with lift against the partition's bad rate."""
    table = woe_table(df, label, binning, [partition])
    whole = Window.partitionBy(partition, "feature")
    overall = F.sum("bad").over(whole) / F.sum("count").over(whole)
    return table.withColumns(
        {"overall_bad_rate": overall, "feature_iv": F.sum("iv").over(whole)}
    ).withColumn("lift", F.try_divide("bad_rate", "overall_bad_rate"))


def _bin_order(keys: Sequence[str]):
    """Bins in order; <OTHER> comes before the groups, as its label does."""
    return Window.partitionBy(*keys).orderBy(F.col("bin") != fixed.OTHER, "bin_index")


def monotonicity(table: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Is the bad rate monotone over the bins? Up to two bins always are."""
    order = _bin_order(keys)
    step = F.col("bad_rate") - F.lag("bad_rate").over(order)
    return (
        table.filter(F.col("bin_index") != MISSING_INDEX)
        .withColumn("step", step)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("bins"),
            (
                (F.count("*") <= 2)
                | F.coalesce(F.bool_and(F.col("step") >= -TOLERANCE), F.lit(True))
                | F.coalesce(F.bool_and(F.col("step") <= TOLERANCE), F.lit(True))
            ).alias("monotonic"),
        )
    )


def merge_suggestions(table: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Neighbouring bins of non-monotone features, closest bad rates first."""
    keys = list(keys)
    order = _bin_order(keys)
    rows = table.filter(F.col("bin_index") != MISSING_INDEX)
    broken = monotonicity(table, keys).filter(~F.col("monotonic") & (F.col("bins") >= 3)).select(*keys)
    paired = rows.withColumns(
        {
            "right_index": F.lead("bin_index").over(order),
            "__rate": F.lead("bad_rate").over(order),
            "__count": F.lead("count").over(order),
            "__bad": F.lead("bad").over(order),
        }
    ).filter(F.col("right_index").isNotNull())
    merged = F.col("count") + F.col("__count")
    return paired.join(broken, keys, "left_semi").select(
        *keys,
        F.col("bin_index").alias("left_index"),
        "right_index",
        F.round(F.abs(F.col("bad_rate") - F.col("__rate")), 8).alias("distance"),
        merged.alias("merged_count"),
        F.round((F.col("bad") + F.col("__bad")) / merged, 8).alias("merged_bad_rate"),
    )

"""The modelling run from a raw table to a champion, as one function over DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lendwright.operators.binning import Binning, BinSpec, apply_manual_binning, bin_report, bin_table, fit_binning
from lendwright.operators.cleaning import apply_cleaning
from lendwright.operators.labels import freeze_target
from lendwright.operators.modeling import TrainingResult, train_candidates
from lendwright.operators.report import bin_sheet, comparison_sheet, executive_summary, feature_sheet, sample_overview
from lendwright.operators.screening import ScreeningThresholds, restore_features, screen_features
from lendwright.operators.splits import TEST, TRAIN, SplitPlan, split_dataset
from lendwright.session import materialize


@dataclass
class ModellingResult:
    split: DataFrame
    screening: DataFrame
    binning: Binning
    training: TrainingResult
    sheets: dict[str, DataFrame]


def modelling_run(
    df: DataFrame,
    target: str,
    row_id: str,
    plan: SplitPlan,
    *,
    protected_targets: Sequence[str] = (),
    cleaning: Sequence[Mapping] = (),
    accepted: Sequence[str] | None = None,
    thresholds: ScreeningThresholds = ScreeningThresholds(),
    restored: Mapping[str, str] | None = None,
    manual_bins: Sequence[BinSpec] = (),
    models: Sequence[str] = ("dummy", "scorecard", "regularized_logistic"),
    options: Mapping[str, Mapping] | None = None,
    calibrate: bool = True,
    out_of_fold_metrics: bool = True,
    review_passed: bool = False,
) -> ModellingResult:
    """Freeze, split, screen, bin, train, report. The frozen rows are written once for the passes of the split, and the split
    table for every later step; everything fitted sees training rows only.

    Decisions of a reviewer come in as arguments: ``accepted`` steps of a ``cleaning`` plan, ``restored`` features with
    their reasons, ``manual_bins``, and ``review_passed`` for the verdict.
    """
    cleaned = apply_cleaning(df, cleaning, accepted) if cleaning else df
    frozen = materialize(freeze_target(cleaned, target), "frozen")
    split = materialize(split_dataset(frozen, target, row_id, plan), "split")
    train = split.filter(F.col("partition") == TRAIN)
    keep_out = {target, row_id, plan.time_column, "partition", "exclusion_reason"}
    names = [c for c in cleaned.columns if c not in keep_out]
    screening = screen_features(train, target, names, protected_targets, thresholds, row_id)
    if restored:
        screening = restore_features(screening, restored)
    features = [r["column"] for r in screening.filter("status = 'included'").select("column").collect()]
    if not features:
        raise ValueError("NO_FEATURES_SELECTED")
    binning = fit_binning(train, target, features, edge_digits=thresholds.edge_digits)
    for spec in manual_bins:
        binning = apply_manual_binning(binning, train, target, spec)
    training = train_candidates(
        split, target, features, row_id, models, options=options, calibrate=calibrate,
        out_of_fold_metrics=out_of_fold_metrics,
    )
    used = split.filter(F.col("partition") != "excluded")
    overview = sample_overview(training.metrics, training.stability)
    ordered = training.ordering.filter(F.col("partition") == TEST).first()["absolute"]
    sheets = {
        "overview": overview,
        "summary": executive_summary(overview, training.champion, ordered, review_passed, len(features)),
        "features": feature_sheet(screening),
        "bins": bin_sheet(bin_table(df.sparkSession, binning)),
        "bin_report": bin_report(used, target, binning),
        "lift": training.lift,
        "ordering": training.ordering,
        "calibration": training.calibration,
        "stability": training.stability,
        "importance": training.importance,
        "comparison": comparison_sheet(training.candidates),
    }
    return ModellingResult(split, screening, binning, training, sheets)


def modelling_run_per_target(df: DataFrame, targets: Sequence[str], row_id: str, plan: SplitPlan, **options) -> dict[str, ModellingResult]:
    """One run per target over the same table; every other target is kept out of the features of each."""
    return {t: modelling_run(df, t, row_id, plan, protected_targets=[o for o in targets if o != t], **options) for t in targets}

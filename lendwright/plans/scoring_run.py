"""Batch scoring: verified read, contract, model, scores, versioned write with evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lendwright.functions.expressions import score_column_name
from lendwright.operators.modeling import PROBABILITY, load_model
from lendwright.operators.scoring import FieldContract, append_scores, apply_contract, score_limits
from lendwright.sources.versions import read_version, write_version


def score_frame(spark: SparkSession, model_path: str, df: DataFrame, model_name: str) -> DataFrame:
    """Map-only from the scan to the scores, apart from the contract check's one aggregate."""
    model, field_types, scale = load_model(spark, model_path)
    contract = FieldContract(field_types)
    checked = apply_contract(df, contract)
    scored = model.score(checked)
    bad = F.col(PROBABILITY).isNull() | F.isnan(PROBABILITY)
    guarded = scored.withColumn(
        PROBABILITY, F.when(bad, F.raise_error(F.lit("MODEL_SCORE_OUTPUT_INVALID"))).otherwise(F.col(PROBABILITY))
    )
    return append_scores(guarded, PROBABILITY, model_name, scale).drop(PROBABILITY)


def score_version(spark: SparkSession, model_path: str, root: str, version: str, model_name: str) -> tuple[str, DataFrame]:
    """Score one dataset version into a new version; returns its id and the evidence row."""
    source = read_version(spark, root, version)
    scored = score_frame(spark, model_path, source, model_name)
    created = write_version(
        scored, root, f"scores of {model_name}", kind="scoring", parents=[version], details={"model": model_path}
    )
    _, _, scale = load_model(spark, model_path)
    written = read_version(spark, root, created, verify=False)
    name = score_column_name(model_name)
    return created, score_limits(written, f"{name}_bad_probability", scale).withColumn("score_column", F.lit(name))

"""Scalar column functions on scores, features, ids and configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Feature columns in their significant order.
FEATURES = (
    "ocr_confidence_p10",
    "ocr_confidence_mean",
    "ocr_confidence_std",
    "ocr_box_count",
    "unmatched_ocr_ratio",
    "predicted_row_count",
    "predicted_column_count",
    "predicted_cell_count",
    "predicted_spanning_cell_count",
    "empty_cell_ratio",
    "numeric_looking_cell_ratio",
    "image_aspect_ratio",
    "cell_area_coefficient_of_variation",
)
# Fixed value: differences up to this size count as unchanged.
TIE_TOLERANCE = 1e-9


def finite_or_null(value: Column) -> Column:
    """Null for NaN and for both infinities."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def cell_indices(numbers: Column, start: Column, end: Column) -> Column:
    """Explicit index list when there is one, else the half-open range, else an empty list."""
    span = F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(numbers, span, F.array().cast("array<int>"))


def stable_id(report_id: Column, page_index: Column, detection_index: Column) -> Column:
    """Readable table id; null when an index is negative."""
    text = F.format_string("%s::page-%04d::table-%04d", report_id, page_index, detection_index)
    return F.when((page_index >= 0) & (detection_index >= 0), text)


def hashed_key(text: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def call_benefit(primary: Column, expert: Column, succeeded: Column) -> Column:
    """Expert minus primary; a failed call is worth nothing.  Null marks a success without scores."""
    return F.when(succeeded, finite_or_null(expert) - finite_or_null(primary)).otherwise(F.lit(0.0))


def difficulty_target(primary: Column) -> Column:
    return F.lit(1.0) - primary


def delta_class(delta: Column, tolerance: float = TIE_TOLERANCE) -> Column:
    return (
        F.when(delta > tolerance, "improved").when(delta < -tolerance, "harmed").otherwise("unchanged")
    )


def score_or_zero(value: Column) -> Column:
    return F.coalesce(finite_or_null(value), F.lit(0.0))


def deployed_score(routed: Column, succeeded: Column, primary: Column, expert: Column) -> Column:
    """Score after replacement: the expert's where it was called and succeeded, else the primary's."""
    return score_or_zero(F.when(F.coalesce(routed, F.lit(False)) & succeeded, expert).otherwise(primary))


def canonical_params(names: Sequence[str]) -> Column:
    """Compact JSON of parameter columns with sorted keys."""
    return F.to_json(F.struct(*[F.col(name) for name in sorted(names)]), {"ignoreNullFields": "false"})


def identity_hash(columns: Sequence[str]) -> Column:
    """Identity of a producing configuration; equal hashes mean a finished record can be reused."""
    return F.sha2(canonical_params(columns), 256)


def ordered_features(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exactly the known features in their order, as nullable finite doubles."""
    missing = [name for name in FEATURES if name not in df.columns]
    if missing:
        raise ValueError(f"feature columns are missing: {missing}")
    return df.select(*keys, *[finite_or_null(F.col(name)).alias(name) for name in FEATURES])

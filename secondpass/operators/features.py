"""The thirteen observations per primary record."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from secondpass.functions import observations
from secondpass.functions.scalars import ordered_features
from secondpass.functions.text import is_numeric_looking, normalize_text
from secondpass.operators.order import exact_percentiles
from secondpass.operators.spatial import unmatched_ocr


def ocr_features(boxes: DataFrame, cells: DataFrame, key: str = "sample_id", largest: float = 65536.0,
                 bounded: bool = False) -> DataFrame:
    """Confidence statistics, box count and the share of boxes outside all cells."""
    # Confidences a hair outside [0, 1] are clipped, others are ignored.
    usable = "confidence BETWEEN -1e-6 AND 1 + 1e-6"
    clipped = boxes.withColumn("_conf", F.expr(f"if({usable}, least(1D, greatest(0D, confidence)), NULL)"))
    moments = clipped.groupBy(key).agg(
        F.avg("_conf").alias("ocr_confidence_mean"), F.stddev_pop("_conf").alias("ocr_confidence_std"))
    tail = exact_percentiles(clipped, "_conf", {"ocr_confidence_p10": 0.1}, [key], bounded=bounded)
    matching = unmatched_ocr(boxes, cells, key, largest=largest, bounded=bounded).selectExpr(
        key, "CAST(box_count AS DOUBLE) AS ocr_box_count", "unmatched_ocr_ratio")
    return moments.join(matching, key).join(tail, key, "left")


# Printable ASCII without spaces that is its own normal form and has no digit, or begins as ``is_numeric_looking`` is sure of.
_DECIDED = r"^(?:[!-/:-~]*|[+-]?[0-9]+(?:%?|[-/:;)\]][!-~]*))\z"


def _decided() -> Column:
    return F.col("text").isNull() | F.col("text").rlike(_DECIDED)


def undecided_texts(cells: DataFrame) -> DataFrame:
    """Cells whose texts Python functions have to look at."""
    return cells.where(~_decided())


def _looked_at(cells: DataFrame) -> DataFrame:
    """Cells with their normal ``_text`` and whether it is ``_numeric``; only undecided texts go to Python."""
    plain = cells.where(_decided()).withColumn("_text", F.col("text")).withColumn(
        "_numeric", F.coalesce(F.col("text").rlike("[0-9]"), F.lit(False)))
    others = undecided_texts(cells).withColumn("_text", normalize_text(F.col("text"))).withColumn(
        "_numeric", is_numeric_looking(F.col("_text")))
    return plain.unionByName(others)


def cell_features(cells: DataFrame, key: str = "sample_id") -> DataFrame:
    """Shape, emptiness, numeric share and area spread of predicted cells."""
    per_table = _looked_at(cells).groupBy(key).agg(
        F.count(F.lit(1)).cast("double").alias("predicted_cell_count"),
        F.count_if(F.expr("row_end - row_start > 1 OR column_end - column_start > 1")).cast("double")
        .alias("predicted_spanning_cell_count"),
        F.avg((F.col("_text") == "").cast("double")).alias("empty_cell_ratio"),
        F.avg(F.col("_numeric").cast("double")).alias("numeric_looking_cell_ratio"),
        F.expr("try_divide(stddev_pop((x1 - x0) * (y1 - y0)), avg((x1 - x0) * (y1 - y0)))")
        .alias("cell_area_coefficient_of_variation"),
    )
    # Distinct indices are removed map-side before they meet.
    lines = (
        "concat(transform(sequence(row_start, row_end - 1), i -> struct('r' AS axis, i AS line)),"
        " transform(sequence(column_start, column_end - 1), i -> struct('c' AS axis, i AS line)))"
    )
    shape = cells.selectExpr(key, f"inline({lines})").distinct().groupBy(key).agg(
        F.count_if(F.col("axis") == "r").cast("double").alias("predicted_row_count"),
        F.count_if(F.col("axis") == "c").cast("double").alias("predicted_column_count"),
    )
    return per_table.join(shape, key)


@F.arrow_udf(from_arrow_type(observations.KIND))
def _observed(cells: pa.Array, boxes: pa.Array) -> pa.Array:
    return observations.observe(cells, boxes)


def record_features(records: DataFrame, key: str = "sample_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Feature columns in order of records ``(key, image_width, image_height, cells, boxes)``; unavailable stays null.

    A record holds its cells and text boxes as arrays of structs, so nothing is moved or joined.
    """
    seen = records.withColumn("_seen", _observed(F.col("cells"), F.col("boxes")))
    return ordered_features(seen.select(key, *keep, "_seen.*", _aspect().alias("image_aspect_ratio")), [key, *keep])


def _aspect() -> Column:
    return F.when(F.col("image_height") > 0, F.col("image_width") / F.col("image_height"))


def _held(rows: DataFrame, key: str, fields: tuple[str, ...], name: str) -> DataFrame:
    """One row per key with the ``fields`` of its rows as an array."""
    return rows.groupBy(key).agg(F.collect_list(F.struct(*fields)).alias(name))


def primary_features(records: DataFrame, boxes: DataFrame, cells: DataFrame, key: str = "sample_id",
                     keep: tuple[str, ...] = (), largest: float = 65536.0, bounded: bool = False) -> DataFrame:
    """Feature columns in order for every record ``(key, image_width, image_height)``; unavailable stays null.

    Where tables are small by construction of the keys (``bounded=True``), each text box and cell moves once, to its record.
    """
    if bounded:
        held = records.join(_held(cells, key, observations.CELL, "cells"), key, "left").join(
            _held(boxes, key, observations.BOX, "boxes"), key, "left")
        return record_features(held, key, keep)
    joined = (
        records.join(ocr_features(boxes, cells, key, largest, bounded), key, "left")
        .join(cell_features(cells, key), key, "left")
        .withColumn("image_aspect_ratio", _aspect())
        .withColumn("ocr_box_count", F.coalesce("ocr_box_count", F.lit(0.0)))
    )
    return ordered_features(joined, [key, *keep])

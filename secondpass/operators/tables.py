"""Table payloads to canonical cell rows, and validation of cell tables."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from secondpass.functions import tables as reader
from secondpass.functions.geometry import to_top_left
from secondpass.functions.text import normalize_text, sanitize_error
from secondpass.operators.order import with_rank
from secondpass.operators.spatial import box_pairs

_CELL_ARROW = pa.struct([
    ("row_start", pa.int32()), ("row_end", pa.int32()), ("column_start", pa.int32()), ("column_end", pa.int32()),
    ("text", pa.string()), ("is_column_header", pa.bool_()), ("is_row_header", pa.bool_()),
])
_PARSED_ARROW = pa.struct([
    ("status", pa.string()), ("format", pa.string()), ("error", pa.string()), ("cells", pa.list_(_CELL_ARROW)),
])


def _read(text: str | bytes | None, notation: str, strict: bool) -> dict:
    try:
        if isinstance(text, bytes):
            text = reader.decoded(text)
        if text is None:
            raise reader.TableError("output: null")
        if notation == "auto":
            cells, notation = reader.output_cells(text)
        else:
            cells = reader.html_cells(text, strict) if notation == "html" else reader.markdown_cells(text)
    except reader.TableError as error:
        return {"status": "parse_failed", "format": None, "error": str(error), "cells": []}
    return {"status": "success", "format": notation, "error": None, "cells": cells}


def _parser(notation: str, strict: bool):
    @F.arrow_udf(from_arrow_type(_PARSED_ARROW))
    def parse(payload: pa.Array) -> pa.Array:
        return pa.array([_read(text, notation, strict) for text in payload.to_pylist()], type=_PARSED_ARROW)

    return parse


def parse_tables(df: DataFrame, id_cols: Sequence[str], payload: str, notation: str = "auto", strict: bool = True) -> DataFrame:
    """One row per cell; a payload that cannot be read gives one row with its error and no cell.

    ``notation`` is ``html``, ``markdown`` or ``auto``; ``strict=False`` reads reference HTML. The payload may be
    text or binary; binary that is not UTF-8 fails its row.
    """
    parsed = df.select(*id_cols, _parser(notation, strict)(F.col(payload)).alias("_parsed"))
    rows = parsed.select(
        *id_cols, F.col("_parsed.status").alias("status"), F.col("_parsed.format").alias("format"),
        sanitize_error(F.col("_parsed.error")).alias("_error"), F.explode_outer("_parsed.cells").alias("_cell"),
    )
    fields = ("row_start", "row_end", "column_start", "column_end", "text", "is_column_header", "is_row_header")
    return rows.select(
        *id_cols, "status", "format", F.when(F.col("status") != "success", F.col("_error")).alias("error"),
        *[F.col(f"_cell.{name}").alias(name) for name in fields],
    )


def parse_table_records(df: DataFrame, id_cols: Sequence[str], payload: str, notation: str = "auto", strict: bool = True) -> DataFrame:
    """One row per payload with its cells as an array."""
    parsed = df.select(*id_cols, _parser(notation, strict)(F.col(payload)).alias("_parsed"))
    return parsed.select(*id_cols, "_parsed.status", "_parsed.format", "_parsed.error", "_parsed.cells")


_FOUND_ARROW = pa.struct([
    ("table_count", pa.int32()), ("blocks", pa.list_(pa.string())), ("nested", pa.bool_()), ("malformed", pa.bool_()),
])


@F.arrow_udf(from_arrow_type(_FOUND_ARROW))
def _top_level(markup: pa.Array) -> pa.Array:
    return pa.array([None if m is None else reader.top_level_tables(m) for m in markup.to_pylist()], type=_FOUND_ARROW)


def top_level_tables(df: DataFrame, id_cols: Sequence[str], markup: str) -> DataFrame:
    """Per page: outermost table count and blocks, nested flag, malformed flag."""
    return df.select(*id_cols, _top_level(F.col(markup)).alias("_found")).select(*id_cols, "_found.*")


def cell_order(has_box: bool = False) -> list[Column]:
    """Sort keys of canonical cells."""
    keys = ["row_start", "column_start", "row_end", "column_end"]
    return [F.asc(k) for k in [*keys, *(["x0", "y0", "x1", "y1"] if has_box else []), "text"]]


def validate_cells(cells: DataFrame, key: str = "sample_id", allow_overlaps: bool = False, bounded: bool = False) -> DataFrame:
    """Problems of cell tables as ``(key, cell_no, problem)`` rows; no rows means every table is valid (``bounded`` as in ``box_pairs``)."""
    bad_range = (
        "row_start IS NULL OR row_end IS NULL OR column_start IS NULL OR column_end IS NULL OR "
        "row_start < 0 OR column_start < 0 OR row_end <= row_start OR column_end <= column_start"
    )
    rules = cells.select(
        key, "cell_no",
        F.explode(F.expr(
            f"filter(array(if({bad_range}, 'invalid range', NULL), if(text IS NULL, 'text missing', NULL)), p -> p IS NOT NULL)"
        )).alias("problem"),
    )
    if allow_overlaps:
        return rules
    grid = cells.where(f"NOT ({bad_range})").select(
        key, "cell_no", F.col("column_start").cast("double").alias("x0"), F.col("row_start").cast("double").alias("y0"),
        F.col("column_end").cast("double").alias("x1"), F.col("row_end").cast("double").alias("y1"),
    )
    # A later cell collides with an earlier one; report each colliding cell once.
    pairs = box_pairs(grid.withColumnRenamed("cell_no", "left_no"), grid.withColumnRenamed("cell_no", "right_no"), key, bounded=bounded)
    clashes = pairs.where("left_no < right_no").groupBy(key, F.col("right_no").alias("cell_no")).agg(
        F.lit("cells overlap").alias("problem"))
    return rules.unionByName(clashes)


def _judged_cells(cells: DataFrame) -> DataFrame:
    """Cells with their top-left ``_box`` and the ``_reason`` why a cell fails its table, else null."""
    bad = "row_start < 0 OR column_start < 0 OR row_end <= row_start OR column_end <= column_start"
    box = to_top_left(*[F.col(c) for c in ("xa", "ya", "xb", "yb", "origin", "image_height")])
    # A box that is present but unusable fails its table, a missing box does not.
    return cells.withColumn("_box", box).withColumn("_reason", F.expr(
        f"CASE WHEN coalesce({bad}, row_start + row_end + column_start + column_end IS NULL) THEN 'invalid range' "
        "WHEN xa IS NOT NULL AND _box IS NULL THEN 'unusable box' END"))


def cell_failures(cells: DataFrame, key: str = "sample_id") -> DataFrame:
    """Tables that ``canonical_cells`` leaves out, one row each with the first reason in alphabetical order."""
    return _judged_cells(cells).where("_reason IS NOT NULL").groupBy(key).agg(F.min("_reason").alias("reason"))


def canonical_cells(cells: DataFrame, key: str = "sample_id", bounded: bool = False) -> DataFrame:
    """Valid cells numbered in canonical order, text never null; ``cell_failures`` names the tables left out.

    Input boxes have corners ``xa, ya, xb, yb``, an ``origin`` and ``image_height``.
    """
    checked = _judged_cells(cells)
    failed = checked.where("_reason IS NOT NULL").select(key).distinct()
    kept = checked.join(failed, key, "left_anti").select(
        key, "row_start", "row_end", "column_start", "column_end", F.coalesce("text", F.lit("")).alias("text"),
        *[F.col(f"_box.{side}").alias(side) for side in ("x0", "y0", "x1", "y1")],
        F.coalesce("column_header", F.lit(False)).alias("is_column_header"),
        (F.coalesce("row_header", F.lit(False)) | F.coalesce("row_section", F.lit(False))).alias("is_row_header"),
    )
    numbered = with_rank(kept, cell_order(has_box=True), [key], "cell_no", bounded=bounded)
    return numbered.withColumn("cell_no", F.col("cell_no") - 1)


def dedupe_ocr(boxes: DataFrame, key: str = "sample_id", position: str = "index",
               identity: Sequence[str] = ("text", "xa", "ya", "xb", "yb", "origin", "confidence"),
               bounded: bool = False) -> DataFrame:
    """First of every structurally equal text box, renumbered from 0; invalid evidence becomes null."""
    columns = [c for c in boxes.columns if c not in (key, position)]
    firsts = boxes.groupBy(key, *identity).agg(
        F.min(position).alias("_first"),
        *[F.min_by(c, position).alias(c) for c in columns if c not in identity],
    )
    ranked = with_rank(firsts, ["_first"], [key], "record_no", bounded=bounded).withColumn("record_no", F.col("record_no") - 1)
    box = to_top_left(*[F.col(c) for c in ("xa", "ya", "xb", "yb", "origin", "image_height")])
    finite = ~F.isnan("confidence") & (F.abs("confidence") != float("inf"))
    return ranked.withColumn("_box", box).select(
        key, "record_no", "text", *[F.col(f"_box.{side}").alias(side) for side in ("x0", "y0", "x1", "y1")],
        F.when(finite, F.col("confidence")).alias("confidence"),
    )


def normalized_cells(cells: DataFrame) -> DataFrame:
    return cells.withColumn("text", normalize_text(F.col("text")))

"""Box functions.  A box is four double columns, so predicates stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def box_struct(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Struct of the four sides, or null unless all are finite and the area is positive."""
    # A side is written out few times: longer code than this is not compiled by the JVM and runs many times slower.
    sides = [side.cast("double") for side in (x0, y0, x1, y1)]
    valid = (sides[0] < sides[2]) & (sides[1] < sides[3])
    for side in sides:
        valid = valid & (F.abs(side) < F.lit(float("inf")))  # NaN is above infinity
    return F.when(valid, F.struct(*[side.alias(name) for side, name in zip(sides, SIDES)]))


def cell_bbox(corners: Column, named: Column) -> Column:
    """Box from a four-element list or from a struct with fields l, t, r, b."""
    from_list = F.when(F.size(corners) == 4, box_struct(*[F.get(corners, i) for i in range(4)]))
    from_named = box_struct(*[named[side] for side in ("l", "t", "r", "b")])
    return F.when(corners.isNotNull(), from_list).otherwise(from_named)


def _origin(origin: Column) -> Column:
    return F.translate(F.lower(origin), "_-", "")


def to_top_left(x_a: Column, y_a: Column, x_b: Column, y_b: Column, origin: Column, height: Column) -> Column:
    """Sorted corners with y growing downwards; null for an unknown origin or an empty box."""
    kind = _origin(origin)
    low, high = F.least(y_a, y_b), F.greatest(y_a, y_b)
    left, right = F.least(x_a, x_b), F.greatest(x_a, x_b)
    return F.when(kind == "topleft", box_struct(left, low, right, high)).when(
        kind == "bottomleft", box_struct(left, height - high, right, height - low))


def crop_box(box: Column, page_width: Column, page_height: Column, width: Column, height: Column) -> Column:
    """Pixel box of a page box: scaled, widened to whole pixels, kept inside the image."""
    scale_x = width.cast("double") / page_width
    scale_y = height.cast("double") / page_height

    def clamp(value: Column, top: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(value.cast("long"), top.cast("long")))

    left = clamp(F.floor(box["x0"] * scale_x), width - 1)
    upper = clamp(F.floor(box["y0"] * scale_y), height - 1)
    right = clamp(F.ceil(box["x1"] * scale_x), width)
    lower = clamp(F.ceil(box["y1"] * scale_y), height)
    return F.when(
        (right > left) & (lower > upper),
        F.struct(left.alias("x0"), upper.alias("y0"), right.alias("x1"), lower.alias("y1")),
    )


def overlap_area(a: str, b: str) -> Column:
    """Area shared by two boxes whose columns carry the prefixes ``a`` and ``b`` (0 when apart)."""
    return F.greatest(overlap_side(a, b, "x"), F.lit(0.0)) * F.greatest(overlap_side(a, b, "y"), F.lit(0.0))


def overlap_side(a: str, b: str, axis: str) -> Column:
    far = F.least(F.col(f"{a}{axis}1"), F.col(f"{b}{axis}1"))
    return far - F.greatest(F.col(f"{a}{axis}0"), F.col(f"{b}{axis}0"))


def box_area(prefix: str = "") -> Column:
    width = F.col(f"{prefix}x1") - F.col(f"{prefix}x0")
    return width * (F.col(f"{prefix}y1") - F.col(f"{prefix}y0"))


def box_intersection(a: str, b: str) -> Column:
    """Shared box as a struct, or null when the boxes do not overlap."""
    return box_struct(
        F.greatest(F.col(f"{a}x0"), F.col(f"{b}x0")), F.greatest(F.col(f"{a}y0"), F.col(f"{b}y0")),
        F.least(F.col(f"{a}x1"), F.col(f"{b}x1")), F.least(F.col(f"{a}y1"), F.col(f"{b}y1")),
    )


def extent() -> list[Column]:
    """Aggregates for the smallest box around many boxes."""
    return [
        F.min("x0").alias("x0"), F.min("y0").alias("y0"),
        F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    ]

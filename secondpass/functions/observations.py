"""Features of many small tables side by side: one array operation serves all records of an Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from secondpass.functions.tables import normalize
from secondpass.functions.text import looks_numeric

CELL = ("row_start", "row_end", "column_start", "column_end", "text", "x0", "y0", "x1", "y1")
BOX = ("x0", "y0", "x1", "y1", "confidence")
NAMES = (
    "ocr_confidence_p10", "ocr_confidence_mean", "ocr_confidence_std", "ocr_box_count", "unmatched_ocr_ratio",
    "predicted_row_count", "predicted_column_count", "predicted_cell_count", "predicted_spanning_cell_count",
    "empty_cell_ratio", "numeric_looking_cell_ratio", "cell_area_coefficient_of_variation",
)
KIND = pa.struct([(name, pa.float64()) for name in NAMES])
# Printable ASCII without spaces that is its own normal form and has no digit, or begins as ``is_numeric_looking`` is sure of.
_DECIDED = r"^(?:[!-/:-~]*|[+-]?[0-9]+(?:%?|[-/:;)\]][!-~]*))\z"
_PAIRS_AT_ONCE = 1 << 20


def _members(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
    """List lengths, the record of every member, and the members' fields."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    members = lists.flatten()
    fields = dict(zip([field.name for field in members.type], members.flatten()))
    return sizes, np.repeat(np.arange(len(lists)), sizes), fields


def _numbers(field: pa.Array, kind=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """Values, 0 for null, and whether they are there."""
    present = field.is_valid().to_numpy(zero_copy_only=False)
    return np.asarray(pc.fill_null(field, 0).to_numpy(zero_copy_only=False), dtype=kind), present


def _per_record(owner: np.ndarray, values: np.ndarray, records: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=records)


def _ordered(owner: np.ndarray, values: np.ndarray, records: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values in order inside their record, their number per record, and where each record starts."""
    count = np.bincount(owner, minlength=records)
    return values[np.lexsort((values, owner))], count, np.cumsum(count) - count


def _mean_and_spread(owner: np.ndarray, values: np.ndarray, records: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Mean and population deviation; equal values have exactly their value and 0."""
    ordered = _ordered(owner, values, records)
    placed, count, start = ordered
    mean = _per_record(owner, values, records) / count
    some = count > 0
    low, high = placed[start[some]], placed[(start + count - 1)[some]]
    mean[some] = np.where(low == high, low, mean[some])
    return mean, np.sqrt(_per_record(owner, (values - mean[owner]) ** 2, records) / count), ordered


def _percentile(ordered: tuple, share: float) -> np.ndarray:
    placed, count, start = ordered
    if not len(placed):
        return np.full(len(count), np.nan)
    at = np.maximum(count - 1, 0) * share
    low, high = np.floor(at), np.ceil(at)
    last = len(placed) - 1
    a, b = (placed[np.minimum(start + side.astype(np.int64), last)] for side in (low, high))
    return np.where(a == b, a, (high - at) * a + (at - low) * b)


def _covered(owner: np.ndarray, start: np.ndarray, end: np.ndarray, records: int) -> np.ndarray:
    """Number of distinct lines under the intervals of each record."""
    if not len(owner):
        return np.zeros(records)
    low, high = np.minimum(start, end - 1), np.maximum(start, end - 1) + 1
    # Records lie behind each other on one axis, so one running maximum serves them all.
    shift = owner * (high.max() - low.min() + 1)
    low, high = low + shift, high + shift
    order = np.argsort(low, kind="stable")
    low, high = low[order], high[order]
    reached = np.concatenate((low[:1], np.maximum.accumulate(high)[:-1]))
    return _per_record(owner[order], np.maximum(high - np.maximum(low, reached), 0), records)


def _at_most(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a <= b`` where NaN is the largest number."""
    return (a <= b) | np.isnan(b)


def _matched(points: tuple, cells: tuple, records: int) -> np.ndarray:
    """Per record, the points inside or on the edge of some cell of theirs."""
    owner, px, py = points
    cell_owner, x0, y0, x1, y1 = cells
    count = np.bincount(cell_owner, minlength=records)
    first = np.cumsum(count) - count
    width = count[owner]
    hit, upto, begin = np.zeros(len(owner), dtype=bool), np.cumsum(width), 0
    while begin < len(owner):
        # As many points as make a bounded number of pairs, one at least.
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + _PAIRS_AT_ONCE, side="right")))
        sizes = width[begin:end]
        point = np.repeat(np.arange(begin, end), sizes)
        cell = np.arange(len(point)) + np.repeat(first[owner[begin:end]] - (np.cumsum(sizes) - sizes), sizes)
        keep = _at_most(y0[cell], py[point]) & _at_most(py[point], y1[cell])
        point, cell = point[keep], cell[keep]
        keep = _at_most(x0[cell], px[point]) & _at_most(px[point], x1[cell])
        hit[point[keep]] = True
        begin = end
    return _per_record(owner, hit, records)


def _text_flags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which texts are there, which of them are empty, which look numeric, in their normal form; each text is read once."""
    present = texts.is_valid().to_numpy(zero_copy_only=False)
    coded = pc.fill_null(texts, "").dictionary_encode()
    known, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.equal(known, "").to_numpy(zero_copy_only=False).copy()
    numeric = pc.match_substring_regex(known, "[0-9]").to_numpy(zero_copy_only=False).copy()
    decided = pc.match_substring_regex(known, _DECIDED).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(~decided):
        text = normalize(known[int(i)].as_py())
        empty[i], numeric[i] = text == "", looks_numeric(text)
    return present, empty[codes] & present, numeric[codes] & present


def observe(cells: pa.Array, boxes: pa.Array) -> pa.Array:
    """``NAMES`` of every record with its ``CELL`` and ``BOX`` lists; what is not there is null."""
    n = len(cells)
    with np.errstate(all="ignore"):
        sizes, owner, cell = _members(cells)
        box_sizes, box_owner, box = _members(boxes)
        lines, has_lines = zip(*[_numbers(cell[name], np.int64) for name in CELL[:4]])
        corners, has_corners = zip(*[_numbers(cell[side]) for side in CELL[5:]])
        ranged = np.logical_and.reduce(has_lines)
        measured = np.logical_and.reduce(has_corners)
        wide = (has_lines[0] & has_lines[1] & (lines[1] - lines[0] > 1)) | (has_lines[2] & has_lines[3] & (lines[3] - lines[2] > 1))
        present, empty, numeric = _text_flags(cell["text"])
        x0, y0, x1, y1 = corners
        mean, spread, _ = _mean_and_spread(owner[measured], ((x1 - x0) * (y1 - y0))[measured], n)
        shown = np.bincount(owner[ranged], minlength=n) > 0  # without any range a table has no shape and is left out
        result = {
            "predicted_row_count": _covered(owner[ranged], lines[0][ranged], lines[1][ranged], n),
            "predicted_column_count": _covered(owner[ranged], lines[2][ranged], lines[3][ranged], n),
            "predicted_cell_count": sizes.astype(float),
            "predicted_spanning_cell_count": _per_record(owner, wide, n),
            "empty_cell_ratio": _per_record(owner, empty, n) / _per_record(owner, present, n),
            "numeric_looking_cell_ratio": _per_record(owner, numeric, n) / sizes,
            "cell_area_coefficient_of_variation": spread / mean,
        }
        result = {name: np.where(shown, values, np.nan) for name, values in result.items()}

        confidence, usable = _numbers(box["confidence"])
        usable &= (confidence >= -1e-6) & (confidence <= 1 + 1e-6)  # a hair outside [0, 1] is clipped, others are ignored
        mean, spread, ordered = _mean_and_spread(box_owner[usable], np.clip(confidence[usable], 0.0, 1.0), n)
        known = np.bincount(box_owner[usable], minlength=n) > 0
        (bx0, a), (by0, b), (bx1, c), (by1, d) = (_numbers(box[side]) for side in BOX[:4])
        placed, usable_cells = a & b & c & d, measured
        matched = _matched(
            (box_owner[placed], ((bx0 + bx1) / 2)[placed], ((by0 + by1) / 2)[placed]),
            (owner[usable_cells], *[side[usable_cells] for side in corners]), n)
        result |= {
            "ocr_confidence_p10": np.where(known, _percentile(ordered, 0.1), np.nan),
            "ocr_confidence_mean": mean, "ocr_confidence_std": spread, "ocr_box_count": box_sizes.astype(float),
            "unmatched_ocr_ratio": (box_sizes - matched) / box_sizes,
        }
    arrays = [pa.array(np.where(np.isfinite(result[name]), result[name], 0.0), mask=~np.isfinite(result[name])) for name in NAMES]
    return pa.StructArray.from_arrays(arrays, fields=list(KIND))

"""Packing of token sequences by minimum bin slack.

Documents are encoded once, their pieces written as rows of a length. Only the
histogram of lengths (as many entries as a sequence has tokens) is searched: for
one bin at a time, bitset subset-sum dynamic programming over the lengths still
available finds the fullest combination that holds the longest one left, and that
combination is removed as often as the histogram allows, so the search depends on
the number of lengths and not on the number of pieces. The pieces of a length are
then numbered by a distributed rank, and the numbers are dealt to the bins.

Defined results: null and empty texts are one piece, the end token alone; every row
is a document, also where ids are repeated or null; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondpass.llm.common import id_and_text, ranked
from secondpass.llm.token_counts import encoder
from secondpass.session import pin

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first)] + [(start, capacity) for start in range(first, n, capacity)] if n else []


def fullest(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The fullest feasible combination {length: times} with the longest length left in it.

    Bit s of ``reach`` says that the lengths seen so far can sum to s. The bitset
    before every step is kept, to walk back from the best sum.
    """
    lengths = [int(x) for x in np.flatnonzero(counts)[::-1]]
    longest = lengths[0]
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room or reach >> room & 1:
            continue
        left = min(int(counts[length]) - (length == longest), room // length)
        times = 1
        while left > 0:  # a multiple at a time: 1, 2, 4, ... and the rest
            now = min(times, left)
            steps.append((length, now, reach))
            reach |= reach << (length * now) & mask
            left, times = left - now, times * 2
    total, chosen = reach.bit_length() - 1, {longest: 1}
    for length, now, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + now
            total -= length * now
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations with the number of bins that take each."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    bins = []
    while counts.any():
        chosen = fullest(counts, capacity)
        times = min(int(counts[length]) // n for length, n in chosen.items())
        for length, n in chosen.items():
            counts[length] -= n * times
        bins.append((chosen, times))
    return bins


def _layout(bins: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length the runs (first rank, per bin, first bin, offset in the bin), in order of rank."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first_bin = 0
    for chosen, times in bins:
        offset = 0
        for length, n in chosen.items():
            runs.setdefault(length, []).append((used.get(length, 0), n, first_bin, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * n
        first_bin += times
    return {length: np.array(rows, dtype=np.int64) for length, rows in runs.items()}


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, crc32 of its ids."""

    def encode(batches):
        packer = encoder(vocabulary)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            out = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = packer.pack(text.as_py()) + end
                for number, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(memoryview(ids)[4 * start:4 * (start + length)])
                    for column, value in zip(out, (doc_id, number, start, length, crc)):
                        column.append(value)
            packer.ids.trim()
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(encode, _PIECES)


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = pin(pieces_of(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    layout = _layout(plan(histogram, capacity))

    def deal(batches):
        for batch in batches:
            lengths, ranks = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                here = np.flatnonzero(lengths == length)
                runs = layout[int(length)]
                rank = ranks[here]
                run = runs[np.searchsorted(runs[:, 0], rank, side="right") - 1]
                inside = rank - run[:, 0]
                sequence[here] = run[:, 2] + inside // run[:, 1]
                offset[here] = run[:, 3] + inside % run[:, 1] * length
            kept = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    numbered = ranked(pieces, ["length"], ["doc_id", "piece"])
    return numbered.mapInArrow(deal, _PIECES + ", sequence_id long, offset long")

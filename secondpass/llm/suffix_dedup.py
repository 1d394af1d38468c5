"""Removal of repeated byte strings by a range-partitioned suffix order.

Every suffix that starts a string of ``LENGTH`` bytes takes part, but most are settled
before they are sorted. Inside any such string the ``GRAM``-byte gram of smallest hash is
its anchor; equal strings have equal anchors at equal places. Neighbouring strings with
one anchor form a record. Records are put in the order of their anchors: sampled splitters
range-partition them, buckets are sorted, and neighbours are compared inside a bucket and
across boundaries, so one anchor may fill many buckets. A record whose anchor is nowhere
else is unique and goes no further. Of the others, those that are
equal as a whole are one class; they are repeated, and are sorted once however many
there are. Classes that share an anchor with another class are cut again, into pieces of
at most ``STEP`` strings by their distance to the anchor. Equal pieces are one class as
before. The strings of a piece all hold its core, so a piece whose core is nowhere else
is unique. Only the suffixes of pieces that share a core with another class are written
as rows and ordered in the same way, by their leading eight bytes (then by a
128-bit fingerprint of all ``LENGTH`` bytes); equal neighbours are repeated.

The sort inside a bucket is Spark's, which spills, in place of a multikey quicksort;
beyond its leading bytes a suffix is compared by fingerprint, not by its text.

Texts are moved once, into a table bucketed by row number; every later step shuffles only
what it knows about them to those buckets.

Texts with copies are removed as a whole if they have ``LENGTH`` bytes; one of each takes
part. Defined results: null texts are empty; shorter texts lose nothing; rows equal in
id and text are copies; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from secondpass.llm.common import bucketed, id_and_text
from secondpass.session import pin

LENGTH, GRAM, STEP = 200, 32, 16
_BLOCK = (1 << 20) - 1024  # strings looked at together; places inside a block take 20 bits
_ONES = (1 << 20) - 1
_BYTES = 1 << 20  # bytes of pieces hashed together
_EMPTY = hashlib.sha256(b"").hexdigest()


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


_LETTERS = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def grams(raw: np.ndarray, width: int, seed: int = 0) -> dict[int, np.ndarray]:
    """Hashes of all byte strings of 1, 2, 4, ... ``width`` bytes."""
    h = _mix(raw.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 + seed))
    out, step = {1: h}, 1
    while step < width:
        h = _mix(h[:-step] * np.uint64(0xA0761D6478BD642F) + h[step:])
        step *= 2
        out[step] = h
    return out


def anchor_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of all strings of ``GRAM`` bytes; cheaper than ``grams``, as equal hashes of unlike strings only cost time."""
    h, step = _LETTERS[raw], 1
    while step < GRAM:
        h = h[:-step] * (np.uint64(0xA0761D6478BD642F) + np.uint64(2 * step)) + h[step:]
        step *= 2
    return _mix(h)


def fingerprints(raw: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of all strings of ``LENGTH`` = 128 + 64 + 8 bytes."""
    g, n = grams(raw, 128, seed), len(raw) - LENGTH + 1
    odd = np.uint64(0xE7037ED1A0B428DB)
    return _mix((g[128][:n] * odd + g[64][128:128 + n]) * odd + g[8][192:192 + n])


def records(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first string and shape of all records of a text.

    A shape is 256 times the distance from the first string to the anchor, plus the number of further strings.
    """
    out = []
    total = len(raw) - LENGTH + 1
    for low in range(0, max(0, total), _BLOCK):
        n = min(_BLOCK, total - low)
        part = np.frombuffer(raw, np.uint8, n + LENGTH - 1, low)
        h = anchor_hashes(part)
        least = (h & ~np.uint64(_ONES)) | np.arange(len(h), dtype=np.uint64)
        width, step = LENGTH - GRAM + 1, 1
        while step * 2 <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        least = np.minimum(least[:n], least[width - step:width - step + n])
        anchor = (least & np.uint64(_ONES)).astype(np.int64)
        firsts = np.flatnonzero(np.diff(anchor, prepend=-1))
        at = anchor[firsts]
        shape = (at - firsts) * 256 + np.diff(firsts, append=n) - 1
        out.append((h[at].view(np.int64), low + firsts, shape.astype(np.int32)))
    return tuple(np.concatenate(column) for column in zip(*out))


def _records(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for low in range(0, batch.num_rows, 512):
            found = [records(text.as_py()) for text in texts[low:low + 512]]
            numbers = np.repeat(batch.column(0)[low:low + 512].to_numpy(), [len(f[0]) for f in found])
            columns = [pa.array(numbers)] + [pa.array(np.concatenate(column)) for column in zip(*found)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "anchor", "first", "shape"])


def _with_lists(batch):
    """Row number, bytes and, for each of its stretches, a tuple of the listed fields; structs are read by column."""
    listed = batch.column(2)
    fields = listed.flatten().flatten()
    stretches = list(zip(*[f.to_pylist() for f in fields]))
    ends = np.cumsum(pc.list_value_length(listed).to_numpy()).tolist()
    for number, text, low, high in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), [0, *ends], ends):
        yield number, text.as_py(), stretches[low:high]


def _table(rows: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _digests(batches):
    """Records (first, shape, anchor) listed with a text, with a digest of all their bytes and the place of the anchor."""
    names = ["row", "anchor", "first", "shape", "digest"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    salts = [i.to_bytes(2, "little") for i in range(LENGTH)]
    for batch in batches:
        rows = []
        for number, raw, listed in _with_lists(batch):
            view = memoryview(raw)
            for first, shape, anchor in listed:
                part = view[first:first + (shape & 255) + LENGTH]
                rows.append((number, anchor, first, shape, hashlib.blake2b(part, digest_size=16, salt=salts[shape >> 8]).digest()))
        yield _table(rows, names, kinds)


def pieces(part: bytes, anchor: int) -> list[tuple[int, int, int, bytes]]:
    """(core, first string, last string, digest) of all pieces of one record, given its bytes and its anchor's place."""
    strings = len(part) - LENGTH + 1
    out, first = [], 0
    while first < strings:
        block = (anchor - first) // STEP  # distances from block * STEP on, the nearest string last
        last = min(strings - 1, anchor - block * STEP)
        low = anchor - block * STEP
        salt = bytes([block])
        core = hashlib.blake2b(part[low:low + LENGTH - STEP + 1], digest_size=8, salt=salt).digest()
        digest = hashlib.blake2b(part[first:last + LENGTH], digest_size=16, salt=salt + bytes([anchor - first]))
        out.append((int.from_bytes(core, "little", signed=True), first, last, digest.digest()))
        first = last + 1
    return out


def _pieces(batches):
    """Pieces of the records (first, shape, single) listed with a text."""
    names = ["row", "core", "first", "last", "digest", "single"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
    for batch in batches:
        rows = []
        for number, raw, listed in _with_lists(batch):
            for at, shape, single in listed:
                for core, first, last, digest in pieces(raw[at:at + (shape & 255) + LENGTH], shape >> 8):
                    rows.append((number, core, at + first, at + last, digest, single))
        yield _table(rows, names, kinds)


def _suffixes(batches):
    """Rows of the suffix order for the pieces (first, last, single) listed with a text.

    The bytes of many pieces are hashed together; strings that run from one piece into the next are left out.
    """
    parts, held = [], 0
    for batch in batches:
        for number, raw, listed in _with_lists(batch):
            for first, last, single in listed:
                parts.append((number, first, last - first + 1, single, raw[first:last + LENGTH]))
                held += len(parts[-1][-1])
                if held >= _BYTES:
                    yield _order_rows(parts)
                    parts, held = [], 0
    if parts:
        yield _order_rows(parts)


def _order_rows(parts: list[tuple]) -> pa.RecordBatch:
    numbers, firsts, counts, singles, raws = zip(*parts)
    raw = np.frombuffer(b"".join(raws), np.uint8)
    counts = np.array(counts)
    begins = np.cumsum([0, *map(len, raws[:-1])])
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(begins, counts) + inside
    lead = np.lib.stride_tricks.sliding_window_view(raw, 8)[at].view(">u8").ravel()
    lead = (lead ^ np.uint64(1 << 63)).astype(np.uint64).view(np.int64)
    columns = [lead, *[fingerprints(raw, seed)[at].view(np.int64) for seed in (1, 2)],
               np.repeat(np.array(numbers, np.int64), counts), np.repeat(np.array(firsts, np.int64), counts) + inside,
               np.repeat(np.array(singles, bool), counts)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["lead", "d1", "d2", "row", "pos", "single"])


_ORDER = "lead long, d1 long, d2 long, row long, pos long, single boolean"


def _neighbours(keys: list[str]):
    """Rows of a sorted bucket that equal a neighbour in their keys (again), and its first and last row (edge)."""

    def marked(table: pa.Table, again: np.ndarray, edge: np.ndarray, bucket: int):
        table = table.append_column("again", pa.array(again)).append_column("edge", pa.array(edge))
        table = table.append_column("bucket", pa.array(np.full(len(again), bucket, np.int32)))
        return table.filter(pa.array(again | edge)).combine_chunks().to_batches()

    def run(batches):
        bucket = TaskContext.get().partitionId()
        held = held_again = first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            values = np.stack([table.column(c).to_numpy() for c in keys])
            same = (values[:, 1:] == values[:, :-1]).all(0)
            again = np.append(same, False) | np.insert(same, 0, False)
            edge = np.zeros(len(again), bool)
            if held is None:
                first = True
            else:
                again[0] |= held_again
            edge[0] = first
            if len(again) > 1:
                yield from marked(table.slice(0, len(again) - 1), again[:-1], edge[:-1], bucket)
                first = False
            held, held_again = table.slice(len(again) - 1, 1), again[-1]
        if held is not None:
            yield from marked(held, np.array([held_again]), np.array([True]), bucket)

    return run


def repeated(order: DataFrame, keys: list[str], ties: list[str], label: str) -> DataFrame:
    """Rows of ``order`` whose integer keys another row has too; ``ties`` split a key that many rows have."""
    buckets = int(order.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = order.repartitionByRange(buckets, *keys, *ties).sortWithinPartitions(*keys, *ties)
    kinds = ", ".join(f"{c} {k}" for c, k in order.dtypes)
    seen = pin(placed.mapInArrow(_neighbours(keys), f"{kinds}, again boolean, edge boolean, bucket int"), label)
    # At most two rows per bucket: small, whatever the input.
    edges = seen.where("edge")
    across = edges.groupBy(*keys).agg(F.count_distinct("bucket").alias("n")).where("n > 1").drop("n")
    met = edges.where("NOT again").join(across, keys, "left_semi")
    return seen.where("again").select(*order.columns).unionByName(met.select(*order.columns))


def _cut(batches):
    """Removed bytes, runs and the digest of what is left, given covered stretches [start, end)."""
    for batch in batches:
        out = ([], [], [])
        for text, stretches in zip(batch.column(1), batch.column(2).to_pylist()):
            raw, kept, at, spans = text.as_py().encode(), hashlib.sha256(), 0, 0
            end = None
            removed = 0
            for start, stop in sorted((s["start"], s["stop"]) for s in stretches or ()):
                if end is None or start > end:
                    kept.update(raw[at:start])
                    spans, end, at = spans + 1, start, start
                if stop > end:
                    removed, end, at = removed + stop - max(end, start), stop, stop
            kept.update(raw[at:])
            for column, value in zip(out, (removed, spans, kept.hexdigest())):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t.as_py().encode()) for t in batch.column(1)], pa.int64()),
             pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("size", F.octet_length("text").cast("long"))
    texts = bucketed(rows.select("row", "doc_id", "size", "sha", "text"), "row", "texts")
    narrow = texts.select("row", "doc_id", "size", "sha")
    groups = pin(narrow.groupBy("sha").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.first("size").alias("size")), "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    long = groups.where(F.col("size") >= LENGTH).select("row")
    long = texts.select("row", "text").join(long, "row", "left_semi")

    found = pin(long.mapInArrow(_records, "row long, anchor long, first long, shape int"), "records")
    met = repeated(found, ["anchor"], ["row", "first"], "met-records")
    found = pin(_listed(texts, met, "first", "shape", "anchor").mapInArrow(
        _digests, "row long, anchor long, first long, shape int, digest binary"), "digests")
    classes = found.groupBy("anchor", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "first", "shape")).alias("at"))
    classes = pin(classes, "record-classes")
    cut_again = _of_shared(classes, "anchor").select("at.*", (F.col("n") == 1).alias("single"))
    parts = pin(_listed(texts, cut_again, "first", "shape", "single").mapInArrow(
        _pieces, "row long, core long, first long, last long, digest binary, single boolean"), "pieces")
    alike = parts.groupBy("core", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "first", "last", "single")).alias("at"))
    alike = pin(alike, "piece-classes")
    sorted_again = _of_shared(alike, "core").select(
        "at.row", "at.first", "at.last", ((F.col("n") == 1) & F.col("at.single")).alias("single"))
    order = pin(_listed(texts, sorted_again, "first", "last", "single").mapInArrow(_suffixes, _ORDER), "suffixes")
    strings = repeated(order, ["lead", "d1", "d2"], ["row", "pos"], "met-suffixes").where("single")

    # Records with copies are known to be repeated as a whole, so only the others are looked up here.
    whole = _members(found, classes.where("n > 1"), "anchor", total)
    whole = whole.select("row", "first", (F.col("first") + F.col("shape") % 256).alias("last"))
    part = _members(parts.where("single"), alike.where("n > 1"), "core", total)
    known = whole.unionByName(part.select("row", "first", "last"))
    known = known.unionByName(strings.select("row", F.col("pos").alias("first"), F.col("pos").alias("last")))
    per_text = _runs(known).groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("stretches"))

    twice = groups.where("n > 1")
    # Texts with a thousandth of all rows: at most a thousand, so they may be broadcast.
    frequent = F.col("n") * 1000 >= max(total, 2000)
    hot = F.broadcast(pin(twice.where(frequent).select("sha"), "hot-texts"))
    rest = narrow.join(hot, "sha", "left_anti").join(twice.where(~frequent).select("sha"), "sha", "left_semi")
    gone = F.col("size") >= LENGTH
    copies = narrow.join(hot, "sha", "left_semi").unionByName(rest.select(*narrow.columns)).select(
        "doc_id", F.col("size").alias("n_bytes"), F.when(gone, F.col("size")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(gone, F.lit(_EMPTY)).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"))
    lone = groups.where("n = 1").select("row").join(per_text, "row", "left")
    lone = texts.join(lone, "row").select("doc_id", "text", "stretches").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return lone.unionByName(copies)


def _runs(known: DataFrame) -> DataFrame:
    """Covered stretches [start, stop) of every text, those that touch or overlap made one."""
    before = Window.partitionBy("row").orderBy("first", "last")  # bounded by the text
    reach = F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("first") > reach + LENGTH, F.lit(True)).cast("int")
    runs = known.withColumn("opens", opens).withColumn("run", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("row", "run").agg(F.min("first").alias("start"), (F.max("last") + LENGTH).alias("stop"))


def _of_shared(classes: DataFrame, key: str) -> DataFrame:
    """Classes whose ``key`` another class has too."""
    shared = classes.groupBy(key).agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    return classes.join(shared, key, "left_semi")


def _listed(texts: DataFrame, stretches: DataFrame, *columns: str) -> DataFrame:
    """row, text and the list of its stretches with the named columns; a list is bounded by its text."""
    listed = stretches.groupBy("row").agg(F.collect_list(F.struct(*columns)).alias("listed"))
    return texts.select("row", "text").join(listed, "row")


def _members(rows: DataFrame, twice: DataFrame, key: str, total: int) -> DataFrame:
    """Rows of the classes in ``twice``; those with a thousandth as many rows as there are texts are broadcast."""
    common = F.broadcast(pin(twice.where(F.col("n") * 1000 >= max(total, 2000)).select("digest"), "hot-classes"))
    rest = rows.join(common, "digest", "left_anti").join(twice.select("digest", key), ["digest", key], "left_semi")
    return rows.join(common, "digest", "left_semi").unionByName(rest.select(*rows.columns))


def brute_force(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by counting every string; for tests."""
    from collections import Counter

    raws = [(t or "").encode() for t in texts]
    seen = Counter(raw[i:i + LENGTH] for raw in raws for i in range(len(raw) - LENGTH + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - LENGTH + 1):
            if seen[raw[i:i + LENGTH]] > 1:
                gone[i:i + LENGTH] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        starts = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        out.append((len(raw), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out

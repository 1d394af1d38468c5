"""Exact deduplication against an index of historical digests.

The index is a minimal perfect hash over the distinct SHA-256 digests of a
history: digests are dealt to buckets by their leading bytes, and every bucket
holds a cascade of bit arrays (a key sits at the first level where it is alone at
its place; its slot is the number of set bits before it). A slot stores the full
digest, the locator of the winning document and the number of copies, so a look-up
is decided by comparing all 32 bytes. Incoming documents are counted per digest
first, so a group of copies of any size is one row when it reaches its bucket.

Defined results: null texts count as empty; a null id is the smallest id; every row
is returned and counted, also rows equal in id and text. These carry the same key, so
``kept`` is true for all of them where their id wins; ``drop_duplicates`` leaves the one
whose columns come first in order. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondpass.llm.common import drop_documents, id_and_text
from secondpass.session import pin

BUCKET_KEYS = 50_000  # distinct digests per bucket of the index
HOT_SHARE = 1_000  # a group is hot from 1/1000 of the rows on: there are at most 1000 such groups
_GAMMA = 2.0
_INDEX = "bucket long, levels array<binary>, digests binary, winners array<bigint>, copies array<bigint>"
_CLASSES = "digest binary, keep_id long, group_size long, known boolean"


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Position of every key (two 64-bit words of its digest) in the bit array of a level."""
    with np.errstate(over="ignore"):
        x = words[:, 0] ^ (words[:, 1] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


def _words(digests: list[bytes]) -> np.ndarray:
    table = np.frombuffer(b"".join(digests), dtype=">u8").reshape(-1, 4)
    return np.stack([table[:, 1] ^ table[:, 3], table[:, 2]], axis=1).astype(np.uint64)


def build_levels(words: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of the cascade; ends when every key is alone somewhere."""
    levels: list[np.ndarray] = []
    left = np.arange(len(words))
    while len(left):
        size = max(64, int(_GAMMA * len(left)))
        place = _place(words[left], len(levels), size)
        alone = np.bincount(place, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[place]]
        if len(levels) > 500:
            raise ValueError("two different digests agree in the bytes the index hashes")
    return levels


def slots(words: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Slot of every key; -1 where no level holds it (then it is no member for sure)."""
    out = np.full(len(words), -1, dtype=np.int64)
    left, before = np.arange(len(words)), 0
    for number, alone in enumerate(levels):
        if not len(left):
            break
        place = _place(words[left], number, len(alone))
        found = alone[place]
        out[left[found]] = before + (np.cumsum(alone) - 1)[place[found]]
        left, before = left[~found], before + int(alone.sum())
    return out


def _pack(levels: list[np.ndarray]) -> list[bytes]:
    return [len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes() for bits in levels]


def _unpack(levels) -> list[np.ndarray]:
    return [
        np.unpackbits(np.frombuffer(raw[8:], np.uint8), count=int.from_bytes(raw[:8], "little")).astype(bool)
        for raw in map(bytes, levels)
    ]


def _build_bucket(rows: pa.Table) -> pa.Table:
    # Arrow keeps ids exact: in pandas a null among them would make them floats.
    digests = rows["digest"].to_pylist()
    words = _words(digests)
    levels = build_levels(words)
    order = np.argsort(slots(words, levels))
    winners, copies = rows["winner"].to_pylist(), rows["copies"].to_pylist()
    return pa.table({
        "bucket": pa.array([rows["bucket"][0].as_py()], pa.int64()),
        "levels": pa.array([_pack(levels)], pa.list_(pa.binary())),
        "digests": pa.array([b"".join(digests[i] for i in order)], pa.binary()),
        "winners": pa.array([[winners[i] for i in order]], pa.list_(pa.int64())),
        "copies": pa.array([[copies[i] for i in order]], pa.list_(pa.int64())),
    })


def _look_up(index: pa.Table, incoming: pa.Table) -> pa.Table:
    """All classes of a bucket: slots (updated by byte-checked hits) and, apart from them, nonmembers."""
    digests, winners, copies = [], [], []
    if index.num_rows:
        raw = index["digests"][0].as_py()
        digests = [raw[i:i + 32] for i in range(0, len(raw), 32)]
        winners, copies = index["winners"][0].as_py(), index["copies"][0].as_py()
    known = len(digests)
    if incoming.num_rows:
        keys = incoming["digest"].to_pylist()
        at = slots(_words(keys), _unpack(index["levels"][0].as_py())) if known else np.full(len(keys), -1)
        for key, slot, winner, n in zip(keys, at, incoming["winner"].to_pylist(), incoming["copies"].to_pylist()):
            if 0 <= slot < known and digests[slot] == key:
                old = winners[slot]
                winners[slot] = winner if old is None else old if winner is None else max(old, winner)
                copies[slot] += n
            else:
                digests.append(key)
                winners.append(winner)
                copies.append(n)
    return pa.table({
        "digest": pa.array(digests, pa.binary()), "keep_id": pa.array(winners, pa.int64()),
        "group_size": pa.array(copies, pa.int64()),
        "known": pa.array([True] * known + [False] * (len(digests) - known), pa.bool_()),
    })


def _per_digest(fingerprints: DataFrame, buckets: int) -> DataFrame:
    return (
        fingerprints.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("copies"))
        .withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    )


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``digest`` of every row."""
    return id_and_text(docs, id_col, text_col).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket for fingerprints of the history; write it to keep it for later batches."""
    return _per_digest(history, buckets).groupBy("bucket").applyInArrow(_build_bucket, _INDEX)


def classes(index: DataFrame, incoming: DataFrame, buckets: int) -> DataFrame:
    """Digest, winning id, size and whether the index knew it, for history and incoming together."""
    grouped = _per_digest(incoming, buckets)
    return index.groupBy("bucket").cogroup(grouped.groupBy("bucket")).applyInArrow(_look_up, _CLASSES)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history=None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    ``history`` is a condition on ``doc_id``: documents that were there before. By
    default half of the ids, chosen by hash, make the history and the rest arrives.
    """
    history = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0 if history is None else history
    history = F.coalesce(history, F.lit(False))  # rows where it is null arrive
    prints = pin(fingerprint(docs, id_col, text_col), "fingerprints")
    total = prints.count()
    buckets = max(1, math.ceil(total / BUCKET_KEYS))
    index = pin(build_index(prints.where(history), buckets), "digest-index")
    found = pin(classes(index, prints.where(~history), buckets), "digest-classes").select("digest", "keep_id", "group_size")
    # Groups with a thousandth of all rows: at most a thousand, so they may be broadcast. The rest cannot be skewed.
    hot = found.where(F.col("group_size") * HOT_SHARE >= max(total, HOT_SHARE * 2))
    cold = found.where(F.col("group_size") * HOT_SHARE < max(total, HOT_SHARE * 2))
    joined = prints.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest").unionByName(
        prints.join(F.broadcast(hot), "digest")
    )
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every text: that of the largest id, of equal ids the first in the order of its columns."""
    found = exact_dedup(docs, id_col, text_col)
    left = drop_documents(docs, found.where("NOT kept").select("doc_id", "text_sha256"), id_col, text_col)
    prints = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    if prints.groupBy("doc_id", "h").count().where("count > 1").take(1):
        # Rows equal in id and text cannot be told apart by a key: one of each stays.
        ordered = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]  # those cannot be compared
        first = F.min_by(F.struct(*docs.columns), F.struct(*ordered)).alias("_row")
        left = left.groupBy(F.coalesce(F.col(text_col), F.lit("")).alias("_text")).agg(first).select("_row.*")
    return left


def digest(text: str | None) -> str:
    """The digest of one text, for tests."""
    return hashlib.sha256((text or "").encode()).hexdigest()

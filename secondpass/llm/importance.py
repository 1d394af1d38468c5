"""Importance resampling towards a target distribution, with hashed n-grams by prefix CRCs.

A document is normalised to its words joined by one space and scanned once; the running
CRC-32 after every word is kept. The CRC of any n-gram then follows from two of these
prefixes: the earlier one, moved past the bytes of the n-gram (a linear map over GF(2)
that depends on their number alone), cancels out of the later one. No n-gram is built
as a string. The moves are vectorised, one table per bit of the number of bytes.

Counts per bucket are added up over all documents (one row per task and bucket before
the shuffle); they and the gains derived from them have ``BUCKETS`` entries however large
the corpus is. A second scan turns the gains into weights. The draw is a global rank by
range partitions, so no task sorts all of it.

Defined results: null texts and texts without a word have no features and weight 0; a null
id draws with the empty string; equal scores go to the smaller id (null first); rows equal in
score and id keep distinct ranks; an empty table gives no rows, an empty target counts zero.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondpass.llm.common import id_and_text, ranked, words_of
from secondpass.session import pin

BUCKETS, ORDER = 10_000, 2
MIN_WORDS, PERCENT = 20, 25
_CHUNK = 1 << 17  # words looked at together
_POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), table >> np.uint32(1))
    return table.astype(np.uint32)


class PrefixCrc:
    """Moves of CRCs past bytes: for every bit of a byte count, four tables of 256 entries."""

    def __init__(self):
        self.byte = _byte_table()
        images = self._zero_byte(np.uint32(1) << np.arange(32, dtype=np.uint32))
        self.moves = []
        for _ in range(32):
            self.moves.append(self._tables(images))
            images = self._apply(self.moves[-1], images)

    def _zero_byte(self, crc: np.ndarray) -> np.ndarray:
        return (crc >> np.uint32(8)) ^ self.byte[crc & np.uint32(255)]

    @staticmethod
    def _tables(images: np.ndarray) -> np.ndarray:
        """Four tables, one per byte of the argument, of the linear map that sends bit i to ``images[i]``."""
        tables = np.zeros((4, 256), np.uint32)
        for bit in range(32):
            lane, place = divmod(bit, 8)
            step = 1 << place
            tables[lane, step:2 * step] = tables[lane, :step] ^ images[bit]
        return tables

    @staticmethod
    def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
        out = tables[0][crc & np.uint32(255)]
        for lane in (1, 2, 3):
            out = out ^ tables[lane][(crc >> np.uint32(8 * lane)) & np.uint32(255)]
        return out

    def past(self, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
        """CRCs moved past ``size`` bytes each."""
        crc, longest = crc.copy(), int(size.max(initial=0))
        for bit in range(longest.bit_length()):
            at = np.flatnonzero((size >> bit) & 1)
            crc[at] = self._apply(self.moves[bit], crc[at])
        return crc

    def past_space(self, crc: np.ndarray) -> np.ndarray:
        """CRC of a text with one more space, given that of the text."""
        inner = crc ^ np.uint32(0xFFFFFFFF)
        return ((inner >> np.uint32(8)) ^ self.byte[(inner ^ np.uint32(32)) & np.uint32(255)]) ^ np.uint32(0xFFFFFFFF)


def buckets_of(words: list[bytes], crcs: PrefixCrc, order: int = ORDER):
    """Buckets of all runs of 1 to ``order`` words, in arrays of bounded length; one scan, running CRCs from prefixes."""
    running, behind = 0, []  # running CRC; (CRC before, end before) of the last order - 1 words
    end = 0
    for low in range(0, len(words), _CHUNK):
        part = words[low:low + _CHUNK]
        after = []
        for word in part:
            running = zlib.crc32(word, running)
            after.append(running)
            running = zlib.crc32(b" ", running)
        size = np.fromiter(map(len, part), np.int64, len(part))
        ends = end + np.cumsum(size + 1) - 1
        end = int(ends[-1]) + 1
        after = np.array(after, np.uint32)
        first = np.array([0 if low == 0 else behind[-1][2]], np.uint32)
        before = np.concatenate([first, crcs.past_space(after)[:-1]])
        starts = ends - size
        carried = len(behind) and min(len(behind), order - 1)
        if carried:
            old = behind[-carried:]
            before = np.concatenate([np.array([o[0] for o in old], np.uint32), before])
            starts = np.concatenate([np.array([o[1] for o in old], np.int64), starts])
        for n in range(1, order + 1):
            # The run of n words that ends at word i starts n - 1 words before; the first words have no such run.
            skip = max(0, n - 1 - carried)
            if len(part) <= skip:
                continue
            from_ = np.arange(skip, len(part)) + carried - (n - 1)
            length = ends[skip:] - starts[from_]
            grams = after[skip:] ^ crcs.past(before[from_], length)
            yield (grams % np.uint32(BUCKETS)).astype(np.int64)
        tail = max(order - 1, 1)
        next_before = int(crcs.past_space(after[-1:])[0])
        behind = [(int(b), int(s), next_before) for b, s in zip(before[-tail:], starts[-tail:])]


def _counted(order: int):
    def run(batches):
        crcs, counts = PrefixCrc(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(1):
                for found in buckets_of(words_of(text.as_py()), crcs, order):
                    counts += np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, id_col: str, text_col: str = "text", order: int = ORDER) -> np.ndarray:
    """Features per bucket over all rows: ``BUCKETS`` numbers, so they may come to the driver."""
    rows = id_and_text(texts, id_col, text_col).mapInArrow(_counted(order), "bucket long, n long")
    counts = np.zeros(BUCKETS, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains_of(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of every bucket, B buckets."""
    all_s, all_t = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return [
        math.floor(1000 * math.log((float(t) + 1) * all_s / ((float(s) + 1) * all_t)))
        for s, t in zip(corpus.tolist(), target.tolist())
    ]


def _weighed(gains: list[int], order: int):
    def run(batches):
        crcs, gain = PrefixCrc(), np.array(gains, np.int64)
        for batch in batches:
            features, weights, words = [], [], []
            for text in batch.column(1):
                found = words_of(text.as_py())
                n = total = 0
                for buckets in buckets_of(found, crcs, order):
                    n, total = n + len(buckets), total + int(gain[buckets].sum())
                features.append(n)
                weights.append(total // n if n else 0)
                words.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in (features, weights, words)]],
                ["doc_id", "n_features", "weight", "n_words"])

    return run


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id",
    target_text: str = "text", order: int = ORDER, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = 7,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for those not drawn."""
    gains = gains_of(bucket_counts(docs, id_col, text_col, order), bucket_counts(target, target_id, target_text, order))
    rows = id_and_text(docs, id_col, text_col).mapInArrow(
        _weighed(gains, order), "doc_id long, n_features long, weight long, n_words long")
    drawn = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(drawn, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = pin(rows.withColumn("score", F.col("weight") + noise), "weights")
    able = rows.where(F.col("n_words") >= min_words)
    count = percent * able.count() // 100
    placed = ranked(able.withColumn("lower", -F.col("score")), [], ["lower", "doc_id"], "place").drop("lower")
    rank = F.when(F.col("place") < count, F.col("place") + 1)
    others = rows.where(F.col("n_words") < min_words).withColumn("place", F.lit(None).cast("long"))
    return placed.unionByName(others).select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def brute_force(docs: list[tuple], items: list[str | None], percent: int = PERCENT, min_words: int = MIN_WORDS) -> dict:
    """doc_id -> (n_features, weight, score, rank), every n-gram built and hashed; for tests."""
    import re
    from collections import Counter

    def features(text):
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
        grams = [*words, *[" ".join(pair) for pair in zip(words, words[1:])]]
        return len(words), [zlib.crc32(g.encode()) % BUCKETS for g in grams]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in items:
        t.update(features(text)[1])
    all_s, all_t = sum(s.values()) + BUCKETS, sum(t.values()) + BUCKETS
    out, able = {}, []
    for i, text in docs:
        n, found = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(found), weight, score, None]
        if n >= min_words:
            able.append((-score, i))
    for rank, (_, i) in enumerate(sorted(able)[:percent * len(able) // 100], 1):
        out[i][3] = rank
    return {i: tuple(row) for i, row in out.items()}

"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most two of 64 bits differ in at most one bit of one
of their two 32-bit halves. The distinct values of both halves are counted and indexed
under their 32 one-wildcard variants (one bit left out, the place of that bit in the key),
so two values one bit apart meet in an equality join. A value held by several fingerprints,
and two values that met, are a group; fingerprints are fetched for groups only and
verified inside groups of up to ``BUCKET`` members, whose number is known beforehand.

Larger groups have an exact way of their own that never compares pairs:
their fingerprints are indexed under all two-wildcard variants of 64 bits. Any two
that share one differ in at most two bits, and any two that differ in at most two
bits share one, so linking each to the smallest of its key gives the components.

Fingerprints are made distinct first, so equal ones never meet in pairs.

Defined results: null texts count as empty; texts without a word have fingerprint
zero and link like others; a null id is never the smallest of a component unless it
is alone there; rows with equal ids stay rows; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondpass.llm.common import drop_documents, id_and_text
from secondpass.llm.graph import components
from secondpass.session import pin

BUCKET = 48  # members of a group that are verified pair by pair
SALTS = 16  # tasks that share the fingerprints of one half
SEED = 42
_CHUNK = 1 << 18  # shingles hashed at a time


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set; up to 255 are added inside bytes at a time."""
    total = np.zeros(64, dtype=np.int64)
    ones = np.uint64(0x0101010101010101)
    starts = np.arange(0, len(hashes), 255)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & ones, starts)
        total[bit::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint: a bit is 1 if it is set in over half of the shingle hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    stops = (ends - 1).tolist()
    last = min(width, len(words)) - 1
    counts, n = np.zeros(64, dtype=np.int64), len(words) - last
    for low in range(0, n, _CHUNK):
        high = min(n, low + _CHUNK)
        hashes = np.array(
            [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[low:high], stops[low + last:high + last])],
            dtype=np.uint64,
        )
        counts += _bit_counts(hashes)
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_sha: bool = False) -> DataFrame:
    """doc_id and the fingerprint as a signed long (and, if wanted, text_sha256), for every row."""
    extra = ["text_sha256"] if with_sha else []

    def compute(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            kept = [batch.column(2 + i) for i in range(len(extra))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *kept], ["doc_id", "fp", *extra])

    rows = id_and_text(docs, id_col, text_col)
    rows = rows.select("*", *[F.sha2("text", 256).alias(name) for name in extra])
    return rows.mapInArrow(compute, "doc_id long, fp long" + "".join(f", {name} string" for name in extra))


def _pair_variants(batches):
    """Rows (place, rest, fp): the fingerprint without two of its bits, for all 2016 pairs of bits."""
    first, second = np.triu_indices(64, 1)
    place = (first * 64 + second).astype(np.int32)
    keep = ~((np.uint64(1) << first.astype(np.uint64)) | (np.uint64(1) << second.astype(np.uint64)))
    for batch in batches:
        fps = np.asarray(batch.column(0)).view(np.uint64)
        for low in range(0, len(fps), 512):
            part = fps[low:low + 512]
            rest = (part[:, None] & keep).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(place, len(part))), pa.array(rest.view(np.int64)),
                 pa.array(np.repeat(part, len(keep)).view(np.int64))], ["place", "rest", "fp"]
            )


def _verify(batches):
    """Links inside keys of bounded size, one per linked pair of fingerprints."""
    for batch in batches:
        left, right = [], []
        for members in batch.column(0).to_pylist():
            fps = np.unique(np.array(members, dtype=np.int64)).view(np.uint64)
            near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
            a, b = np.nonzero(np.triu(near, 1))
            left.append(fps[a].view(np.int64))
            right.append(fps[b].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(left or [np.zeros(0, np.int64)])),
             pa.array(np.concatenate(right or [np.zeros(0, np.int64)]))], ["u", "v"]
        )


def _groups(counted: DataFrame) -> DataFrame:
    """Groups (g, n, low, high) of fingerprints that share a half (low = high) or hold halves one bit apart.

    ``counted`` holds the distinct halves (bit 32 tells the sides apart) and how many fingerprints have each.
    A variant is one number: place and side, the half without the bit at that place, and lastly that bit.
    """
    variant = "(bigint(p) << 34) | ((half & ~(1L << p)) << 1) | ((half >> p) & 1L)"
    variants = counted.selectExpr(f"explode(transform(sequence(0, 31), p -> {variant})) AS variant")
    # Halves are distinct, so a key met twice holds both values of its bit.
    met = variants.groupBy(F.shiftright("variant", 1).alias("g")).agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    pairs = met.selectExpr("g", "g & ((1L << 33) - 1) AS low", "1L << int(g >> 33) AS bit").selectExpr("g", "low", "low | bit AS high")
    sides = pairs.select("g", F.explode(F.array("low", "high")).alias("half")).join(counted, "half")
    near = sides.groupBy("g").agg(F.sum("n").alias("n"), F.min("half").alias("low"), F.max("half").alias("high"))
    same = counted.where("n > 1").selectExpr("-1 - half AS g", "n", "half AS low", "half AS high")
    return near.unionByName(same)


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints that hold all components of the distance graph.

    Up to groups of ``BUCKET`` members these are all pairs at two bits or fewer.
    """
    halves = distinct.selectExpr("fp", "explode(array(fp & 4294967295L, shiftrightunsigned(fp, 32) | 4294967296L)) AS half")
    counted = pin(halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")), "half-counts")
    groups = pin(_groups(counted), "half-groups")
    crowd = F.col("n") > BUCKET
    wanted = groups.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("half"), crowd.alias("crowd"))
    wanted = wanted.groupBy("half").agg(F.bool_or("crowd").alias("crowded"), F.bool_or(~F.col("crowd")).alias("few"))
    # One half may belong to very many fingerprints: they are looked up by several tasks.
    wanted = wanted.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = halves.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    met = pin(salted.join(wanted, ["half", "salt"]).drop("salt"), "grouped-fingerprints")
    few = groups.where(~crowd).select("g", F.explode(F.array_distinct(F.array("low", "high"))).alias("half"))
    few = few.join(met.where("few"), "half").groupBy("g").agg(F.collect_list("fp").alias("members"))
    inside = few.select("members").mapInArrow(_verify, "u long, v long")
    crowded = met.where("crowded").select("fp").distinct()
    stars = crowded.mapInArrow(_pair_variants, "place int, rest long, fp long")
    stars = pin(stars, "star-variants") if crowded.take(1) else stars
    centres = stars.groupBy("place", "rest").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    around = stars.join(centres.drop("n"), ["place", "rest"]).select(F.col("fp").alias("u"), "v").where("u <> v")
    return inside.distinct().unionByName(around.distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_sha: bool = False) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links, of every row.

    Null and repeated ids give unrelated components the same component_id. ``with_sha`` adds what
    identifies rows and components: text_sha256 and ``root``, the smallest fingerprint of the component.
    """
    rows = pin(fingerprints(docs, id_col, text_col, with_sha), "fingerprints")
    distinct = pin(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    root = components(links(distinct))
    named = distinct.join(root.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # Most fingerprints are alone; only the others have a component to look up.
    member = pin(named.join(least, "root").select("fp", "component_id", *(["root"] if with_sha else [])), "members")
    hot = _hot(rows, member)
    printed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return hot.select("doc_id", printed, "component_id", *(["text_sha256", "root"] if with_sha else []))


def _hot(rows: DataFrame, member: DataFrame) -> DataFrame:
    """Rows with their component; fingerprints with a thousandth of all rows (at most a thousand) are broadcast."""
    sizes = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    frequent = sizes.where(F.col("n") * 1000 >= max(total, 2000)).select("fp")
    few = pin(member.join(F.broadcast(frequent), "fp", "left_semi"), "frequent")
    rest = rows.join(F.broadcast(few.select("fp")), "fp", "left_anti").join(member, "fp")
    return rest.unionByName(rows.join(F.broadcast(few), "fp"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of every component: the smallest id (null last), of equal ids the smallest digest.

    A document is an id with its text: rows equal in both stay or go together.
    """
    found = pin(near_duplicates(docs, id_col, text_col, with_sha=True), "near-duplicates")
    document = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_sha256")
    least = found.groupBy("root").agg(F.min(document).alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # One document stays per component; all others of a component of two or more rows go.
    several = least.select(F.col("root").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("salt"), "stays")
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_sha256"), F.lit(32)).cast("int"))
    met = found.join(several, (F.col("root") == F.col("of")) & (found["salt"] == several["salt"]))
    gone = met.where(~document.eqNullSafe(F.col("stays"))).select("doc_id", "text_sha256")
    return drop_documents(docs, gone, id_col, text_col)


def links_of(fps: list[int]) -> pd.DataFrame:
    """All links among a few fingerprints by comparing every pair, for tests."""
    values = np.unique(np.array(fps, dtype=np.uint64))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    a, b = np.nonzero(np.triu(near, 1))
    return pd.DataFrame({"u": values[a].view(np.int64), "v": values[b].view(np.int64)})

"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Words are hashed; at every position of a text and of a benchmark item the words under
the fixed masks are hashed to seeds, positions marked 0 being ignored. Any thirteen
words in a row of which two are replaced leave at least one mask intact at some place
(``guaranteed`` tries all cases), so such a passage meets its item in an equality join
of seeds. Around a hit the text is laid beside the item on the hit's
diagonal and the words are compared: a text is contaminated where, of ``SPAN``
words in a row of one item, at most ``REPLACED`` differ. Of an item with fewer words, as
many may differ as the masks are sure to find (``allowed``: none up to seven words, for
example), so that no verdict depends on a lucky hit.

Seeds of the benchmark are broadcast only when their number, counted before, is at
most ``BROADCAST_SEEDS``; beyond that the join is left to a shuffle. Hits are reduced to
distinct (text, item, diagonal), texts being their digests, so copies are verified once.

Defined results: null and empty texts or items match nothing; an item that is
repeated is one item (its smallest id); documents with equal ids stay rows; an empty
table on either side contaminates nothing.
"""

from __future__ import annotations

import functools
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondpass.llm.common import hashable, unused
from secondpass.session import pin

MASKS = ("111011", "110111", "1101011")
SPAN, REPLACED = 13, 2
BROADCAST_SEEDS = 500_000  # 40 bytes each
_SALTS = 32
_WIDTH = max(map(len, MASKS))


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and marks; punctuation does not separate equal passages."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, keep: list[str], hashes: Column) -> DataFrame:
    """Rows (keep, pos, seed): the seeds of all positions; words past the end are null and end no mask."""
    size = F.size("_h")
    shifted = [F.slice("_h", k + 1, F.greatest(size, F.lit(1))).alias(f"w{k}") for k in range(_WIDTH)]
    lists = rows.select(*keep, hashes.alias("_h")).where(size > 0)
    spread = lists.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "w"))
    seeds = [
        F.when(F.col(f"w.w{len(mask) - 1}").isNotNull(),
               F.xxhash64(F.lit(number), *[F.col(f"w.w{k}") for k, bit in enumerate(mask) if bit == "1"]))
        for number, mask in enumerate(MASKS)
    ]
    return spread.select(*keep, "pos", F.explode(F.array(*seeds)).alias("seed")).where("seed IS NOT NULL")


def _matches(text_words: Column, item_words: Column, diagonal: Column) -> Column:
    """For every word of the item: 1 where the text has the same word on the diagonal."""
    n = F.size(item_words)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when(
        (j + diagonal >= 0) & (F.get(text_words, j + diagonal) == F.get(item_words, j)), 1).otherwise(0))


def _longest(equal: Column) -> Column:
    """The largest number of equal words in any ``SPAN`` words in a row."""
    sums = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(equal) - SPAN + 1, F.lit(1))),
        lambda j: F.aggregate(F.slice(equal, j, SPAN), F.lit(0), lambda a, b: a + b),
    )
    return F.array_max(sums)


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """text_sha256 (binary), item_id, pos (first word) and equal (words) of every verified overlap."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("item"))
    items = pin(items.where(F.size("item") > 0).groupBy("item").agg(F.min("item_id").alias("item_id"))
                .select(F.monotonically_increasing_id().alias("item_no"), "item_id", "item"), "items")
    short = F.size("item") < _WIDTH
    item_seeds = _seeds(items.where(~short), ["item_no"], F.transform("item", lambda w: F.xxhash64(w)))
    item_seeds = pin(item_seeds.withColumnRenamed("pos", "item_pos"), "item-seeds")
    sha = F.unhex(F.sha2(text, 256))
    text_seeds = _seeds(docs.select(text.alias("_t"), sha.alias("sha")), ["sha"], _hashes(F.col("_t")))
    small = item_seeds.count() <= BROADCAST_SEEDS
    hits = text_seeds.join(F.broadcast(item_seeds) if small else item_seeds, "seed")
    hits = hits.select("sha", "item_no", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    few = items.where(short).select("item_no", "item", F.element_at("item", 1).alias("w"))
    if few.take(1):
        # Items shorter than a mask meet texts by their first word.
        first = docs.select(sha.alias("sha"), F.posexplode(words(text)).alias("diagonal", "w"))
        hits = hits.unionByName(first.join(few, "w").select("sha", "item_no", "diagonal").distinct())
    hits = pin(hits, "seed-hits")
    # Texts with a hit, one row per digest; salted, because one text may be a third of all rows.
    salt = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    wanted = hits.select("sha").distinct().select("sha", salt)
    rows = docs.select(text.alias("_t"), sha.alias("sha"), F.pmod(F.xxhash64(F.rand(7)), F.lit(_SALTS)).cast("int").alias("salt"))
    found = rows.join(wanted, ["sha", "salt"], "left_semi")
    found = found.dropDuplicates(["sha", "salt"]).dropDuplicates(["sha"]).select("sha", words(F.col("_t")).alias("words"))
    laid = hits.join(found, "sha").join(items, "item_no")
    laid = laid.withColumn("equal_at", _matches(F.col("words"), F.col("item"), F.col("diagonal")))
    n = F.size("item")
    need = F.get(F.array(*[F.lit(words - allowed(words)) for words in range(SPAN + 1)]), F.least(n, F.lit(SPAN)))
    return laid.withColumn("equal", _longest(F.col("equal_at"))).where(F.col("equal") >= need).select(
        "sha", "item_id", F.greatest("diagonal", F.lit(0)).alias("pos"), "equal"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, contaminated, n_items, first_item, best_equal of every row."""
    flags = contaminated_texts(docs, benchmark, text_col).groupBy("sha").agg(
        F.count_distinct("item_id").alias("n_items"), F.min("item_id").alias("first_item"),
        F.max("equal").cast("long").alias("best_equal"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("sha"))
    return _with_flags(rows, flags).select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "first_item", F.coalesce("best_equal", F.lit(0)).alias("best_equal"))


def _with_flags(rows: DataFrame, flags: DataFrame) -> DataFrame:
    salted = flags.select("*", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "sha"), F.lit(_SALTS)).cast("int"))
    return rows.join(salted, ["sha", "salt"], "left")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is contaminated, all columns kept."""
    sha, salt = unused(docs, "sha", "salt")
    flags = contaminated_texts(docs, benchmark, text_col).select(F.col("sha").alias(sha)).distinct()
    flags = flags.select(sha, F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias(salt))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    dealt = F.pmod(F.xxhash64(*hashable(docs)), F.lit(_SALTS)).cast("int")
    rows = docs.withColumns({sha: digest, salt: dealt})
    return rows.join(flags, [sha, salt], "left_anti").select(*docs.columns)


def brute_force(text: str, items: list[str]) -> bool:
    """Whether a text is contaminated, by comparing every word position of every item; for tests."""
    import regex

    split = lambda t: [w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", (t or "").lower()) if w]
    mine = split(text)
    for item in map(split, items):
        n = len(item)
        need = min(n, SPAN) - allowed(min(n, SPAN))
        for diagonal in range(-n + 1, len(mine)) if n else ():
            equal = [0 <= j + diagonal < len(mine) and mine[j + diagonal] == item[j] for j in range(n)]
            if max(sum(equal[j:j + SPAN]) for j in range(max(1, n - SPAN + 1))) >= need:
                return True
    return False


@functools.cache
def allowed(words: int) -> int:
    """How many of ``words`` words in a row may differ: at most the share of ``REPLACED`` in ``SPAN``."""
    most = words * REPLACED // SPAN
    return next((r for r in range(most, 0, -1) if guaranteed(r, words)), 0)


def guaranteed(replaced: int = REPLACED, span: int = SPAN) -> bool:
    """Whether the masks hit every ``span`` words in a row with ``replaced`` words changed."""
    def hit(gone):
        return any(
            all(bit == "0" or start + k not in gone for k, bit in enumerate(mask))
            for mask in MASKS for start in range(span - len(mask) + 1))

    return all(hit(set(gone)) for gone in combinations(range(span), replaced))

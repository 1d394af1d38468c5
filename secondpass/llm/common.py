"""Helpers shared by the corpus operators.

All operators read only the columns they are told to (id and text), renamed to
private names at once, so further columns of the input never clash with theirs.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from secondpass.session import pin, scratch_path

_RANGE_BITS = 33  # monotonically_increasing_id keeps the partition number above bit 33

# Letters and digits stay, A-Z become small, all other ASCII separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters in UTF-8, A-Z lowered."""
    return (text or "").encode().translate(_FOLD).split()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` (long) and ``text``; null texts become empty ones."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def held_out(id_col: str = "doc_id"):
    """Rows that no classifier may learn from: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def ranked(df: DataFrame, groups: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Add the 0-based position of every row inside its group, whatever the size of the group.

    Rows are sorted by range over group and order together, so a large group
    covers many tasks. Each task's runs of one group (at most one per range plus
    one per group) are counted and summed up to offsets. ``groups`` must have a
    bounded number of values: the offsets are broadcast.
    """
    placed = pin(df.orderBy(*groups, *order).withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_range", F.shiftright("_mid", _RANGE_BITS))
    runs = placed.groupBy("_range", *groups).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (
        placed.join(F.broadcast(runs), ["_range", *groups])
        .withColumn(name, F.col("_before") + F.col("_mid") - F.col("_first"))
        .select(*df.columns, name)
    )


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """Write ``df`` once to shared storage in buckets of ``key``, as many as a shuffle has partitions.

    Joins on ``key`` then leave its rows where they are and shuffle the other side to them.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, label)
    name = os.path.basename(path).replace("-", "_")
    placed = df.repartition(buckets, key).write.bucketBy(buckets, key).format("parquet")
    placed.option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def hashable(df: DataFrame) -> list[str]:
    """Columns that Spark can hash and compare."""
    return [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]


def drop_documents(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents (``doc_id``, ``text_sha256``) in ``dropped``; a document is an id with its text."""
    sha, gone_id, gone_sha = unused(docs, "sha", "gone_id", "gone_sha")
    gone = dropped.select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha))
    rows = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    left = rows.join(gone, (F.col(sha) == F.col(gone_sha)) & F.col(id_col).eqNullSafe(F.col(gone_id)), "left_anti")
    return left.select(*docs.columns)

"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is two aggregations and a join over the links. Stars of any size are
handled as joins on the minimum neighbour, so no neighbourhood is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondpass.session import pin

MAX_ROUNDS = 60


def _step(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (u > v)."""
    both = links.select(F.col("u").alias("a"), F.col("v").alias("b"))
    if large:
        both = both.unionByName(links.select(F.col("v").alias("a"), F.col("u").alias("b")))
    smallest = both.groupBy("a").agg(F.min("b").alias("m"))
    smallest = smallest.select(F.col("a").alias("at"), F.least("a", "m").alias("m"))
    joined = both.join(smallest, F.col("a") == F.col("at"))
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("u"), F.col("m").alias("v")).unionByName(
            smallest.select(F.col("at").alias("u"), F.col("m").alias("v"))
        )
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """Links (``u``, ``v``: any comparable type) to ``u``, ``v``: every node with the smallest node of its component.

    Smallest nodes have no row of their own. Every round is written to the shared
    folder; rounds end when a round changes nothing.
    """
    current = pin(
        links.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    seen = None
    for _ in range(MAX_ROUNDS):
        state = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not state["n"] or seen == (state["n"], state["s"]):
            return current
        seen = (state["n"], state["s"])
        current = pin(_step(_step(current, True), False), "links")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")

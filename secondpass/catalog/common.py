"""Helpers shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Registered queries of one area with their SQL counterparts."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query registered twice: {name}")
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return register


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double column, so both engines agree on the last digits."""
    return df.select(*[
        F.round(F.col(name), digits).alias(name) if kind == "double" else F.col(name) for name, kind in df.dtypes
    ])


def random_bits_sql(rows: str, seed: str, repetition: str = "repetition", position: str = "position") -> str:
    """The SQL table ``rows`` with a column ``bits``: 52 random bits per repetition and position, as the package draws them."""
    return f"(SELECT *, ('0x' || left(md5('{seed}:' || {repetition} || ':' || {position}), 13))::BIGINT AS bits FROM {rows})"


def random_ranks_sql(seed: str, routes: int, budget: int) -> str:
    """Ranks of random routes over ``scores``; of each route at least the first ``budget`` rows."""
    return f"""(SELECT repetition, sample_id, row_number() OVER (PARTITION BY repetition ORDER BY k, sample_id) AS rank FROM (
      SELECT repetition, sample_id, sha256('{seed}:' || repetition || ':' || sample_id) AS k
      FROM scores, (SELECT unnest(range({routes}))::INTEGER AS repetition)), (SELECT count(*) AS n FROM scores)
    WHERE ('0x' || left(k, 8))::BIGINT < 4294967296.0 * ({budget} + 8 * sqrt({budget}) + 30) / n)"""

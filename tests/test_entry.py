"""The driver contract: names agree and the flagship query has rows."""

import __spark_entry__ as entry


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["expert_call_count"] == 300

"""The range path of ranks, totals and percentiles must equal the plain window."""

import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from secondpass.operators import order, resampling, routing
from secondpass.operators.order import exact_percentiles, with_midrank, with_rank, with_running_total


def frame(spark, rows=300):
    rng = random.Random(5)
    # One group holds most of the rows.
    data = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(20)}", rng.randrange(40), f"id{i:04d}") for i in range(rows)]
    return spark.createDataFrame(data, "g string, v int, id string")


def test_rank_range_path_equals_window(spark):
    df = frame(spark)
    for groups in ((), ("g",)):
        order = [F.desc("v"), F.asc("id")]
        plain = {r["id"]: r["rank"] for r in with_rank(df, order, groups).collect()}
        ranged = {r["id"]: r["rank"] for r in with_rank(df, order, groups, hot_rows=50).collect()}
        assert plain == ranged and len(plain) == 300


def test_running_total_range_path_equals_window(spark):
    df = frame(spark)
    for groups in ((), ("g",)):
        plain = {r["id"]: r["running"] for r in with_running_total(df, ["v", "id"], "v", groups).collect()}
        ranged = {r["id"]: r["running"] for r in with_running_total(df, ["v", "id"], "v", groups, hot_rows=50).collect()}
        assert plain == ranged


def test_percentiles_match_numpy_on_both_paths(spark):
    df = frame(spark)
    local = df.toPandas()
    probabilities = {"a": 0.1, "b": 0.5, "c": 0.975}
    for hot_rows in (10_000, 10):
        for row in exact_percentiles(df, "v", probabilities, ["g"], hot_rows=hot_rows).collect():
            values = local[local.g == row["g"]].v
            for name, p in probabilities.items():
                assert abs(row[name] - np.percentile(values, 100 * p)) < 1e-9
    row = exact_percentiles(df, "v", probabilities).first()
    assert abs(row["c"] - np.percentile(local.v, 97.5)) < 1e-9


def test_midrank_averages_ties(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,)], "v int")
    assert sorted((r["v"], r["midrank"]) for r in with_midrank(df, "v").collect()) == [(1, 1.0), (2, 2.5), (2, 2.5), (3, 4.0)]


def test_null_groups_survive_the_range_path(spark):
    df = spark.createDataFrame([(None, i) for i in range(30)] + [("a", i) for i in range(3)], "g string, v int")
    rows = with_rank(df, ["v"], ["g"], hot_rows=10).collect()
    assert len(rows) == 33 and all(r["rank"] == r["v"] + 1 for r in rows)


def test_counted_values_equal_repeated_values(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (7.0, 4)], "v double, n int")
    repeated = df.selectExpr("v", "explode(sequence(1, n))").select("v")
    want = exact_percentiles(repeated, "v", {"p": 0.45}).first()["p"]
    assert exact_percentiles(df, "v", {"p": 0.45}, weight="n").first()["p"] == want


def test_running_total_of_hot_groups_equals_the_plain_path(spark):
    values = [5.0, 0.0, 0.0, 2.0, -3.5, None, 0.0, 1.25]
    rows = [(g, i, None if g == "n" else v) for g in ("a", "b", None, "n") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(5)

    plain, hot = (
        {(r.g, r.i): r.running for r in with_running_total(df, ["i"], "v", ["g"], hot_rows=n).collect()} for n in (100, 3)
    )
    assert plain == hot and plain["a", 3] == 7.0 and plain["n", 7] is None


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_first_rows_equal_a_sort(spark, monkeypatch, hot_rows):
    """Ties, missing and odd values; also where the cuts are useless or wrong."""
    values = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0] * 3 + [float(i % 7) for i in range(200)] + [i / 9 for i in range(300)]
    df = spark.createDataFrame([(f"r{i:03d}", v) for i, v in enumerate(values)], "id string, v double").repartition(3)
    monkeypatch.setattr(order, "with_rank", functools.partial(order.with_rank, hot_rows=hot_rows))
    by = [F.desc("v"), F.asc("id")]
    whole = [r["id"] for r in df.orderBy(*by).collect()]
    for count in (0, 1, 5, 60, 250, len(values), 10**6):
        got = {r["id"] for r in order.first_rows(df, by, order.descending_key("v"), count).collect()}
        assert got == set(whole[:count])
    monkeypatch.setattr(order, "_CUT_MARGIN", -0.2)  # cuts that miss the wanted place
    assert {r["id"] for r in order.first_rows(df, by, order.descending_key("v"), 150).collect()} == set(whole[:150])


def test_random_routes_are_the_start_of_whole_rankings(spark, monkeypatch):
    df = spark.createDataFrame([(f"r{i}",) for i in range(400)], "sample_id string")
    whole = {(r["repetition"], r["rank"]): r["sample_id"] for r in routing.random_order(df, "s", 6).collect()}
    for budget in (1, 30, 399, 500):
        got = {(r["repetition"], r["rank"]): r["sample_id"] for r in routing.random_order(df, "s", 6, budget=budget).collect()}
        assert got == {k: v for k, v in whole.items() if k[1] <= budget}
    monkeypatch.setattr(routing, "_bound", lambda budget, total: budget * 16.0**13 / total)  # leaves too few in about half
    got = {(r["repetition"], r["rank"]): r["sample_id"] for r in routing.random_order(df, "s", 6, budget=30).collect()}
    assert got == {k: v for k, v in whole.items() if k[1] <= 30}
    route = {r["sample_id"] for r in routing.random_route(df, "s", 2, 30).collect()}
    assert route == {whole[2, k] for k in range(1, 31)}


def test_draws_from_an_array_equal_joined_draws(spark, monkeypatch):
    df = spark.createDataFrame([(f"r{i:03d}", float(i * i % 17), 1.0) for i in range(150)], "sample_id string, a double, b double")
    held = resampling.paired_bootstrap(df, "a", "b", "s", 40).first()
    monkeypatch.setattr(resampling, "ARRAY_ROWS", 10)
    joined = resampling.paired_bootstrap(df, "a", "b", "s", 40).first()
    assert held == pytest.approx(joined)

"""Tests of the findings of round 3: work that must not grow faster than the input."""

import hashlib
import random
from fractions import Fraction

from pyspark.sql import functions as F

from secondpass import session
from secondpass.llm import jaccard_join
from secondpass.operators import allocation, order, routing

_ACTIONS = "segment string, sample_id string, action string, action_rank int, available boolean, benefit double, cost long, " \
    "area_num long, area_den long, footprint double"


def test_choices_search_contenders_only(spark):
    draw, rows = random.Random(5), []
    for segment, records in (("a", 400), ("b", 3)):
        for i in draw.sample(range(1000), records):
            name = f"r{i:04d}"
            zero = 0 if draw.random() < 0.98 else 1  # some records are not retained for nothing
            rows.append((segment, name, "retain_primary", 0, True, 0.0, 0, zero, 8, 0.0))
            for rank, action, cost in ((1, "core_read_core_write", 2), (2, "halo_read_core_write", 3), (3, "halo_read_halo_write", 3), (4, "whole_table", 5)):
                rows.append((segment, name, action, rank, draw.random() < 0.7, draw.randrange(-3, 5) / 8, cost, draw.randrange(1, 3), 8, float(draw.randrange(2))))
    df = spark.createDataFrame(rows, _ACTIONS)
    budgets = (0, 4, 9, 13)
    options = allocation.eligible_actions(df)
    kept = allocation.contenders(options, 13, ["segment"])
    assert 3 <= kept.where("segment = 'a'").count() < 60
    frontier, choices = allocation.search_choices(df, budgets, chunk_records=4)
    found = {(r["segment"], r["budget"]): r for r in frontier.collect()}
    picked = {}
    for r in choices.collect():
        picked.setdefault((r["segment"], r["budget"]), {})[r["sample_id"]] = r["action_rank"]
    for segment in ("a", "b"):
        menus = {}
        for r in options.where(F.col("segment") == segment).collect():
            menus.setdefault(r["sample_id"], []).append((r["cost"], r["benefit"], Fraction(r["area_num"], r["area_den"]), r["footprint"],
                                                         int(r["action"] == "whole_table"), str(r["action_rank"])))
        states = {0: (0.0, Fraction(0), 0.0, 0, "")}
        for name in sorted(menus):
            states = allocation._combine(states, menus[name], 13)
        for budget in budgets:
            cost = max((c for c in states if c <= budget), key=lambda c: (round(states[c][0], 12), -c))
            benefit, area, footprint, whole, ranks = states[cost]
            row = found[segment, budget]
            assert (row["cost"], round(row["benefit"], 9), Fraction(row["area"]), row["footprint"], row["whole"]) == (
                cost, round(benefit, 9), area, footprint, whole)
            assert picked[segment, budget] == dict(zip(sorted(menus), map(int, ranks)))


def test_full_random_ranks_move_rows_once_and_leave_the_keys(spark, monkeypatch):
    written = {}

    def pin(df, label="pinned"):
        written[label] = df.columns
        return session.pin(df, label)

    monkeypatch.setattr(order, "pin", pin)
    monkeypatch.setattr(order.with_rank, "__defaults__", ((), "rank", 20, False, ()))
    ids = spark.range(90).select(F.format_string("%04d", "id").alias("sample_id"))
    ranked = routing.random_order(ids, "seed", 3)
    assert ranked.columns == ["sample_id", "repetition", "rank"]
    assert "_key" not in written["ranged"]
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 2
    found = {(r["repetition"], r["sample_id"]): r["rank"] for r in ranked.collect()}
    for repetition in range(3):
        keys = sorted((hashlib.sha256(f"seed:{repetition}:{i:04d}".encode()).hexdigest(), f"{i:04d}") for i in range(90))
        assert [found[repetition, name] for _, name in keys] == list(range(1, 91))


def test_family_of_near_copies_asks_few_groups(spark, monkeypatch):
    draw, asked = random.Random(3), []
    base, texts = [f"w{i}" for i in range(150)], {}
    for i in range(70):
        words = list(base)
        for at in draw.sample(range(5, 145), draw.choice((0, 1, 2, 3, 3, 3, 4, 4))):
            words[at] = f"e{draw.randrange(40)}"
        texts[i] = " ".join(words[:draw.choice((150, 150, 150, 148, 140))])

    def pin(df, label="pinned"):
        out = session.pin(df, label)
        if label == "qualifying":
            asked.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "pin", pin)
    monkeypatch.setattr(jaccard_join, "MEMBERS", 4)
    out = jaccard_join.jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    assert found == jaccard_join.brute_force(texts)
    assert len({c for _, c in found.values()}) > 5
    assert sum(asked) < 3 * len(texts)


def test_risks_of_few_values_do_not_move_records_to_their_percentiles(spark):
    rows = [(f"r{i:03d}", (i % 3) / 4, None if i % 5 == 0 else (i % 2) / 2, 0.0) for i in range(60)]
    records = spark.createDataFrame(rows, "sample_id string, ocr_confidence_p10 double, unmatched_ocr_ratio double, empty_cell_ratio double")
    out = routing.combined_risk(records, records.where("sample_id < 'r030'"))
    assert "strategy=broadcast" in out._jdf.queryExecution().optimizedPlan().toString()
    tail = {r[0]: 1.0 - r[1] for r in rows}
    known = [value for name, value in tail.items() if name < "r030"]
    for r in out.collect():
        value = tail[r["sample_id"]]
        share = sum((v < value) + 0.5 * (v == value) for v in known) / len(known)
        assert abs(r["confidence_tail_risk_percentile"] - share) < 1e-12
        assert r["combined_risk"] == max(r["confidence_tail_risk_percentile"], r["unmatched_ocr_ratio_percentile"])

"""Brute-force and invariant checks of spatial, routing, learning and allocation operators."""

import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from secondpass.operators import allocation, learning, resampling, routing, spatial
from secondpass.operators.aggregates import spearman


def boxes(spark, n, name, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.uniform(-50, 300), rng.uniform(-50, 300)
        w, h = (rng.choice([0.5, 5, 40, 300, 100000]) * rng.uniform(0.5, 1) for _ in "xy")
        rows.append((rng.choice(["hot", "hot", "b"]), i, x, y, x + w, y + h))
    return rows, spark.createDataFrame(rows, f"k string, {name} int, x0 double, y0 double, x1 double, y1 double")


def test_box_pairs_equal_brute_force(spark):
    (a, da), (b, db) = boxes(spark, 60, "i", 1), boxes(spark, 60, "j", 2)
    want = {(p[1], q[1]) for p in a for q in b if p[0] == q[0] and min(p[4], q[4]) > max(p[2], q[2]) and min(p[5], q[5]) > max(p[3], q[3])}
    for largest in (64.0, 65536.0):
        found = [(r["i"], r["j"]) for r in spatial.box_pairs(da, db, "k", largest).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_points_on_edges_count(spark):
    points = spark.createDataFrame([("k", 1, 10.0, 10.0), ("k", 2, 10.1, 10.0), ("k", 3, 0.0, 5.0)], "k string, p int, px double, py double")
    cell = spark.createDataFrame([("k", 0.0, 0.0, 10.0, 10.0)], "k string, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r["p"] for r in spatial.points_in_boxes(points, cell, "k", "p").collect()) == [1, 3]


def test_attach_text_ties_and_threshold(spark):
    cells = spark.createDataFrame([("t", 0, 0.0, 0.0, 10.0, 10.0), ("t", 1, 10.0, 0.0, 20.0, 10.0)],
                                  "sample_id string, cell_no int, x0 double, y0 double, x1 double, y1 double")
    texts = spark.createDataFrame([
        ("t", 0, "tie", 5.0, 2.0, 15.0, 4.0), ("t", 1, "half", -5.0, 0.0, 5.0, 1.0), ("t", 2, "far", 50.0, 0.0, 60.0, 1.0),
        ("t", 3, " b ", 11.0, 6.0, 19.0, 8.0), ("t", 4, "  ", 11.0, 1.0, 12.0, 2.0), ("t", 5, "a", 11.0, 3.0, 19.0, 4.0)],
        "sample_id string, record_no int, text string, x0 double, y0 double, x1 double, y1 double")
    out, counts = spatial.attach_text(texts, cells)
    assert {r["cell_no"]: r["text"] for r in out.collect()} == {0: "half tie", 1: "a b"}
    assert tuple(counts.drop("sample_id").first()) == (6, 5, 1, 1, 2, 2)
    _, all_in = spatial.attach_text(texts, cells, min_overlap=0)
    assert tuple(all_in.drop("sample_id").first())[:4] == (6, 6, 0, 2)


def score_rows(spark, n=40):
    rng = random.Random(3)
    rows = [(f"s{i:03d}", rng.random(), rng.random(), "success" if i % 4 else "parse_failed", rng.random() if i % 4 else None,
             rng.random() if i % 4 else None, 1.0, rng.random()) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, primary_con double, primary_top double, expert_status string, expert_con double, "
                                       "expert_top double, expert_seconds double, p double").withColumn(
        "benefit", F.expr("if(expert_status = 'success', expert_con - primary_con, 0D)"))


def test_curve_invariants(spark):
    df = score_rows(spark)
    curve = routing.quality_budget_curve(df, {"p": "p", "oracle": "benefit"}, (0, 10, 40)).toPandas().set_index(["method", "budget"])
    assert curve.loc[("p", 0)].gain_over_always_primary_con == 0 and curve.loc[("always_primary", 40)].expert_call_count == 0
    for budget in (0, 10, 40):
        assert curve.loc[("oracle", budget)].hybrid_full_set_con >= curve.loc[("p", budget)].hybrid_full_set_con - 1e-12
    assert abs(curve.loc[("oracle", 40)].hybrid_full_set_con - curve.loc[("p", 40)].hybrid_full_set_con) < 1e-12
    assert curve.loc[("p", 40)].failed_expert_return_count == 10


def test_route_fraction_is_half_even(spark):
    for n, want in ((5, 2), (15, 8), (25, 12)):
        assert routing.route_fraction(score_rows(spark, n), "p", 0.5).count() == want


def test_bootstrap_brackets_observed(spark):
    df = score_rows(spark).withColumn("zero", F.lit(0.0))
    for method in ("draws", "poisson"):
        row = resampling.paired_bootstrap(df, "primary_con", "zero", "s", 200, method=method).first()
        assert row["lower"] < row["observed"] < row["upper"] and row["replicates"] == 200


def test_spearman_constant_side(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert tuple(spearman(df, "a", "b").first()) == (2, None, "constant predicted values")
    assert spearman(df, "b", "b").first()["value"] == 1.0


def greedy(groups, k):
    loads, out = [0] * k, {}
    for key, size in sorted(groups.items(), key=lambda kv: (-kv[1], [-ord(c) for c in kv[0]])):
        fold = loads.index(min(loads))
        loads[fold] += size
        out[key] = fold
    return out


def test_group_folds_equal_greedy(spark):
    rng = random.Random(9)
    for spread in (3, 60):
        groups = {f"g{i:03d}": rng.randint(1, spread) for i in range(70)} | {"hot0": 900}
        df = spark.createDataFrame([(g,) for g, n in groups.items() for _ in range(n)], "g string")
        found = {r["g"]: r["fold"] for r in learning.group_folds(df, "g", 4).collect()}
        assert found == greedy(groups, 4)


def training(spark, n=120):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.3 + rng.normal(size=n) * 0.1
    x[::7, 1] = np.nan
    rows = [(f"s{i:03d}", f"i{i % 9}", *[None if np.isnan(v) else float(v) for v in x[i]], float(y[i])) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "sample_id string, issuer string, a double, b double, c double, y double")


def test_ridge_matches_closed_form(spark):
    x, y, df = training(spark)
    model = learning.fit_ridge(df, ["a", "b", "c"], "y", {"alpha": 10.0})
    filled = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    z = (filled - filled.mean(0)) / filled.std(0)
    w = np.linalg.solve(z.T @ z + 10.0 * np.eye(3), z.T @ (y - y.mean()))
    want = z @ w + y.mean()
    got = [r["prediction"] for r in learning.predict(model, df).orderBy("sample_id").collect()]
    assert np.allclose(got, want, atol=1e-9)


def test_fold_models_see_only_training_rows(spark):
    _, _, df = training(spark)
    rows = df.join(learning.group_folds(df, "issuer", 3), "issuer")
    models = learning.fold_models(rows, ["a", "b", "c"], "y", "ridge", [{"alpha": 1.0}], 3)
    for (fold, _), model in models.items():
        direct = learning.fit_ridge(rows.where(F.col("fold") != fold), ["a", "b", "c"], "y", {"alpha": 1.0})
        assert np.allclose(model.coefficients, direct.coefficients, atol=1e-9) and model.medians == direct.medians


def test_nested_predictions_cover_every_row_once(spark):
    _, _, df = training(spark)
    out = learning.nested_predictions(df, ["a", "b", "c"], "y", "issuer", "ridge", {"alpha": (0.1, 10.0)}, 3, 2)
    assert out.count() == out.select("sample_id").distinct().count() == df.count()


def test_trees_predict_finite(spark):
    _, _, df = training(spark)
    model = learning.fit_trees(df, ["a", "b", "c"], "y", {"max_depth": 2, "learning_rate": 0.1, "max_iter": 3})
    assert learning.predict(model, df).where("prediction IS NULL OR isnan(prediction)").count() == 0


def menu(spark, n=7, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        primary, local = rng.random(), i % 2 == 0
        for rank, name in enumerate(("retain_primary", "core_read_core_write", "halo_read_core_write", "halo_read_halo_write", "whole_table")):
            cost = (0, 250, 400, 400, 1000)[rank]
            con = primary if rank == 0 else rng.random()
            ok = local or rank in (0, 4)
            rows.append(("seg", f"s{i}", "iss", rank, name, ok, con if ok else None, con if ok else None, con - primary if ok else None,
                         cost if ok else None, cost if ok else None, 1000 if ok else None, float(cost) if ok else None))
    return rows, spark.createDataFrame(rows, "segment string, sample_id string, issuer string, action_rank int, action string, available boolean, "
                                             "con double, top double, benefit double, cost bigint, area_num bigint, area_den bigint, footprint double")


def test_choice_frontier_equals_enumeration(spark):
    rows, df = menu(spark)
    budgets = (0, 250, 900, 2000, 7000)
    options = {}
    for r in rows:
        if r[5] and (r[3] == 0 or r[8] > 1e-12):
            options.setdefault(r[1], []).append((r[9], r[8], r[3]))
    names = sorted(options)
    for chunk in (2, 100):
        found = {r["budget"]: r for r in allocation.choice_frontier(df, budgets, chunk_records=chunk).collect()}
        for budget in budgets:
            best = max(sum(o[1] for o in pick) for pick in itertools.product(*[options[n] for n in names]) if sum(o[0] for o in pick) <= budget)
            assert abs(found[budget]["benefit"] - best) < 1e-9 and found[budget]["cost"] <= budget
    thirds = df.withColumn("area_den", F.expr("if(available, 3000L, NULL)"))
    exact = allocation.choice_frontier(thirds, (7000,), chunk_records=2).first()
    assert Fraction(exact["area"]) == Fraction(exact["cost"], 3000)
    frontier, choices = allocation.search_choices(df, budgets, chunk_records=2)
    chosen = allocation.chosen_actions(choices, df)
    totals = {r["budget"]: (r["n"], r["cost"], r["benefit"]) for r in chosen.groupBy("budget").agg(
        F.count("sample_id").alias("n"), F.sum("cost").alias("cost"), F.sum("benefit").alias("benefit")).collect()}
    for budget in budgets:
        n, cost, benefit = totals[budget]
        assert n == len(names) and cost == found[budget]["cost"] and abs(benefit - found[budget]["benefit"]) < 1e-9
    assert allocation.full_budget_check(chosen, df, 7000).count() == 0
    whole = allocation.whole_table_frontier(df, budgets, ["segment"])
    assert allocation.headroom(frontier, whole).where("headroom < -1e-12").count() == 0


def test_merges_in_blocks_equal_one_merge(spark, monkeypatch):
    """However a merge is cut into blocks of output cost, states, ties and choices are the same."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(90):
        for rank, (name, cost) in enumerate((("retain_primary", 0), ("core_read_core_write", 250), ("halo_read_core_write", 400), ("whole_table", 1000))):
            benefit = 0.0 if rank == 0 else int(rng.integers(1, 6)) / 4  # many ties
            rows.append((f"s{i:03d}", rank, name, True, benefit, cost, cost, 700 + i % 3, float(cost)))
    df = spark.createDataFrame(rows, "sample_id string, action_rank int, action string, available boolean, benefit double, "
                                     "cost bigint, area_num bigint, area_den bigint, footprint double").withColumn("segment", F.lit(1))
    budgets = (0, 650, 5000, 12345)
    best = np.full(12346, -1.0)
    best[0] = 0
    for i in range(90):
        step = np.full(12346, -1.0)
        for row in rows[4 * i:4 * i + 4]:
            cost, held = row[5], best[:12346 - row[5]]
            step[cost:] = np.maximum(step[cost:], np.where(held >= 0, held + row[4], -1))
        best = step
    seen = []
    for pairs, chunk in ((1 << 22, 100), (1 << 22, 7), (50, 7)):
        monkeypatch.setattr(allocation, "_PAIRS", pairs)
        frontier, choices = allocation.search_choices(df, budgets, chunk_records=chunk)
        seen.append((sorted(map(tuple, frontier.collect())), sorted(map(tuple, choices.select("budget", "sample_id", "action_rank").collect()))))
        for r in frontier.collect():
            assert abs(r["benefit"] - best[:r["budget"] + 1].max()) < 1e-9
    assert seen[0] == seen[1] == seen[2]


def test_risk_midrank(spark):
    values = spark.createDataFrame([("r", 0.0), ("r", 2.0), ("r", 9.0)], "risk string, value double")
    population = spark.createDataFrame([("r", 1.0), ("r", 2.0), ("r", 2.0), ("r", 3.0)], "risk string, value double")
    got = {r["value"]: r["percentile"] for r in routing.midrank_percentile(values, population, ["risk"]).collect()}
    assert got == {0.0: 0.0, 2.0: 0.5, 9.0: 1.0}


def test_models_are_stored_and_checked(spark, tmp_path):
    rows = spark.createDataFrame(
        [(str(i), str(i % 5), float(i % 7), None if i % 11 == 0 else float(i % 3), 0.1 * (i % 7) - 0.3 * (i % 3)) for i in range(200)],
        "sample_id string, issuer string, a double, b double, benefit double")
    grids = {"ridge": {"alpha": (0.1, 10.0)}, "trees": {"max_depth": (2,), "learning_rate": (0.1,), "max_iter": (3,)}}
    folder = str(tmp_path / "models")
    first = learning.fit_final(rows, ["a", "b"], "benefit", "issuer", grids, 2, folder)
    again = learning.fit_final(rows, ["a", "b"], "benefit", "issuer", grids, 2, folder)
    loaded = learning.load_models(spark, folder, ["ridge", "trees"])
    for family in grids:
        want = {r["sample_id"]: r["prediction"] for r in learning.predict(first[family], rows).collect()}
        for model in (again[family], loaded[family]):
            assert model.params == first[family].params
            assert {r["sample_id"]: r["prediction"] for r in learning.predict(model, rows).collect()} == want
    with pytest.raises(ValueError, match="other features or parameters"):
        learning.fit_final(rows, ["a"], "benefit", "issuer", {"ridge": grids["ridge"]}, 2, folder)
    with pytest.raises(Exception, match="(?i)exist"):
        learning.save_model(spark, first["ridge"], f"{folder}/ridge")
    assert not learning.stored(spark, f"{folder}/nothing")


def test_a_cluster_without_shared_folder_is_refused(monkeypatch):
    from types import SimpleNamespace

    from secondpass import session

    def at(master, configured=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: configured), sparkContext=SimpleNamespace(master=master, applicationId="none"))

    monkeypatch.setattr(session, "_FALLBACK", {"none": "/tmp/none"})
    assert session.shared_dir(at("yarn", "hdfs:///shared")) == "hdfs:///shared" and session.shared_dir(at("local[2]")) == "/tmp/none"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(at(master))

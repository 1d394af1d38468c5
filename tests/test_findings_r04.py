"""Tests of the findings of round 4."""

import hashlib
from fractions import Fraction

import numpy as np
import pytest

from secondpass.catalog import jobs as registered
from secondpass.catalog import learning as registered_learning
from secondpass.functions import boosting, digests
from secondpass.functions.scalars import FEATURES
from secondpass.operators import allocation, learning, resampling, routing
from secondpass.plans import jobs


def tree_rows(spark, n=600):
    draw = np.random.default_rng(11)
    a, b = draw.integers(0, 400, n) / 8.0, draw.integers(0, 3, n).astype(float)
    y = np.where(a > 20, 1.0, -1.0) * (b == 1) + np.round(draw.normal(size=n), 2) / 8
    rows = [(f"s{i:03d}", f"i{i % 7}", i % 3, None if i % 13 == 0 else float(a[i]), float(b[i]), float(y[i])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "sample_id string, issuer string, fold int, a double, b double, y double")


def test_trees_take_the_best_split_and_count_rows_once(spark, monkeypatch):
    rows, df = tree_rows(spark)
    x = np.array([[np.nan if r[3] is None else r[3], r[4]] for r in rows])
    y = np.array([r[5] for r in rows])
    x = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    scans, real = [], learning._value_counts
    monkeypatch.setattr(learning, "_value_counts", lambda *args: scans.append(1) or real(*args))
    params = {"max_depth": 1, "learning_rate": 0.5, "max_iter": 2, "l2_regularization": 1.0}
    model = learning.fit_trees(df, ["a", "b"], "y", params)
    assert len(scans) == 1
    # The plain way: every edge of the model tried on all rows.
    want = np.full(len(y), y.mean())
    for _ in range(2):
        left, best = y - want, (0.0, None)
        for f in range(2):
            for edge in model.edges[f]:
                low = x[:, f] <= edge
                if min(low.sum(), (~low).sum()) < learning.MIN_LEAF_ROWS:
                    continue
                gain = sum(left[part].sum() ** 2 / (part.sum() + 1) for part in (low, ~low)) - left.sum() ** 2 / (len(y) + 1)
                if gain > best[0] + 1e-9:
                    best = gain, low
        for part in (best[1], ~best[1]):
            want[part] += 0.5 * left[part].sum() / (part.sum() + 1)
    found = [r["prediction"] for r in learning.predict(model, df).orderBy("sample_id").collect()]
    assert found == pytest.approx(list(want))
    assert 200 < len(model.edges[0]) < learning.MAX_BINS and list(model.edges[1]) == [0.5, 1.5]


def test_trees_of_folds_agree_with_single_fits_and_with_shards(spark, monkeypatch):
    _, df = tree_rows(spark)
    settings = [{"max_depth": d, "learning_rate": 0.3, "max_iter": 4} for d in (2, 3)]
    models = learning.fold_models(df, ["a", "b"], "y", "trees", settings, 3)
    assert len(models) == 6
    alone = learning.fit_trees(df.where("fold <> 1"), ["a", "b"], "y", settings[1])
    key = learning._key(settings[1])
    assert alone.edges == models[1, key].edges and alone.medians == models[1, key].medians
    monkeypatch.setattr(learning, "GROUPS_IN_MEMORY", 0)
    parted = learning.fold_models(df, ["a", "b"], "y", "trees", settings[1:], 3)
    for model in (alone, parted[1, key]):
        assert model.trees.column.tolist() == models[1, key].trees.column.tolist()
        assert model.trees.bin.tolist() == models[1, key].trees.bin.tolist()
        assert model.trees.value == pytest.approx(models[1, key].trees.value)


def test_nodes_that_are_not_split_keep_their_value():
    codes = [np.array([0, 0, 1, 1], np.uint8)]
    rows = boosting.Rows(codes, np.array([30, 30, 30, 30]), np.array([30.0, 30.0, 90.0, 90.0]), [2])
    trees = boosting.grow(rows, {"max_depth": 3, "learning_rate": 1.0, "max_iter": 2}, 20)
    assert boosting.predict(codes, trees) == pytest.approx([1.0, 1.0, 3.0, 3.0])


def reliance_rows(spark, n=210):
    draw = np.random.default_rng(5)
    rows = [(f"s{i:03d}", f"g{i % 6}", i % 3, float(draw.integers(0, 6)) / 4, None if i % 17 == 0 else float(draw.integers(0, 90)) / 8,
             float(draw.integers(0, 30)), 0.5, 0.5, "success" if i % 5 else "failed", float(draw.integers(0, 9)) / 8, 0.5, 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, issuer string, fold int, benefit double, a double, b double, primary_con double, "
                                 "primary_top double, expert_status string, expert_con double, expert_top double, expert_seconds double")


@pytest.mark.parametrize("family,params", [
    ("ridge", {"alpha": 1.0}), ("trees", {"max_depth": 3, "learning_rate": 0.3, "max_iter": 5})])
def test_reliance_in_tasks_agrees_with_moved_rows(spark, monkeypatch, family, params):
    df = reliance_rows(spark)
    models = learning.fold_models(df, ["a", "b"], "benefit", family, [params], 3)
    units = {"a": ("a",), "b": ("b",), "both": ("a", "b")}
    moved, real = [], learning._moved_reliance
    monkeypatch.setattr(learning, "_moved_reliance", lambda *args: moved.append(1) or real(*args))
    found = []
    for room in (learning.RELIANCE_BYTES, 0):
        monkeypatch.setattr(learning, "RELIANCE_BYTES", room)
        out = learning.permutation_reliance(df, models, "benefit", 20, 11, "seed", features=["a", "b"], units=units)
        found.append({(r["unit"], r["measure"]): r for r in out.collect()})
        assert len(moved) == (0 if room else 1)
    assert found[0].keys() == found[1].keys() and len(found[0]) == 9
    for key, row in found[0].items():
        for name in ("count", "mean", "sd", "minimum", "maximum", "median", "p05", "p95"):
            assert row[name] == pytest.approx(found[1][key][name], abs=1e-9), (key, name)
        assert row["count"] == 11


def test_many_and_few_texts_are_hashed_alike(monkeypatch):
    texts = [b"%d" % i for i in range(3000)]
    for few in (0, 2000):
        monkeypatch.setattr(digests, "_FEW", few)
        tails = digests.Tails(texts)
        for prefix in (b"", b"s", b"se:7:", b"protocol-of-a-long-name:4999:", b"p" * 52):
            assert tails.bits(prefix).tolist() == [int(hashlib.md5(prefix + t).hexdigest()[:13], 16) for t in texts]


def test_poisson_weights_by_leading_bits_are_exact():
    table, bounds = resampling._poisson_weights(), np.array(resampling._poisson_bounds())
    unsure = np.flatnonzero(table == resampling._UNSURE)
    assert 0 < len(unsure) <= len(bounds)
    for cell in [*range(0, 1 << 16, 97), *(unsure - 1).clip(0).tolist()]:
        if cell not in unsure:
            for bits in (cell << 36, (cell << 36) + 12345, ((cell + 1) << 36) - 1):
                assert table[cell] == np.searchsorted(bounds, (bits + 0.5) / (1 << 52), side="right")


def cohort_rows(spark):
    draw = np.random.default_rng(2)
    rows = [(f"s{i:03d}", f"g{i % 5}", ("development", "final", "calibration")[i % 3], *[float(v) for v in draw.integers(0, 50, len(FEATURES))],
             float(draw.normal()), 0.5, 0.5, "success", 0.75, 0.5, 1.0) for i in range(300)]
    return spark.createDataFrame(rows, "sample_id string, issuer string, cohort string, " + "".join(f"{f} double, " for f in FEATURES)
                                 + "benefit double, primary_con double, primary_top double, expert_status string, expert_con double, "
                                 "expert_top double, expert_seconds double")


def test_registered_jobs_run_at_published_sizes(spark, monkeypatch):
    rows, seen = cohort_rows(spark), {}

    def catch(name, function):
        import inspect

        def called(*args, **kwargs):
            bound = inspect.signature(function).bind(*args, **kwargs)
            bound.apply_defaults()
            seen[name] = bound.arguments
            raise InterruptedError
        return called

    monkeypatch.setattr(registered, "training_rows", lambda *args: rows)
    monkeypatch.setattr(registered_learning, "training_rows", lambda *args: rows)
    monkeypatch.setattr(learning, "fold_models", lambda df, features, target, family, params, folds: seen.setdefault("folds", folds))
    for module, name in ((jobs, "develop_routes"), (jobs, "diagnose_routes"), (learning, "permutation_reliance")):
        monkeypatch.setattr(module, name, catch(name, getattr(module, name)))
    for query in (registered.develop_routes, registered.diagnose_routes, registered_learning.permutation_reliance):
        with pytest.raises(InterruptedError):
            query(spark, "unused")
    develop, diagnose = seen["develop_routes"], seen["diagnose_routes"]
    assert (develop["repetitions"], develop["replicates"], develop["outer_folds"], develop["inner_folds"]) == (2000, 5000, 5, 4)
    assert develop["grids"] == {"ridge": learning.RIDGE_GRID, "trees": learning.TREE_GRID}
    assert len(learning.param_grid(learning.TREE_GRID)) == 8 and develop["budgets"] == (0, 60, 120, 180, 240, 360, 600)
    assert (diagnose["family"], diagnose["folds"], diagnose["permutations"], diagnose["replicates"]) == ("trees", 5, 200, 5000)
    assert diagnose["params"] == {"max_depth": 3, "learning_rate": 0.1, "max_iter": 100, "l2_regularization": 1.0}
    assert seen["permutation_reliance"]["repetitions"] == 200 and seen["folds"] == 5


def test_plans_rank_by_both_tuned_families_and_refuse_leaks(spark, monkeypatch):
    rows, tuned = cohort_rows(spark), {}

    def fit_final(df, features, target, group, grids, folds=4, models_dir=None):
        tuned.update(grids)
        for family in grids:
            learning.save_model(spark, learning.fit_ridge(df, features, target, {"alpha": 1.0}), f"{models_dir}/{family}")

    monkeypatch.setattr(registered, "training_rows", lambda *args: rows)
    monkeypatch.setattr(registered, "MAIN", 20)
    monkeypatch.setattr(learning, "fit_final", fit_final)
    counts = {r["method"]: r["count"] for r in registered.plan_routes(spark, "unused").groupBy("method").count().collect()}
    assert counts == dict.fromkeys(
        ("confidence_tail_only", "combined_risk", "ridge_benefit", "trees_benefit", "random_matched_budget"), 20)
    assert tuned == {"ridge": learning.RIDGE_GRID, "trees": learning.TREE_GRID}
    final, calibration = (rows.where(f"cohort = '{c}'").select("sample_id", *FEATURES) for c in ("final", "calibration"))
    with pytest.raises(ValueError, match="1 expert outputs exist before the routes are planned, s001"):
        jobs.plan_routes(final, calibration, {}, 20, "s", rows.where("sample_id = 's001'").select("sample_id"))


def test_random_controls_share_their_routes(spark):
    rows = cohort_rows(spark)
    drawn = routing.random_order(rows, "s", 6, budget=30)
    for control, args in ((resampling.random_summary, ((5, 20),)), (resampling.random_mean_vector, (20,))):
        alone, shared = (sorted(map(tuple, control(rows, *args, 6, "s", drawn=d).collect())) for d in (None, drawn))
        assert [tuple(map(str, r)) for r in alone] == [tuple(map(str, r)) for r in shared]


_ACTIONS = "segment string, sample_id string, action string, action_rank int, available boolean, benefit double, cost long, " \
    "area_num long, area_den long, footprint double"


def test_many_segments_are_solved_side_by_side(spark):
    draw, rows = np.random.default_rng(8), []
    for segment in range(60):
        odd = segment % 20 == 7  # costs too far apart for a table
        for i in range(int(draw.integers(1, 9))):
            name = f"r{i}"
            if draw.random() < 0.9:
                rows.append((f"s{segment}", name, "retain_primary", 0, True, 0.0, 0, 0, 8, 0.0))
            for rank, action, cost in ((1, "core_read_core_write", 20), (2, "halo_read_core_write", 30), (3, "halo_read_halo_write", 30), (4, "whole_table", 70)):
                rows.append((f"s{segment}", name, action, rank, bool(draw.random() < 0.8) or rank == 4, float(draw.integers(1, 4)) / 8, cost + odd * 10_001 * rank,
                             int(draw.integers(1, 3)), (8, 12)[segment % 2], float(draw.integers(0, 2))))
    df = spark.createDataFrame(rows, _ACTIONS)
    budgets = (0, 60, 100, 50_000)
    found = {}
    for records in (4, 32):  # chunks that are merged, and one chunk a segment
        frontier, choices = allocation.search_choices(df, budgets, chunk_records=records)
        found[records] = (sorted(map(tuple, frontier.collect())), sorted(map(tuple, choices.select("segment", "budget", "sample_id", "action_rank").collect())))
    assert found[4] == found[32]
    picked = {}
    for segment, budget, name, rank in found[32][1]:
        picked.setdefault((segment, budget), {})[name] = rank
    menus = {}
    for r in allocation.eligible_actions(df).collect():
        menus.setdefault(r["segment"], []).append((r["sample_id"], r["cost"], r["benefit"], Fraction(r["area_num"], r["area_den"]), r["footprint"],
                                                   int(r["action"] == "whole_table"), str(r["action_rank"])))
    wanted = []
    for segment, options in menus.items():
        states = allocation._plain_states(sorted(options), max(budgets))
        for budget in budgets:
            if inside := [s for s in states if s[0] <= budget]:
                cost, benefit, area, footprint, whole, ranks = inside[-1]
                wanted.append((segment, budget, cost, benefit, str(area), footprint, whole))
                assert picked[segment, budget] == dict(zip(sorted({o[0] for o in options}), map(int, ranks)))
    assert found[32][0] == sorted(wanted)


def test_segments_of_few_records_leave_the_states_that_budgets_need(spark, monkeypatch):
    rows = [(f"s{s}", f"r{i}", action, rank, True, benefit, cost, cost, 8, 0.0) for s in range(5) for i in range(6)
            for action, rank, benefit, cost in (("retain_primary", 0, 0.0, 0), ("core_read_core_write", 1, 0.25 + i / 64, 2), ("whole_table", 4, 0.5, 5))]
    written, real = {}, allocation.pin

    def pin(df, label="pinned"):
        written.setdefault(label, []).append(real(df, label))
        return written[label][-1]

    monkeypatch.setattr(allocation, "pin", pin)
    allocation.search_choices(spark.createDataFrame(rows, _ACTIONS), (0, 4, 9))
    assert written["frontier"][0].count() == 5 * 3

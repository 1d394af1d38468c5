"""Grouped cross-validation, ridge and boosted-tree regressors, and reliance analyses.

Models see median-imputed features; medians are exact and come from training
rows only.  Ridge needs one pass of moments per set of training folds, and only
a 13 x 13 system reaches the driver.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from secondpass.functions import boosting, reliance
from secondpass.functions.scalars import FEATURES
from secondpass.operators import aggregates, routing
from secondpass.operators.order import HOT_GROUP_ROWS, exact_percentiles, with_midrank, with_rank, with_running_total
from secondpass.session import pin

# Parameter grids and the parameters of the difficulty control.
RIDGE_GRID = {"alpha": (0.1, 1.0, 10.0)}
GBT_GRID = {"max_depth": (2, 3), "learning_rate": (0.05, 0.1), "max_iter": (100,)}
DIFFICULTY_PARAMS = {"max_depth": 3, "learning_rate": 0.1, "max_iter": 100, "l2_regularization": 1.0}
# The grid of the published trees; ``GBT_GRID`` lacks the penalty on leaf values.
TREE_GRID = {**GBT_GRID, "l2_regularization": (0.0, 1.0)}
MIN_LEAF_ROWS, MAX_BINS = 20, 255

# Feature groups and the feature subsets of the ablation.
FEATURE_GROUPS = {
    "ocr_reliability": FEATURES[0:5], "predicted_structure": FEATURES[5:9],
    "content_profile": FEATURES[9:11], "geometry": FEATURES[11:13],
}
FEATURE_VARIANTS = {
    "all_features": FEATURES, "ocr_confidence_only": FEATURES[0:3], "ocr_reliability_only": FEATURES[0:5],
    "structure_only": FEATURES[5:9], "content_only": FEATURES[9:11], "geometry_only": FEATURES[11:13],
    "without_ocr_reliability": FEATURES[5:13], "without_structure": FEATURES[0:5] + FEATURES[9:13],
    "without_content": FEATURES[0:9] + FEATURES[11:13], "without_geometry": FEATURES[0:11],
}
PERMUTATIONS = 200  # published repetitions
PERMUTATION_UNITS = {**FEATURE_GROUPS, "ocr_confidence": FEATURES[0:3], **{name: (name,) for name in FEATURES}}


def param_grid(grid: dict[str, Sequence[Any]]) -> list[dict[str, Any]]:
    """All parameter combinations, names in sorted order."""
    names = sorted(grid)
    return [dict(zip(names, values)) for values in itertools.product(*[grid[n] for n in names])]


def param_frame(spark, grid: dict[str, Sequence[Any]]) -> DataFrame:
    """The grid as rows; grids are a handful of literals."""
    names = sorted(grid)
    frame = spark.range(1).select()
    for name in names:
        frame = frame.select("*", F.explode(F.array(*[F.lit(v) for v in grid[name]])).alias(name))
    return frame


# ---------------------------------------------------------------- folds

def _fold_pieces(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, list[int], list[list[int]]]]:
    """Largest group to lightest fold, described per group size instead of per group.

    ``sizes`` lists (rows per group, number of groups), largest first.  Groups of
    one size go round the lightest folds in cycles; a cycle is repeated until the
    next heavier fold joins in.  Returns per size the start of each run of cycles
    and the folds of its cycle.
    """
    loads, result = [0] * folds, []
    for size, count in sizes:
        starts, cycles, done = [], [], 0
        while done < count:
            low = min(loads)
            cycle = sorted((f for f in range(folds) if loads[f] < low + size), key=lambda f: (loads[f], f))
            waiting = [loads[f] for f in range(folds) if f not in cycle]
            rounds = (min(waiting) - low) // size if waiting else -(-(count - done) // len(cycle))
            starts.append(done)
            cycles.append(cycle)
            take = min(rounds * len(cycle), count - done)
            for position, fold in enumerate(cycle):
                loads[fold] += size * (take // len(cycle) + (position < take % len(cycle)))
            done += take
        result.append((size, starts, cycles))
    return result


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """``(group, fold)`` with whole groups in one fold and balanced folds.

    Only the histogram of group sizes is read on the driver; the groups stay
    distributed.  Ties in size are broken by the larger key first.
    """
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    sizes = [(row["_size"], row["n"]) for row in counts.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("_size")).collect()]
    pieces = df.sparkSession.createDataFrame(
        _fold_pieces(sizes, folds), "_size bigint, starts array<bigint>, cycles array<array<int>>")
    ranked = with_rank(counts, [F.desc(group)], ["_size"], "_j")
    placed = ranked.join(pieces, "_size").withColumn("_at", F.expr("size(filter(starts, s -> s <= _j - 1))"))
    fold = "element_at(element_at(cycles, _at), CAST((_j - 1 - element_at(starts, _at)) % size(element_at(cycles, _at)) + 1 AS INT))"
    return placed.select(group, F.expr(fold).alias("fold"))


# ---------------------------------------------------------------- preprocessing

def training_medians(df: DataFrame, features: Sequence[str], folds: int | None = None) -> DataFrame:
    """Exact medians per feature: ``(train_fold, feature, median)``.

    With ``folds`` the rows carry ``fold`` and training set ``f`` is every other
    fold; values are counted once per fold before they are spread over the sets.
    """
    counts = _value_counts(df, features, folds).where("value IS NOT NULL")
    return exact_percentiles(counts, "value", {"median": 0.5}, ["train_fold", "feature"], weight="n")


def _value_counts(df: DataFrame, features: Sequence[str], folds: int | None = None) -> DataFrame:
    """``(train_fold, feature, value, n)``, nulls among the values."""
    key = ["fold"] if folds else []
    counts = df.select(*key, *features).unpivot(key, list(features), "feature", "value").groupBy(
        *key, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    spread = f"filter(sequence(0, {folds - 1}), f -> f <> fold)" if folds else "array(-1)"
    spread_rows = counts.select(F.explode(F.expr(spread)).alias("train_fold"), "feature", "value", "n")
    return spread_rows.groupBy("train_fold", "feature", "value").agg(F.sum("n").alias("n"))


def _medians(df: DataFrame, features: Sequence[str], folds: int | None = None) -> dict[int, dict[str, float]]:
    """Medians on the driver: folds times features numbers."""
    return _collected_medians(training_medians(df, features, folds), features)


def _collected_medians(medians: DataFrame, features: Sequence[str]) -> dict[int, dict[str, float]]:
    found: dict[int, dict[str, float]] = {}
    for row in medians.collect():
        found.setdefault(row["train_fold"], {})[row["feature"]] = row["median"]
    for fold, values in found.items():
        absent = [name for name in features if name not in values]
        if absent:
            raise ValueError(f"training columns without any value: {absent}")
    return found


# ---------------------------------------------------------------- models

@dataclass
class RidgeModel:
    """Linear model on imputed features, coefficients in feature units."""

    features: tuple[str, ...]
    medians: dict[str, float]
    coefficients: list[float]
    intercept: float
    params: dict[str, Any]

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        terms = [f"{w!r}D * coalesce({f}, {float(self.medians[f])!r}D)" for f, w in zip(self.features, self.coefficients)]
        return df.withColumn(name, F.expr(" + ".join([f"{self.intercept!r}D", *terms])))


@dataclass
class TreeModel:
    """Boosted trees on imputed features, binned at ``edges``."""

    features: tuple[str, ...]
    medians: dict[str, float]
    edges: list[list[float]]
    trees: boosting.Trees
    params: dict[str, Any]

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        medians, edges, trees = [float(self.medians[f]) for f in self.features], [np.array(e) for e in self.edges], self.trees

        def score(*columns: pa.Array) -> pa.Array:
            return pa.array(boosting.predict(_binned(columns, medians, edges), trees))

        return df.withColumn(name, F.arrow_udf(score, "double")(*[F.col(f).cast("double") for f in self.features]))


def _binned(columns: Sequence[pa.Array], medians: Sequence[float], edges: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Bins of imputed columns."""
    codes = []
    for column, median, cuts in zip(columns, medians, edges):
        values = column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        codes.append(boosting.bins_of(np.where(np.isnan(values), median, values), cuts))
    return codes


def _moment_columns(features: Sequence[str], target: str) -> list:
    """Sums of centred features, their products and the target."""
    x = [f"_c{i}" for i in range(len(features))]
    sums = [f"sum({a})" for a in x]
    crosses = [f"sum({x[i]} * {x[j]})" for i in range(len(x)) for j in range(i, len(x))]
    with_y = [f"sum({a} * {target})" for a in x]
    return [F.expr(f"{text} AS m{k}") for k, text in enumerate([*sums, *crosses, *with_y])]


def _moments(df: DataFrame, features: Sequence[str], target: str, medians: dict[int, dict[str, float]]) -> dict[int, tuple]:
    """Per training set: n, sum y, feature sums, cross products, products with y.  One pass over the data.

    Without folds the only set is -1.  Features are centred at the medians.
    """
    sets = sorted(medians)
    maps = {i: "CASE train_fold " + " ".join(f"WHEN {s} THEN {float(medians[s][f])!r}D" for s in sets) + " END"
            for i, f in enumerate(features)}
    member = "array(-1)" if sets == [-1] else f"filter(array({', '.join(map(str, sets))}), f -> f <> fold)"
    spread = df.select(*features, target, F.explode(F.expr(member)).alias("train_fold"))
    centred = spread.selectExpr("train_fold", target, *[
        f"coalesce({f} - {maps[i]}, 0D) AS _c{i}" for i, f in enumerate(features)])
    rows = centred.groupBy("train_fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum(target).alias("sy"), *_moment_columns(features, target)).collect()
    result = {}
    size = len(features)
    for row in rows:
        values = [row[f"m{k}"] for k in range(size + size * (size + 1) // 2 + size)]
        sums, rest = np.array(values[:size]), values[size:]
        cross = np.zeros((size, size))
        upper = np.triu_indices(size)
        cross[upper] = rest[:len(upper[0])]
        cross = cross + np.triu(cross, 1).T
        result[row["train_fold"]] = (row["n"], row["sy"], sums, cross, np.array(rest[len(upper[0]):]))
    return result


def _solve_ridge(moments: tuple, features: Sequence[str], medians: dict[str, float], alpha: float) -> RidgeModel:
    """Ridge on standardized features (population deviation, 1 for constant columns), free intercept."""
    n, sy, sums, cross, with_y = moments
    means = sums / n
    covariance = cross - n * np.outer(means, means)
    scale = np.sqrt(np.clip(np.diag(covariance), 0, None) / n)
    scale = np.where(scale > 1e-12, scale, 1.0)
    system = covariance / np.outer(scale, scale) + alpha * np.eye(len(features))
    weights = np.linalg.solve(system, (with_y - means * sy) / scale) / scale
    centre = np.array([medians[f] for f in features]) + means
    return RidgeModel(tuple(features), dict(medians), [float(w) for w in weights],
                      float(sy / n - weights @ centre), {"alpha": alpha})


def fit_ridge(df: DataFrame, features: Sequence[str], target: str, params: dict[str, Any]) -> RidgeModel:
    medians = _medians(df, features)
    return _solve_ridge(_moments(df, features, target, medians)[-1], features, medians[-1], float(params["alpha"]))


def fit_trees(df: DataFrame, features: Sequence[str], target: str, params: dict[str, Any]) -> TreeModel:
    """Squared-loss boosting on binned features."""
    return fit_tree_sets(df, features, target, [params])[-1, _key(params)]


GROUPS_IN_MEMORY = 4_000_000  # combinations of bins that one task trains on, some 400 MB


def fit_tree_sets(df: DataFrame, features: Sequence[str], target: str, settings: Sequence[dict[str, Any]],
                  folds: int | None = None) -> dict[tuple[int, str], TreeModel]:
    """Trees per (held-out fold, parameters); without ``folds`` the only training set is -1.

    Rows are binned and counted per training set in one pass, whatever the number of rounds and settings. Sets
    of a bounded number of combinations are trained in tasks side by side; of larger ones every
    level of every round is counted by all tasks.
    """
    medians, edges = _bin_edges(df, features, folds)
    sets = sorted(medians)
    key = ["fold"] if folds else []
    encoded = df.select(*key, *[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("_y")).mapInArrow(
        _set_encoder(features, medians, edges, bool(folds)), "train_set int, codes binary, y double")
    grouped = pin(encoded.groupBy("train_set", "codes").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"), F.count_if(F.col("y").isNull()).alias("_lost")), "combinations")
    sizes = {row["train_set"]: row for row in grouped.groupBy("train_set").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("_lost").alias("lost")).collect()}
    if any(row["lost"] for row in sizes.values()):
        raise ValueError(f"training rows without {target}")
    widths = {s: [len(e) + 1 for e in edges[s]] for s in sets}
    found: dict[tuple[int, int], boosting.Trees] = {}
    small = [s for s in sets if sizes[s]["groups"] <= GROUPS_IN_MEMORY]
    if small:
        found.update(_trained(grouped, small, widths, settings))
    for s in sets:
        if s not in small:
            for i, params in enumerate(settings):
                found[s, i] = boosting.grow(_Shards(grouped.where(F.col("train_set") == s), widths[s]), params, MIN_LEAF_ROWS)
    return {(s, _key(settings[i])): TreeModel(tuple(features), dict(medians[s]), [e.tolist() for e in edges[s]], trees, dict(settings[i]))
            for (s, i), trees in found.items()}


def _bin_edges(df: DataFrame, features: Sequence[str], folds: int | None) -> tuple[dict[int, dict[str, float]], dict[int, list[np.ndarray]]]:
    """Medians, and per training set the edges between bins of the imputed values: one bin a value, or of about as many rows each."""
    keys = ["train_fold", "feature"]
    counts = pin(_value_counts(df, features, folds), "value-counts")
    known = counts.where("value IS NOT NULL")
    sizes = {(row["train_fold"], row["feature"]): row for row in counts.groupBy(*keys).agg(  # a row per set and feature
        F.count("value").alias("distinct"), F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing")).collect()}
    bounded = max(row["distinct"] for row in sizes.values()) <= HOT_GROUP_ROWS
    medians = _collected_medians(exact_percentiles(known, "value", {"median": 0.5}, keys, bounded=bounded, weight="n"), features)

    def of(each) -> Any:
        pairs = [F.lit(v) for (s, f), row in sizes.items() for v in (f"{s}:{f}", each(s, f, row))]
        return F.create_map(*pairs)[F.concat_ws(":", F.col("train_fold").cast("string"), F.col("feature"))]

    placed = with_running_total(known, ["value"], "n", keys, "_upto", bounded=bounded)
    # Imputed rows are counted at the median.
    before = F.col("_upto") - F.col("n") + F.when(F.col("value") > of(lambda s, f, row: float(medians[s][f])), of(lambda s, f, row: row["missing"])).otherwise(0)
    own = F.when(of(lambda s, f, row: row["distinct"] <= MAX_BINS), F.col("value").cast("double")).otherwise(
        F.floor(before * MAX_BINS / of(lambda s, f, row: row["rows"])).cast("double"))
    bins = placed.groupBy(*keys, own.alias("_bin")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    ranges: dict[tuple[int, str], list[tuple[float, float]]] = {}
    for row in bins.collect():
        ranges.setdefault((row["train_fold"], row["feature"]), []).append((row["low"], row["high"]))
    edges = {}
    for s in medians:
        edges[s] = []
        for f in features:
            held_bins = sorted(ranges[s, f])
            high, low = np.array([b[1] for b in held_bins[:-1]]), np.array([b[0] for b in held_bins[1:]])
            middle = high + (low - high) / 2
            edges[s].append(np.where(middle < low, middle, high))
    return medians, edges


def _set_encoder(features: Sequence[str], medians: dict[int, dict[str, float]], edges: dict[int, list[np.ndarray]], folded: bool):
    middle = {s: [float(medians[s][f]) for f in features] for s in medians}

    def encode(batches):
        for batch in batches:
            columns, target = [batch[f] for f in features], batch["_y"]
            for s in sorted(middle):
                codes = np.stack(_binned(columns, middle[s], edges[s]), axis=1) if len(columns) else None
                y = target
                if folded:
                    others = batch["fold"].to_numpy(zero_copy_only=False) != s
                    codes, y = codes[others], target.filter(pa.array(others))
                flat = pa.array(np.ascontiguousarray(codes).view(f"V{len(columns)}").ravel(), pa.binary(len(columns))).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), s, np.int32)), flat, y], ["train_set", "codes", "y"])

    return encode


def _columns_of(batches: Sequence[pa.RecordBatch], width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bins per column, rows and sums of combinations."""
    codes = [np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint8).reshape(-1, width) for batch in batches]
    table = np.concatenate(codes) if codes else np.zeros((0, width), np.uint8)
    counts, sums = (np.concatenate([batch[c].to_numpy(zero_copy_only=False) for batch in batches]) for c in ("n", "total"))
    return [np.ascontiguousarray(table[:, f]) for f in range(width)], counts, sums


def _trained(grouped: DataFrame, sets: list[int], widths: dict[int, list[int]], settings: Sequence[dict[str, Any]]) -> dict[tuple[int, int], boosting.Trees]:
    """Trees of training sets that fit into a task, by set and number of the setting."""
    shares = max(1, min(len(settings), grouped.sparkSession.sparkContext.defaultParallelism // len(sets)))
    number = F.element_at(F.create_map(*[F.lit(v) for i, s in enumerate(sets) for v in (s, i)]), F.col("train_set"))
    dealt = grouped.where(F.col("train_set").isin(sets)).select(
        "codes", "n", "total", number.alias("set"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    dealt = dealt.repartitionById(len(sets) * shares, F.col("set") * shares + F.col("share")).sortWithinPartitions("codes")
    settings = [dict(p) for p in settings]

    def train(batches):
        batches = [batch for batch in batches if batch.num_rows]
        if not batches:
            return
        at, share = batches[0]["set"][0].as_py(), batches[0]["share"][0].as_py()
        sizes = widths[sets[at]]
        rows = boosting.Rows(*_columns_of(batches, len(sizes)), sizes)
        del batches
        for i in range(share, len(settings), shares):
            trees = boosting.grow(rows, settings[i], MIN_LEAF_ROWS)
            yield pa.RecordBatch.from_pylist([{"set": sets[at], "setting": i, **_tree_row(trees)}], schema=_TREES)

    found = dealt.mapInArrow(train, "set int, setting int, base double, column array<array<int>>, bin array<array<int>>, value array<array<double>>")
    return {(row["set"], row["setting"]): _trees_of(row) for row in found.collect()}  # some hundred numbers a round


_TREES = pa.schema([("set", pa.int32()), ("setting", pa.int32()), ("base", pa.float64()), ("column", pa.list_(pa.list_(pa.int32()))),
                    ("bin", pa.list_(pa.list_(pa.int32()))), ("value", pa.list_(pa.list_(pa.float64())))])


def _tree_row(trees: boosting.Trees) -> dict[str, Any]:
    return {"base": float(trees.base), "column": trees.column.tolist(), "bin": trees.bin.tolist(), "value": trees.value.tolist()}


def _trees_of(row) -> boosting.Trees:
    return boosting.Trees(row["base"], np.array(row["column"], np.int64), np.array(row["bin"], np.int64), np.array(row["value"], np.float64))


class _Shards:
    """Combinations of a training set that stay in their tasks, which work out anew what earlier trees have left of the targets."""

    def __init__(self, grouped: DataFrame, sizes: list[int]) -> None:
        self.grouped, self.sizes, self.base, self.trees = grouped.select("codes", "n", "total"), sizes, 0.0, []

    def totals(self) -> tuple[float, float, float]:
        row = self.grouped.agg(F.sum("n"), F.sum("total"), F.sum(F.col("total") * F.col("total") / F.col("n"))).first()
        return float(row[0]), row[1], row[2]

    def restart(self, base: float) -> None:
        self.base, self.trees = base, []

    def add(self, *tree: np.ndarray) -> None:
        self.trees.append(tree)

    def histograms(self, column: np.ndarray, bin_: np.ndarray, level: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        sizes, nodes = self.sizes, 1 << level
        before = boosting.Trees(self.base, *[np.array([t[i] for t in self.trees]) for i in range(3)])

        def count(batches):
            found, held = np.zeros((2, nodes * sum(sizes))), []

            def settle():
                rows = boosting.Rows(*_columns_of(held, len(sizes)), sizes)
                rows.left = rows.sums - rows.counts * boosting.predict(rows.codes, before)
                for into, parts in zip(found, rows.histograms(column, bin_, level)):
                    into += np.concatenate([part.ravel() for part in parts])
                held.clear()

            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= 262_144:
                    settle()
            if held:
                settle()
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["sums"])

        # One row per task, in the order of tasks.
        total = sum(np.frombuffer(row["sums"]).reshape(2, -1) for row in self.grouped.mapInArrow(count, "sums binary").collect())
        ends = np.cumsum([nodes * size for size in sizes])
        return tuple([part.reshape(nodes, -1) for part in np.split(side, ends[:-1])] for side in total)


FITTERS: dict[str, Callable[..., Any]] = {"ridge": fit_ridge, "trees": fit_trees}


def predict(model: RidgeModel | TreeModel, df: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """``(id, prediction)`` with one row per input row."""
    return model.predict(df).select(id_col, "prediction")


_STORED = "family string, features array<string>, medians map<string,double>, coefficients array<double>, intercept double, params string"


_STORED_TREES = "base double, column array<array<int>>, bin array<array<int>>, value array<array<double>>, edges array<array<double>>"


def save_model(spark: SparkSession, model: RidgeModel | TreeModel, path: str) -> None:
    """Write a model into the folder ``path`` on shared storage, which must not hold one yet: one row, and the trees beside it."""
    linear = isinstance(model, RidgeModel)
    if not linear:
        row = {**_tree_row(model.trees), "edges": model.edges}
        spark.createDataFrame([tuple(row[c] for c in ("base", "column", "bin", "value", "edges"))], _STORED_TREES).coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/trees")
    row = ("ridge" if linear else "trees", list(model.features), {k: float(v) for k, v in model.medians.items()},
           model.coefficients if linear else None, model.intercept if linear else None, _key(model.params))
    # The row comes last: without it there is no model, so a write that broke off is never read.
    spark.createDataFrame([row], _STORED).coalesce(1).write.mode("errorifexists").parquet(f"{path}/model")


def load_model(spark: SparkSession, path: str) -> RidgeModel | TreeModel:
    """The model that ``save_model`` wrote; an incomplete or foreign folder is an error."""
    rows = spark.read.schema(_STORED).parquet(f"{path}/model").collect()
    if len(rows) != 1 or rows[0]["family"] not in FITTERS or set(rows[0]["features"]) != set(rows[0]["medians"]):
        raise ValueError(f"no stored model in {path}")
    row, params = rows[0], json.loads(rows[0]["params"])
    if row["family"] == "trees":
        trees = spark.read.schema(_STORED_TREES).parquet(f"{path}/trees").collect()
        if len(trees) != 1 or len(trees[0]["edges"]) != len(row["features"]):
            raise ValueError(f"stored model in {path} lacks trees")
        return TreeModel(tuple(row["features"]), dict(row["medians"]), [list(e) for e in trees[0]["edges"]], _trees_of(trees[0]), params)
    if len(row["coefficients"] or ()) != len(row["features"]) or row["intercept"] is None:
        raise ValueError(f"stored model in {path} lacks coefficients")
    return RidgeModel(tuple(row["features"]), dict(row["medians"]), list(row["coefficients"]), row["intercept"], params)


def stored(spark: SparkSession, path: str) -> bool:
    """Whether a complete model lies in ``path``."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/model/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def load_models(spark: SparkSession, models_dir: str, names: Sequence[str]) -> dict[str, Any]:
    return {name: load_model(spark, f"{models_dir}/{name}") for name in names}


# ---------------------------------------------------------------- validation

def fold_models(df: DataFrame, features: Sequence[str], target: str, family: str, params: Sequence[dict[str, Any]],
                folds: int) -> dict[tuple[int, str], Any]:
    """A model per (held-out fold, parameters); rows carry ``fold``."""
    if family == "trees":
        return fit_tree_sets(df, features, target, params, folds)
    models: dict[tuple[int, str], Any] = {}
    medians = _medians(df, features, folds)
    moments = _moments(df, features, target, medians)
    for fold, setting in itertools.product(sorted(moments), params):
        models[fold, _key(setting)] = _solve_ridge(moments[fold], features, medians[fold], float(setting["alpha"]))
    return models


def _key(params: dict[str, Any]) -> str:
    """Canonical text of parameters, also the tie-break between settings."""
    return json.dumps(params, sort_keys=True, separators=(",", ":"))


def held_out_predictions(df: DataFrame, models: dict[tuple[int, str], Any], keep: Sequence[str]) -> DataFrame:
    """``(params, fold, *keep, prediction)``: every row predicted by the models that did not see its fold."""
    parts = [
        model.predict(df.where(F.col("fold") == fold)).select(
            F.lit(params).alias("params"), "fold", *[c for c in keep if c != "fold"], "prediction")
        for (fold, params), model in models.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def tune(df: DataFrame, features: Sequence[str], target: str, group: str, family: str,
         grid: dict[str, Sequence[Any]], folds: int) -> tuple[dict[str, Any], DataFrame]:
    """Best parameters by mean validation error, and all ``(params, fold, mse)``."""
    settings = param_grid(grid)
    assigned = pin(df.drop("fold").join(group_folds(df, group, folds), group), "folds")
    models = fold_models(assigned, features, target, family, settings, folds)
    errors = aggregates.mean_squared_error(
        held_out_predictions(assigned, models, [target]), "prediction", target, ["params", "fold"])
    # One row per fold and setting.
    errors = df.sparkSession.createDataFrame(errors.collect(), errors.schema)
    best = errors.groupBy("params").agg(F.avg("mse").alias("mse")).orderBy("mse", "params").first()["params"]
    return next(s for s in settings if _key(s) == best), errors


def nested_predictions(df: DataFrame, features: Sequence[str], target: str, group: str, family: str,
                       grid: dict[str, Sequence[Any]], outer_folds: int = 5, inner_folds: int = 4,
                       id_col: str = "sample_id") -> DataFrame:
    """One out-of-fold prediction per row; parameters are chosen inside each outer training set."""
    rows = pin(df.drop("fold").join(group_folds(df, group, outer_folds), group), "outer")
    parts = []
    for fold in range(outer_folds):
        training = rows.where(F.col("fold") != fold)
        chosen, _ = tune(training, features, target, group, family, grid, inner_folds)
        model = FITTERS[family](training, features, target, chosen)
        parts.append(model.predict(rows.where(F.col("fold") == fold)).select(
            id_col, F.col("fold").alias("outer_fold"), F.lit(_key(chosen)).alias("params"), "prediction"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def fit_final(df: DataFrame, features: Sequence[str], target: str, group: str,
              grids: dict[str, dict[str, Sequence[Any]]], folds: int = 4, models_dir: str | None = None) -> dict[str, Any]:
    """Tuned models of every family on all rows.

    With ``models_dir`` they are stored there by family. A model already stored is used in
    place of a new fit, if it has the features and parameters that tuning chose; else
    it is an error, as results made with it would no longer be those of the data.
    """
    spark = df.sparkSession
    fitted = {}
    for family, grid in grids.items():
        chosen, _ = tune(df, features, target, group, family, grid, folds)
        path = f"{models_dir}/{family}"
        if models_dir is not None and stored(spark, path):
            fitted[family] = load_model(spark, path)
            if fitted[family].features != tuple(features) or fitted[family].params != chosen:
                raise ValueError(f"stored model in {path} has other features or parameters than tuning chose")
            continue
        fitted[family] = FITTERS[family](df, features, target, chosen)
        if models_dir is not None:
            save_model(spark, fitted[family], path)
    return fitted


def fit_difficulty(df: DataFrame, features: Sequence[str] = FEATURES, primary: str = "primary_con",
                   params: dict[str, Any] = DIFFICULTY_PARAMS) -> TreeModel:
    """Control that ranks by predicted difficulty, from primary scores only."""
    return fit_trees(df.withColumn("_difficulty", F.lit(1.0) - F.col(primary)), features, "_difficulty", params)


# ---------------------------------------------------------------- reliance on features

def feature_ablation(training: DataFrame, evaluation: DataFrame, target: str, budget: int, family: str = "trees",
                     params: dict[str, Any] = DIFFICULTY_PARAMS, variants: dict[str, Sequence[str]] = FEATURE_VARIANTS,
                     id_col: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Route quality of models on feature subsets, and the per-record deployed scores of each route."""
    keep = ["primary_con", "primary_top", *routing.expert_columns().values()]
    parts = []
    for name, subset in variants.items():
        model = FITTERS[family](training, list(subset), target, params)
        parts.append(model.predict(evaluation).select(F.lit(name).alias("variant"), id_col, *keep, "prediction"))
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    ranked = pin(with_rank(pin(scored, "variants"), [F.desc("prediction"), F.asc(id_col)], ["variant"]), "ranked")
    metrics = routing.evaluate_rankings(ranked, [budget], ["variant"])
    outcomes = routing.with_outcomes(ranked).selectExpr(
        "variant", id_col, f"_p_con + if(rank <= {int(budget)}, _lift_con, 0D) AS deployed_con")
    return metrics, outcomes


def within_group_permutation(df: DataFrame, group: str, repetitions: int, seed: str, id_col: str = "sample_id") -> DataFrame:
    """``(repetition, id, donor)``: a random permutation of the ids inside every group."""
    ids = df.select(group, id_col)
    receivers = with_rank(ids, [id_col], [group], "position")
    shuffled = ids.select("*", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("repetition"))
    # Bytes sort as their hex digits do and are half as many.
    token = F.unhex(F.sha2(F.concat_ws("|", F.lit(seed), F.col("repetition").cast("string"), F.col(group), F.col(id_col)), 256))
    donors = with_rank(shuffled.withColumn("_token", token), ["_token", id_col], [group, "repetition"], "position")
    donors = donors.select(group, "repetition", "position", F.col(id_col).alias("donor"))
    return receivers.join(donors, [group, "position"]).select("repetition", id_col, "donor")


def permutation_reliance(df: DataFrame, models: dict[tuple[int, str], Any], target: str, budget: int, repetitions: int,
                         seed: str, group: str = "issuer", features: Sequence[str] = FEATURES,
                         units: dict[str, Sequence[str]] = PERMUTATION_UNITS, id_col: str = "sample_id") -> DataFrame:
    """Error increase, rank-correlation drop and route-quality drop per permuted unit.

    Models are not refitted.  Rows carry ``fold``, the score columns and the
    features.  Tasks take some repetitions each and hold all rows as positions in tables of distinct values, so
    nothing is moved per unit; larger tables are joined with their donors once and
    rows times units are sorted as numbers.  One row per ``(unit, measure)`` with summary statistics.
    """
    names, repetitions = list(units), int(repetitions)
    own = list(dict.fromkeys([id_col, group, "fold", target, *features]))
    table = _held_reliance(df, models, target, budget, repetitions, seed, group, features, units, id_col)
    if table is None:
        table = _moved_reliance(df.select(*own), df, models, target, budget, repetitions, seed, group, features, units, id_col)
    table = pin(table, "reliance")
    base = table.where("_k = -1").select(
        F.lit(1).alias("_one"), F.col("mse").alias("_mse"), F.col("spearman").alias("_sp"), F.col("quality").alias("_q"))
    unit = F.element_at(F.array(*[F.lit(name) for name in names]), (F.floor(F.col("_k") / repetitions) + 1).cast("int"))
    drops = table.where("_k >= 0").withColumn("unit", unit).withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one").selectExpr(
        "unit", "stack(3, 'mse_increase', mse - _mse, 'spearman_drop', _sp - spearman, 'quality_drop', _q - quality) AS (measure, value)")
    return aggregates.summary_stats(drops, "value", ["unit", "measure"])


# What a task may hold for permuted rows, about, and the distinct feature values that are sent to the tasks.
RELIANCE_BYTES, _ROW_BYTES, _TABLE_VALUES = 1_200_000_000, 150, 1_000_000


def _held_reliance(df: DataFrame, models: dict[tuple[int, str], Any], target: str, budget: int, repetitions: int, seed: str, group: str,
                   features: Sequence[str], units: dict[str, Sequence[str]], id_col: str) -> DataFrame | None:
    """``(_k, mse, spearman, quality)`` from tasks that hold all rows, or None where those are too many or not complete."""
    folds = [fold for fold, _ in models]
    known = f"{target} IS NOT NULL AND NOT isnan({target}) AND {group} IS NOT NULL AND {id_col} IS NOT NULL AND fold IN ({', '.join(map(str, folds))})"
    total, complete = df.agg(F.count(F.lit(1)), F.count_if(F.expr(known))).first()
    if len(set(folds)) < len(folds) or not total or complete < total or total * _ROW_BYTES > RELIANCE_BYTES:
        return None
    distinct = pin(df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], list(features), "feature", "value").distinct(), "values")
    if distinct.count() > _TABLE_VALUES:
        return None
    values: dict[str, np.ndarray] = {}
    found = distinct.where("value IS NOT NULL AND NOT isnan(value)").toArrow()
    names, numbers = np.array(found["feature"].to_pylist(), dtype=object), found["value"].to_numpy()
    for f in features:
        values[f] = np.append(np.sort(numbers[names == f]), np.nan)  # the last stands for a missing value
    kinds = np.dtype([(f"c{i}", "u1" if len(values[f]) <= 256 else "u2" if len(values[f]) <= 65536 else "u4") for i, f in enumerate(features)])

    def encode(batches):
        for batch in batches:
            table = np.empty(batch.num_rows, kinds)
            for i, f in enumerate(features):
                column = batch[f].to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                table[f"c{i}"] = np.where(np.isnan(column), len(values[f]) - 1, np.searchsorted(values[f][:-1], column))
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(kinds.itemsize), len(table), [None, pa.py_buffer(table.tobytes())])
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("id", "group", "fold", "target", "lift")], codes.cast(pa.binary())],
                                             ["id", "group", "fold", "target", "lift", "codes"])

    shares = max(1, min(repetitions, df.sparkSession.sparkContext.defaultParallelism, RELIANCE_BYTES // (total * _ROW_BYTES)))
    rows = routing.with_outcomes(df).select(
        F.col(id_col).cast("string").cast("binary").alias("id"), F.col(group).cast("string").alias("group"), F.col("fold").cast("int").alias("fold"),
        F.col(target).cast("double").alias("target"), F.col("_lift_con").cast("double").alias("lift"), *[F.col(f).cast("double").alias(f) for f in features])
    coded = rows.mapInArrow(encode, "id binary, group string, fold int, target double, lift double, codes binary")
    dealt = coded.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartitionById(
        shares, F.col("share")).sortWithinPartitions("group", "id")
    scorers = {fold: _scorer(model, features, values) for (fold, _), model in models.items()}
    places = [[list(features).index(f) for f in subset] for subset in units.values()]

    def measure(batches):
        batches = [batch for batch in batches if batch.num_rows]
        if not batches:
            return
        share = batches[0]["share"][0].as_py()
        held = pa.Table.from_batches(batches).combine_chunks()
        del batches
        table = np.frombuffer(held["codes"].chunk(0).cast(pa.binary(kinds.itemsize)).buffers()[1], kinds, held.num_rows)
        columns = [np.ascontiguousarray(table[name]) for name in kinds.names]
        ids, spans = held["id"].chunk(0), held["group"].chunk(0).dictionary_encode()
        at = spans.indices.to_numpy()
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        groups = [(spans.dictionary[int(at[low])].as_py(), low, high) for low, high in zip(cuts[:-1], cuts[1:])]
        target_, lift = held["target"].to_numpy().copy(), held["lift"].to_numpy().copy()
        measures = reliance.Measures(target_, lift, ids, int(budget))
        result = []
        for number, repetition, (mse, spearman, called) in reliance.measured(
                scorers, columns, held["fold"].to_numpy(), groups, ids, measures, places, seed, list(range(share, repetitions, shares))):
            if number >= 0 or share == 0:
                result.append((number * repetitions + repetition if number >= 0 else -1, mse, spearman, called / total))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*result), (pa.int32(), *[pa.float64()] * 3))] if result else [
            pa.array([], t) for t in (pa.int32(), *[pa.float64()] * 3)], ["_k", "mse", "spearman", "quality"])

    # The quality lacks what the primary scores give every ranking alike.
    return dealt.mapInArrow(measure, "_k int, mse double, spearman double, quality double")


def _scorer(model: RidgeModel | TreeModel, features: Sequence[str], values: dict[str, np.ndarray]):
    """The model over positions in the tables of distinct values; features it does not have add nothing."""
    filled = {f: np.where(np.isnan(values[f]), float(model.medians[f]), values[f]) for f in model.features}
    if isinstance(model, RidgeModel):
        weights = dict(zip(model.features, model.coefficients))
        return reliance.Linear(model.intercept, [weights[f] * filled[f] if f in weights else np.zeros(len(values[f])) for f in features])
    edges, order = dict(zip(model.features, model.edges)), np.array([list(features).index(f) for f in model.features])
    bins = [boosting.bins_of(filled[f], np.array(edges[f])) if f in edges else np.zeros(len(values[f]), np.uint8) for f in features]
    trees = model.trees
    return reliance.Boosted(boosting.Trees(trees.base, order[trees.column], trees.bin, trees.value), bins)


def _moved_reliance(rows: DataFrame, df: DataFrame, models: dict[tuple[int, str], Any], target: str, budget: int, repetitions: int, seed: str,
                    group: str, features: Sequence[str], units: dict[str, Sequence[str]], id_col: str) -> DataFrame:
    """``(_k, mse, spearman, quality)`` for tables of any size."""
    # The target is the same under every permutation, so it is ranked once.
    rows = pin(with_midrank(rows, target, name="_observed"), "reliance-rows")
    total = rows.count()
    rows = rows.withColumn("_observed", F.col("_observed") - (total + 1) / 2)
    donors = rows.select(F.col(id_col).alias("donor"), *[F.col(f).alias(f"_d_{f}") for f in features])
    keep = [id_col, "fold", F.col(target).cast("double").alias("_target"), "_observed"]
    moved = within_group_permutation(rows, group, repetitions, seed, id_col).join(donors, "donor").drop("donor")
    moved = pin(moved.join(rows.select(*keep, *features), id_col), "permuted")
    choices = ", ".join(
        f"struct(CAST({n * repetitions} + repetition AS INT) AS _k, "
        + ", ".join(f"{'_d_' + f if f in subset else f} AS v{i}" for i, f in enumerate(features)) + ")"
        for n, subset in enumerate(units.values()))
    # Rows times units exist in the tasks only; what is moved is a prediction and the rank of its target.
    plain = [id_col, "fold", "_target", "_observed"]
    spread = moved.selectExpr(*plain, f"inline(array({choices}))").select(
        "_k", *plain, *[F.col(f"v{i}").alias(f) for i, f in enumerate(features)])
    original = rows.select(F.lit(-1).cast("int").alias("_k"), *keep, *features)
    scored = held_out_predictions(original.unionByName(spread), models, ["_k", *plain]).drop("params", "fold")

    share = 1 - min(1.0, max(budget, 1) / max(total, 1) + _TOP_MARGIN)
    sums = pin(scored.groupBy("_k").agg(
        F.avg((F.col("prediction") - F.col("_target")) ** 2).alias("mse"), (F.min("prediction") == F.max("prediction")).alias("_flat"),
        F.percentile_approx("prediction", share, _TOP_ACCURACY).alias("_cut")), "reliance-sums")
    table = sums.drop("_cut").join(_rank_correlations(scored, rows, total), "_k").join(
        _first_quality(scored, sums.select("_k", "_cut"), df, budget, total, id_col), "_k")
    return table.withColumn("spearman", F.when(~F.col("_flat"), F.col("spearman")))


# Rank error of the sketch for the first rows of a ranking, as one part in so many, and how far beyond them the cut lies.
_TOP_ACCURACY, _TOP_MARGIN = 10_000, 3e-4


def _first_quality(scored: DataFrame, cuts: DataFrame, scores: DataFrame, budget: int, total: int, id_col: str) -> DataFrame:
    """``(_k, quality)``: deployed quality of every ranking of the same rows, of which only those above a cut are ranked.

    The cuts are checked by counting, so the result is exact; a cut that leaves too few rows is given up.
    """
    wanted = min(max(int(budget), 1), total)
    above = scored.join(F.broadcast(cuts), "_k")  # one row per unit and repetition
    first = pin(above.where(F.col("prediction") >= F.col("_cut")).select("_k", id_col, "prediction"), "above-cuts")
    counts = cuts.join(first.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")), "_k", "left")
    short = [row["_k"] for row in counts.where(F.coalesce("_n", F.lit(0)) < wanted).select("_k").collect()]
    if short:
        whole = scored.where(F.col("_k").isin(short)).select("_k", id_col, "prediction")
        first = first.where(~F.col("_k").isin(short)).unionByName(whole)
    drawn = with_rank(first, [F.desc("prediction"), F.asc(id_col)], ["_k"]).where(F.col("rank") <= wanted).drop("prediction")
    return routing.evaluate_drawn(drawn, scores, [budget], ["_k"], id_col=id_col).select("_k", F.col("hybrid_full_set_con").alias("quality"))


def _rank_sums(batches):
    """Per ``_k`` of one sorted range: rows, lowest prediction, and sums over the midranks inside the range."""
    found: dict[int, list] = {}
    held = None  # the last run of equal predictions, which may go on in the next batch

    def add(k, low, counts, observed):
        entry = found.setdefault(k, [low, 0, 0.0, 0.0, 0.0, 0.0])
        rank = entry[1] + np.cumsum(counts) - (counts - 1) / 2.0
        entry[1] += int(counts.sum())
        for place, value in enumerate((counts @ rank, counts @ (rank * rank), observed.sum(), observed @ rank), 2):
            entry[place] += float(value)

    for batch in batches:
        if not batch.num_rows:
            continue
        k, value, observed = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
        counts = np.ones(len(k), np.int64)
        if held is not None:
            k, value = np.concatenate([[held[0]], k]), np.concatenate([[held[1]], value])
            counts, observed = np.concatenate([[held[2]], counts]), np.concatenate([[held[3]], observed])
        same = (k[1:] == k[:-1]) & ((value[1:] == value[:-1]) | (np.isnan(value[1:]) & np.isnan(value[:-1])))
        starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
        k, value, counts, observed = k[starts], value[starts], np.add.reduceat(counts, starts), np.add.reduceat(observed, starts)
        held = (k[-1], value[-1], counts[-1], observed[-1])
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(k[:-1])) + 1, [len(k) - 1]])
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if high > low:
                add(int(k[low]), float(value[low]), counts[low:high], observed[low:high])
    if held is not None:
        add(int(held[0]), float(held[1]), np.array([held[2]]), np.array([held[3]]))
    yield pa.RecordBatch.from_pylist(
        [{"_k": k, "low": e[0], "n": e[1], "m": e[2], "mm": e[3], "o": e[4], "om": e[5]} for k, e in found.items()], schema=_SUMS)


_SUMS = pa.schema([("_k", pa.int32()), ("low", pa.float64()), ("n", pa.int64()), *[(c, pa.float64()) for c in ("m", "mm", "o", "om")]])


def _rank_correlations(scored: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """``(_k, spearman)`` of predictions and the ranked target, whose midranks come centred as ``_observed``.

    One sort by range: equal predictions share a range, ranges give sums over midranks inside
    them, and those are shifted by the rows of earlier ranges.
    """
    ranges = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = scored.select("_k", F.col("prediction").cast("double").alias("prediction"), "_observed").repartitionByRange(
        ranges, "_k", "prediction").sortWithinPartitions("_k", "prediction")
    parts = pin(sorted_.mapInArrow(_rank_sums, "_k int, low double, n long, m double, mm double, o double, om double"), "rank-sums")
    earlier = Window.partitionBy("_k").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    shifted = parts.withColumn("_d", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - (total + 1) / 2)
    moments = shifted.groupBy("_k").agg(
        F.expr("sum(mm + 2 * _d * m + _d * _d * n)").alias("_pp"), F.expr("sum(om + _d * o)").alias("_po")).withColumn("_one", F.lit(1))
    spread = rows.agg(F.sum(F.col("_observed") ** 2).alias("_oo")).withColumn("_one", F.lit(1))
    return moments.join(F.broadcast(spread), "_one").select("_k", F.try_divide("_po", F.sqrt(F.col("_pp") * F.col("_oo"))).alias("spearman"))

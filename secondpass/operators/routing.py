"""Rankings, exact budget cuts and route evaluation.

Routes are long tables ``(method, rank, sample_id)``.  A set of budgets is never
expanded against the rows: every row is filed under the smallest budget that
includes it, sums are taken per file, and the budget totals are added up from
the few per-file sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondpass.functions.scalars import TIE_TOLERANCE
from secondpass.operators.order import descending_key, first_rows, is_large, with_rank, with_running_total
from secondpass.session import pin, spread


def rank_by_score(df: DataFrame, score: str, id_col: str = "sample_id", name: str = "rank") -> DataFrame:
    """Full ranking: score descending, id ascending."""
    return with_rank(df, [F.desc(score), F.asc(id_col)], name=name)


def route_for_budget(df: DataFrame, score: str, budget: int, id_col: str = "sample_id",
                     allowed_budgets: Sequence[int] | None = None) -> DataFrame:
    """The first ``budget`` rows of the ranking, without ranking the rest."""
    if budget < 0:
        raise ValueError("budget must not be negative")
    if allowed_budgets is not None and budget not in allowed_budgets:
        raise ValueError(f"unsupported routing budget: {budget}")
    return first_rows(df, [F.desc(score), F.asc(id_col)], descending_key(score), budget)


def budget_of_fraction(df: DataFrame, fraction: float) -> DataFrame:
    """One row ``(population, budget)`` with the half-even rounded share of the rows."""
    return df.agg(F.count(F.lit(1)).alias("population")).withColumn(
        "budget", F.bround(F.col("population") * F.lit(float(fraction)), 0).cast("long")
    )


def route_fraction(df: DataFrame, score: str, fraction: float, id_col: str = "sample_id") -> DataFrame:
    """Ranked rows up to the half-even rounded share of the population."""
    budget = budget_of_fraction(df, fraction).first()["budget"]
    return rank_by_score(route_for_budget(df, score, budget, id_col), score, id_col)


def rankings(df: DataFrame, scores: dict[str, str], id_col: str = "sample_id", keep: Sequence[str] = ()) -> DataFrame:
    """Several rankings of the same rows in long form: ``(method, rank, id, score)``."""
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).cast("double").alias("score")) for m, c in scores.items()])
    long = df.select(id_col, *keep, F.inline(pairs))
    return with_rank(long, [F.desc("score"), F.asc(id_col)], ["method"]).select("method", "rank", id_col, *keep, "score")


def random_key(seed: str, repetition: Column, id_col: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), repetition.cast("string"), F.col(id_col)), 256)


_PREFIX = 13  # leading hex digits of a random key that a double holds exactly


def _prefix(key: Column) -> Column:
    return F.conv(F.substring(key, 1, _PREFIX), 16, 10).cast("double")


def _bound(budget: int, total: int) -> float:
    """Keys below it are more than ``budget`` of ``total`` uniform ones, but for one case in a thousand million."""
    return min(1.0, (budget + 6 * budget**0.5 + 20) / max(total, 1)) * 16.0**_PREFIX


def _below(key: Column, bound: float) -> Column:
    """Whether the leading digits of a key are a number below ``bound``; digits are compared as text, as parsing them costs more than the hash."""
    if bound >= 16.0**_PREFIX:
        return F.lit(True)
    return key < F.lit(f"{math.ceil(bound):0{_PREFIX}x}")


def random_order(df: DataFrame, seed: str, repetitions: int, id_col: str = "sample_id",
                 keep: Sequence[str] = (), budget: int | None = None) -> DataFrame:
    """Deterministic random ranking per repetition, ordered by SHA-256 of ``seed:repetition:id``.

    With a ``budget`` only its first ranks are returned, and only rows that can be among them are
    moved: those whose key lies below a bound that leaves more than the budget in every repetition
    but for rare ones. Repetitions with fewer are found by counting and taken whole.
    """
    # The work is rows times repetitions, so the rows are dealt to all tasks first.
    expanded = spread(df.select(id_col, *keep), id_col).select(id_col, *keep, F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("repetition"))
    keyed = expanded.withColumn("_key", random_key(seed, F.col("repetition"), id_col))
    if budget is None:
        # Bytes sort as their hex digits do and are half as long; the key is not written with the sorted rows.
        return with_rank(keyed.withColumn("_key", F.unhex("_key")), ["_key", id_col], ["repetition"], drop=["_key"])
    total = df.count()
    kept = pin(keyed.where(_below(F.col("_key"), _bound(budget, total))), "random-keys")
    # One row per repetition, a parameter of the job.
    enough = {r["repetition"] for r in kept.groupBy("repetition").count().where(F.col("count") >= min(budget, total)).collect()}
    short = [r for r in range(repetitions) if r not in enough]
    if short:
        kept = kept.where(~F.col("repetition").isin(short)).unionByName(keyed.where(F.col("repetition").isin(short)))
    return with_rank(kept, ["_key", id_col], ["repetition"]).where(F.col("rank") <= budget).drop("_key")


def random_route(df: DataFrame, seed: str, repetition: int, budget: int, id_col: str = "sample_id") -> DataFrame:
    """One matched-budget random route."""
    keyed = df.select(id_col).withColumn("_key", random_key(seed, F.lit(repetition), id_col))
    return first_rows(keyed, ["_key", id_col], _prefix(F.col("_key")), budget).select(id_col)


def combine_selections(left: DataFrame, right: DataFrame, how: str, id_col: str = "sample_id") -> DataFrame:
    """Intersection, difference or union of two selections of ids."""
    a, b = left.select(id_col), right.select(id_col)
    if how == "intersect":
        return a.intersect(b)
    if how == "except":
        return a.exceptAll(b).distinct()
    if how == "union":
        return a.union(b).distinct()
    raise ValueError(f"unknown set operation: {how}")


def dedupe_route(route: DataFrame, population: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """First occurrence of every id that belongs to the population, in route order."""
    firsts = route.groupBy(id_col).agg(F.min("position").alias("position"))
    return firsts.join(population.select(id_col).distinct(), id_col, "left_semi")


# ---------------------------------------------------------------- evaluation

SCORE_SUMS = [f"{who}_{what}" for who in ("p", "e", "oracle") for what in ("con", "top")]
CALL_PARTS = ("calls", "replaced", "improved", "harmed", "gain_sum", "loss_sum", "lift_con", "lift_top", "seconds")


def expert_columns(prefix: str = "expert") -> dict[str, str]:
    return {name: f"{prefix}_{name}" for name in ("status", "con", "top", "seconds")}


def _finite_sql(column: str) -> str:
    return f"CASE WHEN isnan({column}) OR abs({column}) = double('inf') THEN NULL ELSE {column} END"


def with_outcomes(df: DataFrame, expert: str = "expert") -> DataFrame:
    """Add the per-row quantities that route evaluation sums up.

    A missing score counts as 0 and a missing label as no benefit, as in the
    stored records.  ``_lift_*`` is what a call changes: nothing when it fails.
    """
    def or_zero(column: str) -> str:
        return f"coalesce({_finite_sql(column)}, 0D)"

    finite = df.selectExpr(
        "*",
        f"coalesce({expert}_status = 'success', false) AS _ok",
        f"coalesce({expert}_con - primary_con, 0D) AS _raw_delta",
        f"{or_zero('primary_con')} AS _p_con", f"{or_zero('primary_top')} AS _p_top",
        f"{or_zero(f'{expert}_con')} AS _e_con", f"{or_zero(f'{expert}_top')} AS _e_top",
        f"{or_zero(f'{expert}_seconds')} AS _seconds",
    )
    return finite.selectExpr(
        "*",
        "if(_ok, _raw_delta, 0D) AS _delta",
        "if(_ok, _e_con - _p_con, 0D) AS _lift_con", "if(_ok, _e_top - _p_top, 0D) AS _lift_top",
        "greatest(_p_con, _e_con) AS _oracle_con", "greatest(_p_top, _e_top) AS _oracle_top",
    )


def _call_parts() -> list[Column]:
    """Additive totals over called rows."""
    better, worse = f"_ok AND _delta > {TIE_TOLERANCE}", f"_ok AND _delta < -{TIE_TOLERANCE}"
    return [F.expr(text) for text in (
        "count(1) AS calls", "count_if(_ok) AS replaced",
        f"count_if({better}) AS improved", f"count_if({worse}) AS harmed",
        f"sum(if({better}, _delta, 0D)) AS gain_sum", f"sum(if({worse}, -_delta, 0D)) AS loss_sum",
        "sum(_lift_con) AS lift_con", "sum(_lift_top) AS lift_top", "sum(_seconds) AS seconds",
    )]


def _population_parts() -> list[Column]:
    return [F.expr("count(1) AS n"), *[F.expr(f"sum(_{name}) AS {name}") for name in SCORE_SUMS]]


def finish_metrics(totals: DataFrame, keys: Sequence[str], primary_cost: float = 0.0) -> DataFrame:
    """Turn additive totals into the reported route metrics."""
    columns = {
        "expert_call_count": "calls",
        "expert_call_rate": "calls / n",
        "successful_expert_return_count": "replaced",
        "failed_expert_return_count": "calls - replaced",
        "replacement_count": "replaced",
        "replacement_rate": "replaced / n",
        "improved_replacement_count": "improved",
        "harmed_replacement_count": "harmed",
        "unchanged_replacement_count": "replaced - improved - harmed",
        "harmed_replacement_rate": "if(replaced <> 0, harmed / replaced, NULL)",
        "harmed_replacement_rate_reason": "if(replaced = 0, 'no replacements', NULL)",
        "mean_gain_on_improvements": "if(improved <> 0, gain_sum / improved, NULL)",
        "mean_loss_on_harms": "if(harmed <> 0, loss_sum / harmed, NULL)",
    }
    for what in ("con", "top"):
        room = f"(oracle_{what} - p_{what})"
        columns[f"primary_full_set_{what}"] = f"p_{what} / n"
        columns[f"expert_only_full_set_{what}"] = f"e_{what} / n"
        columns[f"hybrid_full_set_{what}"] = f"(p_{what} + lift_{what}) / n"
        columns[f"oracle_full_set_{what}"] = f"oracle_{what} / n"
        columns[f"gain_over_always_primary_{what}"] = f"lift_{what} / n"
        columns[f"fraction_oracle_gain_recovered_{what}"] = f"if({room} <> 0, lift_{what} / {room}, NULL)"
    cost = f"{float(primary_cost)}D"
    columns["primary_cost_seconds"] = cost
    columns["expert_cost_seconds"] = "seconds"
    columns["total_cost_seconds"] = f"{cost} + seconds"
    columns["mean_cost_per_sample_seconds"] = f"({cost} + seconds) / n"
    return totals.selectExpr(*keys, *[f"{text} AS {name}" for name, text in columns.items()])


def evaluate_routes(scores: DataFrame, routes: DataFrame, keys: Sequence[str] = ("method", "budget"),
                    expert: str = "expert", id_col: str = "sample_id", primary_cost: float = 0.0) -> DataFrame:
    """Metrics of arbitrary routes ``(*keys, id)`` against one population of scores.

    A route without rows does not appear; ``evaluate_rankings`` reports budget 0.
    """
    outcomes = with_outcomes(scores, expert)
    calls = routes.select(*keys, id_col).dropDuplicates([*keys, id_col]).join(outcomes, id_col)
    parts = calls.groupBy(*keys).agg(*_call_parts()).withColumn("_one", F.lit(1))
    totals = outcomes.agg(*_population_parts()).withColumn("_one", F.lit(1))  # exactly one row
    return finish_metrics(parts.join(F.broadcast(totals), "_one"), keys, primary_cost)


def _file_sql(budgets: Sequence[int]) -> str:
    """Smallest budget that includes ``rank``; -1 for ranks beyond the largest one."""
    cases = " ".join(f"WHEN rank <= {int(b)} THEN {int(b)}L" for b in sorted(set(budgets)))
    return f"CASE {cases} ELSE -1L END"


def _budget_totals(ranked: DataFrame, budgets: Sequence[int], keys: Sequence[str], expert: str) -> DataFrame:
    filed = with_outcomes(ranked, expert).withColumn("_file", F.expr(_file_sql(budgets)))
    per_file = filed.groupBy(*keys, "_file").agg(*_call_parts(), *_population_parts())
    wanted = ", ".join(f"{int(b)}L" for b in sorted(set(budgets)))
    grid = per_file.withColumn("budget", F.expr(f"explode(array({wanted}))"))
    inside = "_file >= 0 AND _file <= budget"
    return grid.groupBy(*keys, "budget").agg(
        *[F.expr(f"sum(if({inside}, {part}, 0)) AS {part}") for part in CALL_PARTS],
        *[F.expr(f"sum({part}) AS {part}") for part in ("n", *SCORE_SUMS)],
    )


def evaluate_rankings(ranked: DataFrame, budgets: Sequence[int], keys: Sequence[str] = ("method",),
                      expert: str = "expert", primary_cost: float = 0.0) -> DataFrame:
    """Metrics of every ranking at every budget from one pass over ranked score rows.

    ``ranked`` holds whole rankings: each key covers the complete population.
    """
    return finish_metrics(_budget_totals(ranked, budgets, keys, expert), [*keys, "budget"], primary_cost)


def evaluate_drawn(drawn: DataFrame, scores: DataFrame, budgets: Sequence[int], keys: Sequence[str], expert: str = "expert",
                   id_col: str = "sample_id", primary_cost: float = 0.0) -> DataFrame:
    """Metrics of rankings of which only the first rows ``(*keys, rank, id)`` are given, over one population of scores."""
    outcomes = with_outcomes(scores, expert)
    filed = drawn.select(*keys, "rank", id_col).join(outcomes, id_col).withColumn("_file", F.expr(_file_sql(budgets)))
    per_file = filed.groupBy(*keys, "_file").agg(*_call_parts())
    wanted = ", ".join(f"{int(b)}L" for b in sorted(set(budgets)))
    inside = "_file >= 0 AND _file <= budget"
    calls = per_file.withColumn("budget", F.expr(f"explode(array({wanted}))")).groupBy(*keys, "budget").agg(
        *[F.expr(f"sum(if({inside}, {part}, 0)) AS {part}") for part in CALL_PARTS]).withColumn("_one", F.lit(1))
    totals = outcomes.agg(*_population_parts()).withColumn("_one", F.lit(1))  # exactly one row
    return finish_metrics(calls.join(F.broadcast(totals), "_one"), [*keys, "budget"], primary_cost)


def quality_budget_curve(scores: DataFrame, methods: dict[str, str], budgets: Sequence[int],
                         expert: str = "expert", id_col: str = "sample_id", primary_cost: float = 0.0) -> DataFrame:
    """All rankings at all budgets, plus the row that never calls the expert at each budget."""
    keep = ["primary_con", "primary_top", *expert_columns(expert).values()]
    totals = _budget_totals(rankings(scores, methods, id_col, keep), budgets, ("method",), expert)
    # The row without calls has the population totals of any method and empty call totals.
    first = next(iter(methods))
    both = totals.withColumn("_never", F.expr(f"explode(if(method = '{first}', array(false, true), array(false)))"))
    rows = both.selectExpr(
        "if(_never, 'always_primary', method) AS method", "budget",
        *[f"if(_never, 0, {part}) AS {part}" for part in CALL_PARTS], "n", *SCORE_SUMS,
    )
    return finish_metrics(rows, ["method", "budget"], primary_cost)


def figure_rows(curve: DataFrame, intervals: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Chart rows: label, call share, gain, and the interval where one is known.

    Rows whose bounds are out of order get a null interval and ``interval_ok`` false.
    """
    names = F.create_map(*[F.lit(part) for pair in labels.items() for part in pair])
    joined = curve.where(F.col("method").isin(list(labels))).join(intervals, ["method", "budget"], "left")
    ordered = F.coalesce(F.col("lower") <= F.col("upper"), F.lit(True))
    gain = F.coalesce(
        F.col("gain_over_always_primary_con"), F.col("hybrid_full_set_con") - F.col("primary_full_set_con")
    )
    return joined.select(
        F.element_at(names, F.col("method")).alias("label"), "method", "budget",
        F.col("expert_call_rate").alias("call_rate"), F.col("hybrid_full_set_con").alias("quality"),
        gain.alias("gain"),
        F.when(ordered, F.col("lower")).alias("lower"), F.when(ordered, F.col("upper")).alias("upper"),
        ordered.alias("interval_ok"),
    )


# ---------------------------------------------------------------- risk

# Calibration risks and the features they come from.
RISK_SOURCES = {
    "confidence_tail_risk": "ocr_confidence_p10",
    "unmatched_ocr_ratio": "unmatched_ocr_ratio",
    "empty_cell_ratio": "empty_cell_ratio",
}
ACTIVE_RISKS = ("confidence_tail_risk", "unmatched_ocr_ratio")
_FEW_VALUES = 200_000  # percentiles that are broadcast, some 10 MB


def with_risks(features: DataFrame) -> DataFrame:
    """Risk values per record; a missing feature is the highest risk, 1."""
    def risk(name: str, source: str) -> Column:
        value = F.col(source)
        value = F.lit(1.0) - value if name == "confidence_tail_risk" else value
        return F.coalesce(value, F.lit(1.0)).alias(name)

    risks = [risk(name, source) for name, source in RISK_SOURCES.items()]
    others = [c for c in features.columns if c not in RISK_SOURCES]
    return features.select(*others, *risks)


def risk_populations(calibration: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Long calibration values ``(risk, value)``."""
    risks = with_risks(calibration.select(id_col, *RISK_SOURCES.values()))
    return risks.unpivot([id_col], list(RISK_SOURCES), "risk", "value")


def midrank_percentile(values: DataFrame, population: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Share of the population below each value, ties counted half: ``(*keys, value, percentile)``.

    Both sides are reduced to distinct values with counts first.  The two sides
    are then merged in value order and the running population count read off,
    so neither side has to fit anywhere as a whole.
    """
    keys = list(keys)
    known = population.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_here"))
    wanted = values.select(*keys, value).distinct().withColumn("_wanted", F.lit(1))
    merged = known.join(wanted, [*keys, value], "full_outer").withColumn("_here", F.coalesce("_here", F.lit(0)))
    running = with_running_total(merged, [value], "_here", keys, "_upto")
    sizes = known.groupBy(*keys).agg(F.sum("_here").alias("_size"))
    percent = (F.col("_upto") - F.col("_here") + 0.5 * F.col("_here")) / F.col("_size")
    return running.where(F.col("_wanted") == 1).join(sizes, keys).select(*keys, value, percent.alias("percentile"))


def combined_risk(records: DataFrame, calibration: DataFrame, active: Sequence[str] = ACTIVE_RISKS,
                  id_col: str = "sample_id") -> DataFrame:
    """Risk values, their calibration percentiles and the highest active percentile per record."""
    risks = with_risks(records.select(id_col, *RISK_SOURCES.values()))
    long = risks.unpivot([id_col], list(RISK_SOURCES), "risk", "value")
    percentiles = pin(midrank_percentile(long, risk_populations(calibration, id_col), ["risk"]), "percentiles")
    if not is_large(percentiles, _FEW_VALUES):
        # Few values are shared by very many records each: records do not move to meet them.
        percentiles = F.broadcast(percentiles)
    wide = (
        long.join(percentiles, ["risk", "value"])
        .groupBy(id_col)
        .agg(*[
            F.max(F.when(F.col("risk") == name, F.col(source))).alias(alias)
            for name in RISK_SOURCES
            for source, alias in (("value", name), ("percentile", f"{name}_percentile"))
        ])
    )
    return wide.withColumn("combined_risk", F.greatest(*[F.col(f"{name}_percentile") for name in active]))


def risk_rankings(risk_records: DataFrame, id_col: str = "sample_id") -> DataFrame:
    return rankings(
        risk_records,
        {"confidence_tail_only": "confidence_tail_risk_percentile", "combined_risk": "combined_risk"},
        id_col,
    )


def random_position(random_means: DataFrame, target: float | DataFrame, value: str = "hybrid_con") -> DataFrame:
    """Where a target sits among the means of random routes (one row per repetition)."""
    marked = random_means.withColumn("_one", F.lit(1))
    if isinstance(target, DataFrame):  # one row with column ``target``
        marked = marked.join(F.broadcast(target.select(F.lit(1).alias("_one"), "target")), "_one")
    else:
        marked = marked.withColumn("target", F.lit(float(target)))
    # Rows are repetitions, a parameter of the job, so the built-in percentile is safe.
    return marked.agg(
        F.first("target").alias("target"),
        # Sums over different partitions differ in their last bits; equal means must stay equal.
        F.avg((F.round(value, 12) <= F.round("target", 12)).cast("double")).alias("share_at_or_below"),
        F.avg(value).alias("mean"),
        F.percentile(value, F.lit(0.5)).alias("median"),
        F.percentile(value, F.lit(0.025)).alias("lower"),
        F.percentile(value, F.lit(0.975)).alias("upper"),
    )


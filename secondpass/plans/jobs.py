"""Composite jobs: what a user calls, built from the operators only."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondpass.functions.scalars import FEATURES
from secondpass.operators import (
    aggregates,
    allocation,
    expectations,
    learning,
    records,
    resampling,
    routing,
    scoring,
    spatial,
    tables,
)
from secondpass.operators.order import with_rank
from secondpass.session import pin, spread
from secondpass.sources import payloads


def deployed_vectors(ranked: DataFrame, budget: int, expert: str = "expert", id_col: str = "sample_id") -> DataFrame:
    """``(method, id, con, top)``: score of every record under every ranking cut at ``budget``."""
    return routing.with_outcomes(ranked, expert).selectExpr(
        "method", id_col, f"_p_con + if(rank <= {int(budget)}, _lift_con, 0D) AS con",
        f"_p_top + if(rank <= {int(budget)}, _lift_top, 0D) AS top")


def contrasts(vectors: DataFrame, pairs: dict[str, tuple[str, str]], seed: str, replicates: int,
              id_col: str = "sample_id", method: str = "draws") -> DataFrame:
    """Paired bootstrap interval per named pair of methods."""
    vectors = pin(vectors, "vectors")
    parts = []
    for name, (left, right) in pairs.items():
        a = vectors.where(F.col("method") == left).select(id_col, F.col("con").alias("_left"))
        b = vectors.where(F.col("method") == right).select(id_col, F.col("con").alias("_right"))
        interval = resampling.paired_bootstrap(a.join(b, id_col), "_left", "_right", f"{seed}:{name}", replicates, id_col, method)
        parts.append(interval.withColumn("contrast", F.lit(name)))
    return aggregates.all_cohorts(*parts)


def feature_contrasts(outcomes: DataFrame, seed: str, replicates: int, id_col: str = "sample_id") -> DataFrame:
    """The full feature vector against three reduced ones, on per-record deployed scores of the ablation."""
    vectors = outcomes.select(F.col("variant").alias("method"), id_col, F.col("deployed_con").alias("con"))
    others = ("ocr_confidence_only", "ocr_reliability_only", "without_ocr_reliability")
    return contrasts(vectors, {f"all_features_minus_{o}": ("all_features", o) for o in others}, seed, replicates, id_col)


def develop_routes(rows: DataFrame, calibration: DataFrame, budgets: Sequence[int], main_budget: int, seed: str,
                   grids: dict[str, dict[str, Sequence[Any]]], repetitions: int = 2000, replicates: int = 5000,
                   outer_folds: int = 5, inner_folds: int = 4) -> dict[str, DataFrame]:
    """Out-of-fold rankings, every method at every budget, random control, contrasts, standalone summaries.

    ``rows`` holds scores, ``benefit``, ``issuer`` and the features of the
    development cohort; ``calibration`` holds the features of its own cohort.
    """
    rows = pin(rows, "development")
    risks = routing.combined_risk(rows, calibration).select(
        "sample_id", F.col("confidence_tail_risk_percentile").alias("confidence_tail_only"), "combined_risk")
    table = rows.select("sample_id", "benefit", "primary_con", "primary_top", "primary_status",
                        *routing.expert_columns().values()).join(risks, "sample_id")
    methods = {"confidence_tail_only": "confidence_tail_only", "combined_risk": "combined_risk", "oracle": "benefit"}
    for family, grid in grids.items():
        name = f"{family}_benefit"
        oof = learning.nested_predictions(rows, FEATURES, "benefit", "issuer", family, grid, outer_folds, inner_folds)
        table = table.join(oof.select("sample_id", F.col("prediction").alias(name)), "sample_id")
        methods[name] = name
    table = pin(table, "methods")
    keep = ["primary_con", "primary_top", *routing.expert_columns().values()]
    ranked = pin(routing.rankings(table, methods, keep=keep), "rankings")
    vectors = deployed_vectors(ranked, main_budget).select("method", "sample_id", "con")
    never = table.selectExpr("'always_primary' AS method", "sample_id", "primary_con AS con")
    # Both random controls are cuts of the same routes.
    drawn = pin(routing.random_order(table, seed, repetitions, budget=max(1, main_budget, *budgets)), "random-routes")
    random = resampling.random_mean_vector(table, main_budget, repetitions, seed, drawn=drawn).selectExpr(
        "'random' AS method", "sample_id", "mean_con AS con")
    best = f"{list(grids)[-1]}_benefit"
    pairs = {f"{best}_minus_{o}": (best, o) for o in ("always_primary", "random", "confidence_tail_only", "combined_risk")}
    for family in list(grids)[:-1]:
        pairs[f"{best}_minus_{family}_benefit"] = (best, f"{family}_benefit")
        pairs[f"{family}_benefit_minus_always_primary"] = (f"{family}_benefit", "always_primary")
    return {
        "rankings": ranked.select("method", "rank", "sample_id", "score"),
        "curve": routing.quality_budget_curve(table, methods, budgets),
        "random": resampling.random_summary(table, budgets, repetitions, seed, drawn=drawn),
        "contrasts": contrasts(aggregates.all_cohorts(vectors, never, random), pairs, seed, replicates),
        "standalone": aggregates.all_cohorts(*[
            aggregates.standalone_summary(table, system).withColumn("system", F.lit(system)) for system in ("primary", "expert")]),
        "agreement": aggregates.spearman(table, best, "benefit"),
    }


def plan_routes(features: DataFrame, calibration: DataFrame, models: dict[str, Any], main_budget: int, seed: str,
                existing_outputs: DataFrame | None = None) -> dict[str, DataFrame]:
    """Label-free plan of a held-out cohort: rankings, main routes, one random route.

    With ``existing_outputs`` the plan is refused where expert outputs already exist
    for the cohort.
    """
    features = pin(features, "cohort")
    if existing_outputs is not None:
        leaks = expectations.check_no_leak(existing_outputs, features).first()
        if leaks["violations"]:
            raise ValueError(f"{leaks['violations']} expert outputs exist before the routes are planned, {leaks['sample_key']} among them")
    table = routing.combined_risk(features, calibration).select(
        "sample_id", F.col("confidence_tail_risk_percentile").alias("confidence_tail_only"), "combined_risk")
    methods = {"confidence_tail_only": "confidence_tail_only", "combined_risk": "combined_risk"}
    for name, model in models.items():
        table = table.join(learning.predict(model, features).withColumnRenamed("prediction", name), "sample_id")
        methods[name] = name
    table = pin(table, "predictions")
    ranked = pin(routing.rankings(table, methods), "plan")
    routes = ranked.where(F.col("rank") <= int(main_budget)).select("method", "rank", "sample_id")
    chosen = with_rank(routing.random_route(table, seed, 0, main_budget), ["sample_id"])
    random = chosen.select(F.lit("random_matched_budget").alias("method"), "rank", "sample_id")
    return {"rankings": ranked, "routes": routes.unionByName(random)}


def report_routes(scores: DataFrame, plan: DataFrame, budgets: Sequence[int], main_budget: int, seed: str, main_method: str,
                  experts: Sequence[str] = ("expert", "expert_b"), repetitions: int = 2000, replicates: int = 5000) -> dict[str, DataFrame]:
    """Held-out results of a stored plan ``(method, rank, sample_id)`` for several experts.

    The first expert is the one the rankings were made for; the ranking of
    ``main_method`` is transferred unchanged to the others.
    """
    scores = pin(scores, "scores")
    plan = plan.select("method", "rank", "sample_id")
    curves, standalone, randoms, positions, timing = [], [], [], [], []
    intervals = []
    for i, expert in enumerate(experts):
        wanted = plan if i == 0 else plan.where(F.col("method") == main_method)
        ranked = pin(wanted.join(scores, "sample_id"), "ranked")
        curve = routing.evaluate_rankings(ranked, budgets, ("method",), expert)
        curves.append(curve.withColumn("expert", F.lit(expert)))
        standalone.append(aggregates.standalone_summary(scores, expert).withColumn("system", F.lit(expert)))
        means = pin(resampling.random_means(scores, budgets, repetitions, seed, expert), "random")
        randoms.append(means.groupBy("budget").agg(
            F.avg("hybrid_full_set_con").alias("mean_con"), F.percentile("hybrid_full_set_con", F.lit(0.025)).alias("lower_con"),
            F.percentile("hybrid_full_set_con", F.lit(0.975)).alias("upper_con")).withColumn("expert", F.lit(expert)))
        target = curve.where((F.col("method") == main_method) & (F.col("budget") == int(main_budget))).select(
            F.col("hybrid_full_set_con").alias("target"))
        positions.append(routing.random_position(
            means.where(F.col("budget") == int(main_budget)), target, "hybrid_full_set_con").withColumn("expert", F.lit(expert)))
        vectors = deployed_vectors(ranked, main_budget, expert).select("method", "sample_id", "con")
        never = scores.selectExpr("'always_primary' AS method", "sample_id", "primary_con AS con")
        random = resampling.random_mean_vector(scores, main_budget, repetitions, seed, expert).selectExpr(
            "'random' AS method", "sample_id", "mean_con AS con")
        rivals = ["always_primary", "random"]
        if i == 0:
            rivals += [m["method"] for m in plan.select("method").distinct().orderBy("method").collect() if m["method"] != main_method]
        intervals.append(contrasts(
            aggregates.all_cohorts(vectors, never, random), {f"{main_method}_minus_{r}": (main_method, r) for r in rivals},
            seed, replicates).withColumn("expert", F.lit(expert)))
        route = ranked.where((F.col("method") == main_method) & (F.col("rank") <= int(main_budget)))
        timing.append(aggregates.timing_totals(scores, route, expert).withColumn("expert", F.lit(expert)))
    standalone.append(aggregates.standalone_summary(scores, "primary").withColumn("system", F.lit("primary")))
    return {
        "curves": aggregates.all_cohorts(*curves), "standalone": aggregates.all_cohorts(*standalone),
        "random": aggregates.all_cohorts(*randoms), "random_position": aggregates.all_cohorts(*positions),
        "contrasts": aggregates.all_cohorts(*intervals), "timing": aggregates.all_cohorts(*timing),
    }


def evaluate_external(pages: DataFrame, detections: DataFrame, expert_outputs: DataFrame, fraction: float, seed: str,
                      replicates: int = 5000) -> dict[str, DataFrame]:
    """External study: align page tables with detections, replace, score, clustered interval, funnel.

    ``pages``: report_id, page_index, markup.  ``detections``: report_id,
    page_index, table_id, score, cells (array).  ``expert_outputs``: table_id, raw text.
    """
    found = pin(tables.top_level_tables(pages, ["report_id", "page_index"], "markup"), "pages")
    detections = pin(detections, "detections")
    route = pin(routing.route_fraction(detections.select("table_id", "score"), "score", fraction, "table_id"), "route")
    aligned = records.align_one_to_one(found, detections)
    blocks = aligned.select("report_id", "page_index", "table_id", F.element_at("blocks", 1).alias("block"))
    reference = pin(tables.parse_table_records(
        spread(blocks, "table_id"), ["report_id", "page_index", "table_id"], "block", "html", strict=False), "reference")
    # Filtered once written: a filter on what was parsed would be moved below the parser and parse again.
    reference = reference.where("status = 'success'")
    calls = expert_outputs.join(route.select("table_id"), "table_id", "left_semi")
    parsed = pin(tables.parse_table_records(spread(calls, "table_id"), ["table_id"], "raw_output"), "expert")
    joined = (
        reference.select("report_id", "page_index", "table_id", F.col("cells").alias("reference"))
        .join(detections.select("table_id", F.col("cells").alias("primary")), "table_id")
        .join(parsed.select("table_id", F.col("status").alias("expert_status"), F.col("cells").alias("expert")), "table_id", "left")
        .withColumn("deployed_source", F.when(F.col("expert_status") == "success", "expert").otherwise("primary"))
    )
    scored = pin(scoring.paired_scores(joined), "paired")
    totals = pin(aggregates.cluster_totals(scored, "report_id"), "clusters")
    funnel = records.alignment_funnel(found, detections)
    mix = aggregates.coverage_summary(scored, {
        "scored": "true", "routed": "expert_status IS NOT NULL", "replaced": "deployed_source = 'expert'",
        "fallback": "expert_status IS NOT NULL AND deployed_source = 'primary'"})
    return {
        "scores": scored, "funnel": funnel, "mix": mix,
        "means": scored.agg(*[F.avg(c).alias(c) for c in ("primary_con", "primary_top", "deployed_con", "deployed_top")]),
        "intervals": resampling.clustered_bootstrap(totals, "report_id", ["con_diff", "top_diff"], seed, replicates),
    }


def diagnose_routes(development: DataFrame, evaluation: DataFrame, routes: DataFrame, budget: int, seed: str, family: str = "trees",
                    params: dict[str, Any] = learning.DIFFICULTY_PARAMS, folds: int = 5, permutations: int = learning.PERMUTATIONS,
                    replicates: int = 5000) -> dict[str, DataFrame]:
    """Ablation, contrasts, permutation reliance, agreement of two routes, expert outcomes.

    ``routes`` is ``(allocation, sample_id)`` over the evaluation cohort with the
    allocations ``benefit`` and ``difficulty``.
    """
    development, evaluation = pin(development, "development"), pin(evaluation, "evaluation")
    ablation, outcomes = learning.feature_ablation(development, evaluation, "benefit", budget, family, params)
    assigned = pin(development.drop("fold").join(learning.group_folds(development, "issuer", folds), "issuer"), "folds")
    models = learning.fold_models(assigned, FEATURES, "benefit", family, [params], folds)
    routes = pin(routes, "routes")
    a, b = (routes.where(F.col("allocation") == name) for name in ("benefit", "difficulty"))
    every = evaluation.select(F.lit("all").alias("allocation"), "sample_id")
    return {
        "ablation": ablation, "contrasts": feature_contrasts(outcomes, seed, replicates),
        "reliance": learning.permutation_reliance(assigned, models, "benefit", budget, permutations, seed),
        "agreement": aggregates.selection_agreement(evaluation, a, b),
        "outcomes": aggregates.expert_outcomes(evaluation, routes.select("allocation", "sample_id").unionByName(every)),
    }


def analyse_frontier(actions: DataFrame, budgets: Sequence[int], segment: str = "segment") -> dict[str, DataFrame]:
    """Both frontiers per segment, headroom, local opportunity and integrity at the full budget."""
    actions = pin(actions, "actions")
    local, choices = allocation.search_choices(actions, budgets, [segment])
    whole = pin(allocation.whole_table_frontier(actions, budgets, [segment]), "whole")
    chosen = pin(allocation.chosen_actions(choices, actions, [segment]), "chosen")
    return {
        "checks": expectations.check_actions(actions), "local": allocation.frontier_record(chosen, [segment]), "whole": whole,
        "headroom": allocation.headroom(local, whole, [segment, "budget"]), "opportunity": allocation.local_opportunity(actions),
        "integrity": allocation.full_budget_check(chosen, actions, max(budgets)),
    }


def score_cohort(work: DataFrame, finished: DataFrame, structures: DataFrame, contents: DataFrame, predictions: DataFrame,
                 largest: float = 65536.0, bounded: bool = False) -> dict[str, DataFrame]:
    """Evaluation records of pending predictions only.

    ``work``: sample_id, identity.  ``finished``: sample_id, identity of stored
    evaluations.  ``structures`` and ``contents``: sample_id, payload.
    ``predictions``: sample_id, status and cell columns (one row per cell).
    """
    todo, stale = records.pending(work, finished)
    todo = pin(todo.select("sample_id"), "todo")
    # Parted once written: a filter on what was read would be moved below the readers and read again.
    objects, bad_structure = payloads.split_rejected(pin(payloads.structure_rows(
        structures.join(todo, "sample_id", "left_semi"), ["sample_id"], "payload"), "objects"), ["sample_id"])
    texts, bad_content = payloads.split_rejected(pin(payloads.content_rows(
        contents.join(todo, "sample_id", "left_semi"), ["sample_id"], "payload"), "texts"), ["sample_id"])
    cells, problems = spatial.structure_cells(objects.select("sample_id", "object_no", "category", *spatial.SIDES), largest=largest, bounded=bounded)
    cells = pin(cells, "cells")
    reference, diagnostics = spatial.attach_text(texts, cells, largest=largest, bounded=bounded)
    reference = pin(reference, "reference")
    ours = predictions.join(todo, "sample_id", "left_semi")
    scores = pin(scoring.score_tables(reference, ours.where("status = 'success'")), "scores")
    # Statuses of tables whose reference exists; the others are reported as rejects.
    sources = ours.select("sample_id", "status").distinct().join(reference.select("sample_id").distinct(), "sample_id", "left_semi")
    evaluations = pin(scoring.score_output(sources, scores), "evaluations")
    return {
        "evaluations": evaluations, "stale": stale, "diagnostics": diagnostics,
        "characteristics": aggregates.reference_characteristics(cells, texts),
        "statuses": aggregates.status_counts(evaluations, ["source_status"], "scoring_status"),
        "rejects": aggregates.all_cohorts(bad_structure, bad_content, problems.withColumnRenamed("problem", "reason")),
    }

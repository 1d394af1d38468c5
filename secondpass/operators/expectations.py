"""Data-quality expectations: named SQL conditions counted in one pass.

A rule names the condition that is *violated*.  Every report has one row per
check: ``(check, violations, sample_key)`` with the smallest violating id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondpass.functions.scalars import FEATURES


def check_rows(df: DataFrame, rules: Mapping[str, str], id_col: str = "sample_id") -> DataFrame:
    """Violations per rule.  A condition that is null counts as violated."""
    parts = []
    for i, condition in enumerate(rules.values()):
        broken = f"coalesce({condition}, true)"
        parts += [F.expr(f"count_if({broken}) AS n{i}"), F.expr(f"min(if({broken}, {id_col}, NULL)) AS k{i}")]
    entries = ", ".join(f"struct('{name}' AS check, n{i} AS violations, k{i} AS sample_key)" for i, name in enumerate(rules))
    return df.agg(*parts).selectExpr(f"inline(array({entries}))")


def check_unique(df: DataFrame, id_col: str = "sample_id", expected_rows: int | None = None) -> DataFrame:
    """Duplicate ids, empty ids and (optionally) the row count."""
    per_id = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    rules = {"unique_id": "_n > 1", "non_empty_id": f"{id_col} IS NULL OR {id_col} = ''"}
    report = check_rows(per_id, rules, id_col)
    if expected_rows is None:
        return report
    counted = per_id.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).selectExpr(
        "'row_count' AS check", f"abs(n - {int(expected_rows)}L) AS violations", "CAST(NULL AS STRING) AS sample_key"
    )
    return report.unionByName(counted)


def _missing_text(*columns: str) -> str:
    return " OR ".join(f"({c} IS NULL OR trim({c}) = '')" for c in columns)


def primary_rules(required: Sequence[str] = FEATURES, features: Sequence[str] = FEATURES) -> dict[str, str]:
    """Rules of a primary record with feature columns ``f`` and the stored vector ``feature_vector``."""
    mismatch = " OR ".join(f"NOT ({name} <=> feature_vector[{i}])" for i, name in enumerate(features))
    not_finite = " OR ".join(f"coalesce(isnan({name}) OR abs({name}) = double('inf'), false)" for name in features)
    absent = " OR ".join(f"{name} IS NULL" for name in required)
    ok = "coalesce(status = 'success', false)"
    return {
        "terminal_status": "status IS NULL OR status NOT IN ('success', 'failure')",
        "vector_length": f"size(feature_vector) <> {len(features)}",
        "vector_equals_features": mismatch,
        "features_finite": not_finite,
        "success_has_features": f"{ok} AND ({absent})",
        "success_has_image": f"{ok} AND NOT (coalesce(image_width, 0) > 0 AND coalesce(image_height, 0) > 0)",
        "success_has_cells": f"{ok} AND coalesce(cell_count, 0) = 0",
        "success_has_no_failure": f"{ok} AND failure_stage IS NOT NULL",
        "failure_is_explained": f"NOT {ok} AND ({_missing_text('failure_stage', 'error_type', 'error_message')})",
    }


# Terminal states of an expert call.
EXPERT_STATUSES = ("success", "parse_failed", "inference_failed", "inference_timeout", "out_of_memory", "worker_failed")


def _in_list(values: Sequence[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def expert_rules(expert_id: str) -> dict[str, str]:
    ok = "coalesce(status = 'success', false)"
    return {
        "expert_id": f"NOT (expert_id <=> '{expert_id}')",
        "terminal_status": f"status IS NULL OR status NOT IN {_in_list(EXPERT_STATUSES)}",
        "raw_output_present": "raw_output IS NULL",
        "seconds_not_negative": "NOT (inference_seconds >= 0 AND parsing_seconds >= 0)",
        "success_has_output": f"{ok} AND trim(coalesce(raw_output, '')) = ''",
        "success_has_cells": f"{ok} AND coalesce(cell_count, 0) = 0",
        "success_has_format": f"{ok} AND coalesce(native_format, '') NOT IN ('html', 'markdown')",
        "success_has_no_failure": f"{ok} AND (failure_stage IS NOT NULL OR error_type IS NOT NULL)",
        "failure_has_no_cells": f"NOT {ok} AND coalesce(cell_count, 0) > 0",
        "failure_is_explained": f"NOT {ok} AND ({_missing_text('failure_stage', 'error_type', 'error_message')})",
    }


def evaluation_rules() -> dict[str, str]:
    ok = "coalesce(source_status = 'success', false)"
    scores = ("score_top", "score_con", "score_loc", "coverage_top", "coverage_con")
    not_finite = " OR ".join(f"coalesce(isnan({s}) OR abs({s}) = double('inf'), false)" for s in scores)
    return {
        "source_status": f"source_status IS NULL OR source_status NOT IN {_in_list((*EXPERT_STATUSES, 'failure'))}",
        "scoring_status": "scoring_status IS NULL OR scoring_status NOT IN ('scored', 'failed_source', 'metric_failed')",
        "scores_finite": not_finite,
        "failed_source_status": f"NOT {ok} AND NOT (scoring_status <=> 'failed_source')",
        "failed_source_unscored": f"NOT {ok} AND (score_top IS NOT NULL OR score_con IS NOT NULL)",
        "failed_source_zero_coverage": f"NOT {ok} AND NOT (coverage_top <=> 0D AND coverage_con <=> 0D)",
        "success_not_failed_source": f"{ok} AND coalesce(scoring_status = 'failed_source', false)",
        "scored_has_scores": "coalesce(scoring_status = 'scored', false) AND (score_top IS NULL OR score_con IS NULL)",
    }


# The actions of a record in rank order.
ACTIONS = ("retain_primary", "core_read_core_write", "halo_read_core_write", "halo_read_halo_write", "whole_table")
LOCAL_ACTIONS = ACTIONS[1:4]
WHOLE_TABLE_COST = 1000


def action_rules() -> dict[str, str]:
    """Rules of single action rows."""
    values = ("con", "top", "benefit", "cost", "area_num", "area_den", "footprint")
    has_data = " OR ".join(f"{v} IS NOT NULL" for v in values)
    no_data = " OR ".join(f"{v} IS NULL" for v in values)
    names = ", ".join(f"'{name}', {rank}" for rank, name in enumerate(ACTIONS))
    return {
        "known_rank": f"NOT (element_at(map({names}), action) <=> action_rank)",
        "terminal_state": "terminal_state NOT IN ('unavailable', 'retained', 'replacement', 'fallback_primary')",
        "unavailable_has_no_data": f"NOT available AND (terminal_state <> 'unavailable' OR {has_data})",
        "available_has_data": f"available AND ({no_data})",
        "benefit_is_difference": "available AND NOT (benefit <=> con - primary_con)",
        "scores_in_range": "available AND NOT (con BETWEEN 0 AND 1 AND top BETWEEN 0 AND 1)",
        "costs_not_negative": "available AND (cost < 0 OR footprint < 0)",
        "area_in_range": "available AND NOT (area_den > 0 AND area_num BETWEEN 0 AND area_den)",
        "retain_is_free": "action = 'retain_primary' AND NOT (coalesce(cost, -1) = 0 AND coalesce(area_num, -1) = 0 "
                          "AND coalesce(benefit, -1) = 0 AND terminal_state = 'retained')",
        "whole_costs_unit": f"action = 'whole_table' AND available AND NOT (cost = {WHOLE_TABLE_COST} AND area_num = area_den)",
    }


def check_actions(actions: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Row rules plus the rules that tie the actions of one record together."""
    local = _in_list(LOCAL_ACTIONS)
    per_record = actions.groupBy(id_col).agg(
        F.expr("count(1) AS actions"), F.expr("count(DISTINCT action) AS names"),
        F.expr(f"count_if(available AND action IN {local}) AS local_available"),
        *[
            F.expr(f"max(if(action = '{name}', struct(cost, area_num, area_den), NULL)) AS {alias}")
            for name, alias in ((ACTIONS[2], "halo_core"), (ACTIONS[3], "halo_halo"))
        ],
    )
    rules = {
        "five_actions": f"actions <> {len(ACTIONS)} OR names <> {len(ACTIONS)}",
        "local_all_or_none": f"local_available NOT IN (0, {len(LOCAL_ACTIONS)})",
        "halo_pair_equal": "local_available > 0 AND NOT (halo_core.cost = halo_halo.cost AND "
                           "CAST(halo_core.area_num AS DECIMAL(19,0)) * CAST(halo_halo.area_den AS DECIMAL(19,0)) = "
                           "CAST(halo_halo.area_num AS DECIMAL(19,0)) * CAST(halo_core.area_den AS DECIMAL(19,0)))",
    }
    return check_rows(actions, action_rules(), id_col).unionByName(check_rows(per_record, rules, id_col))


def check_routes(routes: DataFrame, ranking: DataFrame, members: DataFrame, methods: Sequence[str],
                 budgets: Sequence[int], id_col: str = "sample_id") -> DataFrame:
    """Routes ``(method, budget, position, id)`` against full rankings ``(method, rank, id)`` and the cohort."""
    spark = routes.sparkSession
    wanted = spark.range(1).selectExpr(
        f"explode(array({', '.join(repr(m) for m in methods)})) AS method"
    ).selectExpr("method", f"explode(array({', '.join(f'{int(b)}L' for b in budgets)})) AS budget")
    sizes = routes.groupBy("method", "budget").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(id_col).alias("ids"))
    grid = wanted.join(sizes, ["method", "budget"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    grid_report = check_rows(
        grid.withColumn("cell", F.format_string("%s@%d", "method", "budget")),
        {"route_size": "n <> budget", "route_ids_unique": "coalesce(ids, 0) <> n"}, "cell",
    )
    prefix = routes.join(ranking.select("method", id_col, "rank"), ["method", id_col], "left")
    prefix_report = check_rows(prefix, {"route_is_prefix": "NOT (rank <=> position)"}, id_col)
    strangers = routes.select(id_col).distinct().join(members.select(id_col), id_col, "left_anti")
    stranger_report = check_rows(strangers, {"route_in_cohort": "true"}, id_col)
    ranked_ids = ranking.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(id_col).alias("ids"),
                                               F.max("rank").alias("top"))
    rank_report = check_rows(ranked_ids, {"ranking_is_permutation": "n <> ids OR n <> top"}, "method")
    reports = [grid_report, prefix_report, stranger_report, rank_report]
    result = reports[0]
    for report in reports[1:]:
        result = result.unionByName(report)
    return result


def check_recomputed(stored: DataFrame, recomputed: DataFrame, check: str, id_col: str = "sample_id") -> DataFrame:
    """Rows of either side without an equal row on the other side."""
    recomputed = recomputed.select(*stored.columns)
    differing = stored.exceptAll(recomputed).unionByName(recomputed.exceptAll(stored))
    return check_rows(differing, {check: "true"}, id_col)


def check_no_leak(outputs: DataFrame, held_out: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Outputs that exist for held-out ids before a route does."""
    return check_rows(outputs.join(held_out.select(id_col), id_col, "left_semi"), {"no_held_out_output": "true"}, id_col)


def check_training(training: DataFrame, validation: DataFrame, features: Sequence[str], group: str = "issuer") -> DataFrame:
    """All-null feature columns and groups that sit on both sides of a split."""
    counts = training.agg(*[F.count(name).alias(name) for name in features])
    nulls = counts.unpivot([], list(features), "feature", "present")
    empty = check_rows(nulls, {"feature_has_values": "present = 0"}, "feature")
    both = training.select(group).intersect(validation.select(group))
    return empty.unionByName(check_rows(both, {"group_on_one_side": "true"}, group))


def check_report_completeness(reports: DataFrame, tables: DataFrame) -> DataFrame:
    """Per-report rules of detected tables: id pattern, page range, contiguous numbering, declared count."""
    joined = tables.join(reports.select("report_id", "page_count"), "report_id", "left")
    expected = "format_string('%s::page-%04d::table-%04d', report_id, page_index, detection_index)"
    rows = check_rows(joined, {
        "table_id_pattern": f"NOT (table_id <=> {expected})",
        "page_in_report": "NOT (page_index >= 0 AND page_index < page_count)",
        "status_success": "NOT (status <=> 'success')",
    }, "table_id")
    pages = tables.groupBy("report_id", "page_index").agg(
        F.count(F.lit(1)).alias("n"), F.min("detection_index").alias("low"), F.max("detection_index").alias("high"),
        F.countDistinct("detection_index").alias("ids"),
    )
    numbering = check_rows(pages, {"detections_contiguous": "low <> 0 OR high <> n - 1 OR ids <> n"}, "report_id")
    found = tables.groupBy("report_id").agg(F.count(F.lit(1)).alias("found"))
    counts = reports.join(found, "report_id", "full_outer").withColumn("found", F.coalesce("found", F.lit(0)))
    declared = check_rows(counts, {"declared_count": "NOT (declared_tables <=> found)"}, "report_id")
    return rows.unionByName(numbering).unionByName(declared)


def check_calls(routed: DataFrame, outcomes: DataFrame, expected_calls: int, id_col: str = "sample_id") -> DataFrame:
    """Route and expert summary: ranks, finite scores, unique ids, and call arithmetic."""
    rows = check_rows(routed, {
        "rank_in_range": f"NOT (rank BETWEEN 1 AND {int(expected_calls)})",
        "score_finite": "score IS NULL OR isnan(score) OR abs(score) = double('inf')",
    }, id_col)
    unique = routed.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(id_col).alias("ids"), F.countDistinct("rank").alias("ranks"))
    shape = check_rows(unique.withColumn("part", F.lit("route")), {
        "call_count": f"n <> {int(expected_calls)}", "ids_unique": "ids <> n", "ranks_unique": "ranks <> n",
    }, "part")
    calls = routed.select(id_col).join(outcomes, id_col, "left").agg(
        F.count(F.lit(1)).alias("attempted"),
        F.expr("count_if(status = 'success') AS succeeded"), F.expr("count_if(status = 'parse_failed') AS parse_failed"),
        F.expr("count_if(status NOT IN ('success', 'parse_failed')) AS generation_failed"),
        F.expr("count_if(deployed_source = 'primary') AS fallbacks"),
    )
    sums = check_rows(calls.withColumn("part", F.lit("calls")), {
        "outcomes_add_up": "succeeded + parse_failed + generation_failed <> attempted",
        "fallbacks_add_up": "fallbacks <> attempted - succeeded",
    }, "part")
    return rows.unionByName(shape).unionByName(sums)


def check_populations(populations: DataFrame, names: Sequence[str], expected_values: int) -> DataFrame:
    """Calibration populations ``(risk, value)``: known names, exact size, finite values."""
    rows = check_rows(populations, {
        "known_risk": f"risk NOT IN {_in_list(names)}",
        "value_finite": "value IS NULL OR isnan(value) OR abs(value) = double('inf')",
    }, "risk")
    sizes = populations.groupBy("risk").agg(F.count(F.lit(1)).alias("n"))
    size = check_rows(sizes, {"population_size": f"n <> {int(expected_values)}"}, "risk")
    present = sizes.where(F.col("risk").isin(list(names))).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("risks"))
    return rows.unionByName(size).unionByName(check_rows(present, {"all_risks_present": f"n <> {len(names)}"}, "part"))

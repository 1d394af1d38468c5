"""Queries over joins of record tables and over data-quality expectations."""

from pyspark.sql import functions as F

from secondpass.catalog import views
from secondpass.catalog.common import Catalog, rounded
from secondpass.catalog.views import with_views
from secondpass.functions import scalars
from secondpass.operators import expectations, records, routing
from secondpass.operators.order import with_rank

catalog = Catalog()


def side(scores, system):
    """Score records of one system; every 50th record carries a wrong issuer."""
    return scores.selectExpr(
        "sample_id", "if(order_key % 50 = 7, 'issuer-wrong', issuer) AS issuer", f"{system}_status AS status",
        f"{system}_con AS con", f"{system}_top AS top", f"{system}_seconds AS seconds")


@catalog.add("join_scores", with_views("scores", """
SELECT cohort, sample_id, issuer, primary_status, primary_con, primary_top, primary_seconds,
  expert_status, expert_con, expert_top, expert_seconds, expert_b_status, expert_b_con, expert_b_top, expert_b_seconds
FROM scores WHERE order_key % 50 <> 7"""))
def join_scores(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    sides = {system: side(s, system) for system in ("primary", "expert", "expert_b")}
    return records.join_scores(s.select("cohort", "sample_id", "issuer"), sides)


@catalog.add("provenance_mismatches", with_views("scores", """
SELECT sample_id, 'issuer' AS field, issuer AS expected, 'issuer-wrong' AS found FROM scores WHERE order_key % 50 = 7"""))
def provenance_mismatches(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    return records.provenance_mismatches(s.select("sample_id", "issuer"), side(s, "primary"), ["issuer"])


def metadata(scores):
    return scores.where("order_key % 40 <> 3").selectExpr(
        "sample_id", "if(order_key % 50 = 7, 'issuer-wrong', issuer) AS issuer", "concat('images/', sample_id, '.png') AS image_file")


@catalog.add("select_members", with_views("scores", """
SELECT sample_id, issuer, cohort, 'images/' || sample_id || '.png' AS image_file, NULL::VARCHAR AS problem
FROM scores WHERE order_key % 40 <> 3 AND order_key % 50 <> 7
UNION ALL SELECT sample_id, NULL, NULL, NULL, CASE WHEN order_key % 40 = 3 THEN 'missing metadata' ELSE 'issuer mismatch' END
FROM scores WHERE order_key % 40 = 3 OR order_key % 50 = 7"""))
def select_members(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    good, bad = records.select_members(metadata(s), s.select("cohort", "sample_id", "issuer"))
    return good.unionByName(bad, allowMissingColumns=True)


@catalog.add("pending_and_stale", with_views("scores", """
SELECT sample_id, 'pending' AS state FROM scores WHERE order_key % 3 = 0
UNION ALL SELECT sample_id, 'stale' FROM scores WHERE order_key % 3 <> 0 AND order_key % 7 = 0"""))
def pending_and_stale(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    work = s.select("sample_id", "order_key", F.lit("v2").alias("model"), F.lit("strict").alias("rules"))
    work = work.withColumn("identity", scalars.identity_hash(["model", "rules"]))
    done = work.where("order_key % 3 <> 0").withColumn("model", F.expr("if(order_key % 7 = 0, 'v1', 'v2')"))
    done = done.withColumn("identity", scalars.identity_hash(["model", "rules"]))
    todo, stale = records.pending(work.select("sample_id", "identity"), done.select("sample_id", "identity"))
    return todo.select("sample_id", F.lit("pending").alias("state")).unionByName(
        stale.select("sample_id", F.lit("stale").alias("state")))


def page_tables(spark, sf_dir):
    """Table counts per report page, and detections on the pages."""
    t = views.turns(spark, sf_dir)
    pages = t.selectExpr("report_id", "page_number - 1 AS page_index", "length(text) % 3 AS table_count",
                         "length(text) % 7 = 1 AS nested", "length(text) % 11 = 1 AS malformed")
    detections = t.where("length(text) % 5 <> 0").selectExpr(
        "report_id", "page_number - 1 AS page_index", "explode(sequence(0, if(length(text) % 4 = 0, 1, 0))) AS detection_index")
    return pages, detections


PAGES = """, pages_of AS (SELECT report_id, page_number - 1 AS page_index, length(text) % 3 AS table_count,
  length(text) % 7 = 1 AS nested, length(text) % 11 = 1 AS malformed,
  CASE WHEN length(text) % 5 = 0 THEN 0 WHEN length(text) % 4 = 0 THEN 2 ELSE 1 END AS detected FROM turns)
"""


@catalog.add("align_one_to_one", with_views("turns", PAGES + """
SELECT report_id, page_index::INTEGER AS page_index, table_count::INTEGER AS table_count, nested, malformed, 0 AS detection_index FROM pages_of
WHERE table_count = 1 AND NOT nested AND NOT malformed AND detected = 1"""))
def align_one_to_one(spark, sf_dir):
    return records.align_one_to_one(*page_tables(spark, sf_dir))


@catalog.add("alignment_funnel", with_views("turns", PAGES + """
SELECT count(*) AS pages, count(*) FILTER (table_count = 1) AS one_table_pages,
  count(*) FILTER (table_count = 1 AND NOT nested AND NOT malformed) AS clean_table_pages,
  count(*) FILTER (table_count = 1 AND NOT nested AND NOT malformed AND detected = 1) AS aligned_pages,
  sum(detected)::BIGINT AS detections FROM pages_of"""))
def alignment_funnel(spark, sf_dir):
    return records.alignment_funnel(*page_tables(spark, sf_dir))


@catalog.add("replace_on_success", with_views("scores", """,
r AS (SELECT sample_id FROM scores ORDER BY pred_benefit DESC, sample_id LIMIT 2000)
SELECT s.sample_id, CASE WHEN r.sample_id IS NOT NULL THEN expert_status END AS expert_status,
  CASE WHEN r.sample_id IS NOT NULL AND expert_status = 'success' THEN 'expert' ELSE 'primary' END AS deployed_source,
  CASE WHEN r.sample_id IS NOT NULL AND expert_status = 'success' THEN 'e' ELSE 'p' END || s.sample_id AS payload
FROM scores s LEFT JOIN r USING (sample_id)"""))
def replace_on_success(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    return records.replace_on_success(
        s.selectExpr("sample_id", "concat('p', sample_id) AS payload"),
        s.selectExpr("sample_id", "expert_status AS status", "concat('e', sample_id) AS payload"),
        routing.route_for_budget(s, "pred_benefit", 2000))


@catalog.add("check_annotation", with_views("scores membership lines cells", """
SELECT m.sample_id, m.issuer, m.spanning, d.issuer AS derived_issuer, d.spanning AS derived_spanning
FROM membership m LEFT JOIN (
  SELECT c.sample_id, bool_or(column_end - column_start > 1 OR row_end - row_start > 1) AS spanning,
    CASE WHEN c.order_key % 50 = 7 THEN 'issuer-wrong' ELSE any_value(s.issuer) END AS issuer
  FROM cells c JOIN scores s USING (sample_id) GROUP BY c.sample_id, c.order_key) d USING (sample_id)
WHERE d.sample_id IS NULL OR m.issuer <> d.issuer OR m.spanning <> d.spanning"""))
def check_annotation(spark, sf_dir):
    s = views.scores(spark, sf_dir).selectExpr(
        "sample_id", "if(order_key % 50 = 7, 'issuer-wrong', issuer) AS issuer")
    spans = views.cells(spark, sf_dir).groupBy("sample_id").agg(
        F.bool_or(F.expr("column_end - column_start > 1 OR row_end - row_start > 1")).alias("spanning"))
    return records.check_annotation(views.membership(spark, sf_dir), spans.join(s, "sample_id"), ["issuer", "spanning"])


@catalog.add("compare_predictions", with_views("scores", """,
a AS (SELECT sample_id, pred_benefit AS p, row_number() OVER (ORDER BY pred_benefit DESC, sample_id) AS r FROM scores),
b0 AS (SELECT sample_id, CASE WHEN order_key % 1000 = 17 THEN pred_benefit + 0.0009765625 ELSE pred_benefit END AS p FROM scores),
b AS (SELECT *, row_number() OVER (ORDER BY p DESC, sample_id) AS r FROM b0)
SELECT count(*) AS sample_count, count(*) FILTER (a.p = b.p) AS exact_equal_count,
  round(max(abs(a.p - b.p)), 9) AS maximum_absolute_difference, count(*) FILTER (abs(a.p - b.p) > 1e-15) AS outside_tolerance,
  min(sample_id) FILTER (abs(a.p - b.p) > 1e-15) AS first_differing_sample, bool_and(a.r = b.r) AS ranking_matches
FROM a JOIN b USING (sample_id)"""))
def compare_predictions(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    stored = routing.rank_by_score(s.selectExpr("sample_id", "pred_benefit AS prediction"), "prediction")
    again = s.selectExpr("sample_id", "if(order_key % 1000 = 17, pred_benefit + 0.0009765625D, pred_benefit) AS prediction")
    return rounded(records.compare_predictions(stored, routing.rank_by_score(again, "prediction")))


# ---------------------------------------------------------------- expectations

def checks_sql(parts: list[tuple[str, str, dict[str, str]]]) -> str:
    """UNION of ``(check, violations, sample_key)`` rows; parts are (source, id, {check: condition})."""
    rows = []
    for source, key, rules in parts:
        for name, condition in rules.items():
            rows.append(f"SELECT '{name}' AS check, count(*) FILTER (coalesce({condition}, true)) AS violations, "
                        f"min({key}) FILTER (coalesce({condition}, true)) AS sample_key FROM {source}")
    return "\n UNION ALL ".join(rows)


@catalog.add("check_unique", "WITH ids AS (SELECT l_orderkey::VARCHAR AS sample_id, count(*) AS n FROM lineitem GROUP BY 1)\n" +
             checks_sql([("ids", "sample_id", {"unique_id": "n > 1", "non_empty_id": "sample_id = ''"})]) +
             " UNION ALL SELECT 'row_count', abs(sum(n) - 60000)::BIGINT, NULL FROM ids")
def check_unique(spark, sf_dir):
    ids = views.table(spark, sf_dir, "lineitem").selectExpr("CAST(l_orderkey AS STRING) AS sample_id")
    return expectations.check_unique(ids, expected_rows=60000)


FEATURE_SQL = {name: f"((order_key * {3 + 2 * i}) % 100) / 100.0" for i, name in enumerate(scalars.FEATURES)}


def primary_records(spark, sf_dir):
    """Primary records of every order, with planted faults."""
    s = views.scores(spark, sf_dir)
    features = [f"if(order_key % {90 + i} = 1, NULL, {sql}D) AS {name}" for i, (name, sql) in enumerate(FEATURE_SQL.items())]
    base = s.selectExpr(
        "sample_id", "order_key", "issuer",
        "CASE WHEN order_key % 23 = 0 THEN 'failure' WHEN order_key % 1009 = 5 THEN 'running' ELSE 'success' END AS status",
        "if(order_key % 211 = 3, 0, 400) AS image_width", "if(order_key % 223 = 3, NULL, 300) AS image_height",
        "if(order_key % 227 = 3, 0, order_key % 50 + 1) AS cell_count",
        "if(order_key % 23 = 0 OR order_key % 229 = 3, 'recognition', NULL) AS failure_stage",
        "if(order_key % 23 = 0, 'Failure', NULL) AS error_type",
        "if(order_key % 23 = 0, if(order_key % 5 = 0, ' ', 'no table'), NULL) AS error_message", *features)
    names = list(scalars.FEATURES)
    shifted = f"if(order_key % 233 = 3, {names[0]} + 1D, {names[0]})"
    return base.selectExpr("*", f"array({', '.join([shifted, *names[1:]])}) AS feature_vector")


PRIMARY = ",\nprimary_records AS (SELECT *, " + ", ".join(
    f"CASE WHEN order_key % {90 + i} = 1 THEN NULL ELSE {sql} END AS {name}" for i, (name, sql) in enumerate(FEATURE_SQL.items())
) + """, CASE WHEN order_key % 23 = 0 THEN 'failure' WHEN order_key % 1009 = 5 THEN 'running' ELSE 'success' END AS status
FROM scores)
"""
_OK = "status = 'success'"


@catalog.add("check_primary_records", with_views("scores", PRIMARY + checks_sql([("primary_records", "sample_id", {
    "terminal_status": "status NOT IN ('success', 'failure')", "vector_length": "false",
    "vector_equals_features": f"order_key % 233 = 3 AND {scalars.FEATURES[0]} IS NOT NULL", "features_finite": "false",
    "success_has_features": f"{_OK} AND (" + " OR ".join(f"{n} IS NULL" for n in scalars.FEATURES) + ")",
    "success_has_image": f"{_OK} AND (order_key % 211 = 3 OR order_key % 223 = 3)",
    "success_has_cells": f"{_OK} AND order_key % 227 = 3",
    "success_has_no_failure": f"{_OK} AND (order_key % 23 = 0 OR order_key % 229 = 3)",
    "failure_is_explained": f"NOT {_OK} AND NOT (order_key % 23 = 0 AND order_key % 5 <> 0)"})])))
def check_primary_records(spark, sf_dir):
    return expectations.check_rows(primary_records(spark, sf_dir), expectations.primary_rules())


@catalog.add("check_expert_records", with_views("scores", checks_sql([("scores", "sample_id", {
    "expert_id": "order_key % 301 = 5", "terminal_status": "false", "raw_output_present": "order_key % 303 = 5",
    "seconds_not_negative": "order_key % 307 = 5",
    "success_has_output": "expert_status = 'success' AND (order_key % 303 = 5 OR order_key % 309 = 5)",
    "success_has_cells": "expert_status = 'success' AND order_key % 311 = 5",
    "success_has_format": "expert_status = 'success' AND order_key % 313 = 5",
    "success_has_no_failure": "expert_status = 'success' AND order_key % 317 = 5",
    "failure_has_no_cells": "expert_status <> 'success' AND order_key % 319 = 5",
    "failure_is_explained": "expert_status <> 'success' AND order_key % 323 = 5"})])))
def check_expert_records(spark, sf_dir):
    ok = "expert_status = 'success'"
    r = views.scores(spark, sf_dir).selectExpr(
        "sample_id", "if(order_key % 301 = 5, 'other', 'expert') AS expert_id", "expert_status AS status",
        "CASE WHEN order_key % 303 = 5 THEN NULL WHEN order_key % 309 = 5 THEN '  ' ELSE 'text' END AS raw_output",
        "if(order_key % 307 = 5, -1D, expert_seconds) AS inference_seconds", "0.5D AS parsing_seconds",
        f"if({ok}, if(order_key % 311 = 5, 0, 4), if(order_key % 319 = 5, 4, 0)) AS cell_count",
        f"if({ok}, if(order_key % 313 = 5, 'csv', 'html'), NULL) AS native_format",
        f"if({ok}, if(order_key % 317 = 5, 'parsing', NULL), 'parsing') AS failure_stage",
        f"if({ok}, NULL, if(order_key % 323 = 5, '', 'ParseError')) AS error_type",
        f"if({ok}, NULL, 'bad table') AS error_message")
    return expectations.check_rows(r, expectations.expert_rules("expert"))


@catalog.add("check_evaluation_records", with_views("scores", checks_sql([("scores", "sample_id", {
    "source_status": "order_key % 401 = 5", "scoring_status": "false", "scores_finite": "order_key % 403 = 5",
    "failed_source_status": "(order_key % 401 = 5 OR expert_status <> 'success') AND order_key % 405 = 5",
    "failed_source_unscored": "(order_key % 401 = 5 OR expert_status <> 'success') AND (order_key % 407 = 5 OR order_key % 403 = 5)",
    "failed_source_zero_coverage": "(order_key % 401 = 5 OR expert_status <> 'success') AND order_key % 409 = 5",
    "success_not_failed_source": "order_key % 401 <> 5 AND expert_status = 'success' AND order_key % 411 = 5",
    "scored_has_scores": "order_key % 401 <> 5 AND expert_status = 'success' AND order_key % 411 <> 5 AND order_key % 413 = 5 AND order_key % 403 <> 5"})])))
def check_evaluation_records(spark, sf_dir):
    failed = "(order_key % 401 = 5 OR expert_status <> 'success')"
    r = views.scores(spark, sf_dir).selectExpr(
        "sample_id", "if(order_key % 401 = 5, 'unknown', expert_status) AS source_status",
        f"if({failed}, if(order_key % 405 = 5, 'metric_failed', 'failed_source'), if(order_key % 411 = 5, 'failed_source', 'scored')) AS scoring_status",
        "CASE WHEN order_key % 403 = 5 THEN double('NaN') "
        f"WHEN {failed} THEN if(order_key % 407 = 5, 0.5D, NULL) WHEN order_key % 413 = 5 THEN NULL ELSE expert_top END AS score_top",
        f"if({failed}, NULL, expert_con) AS score_con", "CAST(NULL AS DOUBLE) AS score_loc",
        f"if({failed}, if(order_key % 409 = 5, 0.1D, 0D), coalesce(expert_top, 0D)) AS coverage_top",
        f"if({failed}, 0D, coalesce(expert_con, 0D)) AS coverage_con")
    return expectations.check_rows(r, expectations.evaluation_rules())


@catalog.add("check_actions", with_views("scores actions", """, faulty AS (SELECT sample_id, order_key, action, action_rank, available,
  CASE WHEN order_key % 501 = 5 AND action_rank = 4 THEN 999 ELSE cost END AS cost, area_num, area_den, con, benefit, primary_con,
  terminal_state FROM actions WHERE NOT (order_key % 503 = 5 AND action_rank = 1))
""" + checks_sql([("faulty", "sample_id", {
    "known_rank": "false", "terminal_state": "false", "unavailable_has_no_data": "false", "available_has_data": "false",
    "benefit_is_difference": "false", "scores_in_range": "false", "costs_not_negative": "false", "area_in_range": "false",
    "retain_is_free": "false", "whole_costs_unit": "action_rank = 4 AND cost <> 1000"}),
    ("(SELECT sample_id, count(*) AS n, count(*) FILTER (available AND action_rank BETWEEN 1 AND 3) AS l FROM faulty GROUP BY sample_id)",
     "sample_id", {"five_actions": "n <> 5", "local_all_or_none": "l NOT IN (0, 3)", "halo_pair_equal": "false"})])))
def check_actions(spark, sf_dir):
    a = views.actions(spark, sf_dir).where("NOT (order_key % 503 = 5 AND action_rank = 1)")
    return expectations.check_actions(a.withColumn("cost", F.expr("if(order_key % 501 = 5 AND action_rank = 4, 999L, cost)")))


@catalog.add("check_routes", with_views("scores", """,
ranked AS (SELECT 'predicted' AS method, sample_id, order_key, row_number() OVER (ORDER BY pred_benefit DESC, sample_id) AS rank FROM scores
  UNION ALL SELECT 'primary', sample_id, order_key, row_number() OVER (ORDER BY primary_con DESC, sample_id) FROM scores),
routes AS (SELECT method, budget, sample_id, rank, CASE WHEN order_key % 601 = 5 THEN rank + 1 ELSE rank END AS position
  FROM ranked, (SELECT unnest([30, 300])::BIGINT AS budget) WHERE rank <= budget AND NOT (method = 'primary' AND budget = 300 AND rank = 9)),
sizes AS (SELECT method, budget, count(*) AS n FROM routes GROUP BY ALL)
""" + checks_sql([
    ("sizes", "method || '@' || budget", {"route_size": "n <> budget", "route_ids_unique": "false"}),
    ("routes", "sample_id", {"route_is_prefix": "rank <> position"}),
    ("(SELECT sample_id FROM routes WHERE false)", "sample_id", {"route_in_cohort": "true"}),
    ("(SELECT method FROM ranked WHERE false)", "method", {"ranking_is_permutation": "true"})])))
def check_routes(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    ranking = routing.rankings(s, {"predicted": "pred_benefit", "primary": "primary_con"}, keep=["order_key"])
    routes = ranking.withColumn("budget", F.explode(F.array(F.lit(30).cast("long"), F.lit(300).cast("long")))).where(
        "rank <= budget AND NOT (method = 'primary' AND budget = 300 AND rank = 9)")
    routes = routes.selectExpr("method", "budget", "sample_id", "if(order_key % 601 = 5, rank + 1, rank) AS position")
    return expectations.check_routes(routes, ranking, s, ["predicted", "primary"], [30, 300])


@catalog.add("check_recomputed", with_views("scores", checks_sql([
    ("(SELECT sample_id FROM scores WHERE order_key % 701 = 5 UNION ALL SELECT sample_id FROM scores WHERE order_key % 701 = 5)",
     "sample_id", {"stored_equals_recomputed": "true"})])))
def check_recomputed(spark, sf_dir):
    s = views.scores(spark, sf_dir).select("sample_id", "order_key", "primary_con")
    stored = s.withColumn("primary_con", F.expr("if(order_key % 701 = 5, primary_con + 1D, primary_con)"))
    return expectations.check_recomputed(stored, s, "stored_equals_recomputed")


@catalog.add("check_plan_reproducible", with_views("scores", checks_sql([
    ("(SELECT '' AS sample_id FROM scores WHERE false)", "sample_id", {"plan_reproducible": "true"})])))
def check_plan_reproducible(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    plan = lambda: routing.rankings(s, {"predicted": "pred_benefit", "primary": "primary_con"}).drop("score")
    return expectations.check_recomputed(plan(), plan(), "plan_reproducible")


@catalog.add("check_no_leak", with_views("scores", checks_sql([
    ("(SELECT sample_id FROM scores WHERE cohort = 'final' AND order_key % 801 = 15)", "sample_id", {"no_held_out_output": "true"})])))
def check_no_leak(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    outputs = s.where("cohort <> 'final' OR order_key % 801 = 15")
    return expectations.check_no_leak(outputs, s.where("cohort = 'final'"))


@catalog.add("check_training", with_views("scores", """, t AS (SELECT issuer, primary_con FROM scores WHERE cohort = 'development'),
v AS (SELECT issuer FROM scores WHERE cohort = 'final')
SELECT 'feature_has_values' AS check, 1::BIGINT AS violations, 'empty' AS sample_key
UNION ALL SELECT 'group_on_one_side', count(*), min(issuer) FROM (SELECT issuer FROM t INTERSECT SELECT issuer FROM v)"""))
def check_training(spark, sf_dir):
    s = views.scores(spark, sf_dir).withColumn("empty", F.lit(None).cast("double"))
    return expectations.check_training(
        s.where("cohort = 'development'"), s.where("cohort = 'final'"), ["primary_con", "empty"])


@catalog.add("check_report_completeness", with_views("turns", """,
tables AS (SELECT report_id, page_number - 1 AS page_index, length(text) AS n FROM turns),
declared AS (SELECT report_id, count(*) AS pages, count(*) + CASE WHEN report_id LIKE '%7-000' THEN 1 ELSE 0 END AS declared FROM turns GROUP BY report_id)
SELECT 'table_id_pattern' AS check, count(*) FILTER (n % 13 = 0) AS violations,
  min(CASE WHEN n % 13 = 0 THEN 'x' ELSE '' END || printf('%s::page-%04d::table-%04d', report_id, page_index, 0)) FILTER (n % 13 = 0) AS sample_key FROM tables
UNION ALL SELECT 'page_in_report', 0, NULL
UNION ALL SELECT 'status_success', count(*) FILTER (n % 17 = 0),
  min(CASE WHEN n % 13 = 0 THEN 'x' ELSE '' END || printf('%s::page-%04d::table-%04d', report_id, page_index, 0)) FILTER (n % 17 = 0) FROM tables
UNION ALL SELECT 'detections_contiguous', 0, NULL
UNION ALL SELECT 'declared_count', count(*) FILTER (pages <> declared), min(report_id) FILTER (pages <> declared) FROM declared"""))
def check_report_completeness(spark, sf_dir):
    t = views.turns(spark, sf_dir)
    tables = t.selectExpr(
        "report_id", "page_number - 1 AS page_index", "0 AS detection_index", "if(length(text) % 17 = 0, 'failure', 'success') AS status",
        "concat(if(length(text) % 13 = 0, 'x', ''), format_string('%s::page-%04d::table-%04d', report_id, page_number - 1, 0)) AS table_id")
    reports = t.groupBy("report_id").agg(F.max("page_number").alias("page_count"), F.count(F.lit(1)).alias("_n"))
    reports = reports.selectExpr("report_id", "page_count", "_n + if(report_id LIKE '%7-000', 1, 0) AS declared_tables")
    return expectations.check_report_completeness(reports, tables)


@catalog.add("check_calls", with_views("scores", """, r AS (SELECT sample_id, expert_status FROM scores ORDER BY pred_benefit DESC, sample_id LIMIT 2000)
SELECT "check", violations, sample_key FROM (VALUES ('rank_in_range', 1::BIGINT, NULL), ('score_finite', 0, NULL), ('call_count', 1, 'route'),
  ('ids_unique', 0, NULL), ('ranks_unique', 0, NULL), ('outcomes_add_up', 0, NULL), ('fallbacks_add_up', 0, NULL)) v("check", violations, sample_key)
WHERE "check" <> 'rank_in_range' UNION ALL
SELECT 'rank_in_range', count(*), min(sample_id) FROM (SELECT sample_id, row_number() OVER (ORDER BY pred_benefit DESC, sample_id) AS rank FROM scores) WHERE rank = 2000"""))
def check_calls(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    top = routing.route_for_budget(s.selectExpr("sample_id", "pred_benefit AS score"), "score", 2000)
    routed = with_rank(top, [F.desc("score"), "sample_id"])
    outcomes = s.selectExpr("sample_id", "expert_status AS status", "if(expert_status = 'success', 'expert', 'primary') AS deployed_source")
    return expectations.check_calls(routed, outcomes, 1999)


@catalog.add("check_populations", with_views("scores", """
SELECT 'known_risk' AS check, 0::BIGINT AS violations, NULL::VARCHAR AS sample_key
UNION ALL SELECT 'value_finite', count(*) FILTER (expert_con IS NULL), CASE WHEN count(*) FILTER (expert_con IS NULL) > 0 THEN 'unmatched_ocr_ratio' END FROM scores
UNION ALL SELECT 'population_size', CASE WHEN count(*) <> 15000 THEN 2 ELSE 0 END, CASE WHEN count(*) <> 15000 THEN 'confidence_tail_risk' END FROM scores
UNION ALL SELECT 'all_risks_present', 1, 'risks'"""))
def check_populations(spark, sf_dir):
    long = views.scores(spark, sf_dir).selectExpr(
        "stack(2, 'confidence_tail_risk', primary_con, 'unmatched_ocr_ratio', expert_con) AS (risk, value)")
    return expectations.check_populations(long, list(routing.RISK_SOURCES), 15000)

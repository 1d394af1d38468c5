"""Queries over aggregates, statuses, cohorts, clusters and sets."""

from pyspark.sql import functions as F

from secondpass.catalog import views
from secondpass.catalog.common import Catalog, random_ranks_sql, rounded
from secondpass.catalog.routing import LABELLED, ROUTES, SEED, labelled
from secondpass.catalog.views import with_views
from secondpass.operators import aggregates, routing

catalog = Catalog()


@catalog.add("linear_percentile", with_views("scores", """
SELECT round(quantile_cont(primary_con, 0.025), 9) AS p025, round(quantile_cont(primary_con, 0.5), 9) AS p50,
  round(quantile_cont(primary_con, 0.975), 9) AS p975 FROM scores"""))
def linear_percentile(spark, sf_dir):
    from secondpass.operators.order import exact_percentiles

    s = views.scores(spark, sf_dir)
    return rounded(exact_percentiles(s, "primary_con", {"p025": 0.025, "p50": 0.5, "p975": 0.975}))


@catalog.add("issuer_percentile", with_views("scores", """
SELECT issuer, round(quantile_cont(pred_benefit, 0.1), 9) AS p10, round(quantile_cont(pred_benefit, 0.9), 9) AS p90
FROM scores GROUP BY issuer"""))
def issuer_percentile(spark, sf_dir):
    from secondpass.operators.order import exact_percentiles

    return rounded(exact_percentiles(views.scores(spark, sf_dir), "pred_benefit", {"p10": 0.1, "p90": 0.9}, ["issuer"]))


def _standalone_sql(system):
    ok = f"{system}_status = 'success'"
    con = f"CASE WHEN {ok} THEN coalesce({system}_con, 0.0) ELSE 0.0 END"
    top = f"CASE WHEN {ok} THEN coalesce({system}_top, 0.0) ELSE 0.0 END"
    return f"""SELECT '{system}' AS system, cohort, count(*) AS sample_count, count(*) FILTER ({ok}) AS success_count,
  round(count(*) FILTER ({ok}) / count(*), 9) AS success_coverage,
  round(avg({con}), 9) AS coverage_aware_con, round(avg({top}), 9) AS coverage_aware_top,
  round(avg({con}) FILTER ({ok}), 9) AS successful_con, round(avg({top}) FILTER ({ok}), 9) AS successful_top
FROM scores GROUP BY cohort"""


@catalog.add("standalone_summary", with_views(
    "scores", " UNION ALL ".join(_standalone_sql(s) for s in ("primary", "expert", "expert_b"))))
def standalone_summary(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    parts = [
        aggregates.standalone_summary(s, system, ["cohort"]).withColumn("system", F.lit(system))
        for system in ("primary", "expert", "expert_b")
    ]
    return rounded(aggregates.all_cohorts(*parts))


@catalog.add("status_counts", with_views("scores", """
SELECT cohort, system, status, count(*) AS records FROM (
  SELECT cohort, 'expert' AS system, expert_status AS status FROM scores
  UNION ALL SELECT cohort, 'expert_b', expert_b_status FROM scores) GROUP BY ALL"""))
def status_counts(spark, sf_dir):
    long = views.scores(spark, sf_dir).selectExpr(
        "cohort", "stack(2, 'expert', expert_status, 'expert_b', expert_b_status) AS (system, status)")
    return aggregates.status_counts(long, ["cohort", "system"])


@catalog.add("cohort_summary", with_views("scores membership", """
, per AS (SELECT cohort, issuer, count(*) AS n, count(*) FILTER (spanning) AS s FROM membership GROUP BY ALL),
homes AS (SELECT issuer, count(*) AS cohorts FROM per GROUP BY issuer)
SELECT cohort, sum(n)::BIGINT AS sample_count, count(*) AS issuer_count, count(*) FILTER (cohorts > 1) AS shared_issuer_count,
  sum(s)::BIGINT AS spanning_count, (sum(n) - sum(s))::BIGINT AS non_spanning_count
FROM per JOIN homes USING (issuer) GROUP BY cohort"""))
def cohort_summary(spark, sf_dir):
    return aggregates.cohort_summary(views.membership(spark, sf_dir))


@catalog.add("shared_issuers", with_views("scores membership", """
SELECT issuer FROM membership WHERE cohort = 'development' INTERSECT SELECT issuer FROM membership WHERE cohort = 'final'"""))
def shared_issuers(spark, sf_dir):
    return aggregates.shared_issuers(views.membership(spark, sf_dir), "development", "final")


@catalog.add("summary_stats", with_views("scores", """
SELECT issuer, count(pred_benefit) AS count, round(avg(pred_benefit), 9) AS mean, round(stddev_samp(pred_benefit), 9) AS sd,
  round(min(pred_benefit), 9) AS minimum, round(max(pred_benefit), 9) AS maximum,
  round(quantile_cont(pred_benefit, 0.5), 9) AS median, round(quantile_cont(pred_benefit, 0.05), 9) AS p05,
  round(quantile_cont(pred_benefit, 0.95), 9) AS p95 FROM scores GROUP BY issuer"""))
def summary_stats(spark, sf_dir):
    return rounded(aggregates.summary_stats(views.scores(spark, sf_dir), "pred_benefit", ["issuer"]))


@catalog.add("mean_squared_error", "WITH " + LABELLED + """
SELECT cohort, round(avg((pred_benefit - benefit) * (pred_benefit - benefit)), 9) AS mse FROM labelled GROUP BY cohort""")
def mean_squared_error(spark, sf_dir):
    return rounded(aggregates.mean_squared_error(labelled(spark, sf_dir), "pred_benefit", "benefit", ["cohort"]))


@catalog.add("spearman", "WITH " + LABELLED + """,
r AS (SELECT cohort,
  rank() OVER (PARTITION BY cohort ORDER BY pred_benefit) + (count(*) OVER (PARTITION BY cohort, pred_benefit) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY cohort ORDER BY benefit) + (count(*) OVER (PARTITION BY cohort, benefit) - 1) / 2.0 AS b
  FROM labelled)
SELECT cohort, count(*) AS n, round(corr(a, b), 9) AS value, NULL::VARCHAR AS reason FROM r GROUP BY cohort
UNION ALL SELECT 'constant', count(*), NULL, 'constant predicted values' FROM labelled""")
def spearman(spark, sf_dir):
    s = labelled(spark, sf_dir)
    flat = s.select(F.lit("constant").alias("cohort"), F.lit(1.0).alias("pred_benefit"), "benefit")
    both = s.select("cohort", "pred_benefit", "benefit").unionByName(flat)
    return rounded(aggregates.spearman(both, "pred_benefit", "benefit", ["cohort"]))


AGREEMENT = "WITH " + LABELLED + """,
a AS (SELECT sample_id FROM labelled ORDER BY pred_benefit DESC, sample_id LIMIT 2000),
b AS (SELECT sample_id FROM labelled ORDER BY difficulty DESC, sample_id LIMIT 2000)
"""


@catalog.add("selection_agreement", AGREEMENT + """
SELECT CASE WHEN a.sample_id IS NOT NULL AND b.sample_id IS NOT NULL THEN 'both' WHEN a.sample_id IS NOT NULL THEN 'left_only'
  WHEN b.sample_id IS NOT NULL THEN 'right_only' ELSE 'neither' END AS selection, count(*) AS table_count,
  round(avg(primary_con), 9) AS mean_primary_con, round(avg(benefit), 9) AS mean_benefit
FROM labelled l LEFT JOIN a USING (sample_id) LEFT JOIN b ON b.sample_id = l.sample_id GROUP BY 1""")
def selection_agreement(spark, sf_dir):
    s = labelled(spark, sf_dir)
    a, b = (routing.route_for_budget(s, c, 2000) for c in ("pred_benefit", "difficulty"))
    return rounded(aggregates.selection_agreement(s, a, b))


@catalog.add("expert_outcomes", AGREEMENT + """, routes AS (
  SELECT 'predicted' AS allocation, sample_id FROM a UNION ALL SELECT 'difficulty', sample_id FROM b
  UNION ALL SELECT 'all', sample_id FROM labelled)
SELECT allocation, count(*) AS calls,
  count(*) FILTER (expert_status = 'success' AND benefit > 1e-9) AS beneficial,
  count(*) FILTER (expert_status = 'success' AND benefit < -1e-9) AS harmful,
  count(*) FILTER (expert_status = 'success' AND abs(benefit) <= 1e-9) AS neutral,
  count(*) FILTER (expert_status <> 'success') AS failed
FROM routes JOIN labelled USING (sample_id) GROUP BY allocation""")
def expert_outcomes(spark, sf_dir):
    s = labelled(spark, sf_dir)
    routes = aggregates.all_cohorts(*[
        part.select(F.lit(name).alias("allocation"), "sample_id")
        for name, part in (("predicted", routing.route_for_budget(s, "pred_benefit", 2000)),
                           ("difficulty", routing.route_for_budget(s, "difficulty", 2000)), ("all", s))
    ])
    return aggregates.expert_outcomes(s, routes)


@catalog.add("reference_characteristics", with_views("lines cells ocr_boxes", """
SELECT sample_id, max(row_end)::INTEGER AS row_count, max(column_end)::INTEGER AS column_count,
  count(*) FILTER (column_end - column_start > 1 OR row_end - row_start > 1) AS spanning_cell_count,
  count(*) AS cell_count, any_value(coalesce(t, 0)) AS text_record_count
FROM cells LEFT JOIN (SELECT sample_id, count(*) AS t FROM ocr_boxes GROUP BY sample_id) USING (sample_id) GROUP BY sample_id"""))
def reference_characteristics(spark, sf_dir):
    return aggregates.reference_characteristics(views.cells(spark, sf_dir), views.ocr_boxes(spark, sf_dir))


@catalog.add("coverage_summary", with_views("scores", """
SELECT issuer, count(*) AS attempted, count(*) FILTER (expert_status = 'success') AS succeeded,
  count(*) FILTER (expert_status = 'parse_failed') AS parse_failures,
  count(*) FILTER (expert_b_status = 'inference_failed') AS generation_failures,
  count(*) FILTER (expert_status <> 'success') AS fallbacks FROM scores GROUP BY issuer"""))
def coverage_summary(spark, sf_dir):
    return aggregates.coverage_summary(views.scores(spark, sf_dir), {
        "attempted": "true", "succeeded": "expert_status = 'success'", "parse_failures": "expert_status = 'parse_failed'",
        "generation_failures": "expert_b_status = 'inference_failed'", "fallbacks": "expert_status <> 'success'",
    }, ["issuer"])


def deployed_rows(spark, sf_dir):
    """Primary and deployed scores of every order under a 20 % route."""
    s = labelled(spark, sf_dir)
    routed = routing.route_fraction(s.select("sample_id", "pred_benefit"), "pred_benefit", 0.2)
    joined = s.join(routed.select("sample_id", F.lit(True).alias("routed")), "sample_id", "left")
    use = "coalesce(routed, false) AND expert_status = 'success'"
    return joined.selectExpr("sample_id", "issuer", "primary_con", "primary_top",
                             f"if({use}, expert_con, primary_con) AS deployed_con",
                             f"if({use}, expert_top, primary_top) AS deployed_top")


DEPLOYED = "WITH " + LABELLED + """,
ordered AS (SELECT *, row_number() OVER (ORDER BY pred_benefit DESC, sample_id) AS rank, count(*) OVER () AS n FROM labelled),
deployed AS (SELECT sample_id, issuer, primary_con, primary_top,
  CASE WHEN rank <= round_even(n * 0.2, 0) AND expert_status = 'success' THEN expert_con ELSE primary_con END AS deployed_con,
  CASE WHEN rank <= round_even(n * 0.2, 0) AND expert_status = 'success' THEN expert_top ELSE primary_top END AS deployed_top
  FROM ordered)"""


@catalog.add("select_deployed", DEPLOYED + """
SELECT sample_id, issuer, primary_con, primary_top, deployed_con, deployed_top FROM deployed""")
def select_deployed(spark, sf_dir):
    return deployed_rows(spark, sf_dir)


@catalog.add("cluster_totals", DEPLOYED + """
SELECT issuer, count(*) AS n, round(sum(deployed_con - primary_con), 6) AS con_diff,
  round(sum(deployed_top - primary_top), 6) AS top_diff FROM deployed GROUP BY issuer""")
def cluster_totals(spark, sf_dir):
    return rounded(aggregates.cluster_totals(deployed_rows(spark, sf_dir), "issuer"), 6)


@catalog.add("timing_totals", "WITH " + LABELLED + """,
r AS (SELECT sample_id FROM labelled ORDER BY pred_benefit DESC, sample_id LIMIT 2000)
SELECT sum(primary_seconds) AS primary_seconds, sum(expert_seconds) AS expert_seconds,
  sum(primary_seconds) + (SELECT sum(expert_seconds) FROM labelled WHERE sample_id IN (SELECT * FROM r)) AS hybrid_seconds
FROM labelled""")
def timing_totals(spark, sf_dir):
    s = labelled(spark, sf_dir)
    return aggregates.timing_totals(s, routing.route_for_budget(s, "pred_benefit", 2000))


@catalog.add("cohorts_disjoint", with_views("scores membership", """
SELECT issuer AS sample_id, count(DISTINCT cohort) AS cohorts FROM membership GROUP BY issuer HAVING count(DISTINCT cohort) > 1"""))
def cohorts_disjoint(spark, sf_dir):
    # Issuers may sit in several cohorts, samples may not: the issuer form has rows to compare.
    return aggregates.cohorts_disjoint(views.membership(spark, sf_dir).selectExpr("cohort", "issuer AS sample_id"))


@catalog.add("set_differences", with_views("scores", """
, a AS (SELECT sample_id FROM scores WHERE expert_status = 'success'),
b AS (SELECT sample_id FROM scores WHERE expert_b_status = 'success')
SELECT 'left' AS side, sample_id FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT 'right', sample_id FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"""))
def set_differences(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    return aggregates.set_differences(
        s.where("expert_status = 'success'").select("sample_id"), s.where("expert_b_status = 'success'").select("sample_id"))


@catalog.add("all_cohorts", with_views("scores membership", """
SELECT cohort, sample_id, issuer, spanning FROM membership"""))
def all_cohorts(spark, sf_dir):
    m = views.membership(spark, sf_dir)
    return aggregates.all_cohorts(*[
        m.where(F.col("cohort") == c) for c in ("development", "final", "reserve", "calibration")])


@catalog.add("random_summary", "WITH " + LABELLED + f""",
drawn AS {random_ranks_sql(SEED, ROUTES, 2000)},
base AS (SELECT count(*) AS n, sum(primary_con) AS con, sum(primary_top) AS top FROM labelled),
per AS (SELECT budget, repetition, (any_value(b.con) + sum(benefit)) / any_value(n) AS con,
    (any_value(b.top) + sum(CASE WHEN expert_status = 'success' THEN expert_top - primary_top ELSE 0.0 END)) / any_value(n) AS top,
    sum(expert_seconds) AS seconds
  FROM drawn JOIN labelled USING (sample_id), base b, (SELECT unnest([300, 2000])::BIGINT AS budget) WHERE rank <= budget GROUP BY budget, repetition)
SELECT budget, count(*) AS repetitions, round(avg(con), 9) AS mean_con, round(median(con), 9) AS median_con,
  round(quantile_cont(con, 0.025), 9) AS lower_con, round(quantile_cont(con, 0.975), 9) AS upper_con,
  round(avg(top), 9) AS mean_top, round(avg(seconds), 6) AS mean_expert_seconds
FROM per GROUP BY budget""")
def random_summary(spark, sf_dir):
    from secondpass.operators import resampling

    return rounded(resampling.random_summary(views.scores(spark, sf_dir), (300, 2000), ROUTES, SEED))


@catalog.add("random_mean_vector", "WITH " + LABELLED + f""",
drawn AS (SELECT sample_id, count(*) AS picked FROM {random_ranks_sql(SEED, ROUTES, 2000)} WHERE rank <= 2000 GROUP BY sample_id)
SELECT sample_id, coalesce(picked, 0) AS picked, round(primary_con + benefit * coalesce(picked, 0) / {ROUTES}.0, 9) AS mean_con
FROM labelled LEFT JOIN drawn USING (sample_id)""")
def random_mean_vector(spark, sf_dir):
    from secondpass.operators import resampling

    return rounded(resampling.random_mean_vector(views.scores(spark, sf_dir), 2000, ROUTES, SEED))

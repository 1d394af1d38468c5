"""Queries over rankings, budget cuts and route evaluation."""

from pyspark.sql import functions as F

from secondpass.catalog import views
from secondpass.catalog.common import Catalog, random_ranks_sql, rounded
from secondpass.catalog.views import with_views
from secondpass.functions import scalars
from secondpass.operators import resampling, routing

catalog = Catalog()

BUDGETS = (0, 30, 60, 90, 120, 180, 300, 2000, 8000)
SEED = "secondpass-random"
REPETITIONS = 5  # whole random rankings, returned row by row
ROUTES = 2000  # random routes behind a control
BENEFIT = "CASE WHEN expert_status = 'success' THEN expert_con - primary_con ELSE 0.0 END"


def labelled(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    ok = F.col("expert_status") == "success"
    return s.withColumn("benefit", scalars.call_benefit(F.col("primary_con"), F.col("expert_con"), ok)).withColumn(
        "difficulty", scalars.difficulty_target(F.col("primary_con"))
    )


LABELLED = views.SQL["scores"] + f""",
labelled AS (SELECT *, {BENEFIT} AS benefit, 1.0 - primary_con AS difficulty FROM scores)"""

# Metrics of route rows ``calls(keys…)`` joined with population totals, in SQL.
OUTCOMES = """outcomes AS (
  SELECT *, expert_status = 'success' AS ok,
    CASE WHEN expert_status = 'success' THEN coalesce(expert_con - primary_con, 0.0) ELSE 0.0 END AS delta,
    CASE WHEN expert_status = 'success' THEN coalesce(expert_con, 0.0) ELSE primary_con END - primary_con AS lift_con,
    CASE WHEN expert_status = 'success' THEN coalesce(expert_top, 0.0) ELSE primary_top END - primary_top AS lift_top,
    greatest(primary_con, coalesce(expert_con, 0.0)) AS best_con,
    greatest(primary_top, coalesce(expert_top, 0.0)) AS best_top
  FROM labelled),
population AS (
  SELECT count(*) AS n, sum(primary_con) AS p_con, sum(primary_top) AS p_top,
    sum(coalesce(expert_con, 0.0)) AS e_con, sum(coalesce(expert_top, 0.0)) AS e_top,
    sum(best_con) AS o_con, sum(best_top) AS o_top FROM outcomes)"""


def metrics_sql(keys: str, calls: str) -> str:
    """SELECT of all route metrics; ``calls`` lists (keys, sample_id) with left-joinable outcomes."""
    per = lambda a, b: f"CASE WHEN {b} <> 0 THEN round({a} / {b}, 9) END"
    what = []
    for w in ("con", "top"):
        what.append(f"""round(p_{w} / n, 9) AS primary_full_set_{w}, round(e_{w} / n, 9) AS expert_only_full_set_{w},
      round((p_{w} + lift_{w}) / n, 9) AS hybrid_full_set_{w}, round(o_{w} / n, 9) AS oracle_full_set_{w},
      round(lift_{w} / n, 9) AS gain_over_always_primary_{w},
      CASE WHEN o_{w} <> p_{w} THEN round(lift_{w} / (o_{w} - p_{w}), 9) END AS fraction_oracle_gain_recovered_{w}""")
    return f"""SELECT {keys}, calls AS expert_call_count, round(calls / n, 9) AS expert_call_rate,
      replaced AS successful_expert_return_count, calls - replaced AS failed_expert_return_count,
      replaced AS replacement_count, round(replaced / n, 9) AS replacement_rate,
      improved AS improved_replacement_count, harmed AS harmed_replacement_count,
      replaced - improved - harmed AS unchanged_replacement_count,
      {per("harmed::DOUBLE", "replaced")} AS harmed_replacement_rate,
      CASE WHEN replaced = 0 THEN 'no replacements' END AS harmed_replacement_rate_reason,
      {per("gain_sum", "improved")} AS mean_gain_on_improvements,
      {per("loss_sum", "harmed")} AS mean_loss_on_harms,
      {", ".join(what)},
      0.0::DOUBLE AS primary_cost_seconds, seconds AS expert_cost_seconds, seconds AS total_cost_seconds,
      round(seconds / n, 9) AS mean_cost_per_sample_seconds
    FROM (SELECT {keys}, count(o.sample_id) AS calls, coalesce(sum(ok::INTEGER), 0)::BIGINT AS replaced,
        count(*) FILTER (ok AND delta > 1e-9) AS improved, count(*) FILTER (ok AND delta < -1e-9) AS harmed,
        coalesce(sum(delta) FILTER (ok AND delta > 1e-9), 0.0) AS gain_sum,
        coalesce(-sum(delta) FILTER (ok AND delta < -1e-9), 0.0) AS loss_sum,
        coalesce(sum(lift_con), 0.0) AS lift_con, coalesce(sum(lift_top), 0.0) AS lift_top,
        coalesce(sum(expert_seconds), 0.0) AS seconds
      FROM ({calls}) c LEFT JOIN outcomes o ON c.sample_id = o.sample_id GROUP BY {keys}) t, population"""


@catalog.add("rank_by_score", with_views("scores", """
SELECT sample_id, pred_benefit, row_number() OVER (ORDER BY pred_benefit DESC, sample_id) AS rank FROM scores"""))
def rank_by_score(spark, sf_dir):
    return routing.rank_by_score(views.scores(spark, sf_dir).select("sample_id", "pred_benefit"), "pred_benefit")


@catalog.add("route_for_budget", with_views("scores", """
SELECT sample_id, pred_benefit FROM scores ORDER BY pred_benefit DESC, sample_id LIMIT 300"""))
def route_for_budget(spark, sf_dir):
    s = views.scores(spark, sf_dir).select("sample_id", "pred_benefit")
    return routing.route_for_budget(s, "pred_benefit", 300, allowed_budgets=BUDGETS)


@catalog.add("route_fraction", with_views("scores", """
SELECT sample_id, rank FROM (
  SELECT sample_id, row_number() OVER (ORDER BY pred_benefit DESC, sample_id) AS rank, count(*) OVER () AS n FROM scores)
WHERE rank <= round_even(n * 0.2, 0)"""))
def route_fraction(spark, sf_dir):
    s = views.scores(spark, sf_dir).select("sample_id", "pred_benefit")
    return routing.route_fraction(s, "pred_benefit", 0.2).select("sample_id", "rank")


@catalog.add("random_route", with_views("scores", f"""
SELECT sample_id FROM scores ORDER BY sha256('{SEED}:3:' || sample_id), sample_id LIMIT 300"""))
def random_route(spark, sf_dir):
    return routing.random_route(views.scores(spark, sf_dir), SEED, 3, 300)


@catalog.add("random_order", with_views("scores", f"""
SELECT repetition, sample_id, row_number() OVER (PARTITION BY repetition
  ORDER BY sha256('{SEED}:' || repetition || ':' || sample_id), sample_id) AS rank
FROM scores, (SELECT unnest(range({REPETITIONS}))::INTEGER AS repetition)"""))
def random_order(spark, sf_dir):
    return routing.random_order(views.scores(spark, sf_dir), SEED, REPETITIONS)


@catalog.add("oracle_ranking", "WITH " + LABELLED + """
SELECT sample_id, round(benefit, 9) AS benefit,
  row_number() OVER (ORDER BY benefit DESC, sample_id) AS rank FROM labelled""")
def oracle_ranking(spark, sf_dir):
    df = labelled(spark, sf_dir).select("sample_id", "benefit")
    return rounded(routing.rank_by_score(df, "benefit"))


METHODS = {"predicted": "pred_benefit", "difficulty": "difficulty", "oracle": "benefit"}
RANKED = "WITH " + LABELLED + ",\n" + OUTCOMES + ",\nranked AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS method, sample_id, row_number() OVER (ORDER BY {c} DESC, sample_id) AS rank FROM labelled"
    for m, c in METHODS.items()
) + f"),\nbudgets AS (SELECT unnest([{', '.join(map(str, BUDGETS))}])::BIGINT AS budget),\n" + """grid AS (
  SELECT method, budget FROM budgets, (SELECT unnest(['predicted', 'difficulty', 'oracle', 'always_primary']) AS method)),
calls AS (SELECT g.method, g.budget, r.sample_id FROM grid g
  LEFT JOIN ranked r ON r.method = g.method AND r.rank <= g.budget)
"""


@catalog.add("quality_budget_curve", RANKED + metrics_sql("method, budget", "SELECT * FROM calls"))
def quality_budget_curve(spark, sf_dir):
    return rounded(routing.quality_budget_curve(labelled(spark, sf_dir), METHODS, BUDGETS))


@catalog.add("evaluate_route", "WITH " + LABELLED + ",\n" + OUTCOMES + ",\nroutes AS (" + f"""
  SELECT 'top' AS method, sample_id FROM (SELECT sample_id FROM labelled ORDER BY pred_benefit DESC, sample_id LIMIT 2000)
  UNION ALL SELECT 'random', sample_id FROM (
    SELECT sample_id FROM labelled ORDER BY sha256('{SEED}:0:' || sample_id), sample_id LIMIT 2000))
""" + metrics_sql("method", "SELECT * FROM routes"))
def evaluate_route(spark, sf_dir):
    s = labelled(spark, sf_dir)
    top = routing.route_for_budget(s, "pred_benefit", 2000).select(F.lit("top").alias("method"), "sample_id")
    rnd = routing.random_route(s, SEED, 0, 2000).select(F.lit("random").alias("method"), "sample_id")
    return rounded(routing.evaluate_routes(s, top.unionByName(rnd), ("method",)))


@catalog.add("transfer_evaluation", with_views("scores", """,
labelled AS (SELECT sample_id, primary_con, primary_top, pred_benefit, expert_b_status AS expert_status,
  expert_b_con AS expert_con, expert_b_top AS expert_top, expert_b_seconds AS expert_seconds FROM scores),
""") + OUTCOMES + """,
calls AS (SELECT b.budget, r.sample_id FROM (SELECT unnest([30, 300, 2000])::BIGINT AS budget) b
  JOIN (SELECT sample_id, row_number() OVER (ORDER BY pred_benefit DESC, sample_id) AS rank FROM labelled) r
  ON r.rank <= b.budget)
""" + metrics_sql("budget", "SELECT * FROM calls"))
def transfer_evaluation(spark, sf_dir):
    keep = ["primary_con", "primary_top", *routing.expert_columns("expert_b").values()]
    s = views.scores(spark, sf_dir).select("sample_id", "pred_benefit", *keep)
    ranked = routing.rank_by_score(s, "pred_benefit").withColumn("method", F.lit("predicted"))
    return rounded(routing.evaluate_rankings(ranked, (30, 300, 2000), ("method",), "expert_b").drop("method"))


@catalog.add("selection_sets", with_views("scores", """,
a AS (SELECT sample_id FROM scores ORDER BY pred_benefit DESC, sample_id LIMIT 2000),
b AS (SELECT sample_id FROM scores ORDER BY primary_con, sample_id LIMIT 2000)
SELECT 'intersect' AS operation, sample_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'except', sample_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'union', sample_id FROM (SELECT * FROM a UNION SELECT * FROM b)"""))
def selection_sets(spark, sf_dir):
    s = labelled(spark, sf_dir)
    a = routing.route_for_budget(s, "pred_benefit", 2000)
    b = routing.route_for_budget(s, "difficulty", 2000)
    parts = [
        routing.combine_selections(a, b, how).select(F.lit(how).alias("operation"), "sample_id")
        for how in ("intersect", "except", "union")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@catalog.add("dedupe_route", with_views("scores", """
SELECT printf('%010d-000', o.o_orderkey) AS sample_id, min(l.l_partkey) AS position
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY 1"""))
def dedupe_route(spark, sf_dir):
    requested = views.table(spark, sf_dir, "lineitem").select(
        views.order_sample_id("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("position")
    )
    return routing.dedupe_route(requested, views.scores(spark, sf_dir).select("sample_id"))


@catalog.add("random_position", "WITH " + LABELLED + f""",
drawn AS {random_ranks_sql(SEED, ROUTES, 2000)},
base AS (SELECT count(*) AS n, sum(primary_con) AS con FROM labelled),
means AS (SELECT repetition, (any_value(con) + sum(benefit)) / any_value(n) AS hybrid_con
  FROM drawn JOIN labelled USING (sample_id), base WHERE rank <= 2000 GROUP BY repetition),
target AS (SELECT avg(primary_con + CASE WHEN rank <= 2000 THEN benefit ELSE 0.0 END) AS target FROM (
  SELECT *, row_number() OVER (ORDER BY pred_benefit DESC, sample_id) AS rank FROM labelled))
SELECT round(any_value(target), 9) AS target, avg((round(hybrid_con, 12) <= round(target, 12))::INTEGER) AS share_at_or_below,
  round(avg(hybrid_con), 9) AS mean, round(median(hybrid_con), 9) AS median,
  round(quantile_cont(hybrid_con, 0.025), 9) AS lower, round(quantile_cont(hybrid_con, 0.975), 9) AS upper
FROM means, target""")
def random_position(spark, sf_dir):
    s = labelled(spark, sf_dir)
    means = resampling.random_means(s, (2000,), ROUTES, SEED)
    ranked = routing.rank_by_score(s, "pred_benefit").withColumn("method", F.lit("predicted"))
    target = routing.evaluate_rankings(ranked, (2000,)).select(F.col("hybrid_full_set_con").alias("target"))
    return rounded(routing.random_position(means, target, "hybrid_full_set_con"))


@catalog.add("figure_rows", RANKED + """, curve AS (""" + metrics_sql("method, budget", "SELECT * FROM calls") + """),
bounds AS (SELECT 'predicted' AS method, budget, budget / 10000.0 - 0.01 AS lower, budget / 10000.0 + 0.01 AS upper
  FROM budgets WHERE budget >= 60
  UNION ALL SELECT 'difficulty', budget, 0.5::DOUBLE, 0.4::DOUBLE FROM budgets WHERE budget = 300)
SELECT CASE method WHEN 'predicted' THEN 'Benefit route' ELSE 'Difficulty route' END AS label, c.method, c.budget,
  expert_call_rate AS call_rate, hybrid_full_set_con AS quality, gain_over_always_primary_con AS gain,
  CASE WHEN coalesce(lower <= upper, true) THEN round(lower, 9) END AS lower,
  CASE WHEN coalesce(lower <= upper, true) THEN round(upper, 9) END AS upper,
  coalesce(lower <= upper, true) AS interval_ok
FROM curve c LEFT JOIN bounds b USING (method, budget) WHERE c.method IN ('predicted', 'difficulty')""")
def figure_rows(spark, sf_dir):
    curve = routing.quality_budget_curve(labelled(spark, sf_dir), METHODS, BUDGETS)
    known = curve.where("method = 'predicted' AND budget >= 60").select(
        "method", "budget", (F.col("budget") / 10000.0 - 0.01).alias("lower"), (F.col("budget") / 10000.0 + 0.01).alias("upper"))
    wrong = curve.where("method = 'difficulty' AND budget = 300").select(
        "method", "budget", F.lit(0.5).alias("lower"), F.lit(0.4).alias("upper"))
    labels = {"predicted": "Benefit route", "difficulty": "Difficulty route"}
    return rounded(routing.figure_rows(curve, known.unionByName(wrong), labels))


@catalog.add("benefit_at_fraction", "WITH " + LABELLED + ",\n" + OUTCOMES + """,
routes AS (SELECT 'predicted' AS method, sample_id FROM (
  SELECT sample_id, row_number() OVER (ORDER BY pred_benefit DESC, sample_id) AS rank, count(*) OVER () AS n FROM labelled)
  WHERE rank <= round_even(n * 0.2, 0))
""" + metrics_sql("method", "SELECT * FROM routes"))
def benefit_at_fraction(spark, sf_dir):
    s = labelled(spark, sf_dir)
    routed = routing.route_fraction(s.select("sample_id", "pred_benefit"), "pred_benefit", 0.2)
    return rounded(routing.evaluate_routes(s, routed.select(F.lit("predicted").alias("method"), "sample_id"), ("method",)))

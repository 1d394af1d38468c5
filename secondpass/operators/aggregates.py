"""Summaries over score records, statuses, cohorts and clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondpass.functions.scalars import TIE_TOLERANCE
from secondpass.operators.order import exact_percentiles, with_midrank


def standalone_summary(scores: DataFrame, system: str, keys: Sequence[str] = (), loc: str | None = None) -> DataFrame:
    """Status coverage and score means of one system.

    Coverage-aware means count failures as 0; successful-only means leave them
    out.  Location means exist only where every success has a location score.
    """
    ok = f"coalesce({system}_status = 'success', false)"
    con, top = f"if({ok}, coalesce({system}_con, 0D), 0D)", f"if({ok}, coalesce({system}_top, 0D), 0D)"
    parts = [
        "count(1) AS sample_count",
        f"count_if({ok}) AS success_count",
        f"count_if({ok}) / count(1) AS success_coverage",
        f"avg({con}) AS coverage_aware_con",
        f"avg({top}) AS coverage_aware_top",
        f"avg(if({ok}, {con}, NULL)) AS successful_con",
        f"avg(if({ok}, {top}, NULL)) AS successful_top",
    ]
    if loc:
        complete = f"count_if({ok} AND {loc} IS NOT NULL) = count_if({ok})"
        parts.append(f"if({complete}, avg(if({ok}, coalesce({loc}, 0D), 0D)), NULL) AS coverage_aware_loc")
        parts.append(f"if({complete}, avg(if({ok}, {loc}, NULL)), NULL) AS successful_loc")
    return scores.groupBy(*keys).agg(*[F.expr(part) for part in parts])


def status_counts(records: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    return records.groupBy(*keys, status).agg(F.count(F.lit(1)).alias("records"))


def cohort_summary(membership: DataFrame) -> DataFrame:
    """Records, issuers and spanning split per cohort, and issuers shared with other cohorts."""
    per_issuer = membership.groupBy("cohort", "issuer").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("spanning").alias("spanning_n")
    )
    homes = per_issuer.groupBy("issuer").agg(F.count(F.lit(1)).alias("cohorts"))
    return (
        per_issuer.join(homes, "issuer")
        .groupBy("cohort")
        .agg(
            F.sum("n").alias("sample_count"),
            F.count(F.lit(1)).alias("issuer_count"),
            F.count_if(F.col("cohorts") > 1).alias("shared_issuer_count"),
            F.sum("spanning_n").alias("spanning_count"),
            (F.sum("n") - F.sum("spanning_n")).alias("non_spanning_count"),
        )
    )


def shared_issuers(membership: DataFrame, left: str, right: str) -> DataFrame:
    """Issuers found in both cohorts."""
    def of(cohort: str) -> DataFrame:
        return membership.where(F.col("cohort") == cohort).select("issuer")

    return of(left).intersect(of(right))


def score_micro_macro(pairs: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Micro: one score over all grids.  Macro: mean of the table scores.

    Each metric comes as ``<metric>_matched``; sizes are ``reference_size`` and ``prediction_size``.
    """
    sizes = "sum(reference_size + prediction_size)"
    parts = ["count(1) AS document_count"]
    for metric in metrics:
        parts.append(f"2 * sum({metric}_matched) / {sizes} AS micro_{metric}")
        parts.append(f"avg(2 * {metric}_matched / (reference_size + prediction_size)) AS macro_{metric}")
    return pairs.groupBy(*keys).agg(*[F.expr(part) for part in parts])


def summary_stats(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, median, 5th and 95th percentile, minimum and maximum."""
    present = df.where(F.col(value).isNotNull())
    keys = list(keys)
    base = present if keys else present.withColumn("_all", F.lit(1))
    by = keys or ["_all"]
    moments = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("minimum"), F.max(value).alias("maximum"),
    )
    quantiles = exact_percentiles(base, value, {"median": 0.5, "p05": 0.05, "p95": 0.95}, by)
    return moments.join(quantiles, by).drop("_all")


def mean_squared_error(df: DataFrame, prediction: str, target: str, keys: Sequence[str] = ()) -> DataFrame:
    error = F.col(prediction) - F.col(target)
    return df.groupBy(*keys).agg(F.avg(error * error).alias("mse"))


def spearman(df: DataFrame, predicted: str, observed: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with average ranks for ties; null with a reason when one side is constant."""
    keys = list(keys)
    ranked = with_midrank(df.select(*keys, predicted, observed), predicted, keys, "_rp")
    ranked = with_midrank(ranked, observed, keys, "_ro")
    parts = ranked.groupBy(*keys).agg(
        F.try_divide(F.covar_pop("_rp", "_ro"), F.stddev_pop("_rp") * F.stddev_pop("_ro")).alias("_corr"),
        (F.min(predicted) == F.max(predicted)).alias("_flat_p"),
        (F.min(observed) == F.max(observed)).alias("_flat_o"),
        F.count(F.lit(1)).alias("n"),
    )
    reason = F.when(F.col("_flat_p"), "constant predicted values").when(F.col("_flat_o"), "constant observed values")
    return parts.select(*keys, "n", F.when(reason.isNull(), F.col("_corr")).alias("value"), reason.alias("reason"))


def selection_agreement(scores: DataFrame, left: DataFrame, right: DataFrame, benefit: str = "benefit",
                        id_col: str = "sample_id") -> DataFrame:
    """Rows selected by both routes, one of them, or neither, with their mean quality and benefit."""
    a = left.select(id_col).distinct().withColumn("_a", F.lit(True))
    b = right.select(id_col).distinct().withColumn("_b", F.lit(True))
    flagged = scores.join(a, id_col, "left").join(b, id_col, "left")
    group = (
        F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "left_only")
        .when(F.col("_b"), "right_only").otherwise("neither")
    )
    return flagged.groupBy(group.alias("selection")).agg(
        F.count(F.lit(1)).alias("table_count"), F.avg("primary_con").alias("mean_primary_con"),
        F.avg(benefit).alias("mean_benefit"),
    )


def expert_outcomes(scores: DataFrame, routes: DataFrame, benefit: str = "benefit", status: str = "expert_status",
                    id_col: str = "sample_id") -> DataFrame:
    """Beneficial, harmful, neutral and failed calls per allocation."""
    ok = f"coalesce({status} = 'success', false)"
    return routes.join(scores, id_col).groupBy("allocation").agg(
        F.count(F.lit(1)).alias("calls"),
        F.expr(f"count_if({ok} AND {benefit} > {TIE_TOLERANCE}) AS beneficial"),
        F.expr(f"count_if({ok} AND {benefit} < -{TIE_TOLERANCE}) AS harmful"),
        F.expr(f"count_if({ok} AND abs({benefit}) <= {TIE_TOLERANCE}) AS neutral"),
        F.expr(f"count_if(NOT {ok}) AS failed"),
    )


def reference_characteristics(cells: DataFrame, records: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Rows, columns, spanning cells, cells and text records per reference table."""
    per_table = cells.groupBy(id_col).agg(
        F.max("row_end").alias("row_count"), F.max("column_end").alias("column_count"),
        F.count_if((F.col("row_end") - F.col("row_start") > 1) | (F.col("column_end") - F.col("column_start") > 1))
        .alias("spanning_cell_count"),
        F.count(F.lit(1)).alias("cell_count"),
    )
    texts = records.groupBy(id_col).agg(F.count(F.lit(1)).alias("text_record_count"))
    return per_table.join(texts, id_col, "left").withColumn(
        "text_record_count", F.coalesce("text_record_count", F.lit(0))
    )


def cluster_totals(rows: DataFrame, cluster: str) -> DataFrame:
    """Paired totals per cluster: count and summed differences."""
    return rows.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("deployed_con") - F.col("primary_con")).alias("con_diff"),
        F.sum(F.col("deployed_top") - F.col("primary_top")).alias("top_diff"),
    )


def coverage_summary(df: DataFrame, counters: dict[str, Column | str], keys: Sequence[str] = ()) -> DataFrame:
    """Stage totals: each counter is a condition, counted in one pass."""
    return df.groupBy(*keys).agg(*[
        F.count_if(F.expr(rule) if isinstance(rule, str) else rule).alias(name) for name, rule in counters.items()
    ])


def timing_totals(scores: DataFrame, route: DataFrame, expert: str = "expert", id_col: str = "sample_id") -> DataFrame:
    """Seconds of the primary, of calling the expert everywhere, and of the routed mix."""
    routed = scores.join(route.select(id_col).distinct().withColumn("_routed", F.lit(True)), id_col, "left")
    return routed.agg(
        F.sum("primary_seconds").alias("primary_seconds"),
        F.sum(f"{expert}_seconds").alias("expert_seconds"),
        (F.sum("primary_seconds") + F.sum(F.when(F.col("_routed"), F.col(f"{expert}_seconds")).otherwise(0.0)))
        .alias("hybrid_seconds"),
    )


# ---------------------------------------------------------------- sets

def cohorts_disjoint(membership: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Ids that belong to more than one cohort (empty when the cohorts are disjoint)."""
    return membership.select("cohort", id_col).distinct().groupBy(id_col).agg(
        F.count(F.lit(1)).alias("cohorts")
    ).where(F.col("cohorts") > 1)


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows found on one side only, with the side (empty when both are equal as multisets)."""
    right = right.select(*left.columns)
    only_left = left.exceptAll(right).withColumn("side", F.lit("left"))
    return only_left.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def all_cohorts(*cohorts: DataFrame) -> DataFrame:
    """One work list from several cohorts."""
    result = cohorts[0]
    for cohort in cohorts[1:]:
        result = result.unionByName(cohort, allowMissingColumns=True)
    return result

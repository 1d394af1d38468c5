"""Ranks, running totals and exact percentiles that survive hot groups.

A window over ``partitionBy(group)`` sorts the whole group in one task, and a
window without ``partitionBy`` sorts everything in one task.  The functions here
measure the sizes first.  Groups (or whole tables) of at most ``hot_rows`` rows
take the plain window.  Everything above that takes a range-partitioned sort:
rows keep their position inside their range, ranges are counted, and the (few)
range totals are turned into offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secondpass.session import pin

# A group up to this many rows is sorted by one task without spilling much.
HOT_GROUP_ROWS = 1_000_000
# Rank error of the sketch, as one part in so many, and how far from the wanted share the cuts lie.
_CUT_ACCURACY, _CUT_MARGIN = 10_000, 3e-4
_RANGE_BITS = 33  # monotonically_increasing_id keeps the partition number above bit 33


def hot_groups(df: DataFrame, groups: Sequence[str], hot_rows: int) -> DataFrame | None:
    """Groups with more than ``hot_rows`` rows as columns ``_h0`` …, or None when there are none.

    There is at most one per ``hot_rows`` rows, so they are broadcast: the rows they meet stay where they are.
    """
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    counts = pin(counts.select(*[F.col(group).alias(f"_h{i}") for i, group in enumerate(groups)]), "hot-groups")
    return F.broadcast(counts) if counts.take(1) else None


def _same_group(groups: Sequence[str], prefix: str) -> Column:
    """Null-safe match of group columns with their renamed copies."""
    condition = F.lit(True)
    for i, group in enumerate(groups):
        condition = condition & F.col(group).eqNullSafe(F.col(f"{prefix}{i}"))
    return condition


def is_large(df: DataFrame, rows: int) -> bool:
    """Whether the whole table holds more than ``rows`` rows."""
    return df.agg(F.count(F.lit(1)).alias("n")).first()["n"] > rows


def _ranged(df: DataFrame, order: Sequence[Column | str], drop: Sequence[str] = ()) -> DataFrame:
    """Globally sorted rows with their range number and position inside the range; columns to ``drop`` are only sorted by."""
    placed = pin(df.orderBy(*order).withColumn("_pos", F.monotonically_increasing_id()).drop(*drop), "ranged")
    return placed.withColumn("_range", F.shiftright("_pos", _RANGE_BITS)).withColumn(
        "_slot", F.col("_pos").bitwiseAND((1 << _RANGE_BITS) - 1)
    )


def _range_offsets(placed: DataFrame, total: Column) -> DataFrame:
    """One row per range: the total of all earlier ranges (at most one row per sort partition)."""
    per_range = placed.groupBy("_range").agg(total.alias("_total"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return per_range.select("_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))


def _global_rank(df: DataFrame, order: Sequence[Column | str], name: str, drop: Sequence[str] = ()) -> DataFrame:
    placed = _ranged(df, order, drop)
    offsets = _range_offsets(placed, F.count(F.lit(1)))
    return (
        placed.join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_slot") + F.col("_before") + F.lit(1))
        .drop("_pos", "_range", "_slot", "_before")
    )


def with_rank(
    df: DataFrame,
    order: Sequence[Column | str],
    groups: Sequence[str] = (),
    name: str = "rank",
    hot_rows: int = HOT_GROUP_ROWS,
    bounded: bool = False,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Add the 1-based position of every row in ``order`` (inside ``groups`` if given).

    ``bounded`` says that no group can exceed ``hot_rows`` by construction of the
    keys, so group sizes need not be measured. Columns to ``drop`` are only sorted by.
    """
    groups = list(groups)
    if not groups:
        if is_large(df, hot_rows):
            return _global_rank(df, order, name, drop)
        # At most ``hot_rows`` rows, just counted: one sort is the cheapest way.
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long")).drop(*drop)
    window = Window.partitionBy(*groups).orderBy(*order)
    plain = F.row_number().over(window).cast("long")
    hot = None if bounded else hot_groups(df, groups, hot_rows)
    if hot is None:
        return df.withColumn(name, plain).drop(*drop)
    cold_rows = df.join(hot, _same_group(groups, "_h"), "left_anti").withColumn(name, plain).drop(*drop)
    ranked = _global_rank(df.join(hot, _same_group(groups, "_h"), "left_semi"), [*groups, *order], "_global", drop)
    starts = ranked.groupBy(*groups).agg((F.min("_global") - 1).alias("_start"))
    renamed = starts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_start")
    hot_rows_ranked = ranked.join(F.broadcast(renamed), _same_group(groups, "_g")).withColumn(name, F.col("_global") - F.col("_start"))
    return cold_rows.unionByName(hot_rows_ranked.select(*cold_rows.columns))


def first_rows(df: DataFrame, order: Sequence[Column | str], key: Column, count: int) -> DataFrame:
    """The first ``count`` rows in ``order``, without sorting the others.

    ``key`` is a double that never falls along ``order`` (equal keys are allowed). A
    mergeable sketch of the keys gives two cuts around the wanted place. Rows before the
    first are in, rows after the second are out, and only those between are ranked. The cuts are
    checked by counting, so the result is exact; were they wrong, all rows would be between.
    """
    if count <= 0:
        return df.limit(0)
    (name,) = [next(n for n in (f"_key{i}" for i in range(len(df.columns) + 1)) if n not in df.columns)]
    keyed = df.withColumn(name, key)
    total = keyed.count()
    if total <= count:
        return df
    share = count / total
    cuts = keyed.agg(F.percentile_approx(name, [max(0.0, share - _CUT_MARGIN), min(1.0, share + _CUT_MARGIN)], _CUT_ACCURACY)).first()[0]
    before, between = F.col(name) < F.lit(cuts[0]), (F.col(name) >= F.lit(cuts[0])) & (F.col(name) <= F.lit(cuts[1]))
    sure, near = keyed.agg(F.count_if(before), F.count_if(between)).first()
    if not sure <= count <= sure + near:
        before, between, sure = F.lit(False), F.lit(True), 0
    ranked = with_rank(keyed.where(between), order, name=f"{name}_rank")
    rest = ranked.where(F.col(f"{name}_rank") <= count - sure)
    return keyed.where(before).select(*df.columns).unionByName(rest.select(*df.columns))


def descending_key(value: str | Column) -> Column:
    """A key for ``first_rows`` along descending ``value``: NaN first, null last."""
    value = F.col(value).cast("double") if isinstance(value, str) else value.cast("double")
    return F.coalesce(F.when(F.isnan(value), F.lit(float("-inf"))).otherwise(-value), F.lit(float("inf")))


def _global_running(df: DataFrame, order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    placed = _ranged(df, order)
    offsets = _range_offsets(placed, F.sum(value))
    local = Window.partitionBy("_range").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_local", F.sum(value).over(local))
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop("_pos", "_range", "_slot", "_before", "_local")
    )


def with_running_total(
    df: DataFrame,
    order: Sequence[Column | str],
    value: str,
    groups: Sequence[str] = (),
    name: str = "running",
    hot_rows: int = HOT_GROUP_ROWS,
    bounded: bool = False,
) -> DataFrame:
    """Add the inclusive running total of ``value`` in ``order`` (inside ``groups`` if given; ``bounded`` as in ``with_rank``)."""
    groups = list(groups)
    if not groups:
        if is_large(df, hot_rows):
            return _global_running(df, order, value, name)
        whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value).over(whole))
    window = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    hot = None if bounded else hot_groups(df, groups, hot_rows)
    if hot is None:
        return df.withColumn(name, F.sum(value).over(window))
    cold_rows = df.join(hot, _same_group(groups, "_h"), "left_anti").withColumn(name, F.sum(value).over(window))
    # Sums restart at every group: inside a range by the window, across ranges by the sums of the group's earlier runs.
    placed = _ranged(df.join(hot, _same_group(groups, "_h"), "left_semi"), [*groups, *order])
    runs = placed.groupBy("_range", *groups).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_range").alias("_r"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.sum("_total").over(earlier).alias("_before"),
    )
    local = Window.partitionBy("_range", *groups).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_local", F.sum(value).over(local)).join(
        F.broadcast(runs), (F.col("_range") == F.col("_r")) & _same_group(groups, "_g")
    )
    # Null only while the group has had no value yet, as a plain window has it.
    hot_totals = summed.withColumn(name, F.coalesce(F.col("_local") + F.col("_before"), "_local", "_before"))
    return cold_rows.unionByName(hot_totals.select(*df.columns, name))


def with_midrank(df: DataFrame, value: str, groups: Sequence[str] = (), name: str = "midrank") -> DataFrame:
    """Average rank of tied values.  Values are counted first, so ties never meet in one task."""
    groups = list(groups)
    counts = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_peers"))
    placed = with_running_total(counts, [value], "_peers", groups, "_upto")
    ranks = placed.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col(value).alias("_value"),
        (F.col("_upto") - (F.col("_peers") - 1) / 2.0).alias(name),
    )
    return df.join(ranks, _same_group(groups, "_g") & F.col(value).eqNullSafe(F.col("_value"))).drop("_value", *[f"_g{i}" for i in range(len(groups))])


def exact_percentiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    groups: Sequence[str] = (),
    hot_rows: int = HOT_GROUP_ROWS,
    bounded: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolation percentiles, exact for any group size (``bounded`` as in ``with_rank``).

    ``weight`` names a column of whole counts for rows that were counted before.

    ``probabilities`` maps output column to probability.  Nulls are ignored.
    Returns one row per group with at least one value.
    """
    groups = list(groups)
    count = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    present = df.where(F.col(value).isNotNull()).select(
        *groups, F.col(value).cast("double").alias("_v"), count.alias("_w"))
    if groups and (bounded or hot_groups(present, groups, hot_rows) is None):
        return present.groupBy(*groups).agg(
            *[F.percentile("_v", F.lit(p), F.col("_w")).alias(column) for column, p in probabilities.items()]
        )
    if not groups:
        present = present.withColumn("_all", F.lit(1))
    keys = groups or ["_all"]
    counts = present.groupBy(*keys, "_v").agg(F.sum("_w").alias("_c"))
    running = with_running_total(counts, ["_v"], "_c", groups, "_upto", hot_rows)
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    joined = running.join(totals, keys)
    picks = []
    for i, p in enumerate(probabilities.values()):
        at = (F.col("_n") - 1) * F.lit(float(p))
        picks.append(F.min(F.when(F.col("_upto") > F.floor(at), F.col("_v"))).alias(f"_lo{i}"))
        picks.append(F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_v"))).alias(f"_hi{i}"))
    picked = joined.groupBy(*keys).agg(F.first("_n").alias("_n"), *picks)
    output = []
    for i, (column, p) in enumerate(probabilities.items()):
        at = (F.col("_n") - 1) * F.lit(float(p))
        weight = at - F.floor(at)
        output.append((F.col(f"_lo{i}") + weight * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(column))
    return picked.select(*groups, *output)

"""Exact allocation of a budget over several actions per record.

Records with a whole-table action only need no search: the best ``k`` calls are
the ``k`` largest benefits.  Records with local actions form a multiple-choice
knapsack.  It is solved for bounded chunks of records side by side.  Chunk results
are merged pairwise by (max, +) convolution: a merge is dealt to tasks by blocks of
the cost it puts out, so the last merges of one large segment use many tasks too.
States carry numbers only.  What a state consists of is a row that points back to
the costs of its two parts, and choices are read by walking down from the budgets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from secondpass.functions import choices
from secondpass.operators.expectations import ACTIONS, LOCAL_ACTIONS, WHOLE_TABLE_COST
from secondpass.operators.order import with_rank, with_running_total
from secondpass.session import pin, spread

# Smallest benefit of an action worth taking, and the digits benefits are compared with.
BENEFIT_TOLERANCE = 1e-12
_DIGITS = 12


def eligible_actions(actions: DataFrame) -> DataFrame:
    """Available actions; all but retaining need a positive benefit."""
    return actions.where(f"available AND (action = 'retain_primary' OR benefit > {BENEFIT_TOLERANCE})")


def preference() -> list:
    """Order of actions of one record, best first.

    Benefits are rounded first: comparing with a tolerance is not transitive.
    """
    whole = F.when(F.col("action") == "whole_table", 1).otherwise(0)
    return [F.desc(F.round("benefit", _DIGITS)), F.asc("cost"), F.asc(F.col("area_num") / F.col("area_den")),
            F.asc("footprint"), whole.asc(), F.asc("action_rank")]


def best_action(actions: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Best eligible action per record when the budget does not bind."""
    sort_key = F.struct(
        (-F.round("benefit", _DIGITS)).alias("b"), "cost", (F.col("area_num") / F.col("area_den")).alias("a"), "footprint",
        F.when(F.col("action") == "whole_table", 1).otherwise(0).alias("w"), "action_rank",
    )
    rest = [c for c in actions.columns if c != id_col]
    best = eligible_actions(actions).groupBy(id_col).agg(F.min_by(F.struct(*rest), sort_key).alias("_best"))
    return best.select(id_col, "_best.*")


def _whole_ranked(actions: DataFrame, id_col: str, segment: Sequence[str]) -> DataFrame:
    """Positive whole-table calls in the order they are bought, with running totals."""
    calls = eligible_actions(actions).where("action = 'whole_table'")
    # On equal benefit the smaller footprint, then the later id: earlier ids retain first.
    order = [F.desc(F.round("benefit", _DIGITS)), F.asc("footprint"), F.desc(id_col)]
    ranked = with_rank(calls, order, list(segment), "k")
    return with_running_total(ranked, ["k"], "benefit", list(segment), "total_benefit")


def whole_table_frontier(actions: DataFrame, budgets: Sequence[int], segment: Sequence[str] = (),
                         id_col: str = "sample_id") -> DataFrame:
    """Exact optimum per budget with whole-table calls only."""
    segment = list(segment)
    ranked = pin(_whole_ranked(actions, id_col, segment), "calls")
    grid = ", ".join(f"{int(b)}L" for b in budgets)
    # The total at a budget is the running total of the last affordable call.
    cases = F.expr(f"explode(filter(array({grid}), b -> k * {WHOLE_TABLE_COST}L <= b))")
    best = ranked.select(*segment, "k", "total_benefit", cases.alias("budget")).groupBy(*segment, "budget").agg(
        F.max("k").alias("calls"), F.max_by("total_benefit", "k").alias("total_benefit"))
    every = actions.select(*segment).distinct() if segment else actions.sparkSession.range(1).select()
    wanted = every.select(*segment, F.explode(F.expr(f"array({grid})")).alias("budget"))
    return wanted.join(best, [*segment, "budget"], "left").selectExpr(
        *segment, "budget", "coalesce(calls, 0L) AS calls", f"coalesce(calls, 0L) * {WHOLE_TABLE_COST}L AS used_cost",
        "coalesce(total_benefit, 0D) AS total_benefit")


def exact_k_frontier(actions: DataFrame, segment: Sequence[str] = (), id_col: str = "sample_id") -> DataFrame:
    """Best total benefit for exactly ``k`` positive calls, for every ``k``."""
    return _whole_ranked(actions, id_col, list(segment)).select(*segment, "k", id_col, "benefit", "total_benefit")


# ---------------------------------------------------------------- multiple choice

# A frontier state: cost → (benefit, area, footprint, whole calls) and its place among the states of its node in the
# order of chosen ranks. Areas are exact fractions; between tasks they travel as text ("3/8").
_STATE = "cost bigint, benefit double, area string, footprint double, whole bigint, place bigint"
_PAIRS = 1 << 22  # pairs of states that one task of a merge looks at, about


def _better(a: tuple, b: tuple) -> bool:
    """Whether state ``a`` beats ``b`` of the same cost."""
    return (-round(a[0], _DIGITS), *a[1:]) < (-round(b[0], _DIGITS), *b[1:])


def _plain_states(options: Sequence[tuple], limit: int) -> list[tuple]:
    """States of one chunk from options ``(record, cost, benefit, area, footprint, whole, rank)``, in the order of cost."""
    menus: dict[int, list[tuple]] = {}
    for record, *option in options:
        menus.setdefault(record, []).append(tuple(option))
    states = {0: (0.0, Fraction(0), 0.0, 0, "")}
    for record in sorted(menus):
        states = _combine(states, menus[record], limit)
    return [(cost, *state) for cost, state in sorted(states.items())]


_NUMBERS = ("record", "benefit", "cost", "area_num", "area_den", "footprint", "whole", "action_rank")
_BATCH_ROWS = 200_000  # options solved together


def _chunk_solver(limit: int, budgets: Sequence[int], keys: Sequence[str], chunk_records: int):
    """States of chunks whose options come sorted by chunk and record.

    A chunk that is not full is the only one of its segment: of it, only the states that are best within a budget are needed.
    """
    names = [*keys, "chunk"]

    def solved(rows: pa.Table) -> pa.Table:
        for name in _NUMBERS:
            if rows[name].null_count:
                raise ValueError(f"eligible actions without {name}")
        columns = {name: rows[name].to_numpy() for name in _NUMBERS}
        marks = np.zeros(len(rows) - 1, bool)
        for name in names:
            column = rows[name].chunk(0)
            differs = pc.invert(pc.equal(column.slice(1), column.slice(0, len(column) - 1)))
            nulls = pc.is_null(column).to_numpy(zero_copy_only=False)
            marks |= pc.fill_null(differs, False).to_numpy(zero_copy_only=False) | (nulls[1:] != nulls[:-1])
        starts = np.concatenate([[0], np.flatnonzero(marks) + 1])
        group = np.concatenate([[0], np.cumsum(marks)])
        counts = np.diff(np.append(starts, len(rows)))
        record, cost, rank = columns["record"].astype(np.int64), columns["cost"].astype(np.int64), columns["action_rank"].astype(np.int64)
        unit = math.lcm(*map(int, np.unique(columns["area_den"])))
        area, largest = None, max(abs(int(columns["area_num"].min())), abs(int(columns["area_num"].max())))
        if unit < 2**31 and largest < 2**31:
            area = columns["area_num"].astype(np.int64) * (unit // columns["area_den"].astype(np.int64))
        records = np.maximum.reduceat(record, starts) + 1
        single = (rows["chunk"].to_numpy()[starts] == 0) & (records < chunk_records)
        exact = np.zeros(len(starts), bool)
        if area is not None and not (cost < 0).any():
            divisor = max(1, math.gcd(*np.unique(cost).tolist(), 0))
            exact = choices.solvable(cost, rank, area, int(records.max()), choices.widths(group, record, cost // divisor, limit // divisor))
        found = choices.solve(group, record, {
            "cost": cost, "benefit": columns["benefit"], "area": area, "footprint": columns["footprint"].astype(np.float64),
            "whole": columns["whole"].astype(np.int64), "rank": rank}, limit, [int(b) for b in budgets], single, np.flatnonzero(exact)) if exact.any() else {
                name: np.zeros(0, np.int64) for name in ("group", "cost", "benefit", "area", "footprint", "whole", "high", "low")}
        texts = {int(a): str(Fraction(int(a), unit)) for a in np.unique(found["area"])}
        half = choices._HALF
        ranks = [f"{high:0{min(n, half)}d}" + (f"{low:0{n - half}d}" if n > half else "") for high, low, n in zip(
            found["high"].tolist(), found["low"].tolist(), records[found["group"].astype(np.int64)].tolist())]
        states = list(zip(found["group"].tolist(), found["cost"].tolist(), found["benefit"].tolist(), [texts[a] for a in found["area"].tolist()],
                          found["footprint"].tolist(), found["whole"].tolist(), ranks))
        for g in np.flatnonzero(~exact).tolist():  # odd costs, areas or ranks
            part = slice(int(starts[g]), int(starts[g] + counts[g]))
            options = zip(record[part].tolist(), cost[part].tolist(), columns["benefit"][part].tolist(),
                          [Fraction(int(n), int(d)) for n, d in zip(columns["area_num"][part].tolist(), columns["area_den"][part].tolist())],
                          columns["footprint"][part].tolist(), columns["whole"][part].tolist(), map(str, columns["action_rank"][part].tolist()))
            states += [(g, c, b, str(a), f, w, r) for c, b, a, f, w, r in _plain_states(list(options), limit)]
        # The place of a state in the order of chosen ranks, for merges of chunks.
        states.sort(key=lambda state: (state[0], state[-1]))
        at, place, last = np.array([state[0] for state in states], np.int64), [], None
        for state in states:
            place.append(0 if state[0] != last else place[-1] + 1)
            last = state[0]
        held = [rows[name].chunk(0).take(pa.array(starts[at])) for name in names]
        values = list(zip(*[state[1:] for state in states])) or [()] * 6
        kinds = (pa.int64(), pa.float64(), pa.string(), pa.float64(), pa.int64(), pa.string())
        cost_, benefit, text, footprint, whole, ranks_ = (pa.array(v, kind) for v, kind in zip(values, kinds))
        return pa.Table.from_arrays([*held, cost_, benefit, text, footprint, whole, pa.array(place, pa.int64()), ranks_],
                                    [*names, "cost", "benefit", "area", "footprint", "whole", "place", "ranks"])

    def solve(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < _BATCH_ROWS:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            # The last chunk may go on in the next batch.
            last = len(rows) - 1
            while last and all(rows[name][last - 1].equals(rows[name][-1]) for name in names):
                last -= 1
            if last:
                yield from solved(rows.slice(0, last).combine_chunks()).to_batches()
            held, size = rows.slice(last).combine_chunks().to_batches(), len(rows) - last
        if size:
            yield from solved(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return solve


def _combine(states: dict, options: list[tuple], limit: int) -> dict:
    """Best state per cost after adding one of the options to one of the states."""
    reached: dict = {}
    for cost, (benefit, area, footprint, whole, ranks) in states.items():
        for o_cost, o_benefit, o_area, o_footprint, o_whole, o_ranks in options:
            total = cost + o_cost
            if total > limit:
                continue
            held = reached.get(total)
            # Most candidates lose on benefit alone; only close ones are built and compared.
            if held is None or benefit + o_benefit > held[0] - 2 * BENEFIT_TOLERANCE:
                state = (benefit + o_benefit, area + o_area, footprint + o_footprint, whole + o_whole, ranks + o_ranks)
                if held is None or _better(state, held):
                    reached[total] = state
    # A dearer state without more benefit can never end up in the optimum.
    kept, best = {}, None
    for total in sorted(reached):
        if best is None or round(reached[total][0], _DIGITS) > best:
            kept[total], best = reached[total], round(reached[total][0], _DIGITS)
    return kept


def _keyed(frame: pd.DataFrame, rows: pd.DataFrame, keys: Sequence[str]) -> pd.DataFrame:
    for key in keys:
        frame.insert(0, key, pd.Series([rows[key].iloc[0]] * len(frame), dtype=rows[key].dtype))
    return frame


def convolve(left: pd.DataFrame, right: pd.DataFrame, low: int, high: int) -> pd.DataFrame:
    """Best sum of a left and a right state for every total cost in [low, high), with the costs of its parts.

    Equal benefits go to the smaller area, footprint, number of whole calls and chosen ranks, in this order.
    """
    left, right = left.sort_values("cost"), right.sort_values("cost")
    unit = math.lcm(*[Fraction(a).denominator for a in {*left["area"], *right["area"]}] or [1])
    areas = [np.array([int(Fraction(a) * unit) for a in side["area"]], dtype=object) for side in (left, right)]
    if sum(max(map(abs, a), default=0) for a in areas) < 2**62:
        areas = [a.astype(np.int64) for a in areas]
    width = high - low
    empty = np.zeros(width, dtype=np.int64)
    # benefit as compared, then the tie breakers, then what is carried along
    best = [np.full(width, -np.inf), np.zeros(width, areas[0].dtype), np.zeros(width), *[empty.copy() for _ in range(3)]]
    value, from_left, from_right = np.zeros(width), empty.copy(), empty.copy()
    costs, benefits, footprints, wholes, places = (right[c].to_numpy() for c in ("cost", "benefit", "footprint", "whole", "place"))
    for i, (cost, benefit, footprint, whole, place) in enumerate(left[["cost", "benefit", "footprint", "whole", "place"]].itertuples(index=False, name=None)):
        some = slice(*np.searchsorted(costs, [low - cost, high - cost]))
        at = costs[some] + cost - low
        total = benefit + benefits[some]
        new = [np.round(total, _DIGITS), areas[0][i] + areas[1][some], footprint + footprints[some],
               whole + wholes[some], np.full(len(at), place), places[some]]
        wins, even = new[0] > best[0][at], new[0] == best[0][at]
        for mine, held in zip(new[1:], best[1:]):
            if not even.any():
                break
            old = held[at]
            wins |= even & (mine < old).astype(bool)
            even &= (mine == old).astype(bool)
        to = at[wins]
        for mine, held in zip(new, best):
            held[to] = mine[wins]
        value[to], from_left[to], from_right[to] = total[wins], cost, costs[some][wins]
    hit = np.flatnonzero(best[0] > -np.inf)
    return pd.DataFrame({
        "cost": hit + low, "benefit": value[hit], "area": pd.Series([str(Fraction(int(a), unit)) for a in best[1][hit]], dtype=object),
        "footprint": best[2][hit], "whole": best[3][hit], "left_place": best[4][hit], "right_place": best[5][hit],
        "left_cost": from_left[hit], "right_cost": from_right[hit]})


def _block_merger(keys: Sequence[str]):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
        result = convolve(rows[rows["side"] == 0], rows[rows["side"] == 1], low, high)
        result.insert(0, "chunk", np.full(len(result), rows["chunk"].iloc[0]))
        return _keyed(result, rows, keys)

    return merge


def _merge_level(states: DataFrame, limit: int, keys: list[str], key_ddl: str) -> DataFrame:
    """Neighbouring chunks merged: states of the next level with the costs of their parts (right null where none)."""
    sided = states.withColumn("side", F.col("chunk") % 2).withColumn("chunk", F.floor(F.col("chunk") / 2))
    node = [*keys, "chunk"]
    sizes = sided.groupBy(*node).agg(*[
        F.coalesce(f(F.when(F.col("side") == side, F.col("cost"))), F.lit(0)).alias(f"_{what}{side}")
        for side in (0, 1) for what, f in (("n", F.count), ("dearest", F.max))])
    sizes = sizes.withColumn("_top", F.least(F.lit(limit), F.col("_dearest0") + F.col("_dearest1")) + 1)
    sizes = sizes.withColumn("_blocks", F.least(F.col("_top"), F.ceil(F.col("_n0") * F.col("_n1") / _PAIRS)))
    sizes = sizes.withColumn("_width", F.ceil(F.col("_top") / F.greatest("_blocks", F.lit(1))))
    sided = pin(sided.join(sizes, node), "sides")
    alone = sided.where("_n1 = 0")
    # A state meets the blocks of total costs that it can reach with any state of the other side.
    other = F.when(F.col("side") == 0, F.col("_dearest1")).otherwise(F.col("_dearest0"))
    first = F.floor(F.col("cost") / F.col("_width"))
    last = F.floor(F.least(F.col("cost") + other, F.col("_top") - 1) / F.col("_width"))
    dealt = sided.where(F.col("_n1") > 0).withColumn("_block", F.explode(F.sequence(first, last)))
    dealt = dealt.withColumn("low", F.col("_block") * F.col("_width")).withColumn(
        "high", F.least(F.col("low") + F.col("_width"), "_top"))
    merged = spread(dealt, *node, "_block").groupBy(*node, "_block").applyInPandas(_block_merger(list(reversed(keys))), (
        f"{key_ddl}, chunk bigint, cost bigint, benefit double, area string, footprint double, whole bigint, "
        "left_place bigint, right_place bigint, left_cost bigint, right_cost bigint"))
    # A node has one state per cost, at most limit + 1. A dearer state without more benefit is dropped, across blocks.
    cheaper = Window.partitionBy(*node).orderBy("cost").rowsBetween(Window.unboundedPreceding, -1)
    compared = F.round("benefit", _DIGITS)
    merged = merged.withColumn("_best", F.max(compared).over(cheaper)).where(F.col("_best").isNull() | (compared > F.col("_best")))
    by_ranks = Window.partitionBy(*node).orderBy("left_place", "right_place")
    merged = merged.withColumn("place", F.row_number().over(by_ranks).cast("long"))
    names = [*node, "cost", "benefit", "area", "footprint", "whole", "place", "left_cost", "right_cost"]
    alone = alone.withColumn("left_cost", F.col("cost")).withColumn("right_cost", F.lit(None).cast("long"))
    return merged.select(*names).unionByName(alone.select(*names))


def contenders(options: DataFrame, limit: int, keys: Sequence[str]) -> DataFrame | None:
    """Records (keys, sample_id) that an optimum within ``limit`` may pay for, or None where that would drop few.

    Were a payment of a cost in an optimum and not among the best of that cost, one of the better ones would be
    for a record that is retained, and paying for that record instead would be better. So the best of every cost are
    enough, one more than what is left of the limit can pay for. Equal ones are better the later their record is,
    as chosen ranks are compared in the order of ids. Records not retained at cost and value 0 by their lowest rank always stay.
    """
    paid = F.col("cost") > 0
    sizes = options.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(paid, F.col("cost"))).alias("least"), F.min("cost").alias("lowest"))
    largest, least, lowest = sizes.agg(F.max("n"), F.min("least"), F.min("lowest")).first()
    most = max(1, limit // least) if least else 1  # records paid for at once
    if not largest or largest <= 16 * most or not least or lowest < 0:
        return None
    record = [*keys, "sample_id"]
    own = Window.partitionBy(*record)
    still = "cost = 0 AND benefit = 0 AND area_num = 0 AND footprint = 0"
    plain = (F.min("cost").over(own) == 0) & (F.count_if(F.col("cost") == 0).over(own) == 1) & (
        F.min_by(F.expr(f"coalesce({still}, false)"), "action_rank").over(own))
    marked = options.withColumn("_plain", plain)
    better = [F.desc(F.round("benefit", _DIGITS)), F.col("area_num") / F.col("area_den"), "footprint", F.col("action") == "whole_table"]
    best = marked.where(F.col("_plain") & paid & (F.col("cost") <= limit)).withColumn(
        "_own", F.row_number().over(Window.partitionBy(*record, "cost").orderBy(*better, "action_rank"))).where("_own = 1")
    order = [*better, F.desc("sample_id")]
    if most <= 1000:  # sorted in every task first, which passes on that many rows only
        best = best.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "cost").orderBy(*order)))
    else:
        best = with_rank(best, order, [*keys, "cost"], "_place")
    best = best.where(F.col("_place") <= most).where(
        F.col("_place") <= 1 + F.floor((F.lit(limit) - F.col("cost")) / F.lit(least)))
    # A segment keeps one record at least.
    last = options.groupBy(*keys).agg(F.max("sample_id").alias("sample_id"))
    special = marked.where(~F.col("_plain")).select(*record)
    return pin(best.select(*record).unionByName(special).unionByName(last.select(*record)).distinct(), "contenders")


def search_choices(actions: DataFrame, budgets: Sequence[int], segment: Sequence[str] = ("segment",),
                   id_col: str = "sample_id", chunk_records: int = 32) -> tuple[DataFrame, DataFrame]:
    """Exact best choice of one action per record, per segment and budget.

    Returns the frontier (cost, benefit, area as an exact fraction in text, footprint, whole-table calls
    per segment and budget) and the choices (segment, budget, id, action_rank) that make it up.
    """
    keys = list(segment)
    limit = int(max(budgets))
    options = eligible_actions(actions).select(
        *keys, F.col(id_col).alias("sample_id"), "action", "action_rank", "benefit", "cost", "area_num", "area_den", "footprint")
    record, retained = [*keys, "sample_id"], None
    if (some := contenders(options, limit, keys)) is not None:
        # All others have one action without cost, by which they are retained.
        retained = options.where("cost = 0").join(some, record, "left_anti").select(*record, "action_rank")
        options = pin(options.join(some, record, "left_semi"), "contenders")
    ids = pin(with_rank(options.select(*keys, "sample_id").distinct(), ["sample_id"], keys, "_n"), "record-numbers")
    place = F.col("_n") - 1
    chunked = options.join(ids, [*keys, "sample_id"]).select(
        *keys, F.floor(place / chunk_records).alias("chunk"), (place % chunk_records).alias("record"), "benefit", F.col("cost").cast("long").alias("cost"),
        F.col("area_num").cast("long").alias("area_num"), F.col("area_den").cast("long").alias("area_den"), F.col("footprint").cast("double").alias("footprint"),
        (F.col("action") == "whole_table").cast("int").alias("whole"), "action_rank")
    types = {f.name: f.dataType.simpleString() for f in actions.schema}
    key_ddl = ", ".join(f"{k} {types[k]}" for k in keys)
    solved = pin(spread(chunked, *keys, "chunk").sortWithinPartitions(*keys, "chunk", "record").mapInArrow(
        _chunk_solver(limit, budgets, keys, chunk_records), f"{key_ddl}, chunk bigint, {_STATE}, ranks string"), "frontier")
    levels, states = [], solved.drop("ranks")
    chunks = solved.agg(F.max("chunk")).first()[0] or 0
    while chunks:
        # Neighbours in id order meet, so the order of chosen ranks is that of the parts.
        states = pin(_merge_level(states, limit, keys, key_ddl), "frontier")
        levels.append(states)
        states, chunks = states.drop("left_cost", "right_cost"), chunks // 2
    grid = ", ".join(f"{int(b)}L" for b in budgets)
    reachable = states.select("*", F.explode(F.expr(f"filter(array({grid}), b -> cost <= b)")).alias("budget"))
    # Kept states rise strictly in benefit with their cost, so the best affordable one is unique.
    sort_key = F.struct((-F.round("benefit", _DIGITS)).alias("b"), "cost")
    value = F.struct("cost", "benefit", "area", "footprint", "whole")
    frontier = pin(reachable.groupBy(*keys, "budget").agg(F.min_by(value, sort_key).alias("_best")).select(
        *keys, "budget", "_best.*"), "frontier")
    wanted = frontier.select(*keys, "budget", F.lit(0).cast("long").alias("chunk"), "cost")
    for level in reversed(levels):
        parts = wanted.join(level.select(*keys, "chunk", "cost", "left_cost", "right_cost"), [*keys, "chunk", "cost"])
        both = F.array(F.struct((F.col("chunk") * 2).alias("chunk"), F.col("left_cost").alias("cost")),
                       F.struct((F.col("chunk") * 2 + 1).alias("chunk"), F.col("right_cost").alias("cost")))
        wanted = parts.select(*keys, "budget", F.inline(both)).where("cost IS NOT NULL")
    picks = wanted.join(solved.select(*keys, "chunk", "cost", "ranks"), [*keys, "chunk", "cost"]).select(
        *keys, "budget", "chunk", F.posexplode(F.split("ranks", "(?!^)(?!$)")).alias("_p", "_r"))
    picks = picks.select(*keys, "budget", (F.col("chunk") * chunk_records + F.col("_p") + 1).alias("_n"),
                         F.col("_r").cast("int").alias("action_rank"))
    picks = picks.join(ids, [*keys, "_n"]).select(*keys, "budget", F.col("sample_id").alias(id_col), "action_rank")
    if retained is not None:
        rest = retained.join(frontier.select(*keys, "budget"), keys).select(
            *keys, "budget", F.col("sample_id").alias(id_col), F.col("action_rank").cast("int").alias("action_rank"))
        picks = picks.unionByName(rest)
    return frontier, picks


def choice_frontier(actions: DataFrame, budgets: Sequence[int], segment: Sequence[str] = ("segment",),
                    id_col: str = "sample_id", chunk_records: int = 32) -> DataFrame:
    """The frontier of ``search_choices``."""
    return search_choices(actions, budgets, segment, id_col, chunk_records)[0]


def chosen_actions(choices: DataFrame, actions: DataFrame, segment: Sequence[str] = ("segment",), id_col: str = "sample_id") -> DataFrame:
    """One action row per record and budget."""
    return choices.join(actions, [*segment, id_col, "action_rank"])


def frontier_record(chosen: DataFrame, segment: Sequence[str] = ("segment",)) -> DataFrame:
    """Summary of chosen actions per segment and budget.

    The area is the exact integer ``used_area / area_unit`` wherever all chosen
    actions share their denominator, which ``one_area_unit`` reports.
    """
    keys = [*segment, "budget"]
    local = ", ".join(f"'{name}'" for name in LOCAL_ACTIONS)
    return chosen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("selected_count"), F.avg("con").alias("mean_con"), F.avg("top").alias("mean_top"),
        F.sum("benefit").alias("total_benefit"), F.sum("cost").alias("used_cost"),
        F.sum("area_num").alias("used_area"), F.max("area_den").alias("area_unit"),
        (F.min("area_den") == F.max("area_den")).alias("one_area_unit"),
        *[F.expr(f"count_if(action = '{name}') AS {name}_count") for name in ACTIONS],
        F.expr(f"count_if(action IN ({local})) AS local_action_count"),
        (F.sum("cost") <= F.first("budget")).alias("within_budget"),
    )


def full_budget_check(chosen: DataFrame, actions: DataFrame, budget: int, id_col: str = "sample_id") -> DataFrame:
    """Records whose choice at the full budget is not their best action (empty when the search is exact)."""
    best = best_action(actions, id_col).select(id_col, "action_rank")
    at_full = chosen.where(F.col("budget") == int(budget)).select(id_col, "action_rank")
    return at_full.exceptAll(best).unionByName(best.exceptAll(at_full)).select(id_col).distinct()


def headroom(local_frontier: DataFrame, whole_frontier: DataFrame, keys: Sequence[str] = ("segment", "budget")) -> DataFrame:
    """Benefit that local actions add at each budget."""
    whole = whole_frontier.select(*keys, F.col("total_benefit").alias("_whole"))
    return local_frontier.join(whole, list(keys)).select(*keys, (F.col("benefit") - F.col("_whole")).alias("headroom"))


def local_opportunity(actions: DataFrame, id_col: str = "sample_id", group: str = "issuer") -> DataFrame:
    """Records and groups with at least one positive local action."""
    names = ", ".join(f"'{name}'" for name in LOCAL_ACTIONS)
    positive = eligible_actions(actions).where(f"action IN ({names})")
    return positive.agg(F.countDistinct(id_col).alias("positive_table_count"), F.countDistinct(group).alias("positive_group_count"))

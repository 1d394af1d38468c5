"""Best choice of one option per record for many small groups of records side by side.

A group's states lie in a row of a table whose columns are total costs in units of
their common divisor.  One record is added to all groups at a time.  Per cost the
best state stays: highest benefit, then smallest area, footprint, number of whole
calls and chosen ranks.  States that cost more without more benefit are dropped.
"""

from __future__ import annotations

import math

import numpy as np

DIGITS = 12  # digits benefits are compared with
_CELLS = 1 << 20  # cells of one table, about
_WIDEST = 8_192  # costs of a group that are worth a table
_HALF = 16  # chosen ranks that one number holds, as decimal digits


def widths(group: np.ndarray, record: np.ndarray, cost: np.ndarray, limit: int) -> np.ndarray:
    """Reachable costs per group; options lie in the order of groups and records."""
    starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (record[1:] != record[:-1])]))
    return np.minimum(np.bincount(group[starts], np.maximum.reduceat(cost, starts)), limit).astype(np.int64) + 1


def solvable(cost: np.ndarray, rank: np.ndarray, area: np.ndarray, records: int, group_widths: np.ndarray) -> np.ndarray:
    """Groups that a table can solve exactly."""
    if (cost < 0).any() or (rank < 0).any() or (rank > 9).any() or records > 2 * _HALF or int(np.abs(area).max(initial=0)) * records >= 2**62:
        return np.zeros(len(group_widths), bool)
    return group_widths <= _WIDEST


class _Table:
    """States of some groups: benefit, the benefit as compared, and what breaks ties, in this order."""

    def __init__(self, groups: int, width: int) -> None:
        shape = (groups, width)
        self.benefit, self.compared = np.full(shape, -np.inf), np.full(shape, -np.inf)
        self.ties = [np.zeros(shape, kind) for kind in (np.int64, np.float64, np.int64, np.int64, np.int64)]


def _add_option(old: _Table, new: _Table, at: np.ndarray, shift: int, benefit: np.ndarray, steps: list[np.ndarray], scale: list[int]) -> None:
    """Offer the states of the groups ``at`` with one more option to the new table."""
    width = old.benefit.shape[1] - shift
    if width <= 0:
        return
    whole = len(at) == len(old.benefit)
    rows = slice(None) if whole else at
    total = old.benefit[rows, :width] + benefit[:, None]
    compared, held = np.round(total, DIGITS), new.compared[rows, shift:]
    wins = compared > held
    even = np.flatnonzero((compared == held) & (compared > -np.inf))
    room, ties = old.benefit.shape[1], list(zip(range(5), steps, scale))
    if len(even):
        r, c = np.divmod(even, width)
        cell = at[r] * room + c
        for tie, step, factor in ties:
            mine = old.ties[tie].ravel().take(cell) * factor + step.take(r)
            other = new.ties[tie].ravel().take(cell + shift)
            wins.ravel()[even[mine < other]] = True
            same = mine == other
            even, r, cell = even[same], r[same], cell[same]
            if not len(r):
                break
    won = np.flatnonzero(wins)
    r = won // width
    cell = at[r] * room + (won - r * width)
    to = cell + shift
    new.benefit.ravel()[to], new.compared.ravel()[to] = total.ravel().take(won), compared.ravel().take(won)
    for tie, step, factor in ties:
        values = old.ties[tie].ravel().take(cell)
        if factor != 1:
            values *= factor
        values += step.take(r)
        new.ties[tie].ravel()[to] = values


def _solve_table(records: int, width: int, lows: np.ndarray, starts: np.ndarray, ends: np.ndarray, options: dict[str, np.ndarray]) -> _Table:
    """States of groups of equal numbers of records; ``starts`` and ``ends`` are (group, record) positions of options."""
    table = _Table(len(lows), width)
    table.benefit[:, 0] = table.compared[:, 0] = 0.0
    for j in range(records):
        grown = _Table(len(lows), width)
        first, count = starts[:, j], ends[:, j] - starts[:, j]
        half = j < _HALF
        for slot in range(int(count.max())):
            have = np.flatnonzero(count > slot)
            option = first[have] + slot
            cost = options["cost"][option]
            for shift in np.unique(cost).tolist():
                some = cost == shift
                at, chosen = have[some], option[some]
                rank, none = options["rank"][chosen], np.zeros(len(at), np.int64)
                _add_option(table, grown, at, shift, options["benefit"][chosen],
                            [options["area"][chosen], options["footprint"][chosen], options["whole"][chosen], rank if half else none, none if half else rank],
                            [1, 1, 1, 10 if half else 1, 1 if half else 10])
        best = np.maximum.accumulate(grown.compared, axis=1)
        worse = np.zeros(best.shape, bool)
        worse[:, 1:] = grown.compared[:, 1:] <= best[:, :-1]
        grown.benefit[worse] = grown.compared[worse] = -np.inf
        table = grown
    return table


def solve(group: np.ndarray, record: np.ndarray, options: dict[str, np.ndarray], limit: int, budgets: list[int], only_budgets: np.ndarray,
          some: np.ndarray) -> dict[str, np.ndarray]:
    """States of the groups ``some``: those that are best within a budget where ``only_budgets``, else all.

    Options lie in the order of groups and records. Costs, budgets and the limit are in the same unit. Chosen
    ranks come as two numbers, of the first records and of the others.
    """
    unit = max(1, math.gcd(*np.unique(options["cost"]).tolist(), 0))
    options = {**options, "cost": options["cost"] // unit}
    width = widths(group, record, options["cost"], limit // unit)
    cuts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (record[1:] != record[:-1])]))
    ends = np.append(cuts[1:], len(group))
    records = np.bincount(group[cuts], minlength=len(width))
    first = np.cumsum(records) - records
    order = some[np.lexsort((width[some], records[some]))]
    found: dict[str, list] = {name: [] for name in ("group", "cost", "benefit", "area", "footprint", "whole", "high", "low")}
    low = 0
    while low < len(order):
        n = int(records[order[low]])
        high = int(np.searchsorted(records[order], n, side="right"))
        # As many groups as fit a table that is not much wider than most of them need.
        narrow = low + int(np.searchsorted(width[order[low:high]], 2 * width[order[low]] + 8, side="right"))
        at_once = max(1, _CELLS // int(width[order[narrow - 1]]))
        part = order[low:min(narrow, low + at_once)]
        low += len(part)
        places = first[part][:, None] + np.arange(n)
        table = _solve_table(n, int(width[part].max()), part, cuts[places], ends[places], options)
        kept = table.benefit > -np.inf
        wanted = kept & ~only_budgets[part][:, None]
        columns = np.arange(kept.shape[1])
        last = np.maximum.accumulate(np.where(kept, columns, -1), axis=1)
        for budget in budgets:
            best = last[:, min(budget // unit, kept.shape[1] - 1)]
            rows = np.flatnonzero(best >= 0)
            wanted[rows, best[rows]] = True
        r, c = np.nonzero(wanted)
        for name, values in (("group", part[r]), ("cost", c * unit), ("benefit", table.benefit[r, c]),
                             *zip(("area", "footprint", "whole", "high", "low"), (tie[r, c] for tie in table.ties))):
            found[name].append(values)
    return {name: np.concatenate(parts) if parts else np.zeros(0, np.int64) for name, parts in found.items()}

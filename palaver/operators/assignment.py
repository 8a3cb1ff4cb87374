"""Optimal one-to-one assignment per meeting.

The weights of a meeting are one row per pair of names that meet at all, at most speakers x speakers. They go to one task as
that small table and are solved exactly; the time line itself is never grouped by meeting.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_columns(weight: np.ndarray) -> np.ndarray:
    """For each row of a matrix with at least as many columns as rows its column, so that the sum of weights is largest.

    Rows are put in one by one; each goes along the cheapest alternating path to a free column, with prices that keep every
    reduced cost at or over zero, so the work is rows ** 2 x columns.
    """
    rows, columns = weight.shape
    cost = weight.max(initial=0.0) - weight
    row_price, price = np.zeros(rows), np.zeros(columns)
    holder = np.full(columns, -1)
    for start in range(rows):
        reach = cost[start] - row_price[start] - price
        came_from = np.full(columns, start)
        closed = np.zeros(columns, dtype=bool)
        while True:
            at = int(np.where(closed, np.inf, reach).argmin())
            if holder[at] < 0:
                break
            closed[at] = True
            row = holder[at]
            over = reach[at] + cost[row] - row_price[row] - price
            better = ~closed & (over < reach)
            reach[better], came_from[better] = over[better], row
        # prices: what is closed gets as much dearer as it is nearer than the end of the path
        gain = reach[at] - reach[closed]
        row_price[holder[closed]] += gain
        price[closed] -= gain
        row_price[start] += reach[at]
        held = np.full(rows, -1)
        held[holder[holder >= 0]] = np.flatnonzero(holder >= 0)
        while at >= 0:
            row = came_from[at]
            holder[at], at = row, held[row]
            if row == start:
                break
    out = np.full(rows, -1)
    out[holder[holder >= 0]] = np.flatnonzero(holder >= 0)
    return out


def optimal_map(weights: DataFrame, left: str = "r_spk", right: str = "h_spk", weight: str = "overlap_s") -> DataFrame:
    """(meeting_id, left, right): the one-to-one map with the largest sum of weights in every meeting. Pairs without weight are
    not in it; rows without a weight or a name count for nothing. Names are taken in order, so the result is determined."""

    def solve(table: pd.DataFrame) -> pd.DataFrame:
        matrix = table.pivot_table(index=left, columns=right, values=weight, aggfunc="sum", fill_value=0.0).sort_index().sort_index(axis=1)
        w = matrix.to_numpy(dtype=np.float64)
        turned = w.shape[0] > w.shape[1]
        at = best_columns(w.T if turned else w)
        pairs = [(c, r) if turned else (r, c) for r, c in enumerate(at.tolist())]
        pairs = [(r, c) for r, c in pairs if w[r, c] > 0]
        return pd.DataFrame({"meeting_id": table["meeting_id"].iloc[0], left: [matrix.index[r] for r, _ in pairs], right: [matrix.columns[c] for _, c in pairs]}, columns=["meeting_id", left, right])

    usable = weights.filter((F.col(weight) > 0) & F.col(left).isNotNull() & F.col(right).isNotNull()).select("meeting_id", left, right, weight)
    types = {f.name: f.dataType.simpleString() for f in weights.schema.fields}
    return usable.groupBy("meeting_id").applyInPandas(solve, ", ".join(f"`{c}` {types[c]}" for c in ("meeting_id", left, right)))

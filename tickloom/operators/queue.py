"""Queue position under assumptions: when a resting order fills if part of the displayed size is ahead of it.

At a price level each print takes from the size ahead first, and a removal that neither later additions nor
earlier prints explain moves the order up by a share of it. Both rules start at the order's placement, so a
running total from the segment's start doesn't answer them. Two facts make them prefix questions all the same:

* With ``D`` = removed - added - printed, running from anywhere, the unexplained removals from placement to now are
  ``max(0, max of D at removals since - D at placement)``: drawing from two pools in turn is one running maximum.
* The removals that raise that maximum for some order form a forest: the next one is the next removal with a
  greater ``D``. What is credited along a path is a difference of sums to the root.

So an order looks up where its path starts, hops along it to the place where nothing is left ahead, and looks up
the print that completes it, all on arrays of its level and with no row per order and event.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.intervals import first_beyond, first_index_beyond
from tickloom.operators.labels import direction
from tickloom.operators.ordered import BLOCK, ONE_BLOCK, Blocks

FAR = 1 << 61
HOP = 8


def greater_next(values: np.ndarray) -> np.ndarray:
    """Index of the next greater value of each, ``len(values)`` where there is none."""
    n = len(values)
    return first_index_beyond(values, np.arange(1, n + 1), np.full(n, n), values)


def path_sums(values: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of ``weight`` from each index along the path of next greater values to its end.

    The indexes whose paths pass an index are the ones right before it with smaller values, so each weight is
    added to one range: at its first index, and taken off after its last.
    """
    n = len(values)
    back = values[::-1]
    before = first_index_beyond(back, np.arange(1, n + 1), np.full(n, n), back - 1)[::-1]
    change = np.zeros(n + 1, dtype="int64")
    np.add.at(change, n - before, weight)
    change[1:] -= weight
    return np.cumsum(change)[:n]


def _hops(step: np.ndarray) -> list[np.ndarray]:
    """Tables that follow ``step`` by 1, ``HOP``, ``HOP``^2 ... at once, until all have arrived at the end."""
    tables = [step]
    while (tables[-1] < len(step) - 1).any():
        far = tables[-1]
        for _ in range(HOP - 1):
            far = tables[-1][far]
        tables.append(far)
    return tables


class Level:
    """Events of one price level in order; ``size`` is the printed quantity or the change of the displayed one."""

    def __init__(self, ts: np.ndarray, is_print: np.ndarray, size: np.ndarray):
        self.ts = ts
        self.printed = np.cumsum(np.where(is_print, size, 0))
        self.net = -np.cumsum(size)
        self.at = np.flatnonzero(~is_print & (size < 0))
        self.peak = self.net[self.at]
        self.step = np.append(greater_next(self.peak), len(self.at))
        self.tables = _hops(self.step)

    def fills(self, at: np.ndarray, end: np.ndarray, displayed: np.ndarray, lots: int, alphas: Sequence[int], betas: Sequence[int]) -> np.ndarray:
        """Fill stamps, -1 without one: orders x alphas x betas. Windows are open at both ends."""
        n, m = len(self.ts), len(self.at)
        out = np.full((len(at), len(alphas), len(betas)), -1, dtype="int64")
        if not n:
            return out
        first = np.searchsorted(self.ts, at, side="right")
        last = np.searchsorted(self.ts, end, side="left")
        before = lambda total: np.where(first > 0, total[np.maximum(first - 1, 0)], 0)
        printed, net = before(self.printed), before(self.net)
        head = first_index_beyond(self.peak, np.searchsorted(self.at, first), np.full(len(at), m), net) if m else np.zeros(len(at), dtype="int64")
        peak, done = np.append(self.peak, 0), np.append(self.printed[self.at], FAR)
        event = np.append(self.at, n)
        done_at = np.append(self.printed, FAR)
        for b, beta in enumerate(betas):
            gain = np.where(self.step[:-1] < m, peak[self.step[:-1]] - self.peak, 0) * beta // 100
            path = np.append(path_sums(self.peak, gain), 0)
            head_credit = np.where(head < m, (peak[head] - net) * beta // 100, 0)
            for a, alpha in enumerate(alphas):
                ahead = displayed * alpha // 100
                node = self._last_short(head, ahead + printed - head_credit - path[head], done - path)
                on_path = node >= 0
                credit = np.where(on_path, head_credit + path[head] - path[node], 0)
                turn = event[np.where(on_path, self.step[node], head)]
                wanted = printed + ahead - credit
                by_print = np.searchsorted(self.printed, wanted, side="left")
                clear = np.minimum(by_print, turn)
                need = np.where(by_print < turn, wanted, done_at[turn]) + lots
                none_ahead = ahead <= 0
                need = np.where(none_ahead, printed + lots, need)
                hit = np.searchsorted(self.printed, need, side="left")
                filled = (hit < last) & (none_ahead | (clear < last))
                out[filled, a, b] = self.ts[hit[filled]]
        return out

    def _last_short(self, head: np.ndarray, want: np.ndarray, reached: np.ndarray) -> np.ndarray:
        """Last node of each path from ``head`` with ``reached`` below ``want``, -1 if the first one isn't."""
        short = reached[head] < want
        node = np.where(short, head, len(reached) - 1)
        for table in reversed(self.tables):
            for _ in range(HOP - 1):
                far = table[node]
                node = np.where(reached[far] < want, far, node)
        return np.where(short, node, -1)


def queue_grid_fills(
    quotes: DataFrame,
    prints: DataFrame,
    deltas: DataFrame,
    keys: Sequence[str],
    oid: Sequence[str],
    window: int,
    lots: int,
    alphas: Sequence[int],
    betas: Sequence[int],
    blocks: Blocks = ONE_BLOCK,
) -> DataFrame:
    """Quotes (``at_us``, ``side``, ``px``, ``displayed``; unique by ``oid``) x alphas x betas with the fill time of
    ``lots`` in the open window after ``at_us``.

    alpha % of the displayed size is ahead at placement; beta % of each unexplained removal advances the order. A
    print beyond the price fills at once, and wins over a fill at the price only when it is earlier. Events of one
    stamp go prints first, then by ``ord``.

    Work is split by (level, block) with blocks at least a window long, so an event is read by its own block and the
    one before, and an order by one block.
    """
    level = [*keys, "side", "px"]
    wide = blocks.for_python.at_least(window)
    ev = prints.select(*level, "ts_us", F.lit(0).alias("_k"), "ord", F.col("qty").cast("bigint").alias("_x")).unionByName(
        deltas.where("delta <> 0").select(*level, "ts_us", F.lit(1).alias("_k"), "ord", F.col("delta").cast("bigint").alias("_x"))
    )
    ev = wide.assign(wide.assign(ev.where("px IS NOT NULL"), F.col("ts_us") - window, "_b0"), "ts_us", "_b1")
    ev = ev.withColumn(BLOCK, F.explode(F.sequence("_b0", "_b1"))).drop("_b0", "_b1")
    ids = list(dict.fromkeys([*oid, "at_us"]))
    q = wide.assign(quotes.select(*dict.fromkeys([*level, *ids, "displayed"])), "at_us")
    types = dict(quotes.dtypes)
    cells = pd.MultiIndex.from_product([alphas, betas]).to_frame(index=False).astype("int64")

    def fill(orders: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
        events = events.sort_values(["ts_us", "_k", "ord"])
        book = Level(events["ts_us"].to_numpy(), events["_k"].to_numpy() == 0, events["_x"].to_numpy())
        at = orders["at_us"].to_numpy()
        got = book.fills(at, at + window, orders["displayed"].to_numpy(), lots, alphas, betas).reshape(-1)
        out = orders[list(oid)].loc[orders.index.repeat(len(cells))].reset_index(drop=True)
        for i, c in enumerate(("alpha", "beta")):
            out[c] = np.tile(cells[i].to_numpy(), len(orders))
        out["_exact"] = pd.array(np.maximum(got, 0), dtype="Int64")
        out.loc[got < 0, "_exact"] = pd.NA
        return out

    schema = ", ".join(f"`{c}` {types[c]}" for c in oid) + ", alpha bigint, beta bigint, _exact bigint"
    at_quote = q.groupBy(*level, BLOCK).cogroup(ev.groupBy(*level, BLOCK)).applyInPandas(fill, schema)
    thru = first_beyond(quotes, prints, [*keys, "side"], oid, "at_us", F.col("at_us") + window, F.col("px"), -direction(), "ts_us", "px", "_thru", blocks)
    d = thru.join(at_quote, list(oid))
    early = F.col("_thru").isNotNull() & (F.col("_exact").isNull() | (F.col("_thru") < F.col("_exact")))
    return d.withColumns(
        {"fill_us": F.least("_thru", "_exact"), "mechanism": F.when(early, "through").when(F.col("_exact").isNotNull(), "at_quote")}
    ).drop("_thru", "_exact")

"""Segments, grids and point-in-time state from change logs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ordered import BLOCK, ONE_BLOCK, Blocks, asof, island_ids, running, shifted


GRID_STEPS = 4_096


def aligned_grid(spans: DataFrame, start: str, end: str, step: int, out: str) -> DataFrame:
    """Absolute multiples of ``step`` from the first one >= start up to end, one row each.

    A long span is first cut into stretches of ``GRID_STEPS`` steps that are dealt out over all tasks,
    so neither an array nor a task grows with the span.
    """
    first = (F.ceil(F.col(start) / F.lit(step)) * F.lit(step)).cast("bigint")
    spans = spans.withColumn("_first", first).where(F.col("_first") <= F.col(end))
    stretch = F.lit(step * GRID_STEPS)
    cut = spans.withColumn("_from", F.explode(F.sequence("_first", F.col(end), stretch))).repartition("_from")
    last = F.least(F.col(end), F.col("_from") + F.lit(step * (GRID_STEPS - 1)))
    return cut.withColumn(out, F.explode(F.sequence("_from", last, F.lit(step)))).drop("_first", "_from")


def mid_change_path(
    df: DataFrame, keys: Sequence[str], ts: str, mid: str, blocks: Blocks = ONE_BLOCK
) -> DataFrame:
    """Rows at which the mid differs from the previous row of the key; the first row always stays."""
    d = shifted(df, keys, ts, {"_prev": (F.col(mid), 1)}, blocks)
    return d.where(~F.col(mid).eqNullSafe(F.col("_prev"))).drop("_prev")


def both_up_segments(
    df: DataFrame, keys: Sequence[str], ts: str, stream: str, is_open: str, streams: Sequence[str],
    blocks: Blocks = ONE_BLOCK,
) -> DataFrame:
    """Maximal spans during which every stream is up, closed by the row that takes one down."""
    ups = {f"_up_{s}": ("last", F.when(F.col(stream) == s, F.col(is_open))) for s in streams}
    d = running(df, keys, ts, ups, blocks)
    up = F.lit(True)
    for s in streams:
        up = up & F.coalesce(F.col(f"_up_{s}"), F.lit(False))
    d = d.withColumn("_up", up)
    d = shifted(d, keys, ts, {"_next_ts": (F.col(ts), -1), "_next_stream": (F.col(stream), -1)}, blocks)
    d = island_ids(d, keys, ts, lambda prev: F.col("_up") != prev("_up"), ["_up"], "_run", blocks, peers=True)
    reason = F.when(F.col("_next_ts").isNull(), "end_of_data").otherwise(F.concat(F.col("_next_stream"), F.lit("_down")))
    return (
        d.where("_up")
        .groupBy(*keys, "_run")
        .agg(
            F.min(ts).alias("start_us"),
            F.max(F.coalesce("_next_ts", ts)).alias("end_us"),
            F.max_by(reason, ts).alias("close_reason"),
            F.count("*").alias("n"),
        )
        .drop("_run")
    )


def valid_run_ids(
    df: DataFrame, keys: Sequence[str], ts: str, valid: Column, out: str, blocks: Blocks = ONE_BLOCK
) -> DataFrame:
    """Number the runs of valid rows inside each key from 1; NULL on invalid rows."""
    d = df.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    d = shifted(d, keys, ts, {"_prev_ok": (F.col("_ok"), 1)}, blocks)
    start = F.col("_ok") & ~F.coalesce("_prev_ok", F.lit(False))
    d = running(d, keys, ts, {"_run": ("sum", start.cast("bigint"))}, blocks)
    return d.withColumn(out, F.when(F.col("_ok"), F.col("_run"))).drop("_ok", "_prev_ok", "_run")


def level_intervals(levels: DataFrame, keys: Sequence[str], ts: str, blocks: Blocks = ONE_BLOCK) -> DataFrame:
    """Price-level change log as intervals [valid_from, valid_to); a zero quantity only ends one."""
    d = shifted(levels, [*keys, "side", "px"], ts, {"valid_to": (F.col(ts), -1)}, blocks)
    return d.where("qty > 0").select(*keys, "side", "px", "qty", F.col(ts).alias("valid_from"), "valid_to")


def book_on_grid(
    intervals: DataFrame, ends: DataFrame, keys: Sequence[str], step: int, out: str = "g_us"
) -> DataFrame:
    """Live levels at every grid instant: all changes with stamp <= t. Each interval lists its own
    instants, so nothing is range-joined. ``ends`` gives the last instant (``end_us``) per key."""
    d = intervals.join(ends, list(keys))
    first = (F.ceil(F.col("valid_from") / F.lit(step)) * F.lit(step)).cast("bigint")
    last = F.least(F.coalesce(F.col("valid_to") - 1, F.col("end_us")), F.col("end_us"))
    d = d.withColumns({"_first": first, "_last": last}).where("_first <= _last")
    d = d.withColumn(out, F.explode(F.sequence("_first", "_last", F.lit(step))))
    return d.select(*keys, out, "side", "px", "qty")


def book_validity(bid: Column, ask: Column) -> Column:
    return (
        F.when(bid.isNull() & ask.isNull(), "empty")
        .when(bid.isNull(), "empty_bid")
        .when(ask.isNull(), "empty_ask")
        .when(bid >= ask, "crossed")
        .otherwise("valid")
    )


def trade_buckets(prints: DataFrame, grid: DataFrame, keys: Sequence[str], ts: str, at: str, step: int) -> DataFrame:
    """Prints summed into buckets (g - step, g] and laid on the grid; empty buckets are zero."""
    g = (F.ceil(F.col(ts) / F.lit(step)) * F.lit(step)).cast("bigint")
    buy, qty = F.col("is_buy"), F.col("qty")

    def total(v: Column, when: Column) -> Column:
        return F.sum(F.when(when, v).otherwise(F.lit(0)))

    b = prints.groupBy(*keys, g.alias(at)).agg(
        total(qty, buy).alias("buy_qty"),
        total(qty, ~buy).alias("sell_qty"),
        total(qty * F.col("px"), buy).alias("buy_notional"),
        total(qty * F.col("px"), ~buy).alias("sell_notional"),
        F.count_if(buy).alias("buy_count"),
        F.count_if(~buy).alias("sell_count"),
        F.max(ts).alias("last_trade_us"),
    )
    out = grid.select(*keys, at).join(b, [*keys, at], "left")
    sums = [c for c in b.columns if c not in (*keys, at, "last_trade_us")]
    return out.na.fill(0, sums)


def _descend(rank: np.ndarray, live: np.ndarray, size: np.ndarray, seek: list[dict], own: dict | None = None) -> None:
    """Find live ranks after a number of updates, all searches at once.

    Updates are in order; ``live`` and ``size`` are what each changes at its rank. A search in ``seek`` has arrays ``hi``
    (updates seen) and ``k``: it ends at the k-th live ``rank``, with the ``sum`` of sizes before it and its own
    ``last``. ``own`` follows each update's rank as it was before it and counts the live ranks ahead. The ranks are
    split bit by bit as in a binary tree: whoever looks for the k-th live rank goes left if so many of the left half
    live at its moment, else right for the rest. Time grows with updates and searches times the bits of a rank.
    """
    n, bits = len(rank), max(1, int(rank.max(initial=0)).bit_length())
    at, of = rank, np.arange(n)
    start = lambda x: np.concatenate(([0], np.cumsum(x)))
    for s in seek:
        s["lo"] = s["rank"] = s["sum"] = np.zeros(len(s["hi"]), dtype="int64")
    if own is not None:
        own["lo"] = own["count"] = np.zeros(n, dtype="int64")
        own["hi"] = np.arange(n)
    for b in range(bits - 1, -1, -1):
        left = (at >> b) & 1 == 0
        lefts, lives, sizes = start(left), start(np.where(left, live[of], 0)), start(np.where(left, size[of], 0))

        def move(s: dict, right: np.ndarray) -> None:
            s["lo"], s["hi"] = (np.where(right, lefts[-1] + x - lefts[x], lefts[x]) for x in (s["lo"], s["hi"]))

        for s in seek:
            count = lives[s["hi"]] - lives[s["lo"]]
            right = count < s["k"]
            s["sum"] = s["sum"] + np.where(right, sizes[s["hi"]] - sizes[s["lo"]], 0)
            s["k"] = s["k"] - np.where(right, count, 0)
            s["rank"] = s["rank"] | (right.astype("int64") << b)
            move(s, right)
        if own is not None:
            right = (rank >> b) & 1 == 1
            own["count"] = own["count"] + np.where(right, lives[own["hi"]] - lives[own["lo"]], 0)
            move(own, right)
        order = np.concatenate((np.flatnonzero(left), np.flatnonzero(~left)))
        at, of = at[order], of[order]
    sizes = start(size[of])
    for s in seek:
        s["last"] = sizes[s["hi"]] - sizes[s["lo"]]


def ranked_levels(rank: np.ndarray, live: np.ndarray, size: np.ndarray, depth: int) -> dict[str, np.ndarray]:
    """Best rank, its size, the size of the best ``depth`` ranks and the live ranks before its own, after each update."""
    total = np.cumsum(live)
    now = np.arange(1, len(rank) + 1)
    first, deep = ({"hi": now, "k": np.minimum(total, k)} for k in (1, depth))
    own: dict = {}
    _descend(rank, live, size, [first, deep], own)
    some = total > 0
    return {
        "best": first["rank"],
        "qty": np.where(some, first["last"], 0),
        "depth": np.where(some, deep["sum"] + deep["last"], 0),
        "live": total,
        "rank": own["count"],
    }


def _changes(px: np.ndarray, qty: np.ndarray, best_is: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prices from the best one on, the rank of each update's price, and the quantity that it replaces."""
    prices, rank = np.unique(px * best_is, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    old = np.zeros(len(px), dtype="int64")
    same = rank[order][1:] == rank[order][:-1]
    old[order[1:]] = np.where(same, qty[order][:-1], 0)
    return prices * best_is, rank, old


def _sweep_side(px: np.ndarray, qty: np.ndarray, best_is: int) -> dict[str, np.ndarray]:
    """Touch, ten-level depth, and rank and size before each of one side's updates (``best_is`` -1: the highest)."""
    prices, rank, old = _changes(px, qty, best_is)
    got = ranked_levels(rank, (qty > 0).astype("int64") - (old > 0), qty - old, 10)
    best = prices[got["best"]] if len(px) else px
    return {**got, "best": best, "old": old}


def _best_at(px: np.ndarray, qty: np.ndarray, best_is: int, seen: np.ndarray, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Prices and sizes of one side's best ``n`` levels after ``seen`` of its updates, from the touch outward."""
    prices, rank, old = _changes(px, qty, best_is)
    live = (qty > 0).astype("int64") - (old > 0)
    total = np.concatenate(([0], np.cumsum(live)))[seen]
    seek = [{"hi": seen, "k": np.minimum(total, k)} for k in range(1, n + 1)]
    if not len(px):
        return ([np.zeros(0, dtype="int64")] * len(seen),) * 2
    _descend(rank, live, qty - old, seek)
    price, size = (np.stack(x, axis=1) for x in ([prices[s["rank"]] for s in seek], [s["last"] for s in seek]))
    return tuple([row[:k] for row, k in zip(x, np.minimum(total, n))] for x in (price, size))


SWEPT = (
    "best_bid bigint, bid_qty bigint, bid_depth bigint, bid_levels bigint, "
    "best_ask bigint, ask_qty bigint, ask_depth bigint, ask_levels bigint, rank bigint, old_qty bigint"
)


def carried_levels(levels: DataFrame, keys: Sequence[str], ts: str, ord_: str, blocks: Blocks = ONE_BLOCK) -> DataFrame:
    """Level updates with their block, and ``_carry`` rows: what earlier blocks left of each live level."""
    cols = [*keys, ts, ord_, "side", "px", "qty"]
    d = blocks.assign(levels.select(*cols), ts).withColumn("_carry", F.lit(False))
    if not blocks.single:
        per_level = d.groupBy(*keys, "side", "px", BLOCK).agg(
            F.max_by("qty", F.struct(ts, ord_)).alias("qty"), F.max(ts).alias(ts), F.max(ord_).alias(ord_)
        )
        w = Window.partitionBy(*keys, "side", "px").orderBy(BLOCK)
        nxt = F.coalesce(F.lead(BLOCK).over(w), F.lit(len(blocks.splits)))
        carried = (
            per_level.withColumn("_to", nxt)
            .where(F.col("qty") > 0)
            .where(F.col("_to") > F.col(BLOCK))
            .withColumn(BLOCK, F.explode(F.sequence(F.col(BLOCK) + 1, F.col("_to"))))
            .select(*cols, BLOCK, F.lit(True).alias("_carry"))
        )
        d = d.unionByName(carried)
    return d


def book_after_updates(
    levels: DataFrame, keys: Sequence[str], ts: str, ord_: str, blocks: Blocks = ONE_BLOCK
) -> DataFrame:
    """Every level update with the book right after it and its price's rank right before it.

    Work is split by (key, block); a block starts from the last quantity of each live level of the
    earlier blocks, which is one row per level, and is swept with numpy.
    """
    cols = [*keys, ts, ord_, "side", "px", "qty"]
    d = carried_levels(levels, keys, ts, ord_, blocks.for_python)
    schema = ", ".join(f"{c} {t}" for c, t in levels.select(*cols).dtypes) + ", " + SWEPT

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_carry", ts, ord_], ascending=[False, True, True], kind="stable")
        px, qty = pdf["px"].to_numpy(), pdf["qty"].to_numpy()
        is_bid = (pdf["side"] == "bid").to_numpy()
        out = pdf[cols].copy()
        out["rank"], out["old_qty"] = np.int64(0), np.int64(0)
        for side, mine, best_is in (("bid", is_bid, -1), ("ask", ~is_bid, 1)):
            got = _sweep_side(px[mine], qty[mine], best_is)
            # A side is as its own last update left it; before the first one it is empty.
            last = np.cumsum(mine)
            state = {c: np.concatenate(([0], got[c]))[last] for c in ("best", "qty", "depth", "live")}
            out[f"best_{side}"] = pd.array(state["best"], dtype="Int64")
            out.loc[state["live"] == 0, f"best_{side}"] = pd.NA
            for c, name in (("qty", "qty"), ("depth", "depth"), ("live", "levels")):
                out[f"{side}_{name}"] = state[c]
            for c, name in (("rank", "rank"), ("old", "old_qty")):
                out.loc[mine, name] = got[c]
        return out[~pdf["_carry"].to_numpy()]

    return d.groupBy(*keys, BLOCK).applyInPandas(sweep, schema)


def books_at(
    levels: DataFrame, instants: DataFrame, keys: Sequence[str], ts: str, ord_: str, at: str, n: int, blocks: Blocks = ONE_BLOCK
) -> DataFrame:
    """Best ``n`` levels of each side at every instant, all updates up to it included, as arrays from the touch outward.

    A block starts from the levels that earlier blocks left and answers its instants from its own updates, so no
    row per level and instant exists and no level's interval is listed out. Instants without a live level have no row.
    """
    blocks = blocks.for_python
    d = carried_levels(levels, keys, ts, ord_, blocks)
    grid = blocks.assign(instants.select(*keys, at), at)
    types = dict(instants.dtypes)
    arrays = [f"{side}_{c}" for side in ("bid", "ask") for c in ("px", "qty")]
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in (*keys, at)], *[f"{c} array<bigint>" for c in arrays]])

    def answer(asked: pd.DataFrame, updates: pd.DataFrame) -> pd.DataFrame:
        updates = updates.sort_values(["_carry", ts, ord_], ascending=[False, True, True], kind="stable")
        carried = int(updates["_carry"].sum())
        stamps = updates[ts].to_numpy()[carried:]
        seen = carried + np.searchsorted(stamps, asked[at].to_numpy(), side="right")
        px, qty = updates["px"].to_numpy(), updates["qty"].to_numpy()
        is_bid = (updates["side"] == "bid").to_numpy()
        out = asked[[*keys, at]].copy()
        for side, mine, best_is in (("bid", is_bid, -1), ("ask", ~is_bid, 1)):
            so_far = np.concatenate(([0], np.cumsum(mine)))[seen]
            out[f"{side}_px"], out[f"{side}_qty"] = (pd.Series(x, index=out.index, dtype=object) for x in _best_at(px[mine], qty[mine], best_is, so_far, n))
        return out[[len(b) + len(a) > 0 for b, a in zip(out["bid_px"], out["ask_px"])]]

    return grid.groupBy(*keys, BLOCK).cogroup(d.groupBy(*keys, BLOCK)).applyInPandas(answer, schema)


def touch_of(books: DataFrame) -> DataFrame:
    """Best prices and sizes, spread, doubled mid and validity of ``books_at`` rows, instead of their arrays."""
    bid, ask = (F.get(f"{s}_px", F.lit(0)) for s in ("bid", "ask"))
    keep = [c for c in books.columns if c not in ("bid_px", "bid_qty", "ask_px", "ask_qty")]
    return books.select(
        *keep,
        bid.alias("best_bid"),
        F.get("bid_qty", F.lit(0)).alias("bid_qty"),
        ask.alias("best_ask"),
        F.get("ask_qty", F.lit(0)).alias("ask_qty"),
        (ask - bid).alias("spread_ticks"),
        (ask + bid).alias("mid_x2"),
        book_validity(bid, ask).alias("validity"),
    )


def touch_path(book: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """One row per update and side: touch price and size (NULL price when the side is empty)."""
    sides = F.array(
        F.struct(F.lit("bid").alias("side"), F.col("best_bid").alias("px"), F.col("bid_qty").alias("qty")),
        F.struct(F.lit("ask").alias("side"), F.col("best_ask").alias("px"), F.col("ask_qty").alias("qty")),
    )
    return book.select(*keys, ts, F.inline(sides))


def episode_rows(touch: DataFrame, keys: Sequence[str], ts: str, blocks: Blocks = ONE_BLOCK) -> DataFrame:
    """Touch rows with the episode (run of one best price) they belong to and their size change.

    Adds ``episode``, ``delta`` (0 on the first row) and the next row's stamp and price.
    """
    side_keys = [*keys, "side"]
    d = island_ids(touch, side_keys, ts, lambda prev: ~F.col("px").eqNullSafe(prev("px")), ["px"], "episode", blocks, peers=True)
    moves = {
        "_pe": (F.col("episode"), 1), "_pq": (F.col("qty"), 1),
        "next_ts": (F.col(ts), -1), "next_px": (F.col("px"), -1), "_ne": (F.col("episode"), -1),
    }
    d = shifted(d, side_keys, ts, moves, blocks)
    same = F.col("_pe") == F.col("episode")
    d = d.withColumn("delta", F.when(same, F.col("qty") - F.col("_pq")).otherwise(F.lit(0)))
    return d.withColumn("last_row", F.col("_ne").isNull() | (F.col("_ne") != F.col("episode"))).drop("_pe", "_pq", "_ne")


def episode_flow(rows: DataFrame, keys: Sequence[str], ts: str, blocks: Blocks = ONE_BLOCK) -> DataFrame:
    """Per row: size added, removed, and added after an earlier removal in the same episode."""
    delta = F.col("delta")
    d = running(
        rows, [*keys, "side", "episode"], ts, {"_removed": ("sum", (delta < 0).cast("bigint"))}, blocks, exclusive=True
    )
    add = F.greatest(delta, F.lit(0))
    again = F.coalesce("_removed", F.lit(0)) > 0
    return d.withColumns(
        {
            "added": add,
            "removed": F.greatest(-delta, F.lit(0)),
            "replenished": F.when(again, add).otherwise(F.lit(0)),
        }
    ).drop("_removed")


def level_episodes(flow: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """One row per episode of a present touch: lifetime, sizes, flows and why it ended."""
    bid = F.col("side") == "bid"
    px, nxt = F.col("px"), F.col("next_px")
    better = F.when(bid, nxt > px).otherwise(nxt < px)
    reason = (
        F.when(F.col("next_ts").isNull(), "segment_end")
        .when(nxt.isNull(), "book_side_empty")
        .when(better, "improved")
        .otherwise("stepped_away")
    )
    return flow.where("px IS NOT NULL").groupBy(*keys, "side", "episode", "px").agg(
        F.min(ts).alias("start_us"),
        F.max(F.when(F.col("last_row"), F.coalesce("next_ts", ts))).alias("end_us"),
        F.min_by("qty", ts).alias("initial_qty"),
        F.max_by("qty", ts).alias("final_qty"),
        F.max("qty").alias("max_qty"),
        F.min("qty").alias("min_qty"),
        F.sum("added").alias("cum_add"),
        F.sum("removed").alias("cum_remove"),
        F.sum("replenished").alias("cum_replenish"),
        F.count_if(F.col("added") > 0).alias("add_events"),
        F.count_if(F.col("removed") > 0).alias("remove_events"),
        F.count_if(F.col("replenished") > 0).alias("replenish_events"),
        F.max(F.when(F.col("last_row"), reason)).alias("close_reason"),
    )


def episode_prints(
    prints: DataFrame, rows: DataFrame, keys: Sequence[str], ts: str, blocks: Blocks = ONE_BLOCK
) -> DataFrame:
    """Aggressive prints with the episode of the touch they hit: at the quote, through it, or outside."""
    side = F.when(F.col("is_buy"), "ask").otherwise("bid")
    p = prints.withColumn("side", side)
    got = asof(p, rows, [*keys, "side"], ts, ts, {"episode": "episode", "px": "touch_px"}, blocks)
    beyond = F.when(F.col("side") == "bid", F.col("px") < F.col("touch_px")).otherwise(F.col("px") > F.col("touch_px"))
    kind = F.when(F.col("px") == F.col("touch_px"), "at_quote").when(beyond, "through").otherwise("outside")
    return got.where("touch_px IS NOT NULL").withColumn("kind", kind)


def explained_removals(
    flow: DataFrame, hits: DataFrame, keys: Sequence[str], ts: str, blocks: Blocks = ONE_BLOCK
) -> DataFrame:
    """Removals split into the part earlier prints at the level account for and the rest.

    The unexplained total is the running maximum of (removed - printed), floored at zero, which
    equals drawing every removal from the pool of unconsumed prints in event order.
    """
    cols = [*keys, "side", "episode"]
    a = flow.where("removed > 0").select(*cols, ts, F.col("removed"), F.lit(0).cast("bigint").alias("printed"), F.lit(1).alias("_k"))
    b = hits.where("kind = 'at_quote'").select(*cols, ts, F.lit(0).cast("bigint").alias("removed"), F.col("qty").alias("printed"), F.lit(0).alias("_k"))
    d = running(
        a.unionByName(b), cols, ts,
        {"_r": ("sum", F.col("removed")), "_p": ("sum", F.col("printed"))}, blocks, ["_k"],
    )
    short = F.when(F.col("removed") > 0, F.col("_r") - F.col("_p"))
    d = running(d, cols, ts, {"_u": ("max", short)}, blocks, ["_k"])
    d = d.withColumn("_u", F.greatest(F.coalesce("_u", F.lit(0)), F.lit(0)))
    d = shifted(d, cols, ts, {"_pu": (F.col("_u"), 1)}, blocks, ["_k"])
    unexplained = F.col("_u") - F.coalesce("_pu", F.lit(0))
    d = d.where("removed > 0").withColumn("unexplained", unexplained)
    return d.withColumn("explained", F.col("removed") - F.col("unexplained")).select(
        *cols, ts, "removed", "explained", "unexplained"
    )


def reconnect_gaps(df: DataFrame, keys: Sequence[str], ts: str, snapshot: str, blocks: Blocks = ONE_BLOCK) -> DataFrame:
    """Outage before each replacement snapshot (last message to snapshot), rolled up per key."""
    d = shifted(df, keys, ts, {"_prev": (F.col(ts), 1)}, blocks)
    gap = F.when(F.col(snapshot) & F.col("_prev").isNotNull(), F.col(ts) - F.col("_prev"))
    span = F.max(ts) - F.min(ts)
    d = d.withColumn("_gap", gap)
    return d.groupBy(*keys).agg(
        F.count("_gap").alias("reconnects"),
        F.coalesce(F.sum("_gap"), F.lit(0)).alias("gap_us"),
        F.max("_gap").alias("max_gap_us"),
        (F.lit(100.0) * (span - F.coalesce(F.sum("_gap"), F.lit(0))) / span).alias("valid_pct"),
    )

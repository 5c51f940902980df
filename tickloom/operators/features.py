"""Features that need neighbouring rows or a change of row grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.book import ratio
from tickloom.operators.ordered import ONE_BLOCK, Blocks, running, shifted


def rank_flow(book: DataFrame, keys: Sequence[str], ts: str, step: int, ranks: int) -> DataFrame:
    """Size added and removed per bucket, side and the rank the price held before its update."""
    g = (F.ceil(F.col(ts) / F.lit(step)) * F.lit(step)).cast("bigint")
    delta = F.col("qty") - F.col("old_qty")
    return (
        book.where(F.col("rank") < ranks)
        .groupBy(*keys, g.alias("g_us"), "side", "rank")
        .agg(
            F.sum(F.greatest(delta, F.lit(0))).alias("added"),
            F.sum(F.greatest(-delta, F.lit(0))).alias("removed"),
        )
    )


def event_contributions(book: DataFrame, keys: Sequence[str], ts: str, ord_: str, blocks: Blocks = ONE_BLOCK) -> DataFrame:
    """Signed flow of each book event (all rows of one stamp) against the touch just before it."""
    prev = {"_pb": "best_bid", "_pa": "best_ask", "_pbq": "bid_qty", "_paq": "ask_qty"}
    ends = book.groupBy(*keys, ts).agg(
        F.max_by(F.struct("best_bid", "best_ask", "bid_qty", "ask_qty"), ord_).alias("_s")
    ).select(*keys, ts, "_s.*")
    ends = shifted(ends, keys, ts, {k: (F.col(c), 1) for k, c in prev.items()}, blocks)
    rows = book.select(*keys, ts, "side", "px", (F.col("qty") - F.col("old_qty")).alias("_d")).join(ends, [*keys, ts])
    bid = F.col("side") == "bid"
    signed = F.when(bid, F.col("_d")).otherwise(-F.col("_d"))
    at_touch = F.col("px") == F.when(bid, F.col("_pb")).otherwise(F.col("_pa"))

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, signed).otherwise(F.lit(0)))

    moved = ~F.col("_pb").eqNullSafe(F.col("best_bid")) | ~F.col("_pa").eqNullSafe(F.col("best_ask"))
    now = ratio(F.col("bid_qty") - F.col("ask_qty"), F.nullif(F.col("bid_qty") + F.col("ask_qty"), F.lit(0)))
    was = ratio(F.col("_pbq") - F.col("_paq"), F.nullif(F.col("_pbq") + F.col("_paq"), F.lit(0)))
    mid = F.abs(F.col("best_bid") + F.col("best_ask") - F.col("_pb") - F.col("_pa")) / 2.0
    return rows.groupBy(*keys, ts).agg(
        F.sum(signed).alias("ofi"),
        total(F.col("_d") > 0).alias("add_flow"),
        total(F.col("_d") < 0).alias("cancel_flow"),
        total((F.col("_d") > 0) & at_touch).alias("replenish_flow"),
        total((F.col("_d") < 0) & at_touch).alias("depletion_flow"),
        F.count("*").alias("depth_changes"),
        F.max(moved.cast("bigint")).alias("bbo_change"),
        F.max(mid).alias("abs_mid_move"),
        F.max(now - was).alias("delta_obi"),
    )


def side_rows(
    df: DataFrame, key: Sequence[str], pairs: dict[str, tuple[str, str]], signed: Sequence[str]
) -> DataFrame:
    """One row per side: own/opp columns swapped for the ask, signed columns times +1 / -1."""

    def one(side: str, own: int, sign: int) -> Column:
        cols = [F.lit(side).alias("side")]
        for name, p in pairs.items():
            cols += [F.col(p[own]).alias(f"own_{name}"), F.col(p[1 - own]).alias(f"opp_{name}")]
        return F.struct(*cols, *[(F.col(c) * sign).alias(c) for c in signed])

    return df.select(*key, F.inline(F.array(one("bid", 0, 1), one("ask", 1, -1))))


def lifecycle_features(flow: DataFrame, keys: Sequence[str], ts: str, blocks: Blocks = ONE_BLOCK) -> DataFrame:
    """State of a touch episode known at each of its rows; ratios are NULL on a zero base."""
    d = running(
        flow.where("px IS NOT NULL"), keys, ts,
        {
            "_iq": ("first", F.col("qty")), "_mx": ("max", F.col("qty")), "_cr": ("sum", F.col("removed")),
            "_rp": ("sum", F.col("replenished")), "_st": ("min", F.col(ts)),
        },
        blocks,
    )

    def per(a: Column, base: str) -> Column:
        return ratio(a, F.nullif(F.col(base), F.lit(0)))

    return d.withColumns(
        {
            "remaining": per(F.col("qty"), "_iq"),
            "drawdown": per(F.col("_mx") - F.col("qty"), "_mx"),
            "removal_ratio": per(F.col("_cr"), "_iq"),
            "replenish_ratio": per(F.col("_rp"), "_cr"),
            "log_age_ms": F.log1p((F.col(ts) - F.col("_st")) / 1000.0),
        }
    )

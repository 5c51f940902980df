"""Column factories over ten-level books, flows and episodes. Undefined ratios are NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def arr_sum(values: Column, n: int | None = None) -> Column:
    v = values if n is None else F.slice(values, 1, n)
    return F.aggregate(v, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def enough(bids: Column, asks: Column, n: int, value: Column) -> Column:
    return F.when((F.size(bids) >= n) & (F.size(asks) >= n), value)


def obi(bids: Column, asks: Column, n: int) -> Column:
    """(bid - ask) / (bid + ask) over the first n levels; NULL with fewer levels or no size."""
    b, a = arr_sum(bids, n), arr_sum(asks, n)
    return enough(bids, asks, n, ratio(b - a, b + a))


def weighted_obi(bids: Column, asks: Column, n: int, decay: float = 0.5) -> Column:
    def total(q: Column) -> Column:
        w = F.transform(F.slice(q, 1, n), lambda x, i: x * F.exp(F.lit(-decay) * i))
        return F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x)

    b, a = total(bids), total(asks)
    return enough(bids, asks, n, ratio(b - a, b + a))


def microprice(bid_px: Column, bid_qty: Column, ask_px: Column, ask_qty: Column) -> Column:
    return ratio(ask_qty * bid_px + bid_qty * ask_px, bid_qty + ask_qty)


def dispersion(px: Column, qty: Column) -> Column:
    """Size-weighted distance from the side's own best price, in ticks."""
    far = F.zip_with(px, qty, lambda p, q: F.abs(p - px[0]) * q)
    return ratio(arr_sum(far), arr_sum(qty))


def l1_ofi(prev: dict[str, Column], cur: dict[str, Column]) -> Column:
    """Touch order flow between two states; dict keys bid, bid_qty, ask, ask_qty."""

    def part(cond: Column, value: Column) -> Column:
        return F.when(cond, value).otherwise(F.lit(0))

    return (
        part(cur["bid"] >= prev["bid"], cur["bid_qty"])
        - part(cur["bid"] <= prev["bid"], prev["bid_qty"])
        - part(cur["ask"] <= prev["ask"], cur["ask_qty"])
        + part(cur["ask"] >= prev["ask"], prev["ask_qty"])
    )


def pressure(adds: Column, removes: Column, n: int, decay: float = 0.5) -> Column:
    """Rank-weighted net over gross depth flow of the first n ranks; NULL without flow."""
    pairs = F.slice(F.arrays_zip(adds.alias("a"), removes.alias("r")), 1, n)
    net = F.aggregate(
        F.transform(pairs, lambda x, i: (x["a"] - x["r"]) * F.exp(F.lit(-decay) * i)), F.lit(0.0), lambda s, x: s + x
    )
    gross = F.aggregate(
        F.transform(pairs, lambda x, i: (x["a"] + x["r"]) * F.exp(F.lit(-decay) * i)), F.lit(0.0), lambda s, x: s + x
    )
    return ratio(net, F.nullif(gross, F.lit(0.0)))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def mean_present(values: Sequence[Column]) -> Column:
    """Mean of the non-NULL values; NULL when all are."""
    got = F.array_compact(F.array(*values))
    return F.try_divide(F.aggregate(got, F.lit(0.0), lambda a, x: a + x), F.size(got).cast("double"))


def consensus(z: Sequence[Column]) -> Column:
    """Mean of z-scores, NULL as soon as one is."""
    total = z[0]
    for c in z[1:]:
        total = total + c
    return total / len(z)


def vote_share(features: Sequence[Column]) -> Column:
    votes = F.lit(0)
    for c in features:
        votes = votes + F.coalesce((c > 0).cast("int"), F.lit(0))
    return votes / F.lit(float(len(features)))


def session_of(us: Column) -> Column:
    """UTC session of an instant: asia 0-8 h, europe 8-16 h, us 16-24 h."""
    h = F.hour(F.timestamp_micros(us))
    return F.when(h < 8, "asia").when(h < 16, "europe").otherwise("us")


def walk_book(px: Column, qty: Column, wanted: Column, is_buy: bool, tick: float = 1.0) -> Column:
    """Take visible levels outward until ``wanted`` is filled; NULL when depth does not suffice.

    Struct: vwap, levels, slippage_ticks, touch_participation, visible_participation.
    """
    start = F.struct(
        wanted.cast("bigint").alias("rem"), F.lit(0).cast("bigint").alias("notional"), F.lit(0).cast("bigint").alias("n")
    )

    def step(acc: Column, lv: Column) -> Column:
        take = F.least(acc["rem"], lv["q"])
        return F.struct(
            (acc["rem"] - take).alias("rem"),
            (acc["notional"] + take * lv["p"]).alias("notional"),
            (acc["n"] + F.when(take > 0, 1).otherwise(0)).cast("bigint").alias("n"),
        )

    end = F.aggregate(F.arrays_zip(px.alias("p"), qty.alias("q")), start, step)
    vwap = end["notional"] / wanted
    slip = (vwap - px[0]) if is_buy else (px[0] - vwap)
    return F.when(
        (wanted > 0) & (end["rem"] == 0),
        F.struct(
            vwap.alias("vwap"),
            end["n"].alias("levels"),
            (slip / tick).alias("slippage_ticks"),
            (wanted / qty[0]).alias("touch_participation"),
            (wanted / arr_sum(qty)).alias("visible_participation"),
        ),
    )


def floor_to_step(notional: Column, price: Column, step: str) -> Column:
    d = F.lit(step).cast("decimal(18,6)")
    return F.floor(notional.cast("decimal(18,4)") / price.cast("decimal(18,4)") / d) * d


def ticks_to_bps(ticks: Column, mid: Column, tick: float = 1.0) -> Column:
    return ratio(ticks * tick * 10_000, mid)

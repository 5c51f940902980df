"""Forward labels. An outcome that was not fully observed is NULL, never 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.book import ratio
from tickloom.operators.intervals import first_beyond
from tickloom.operators.ordered import ONE_BLOCK, Blocks, asof, shifted


def direction(side: str = "side") -> Column:
    return F.when(F.col(side) == "bid", 1).otherwise(-1)


def grid_markouts(
    df: DataFrame, keys: Sequence[str], order: str, mid: str, horizons: dict[str, int], blocks: Blocks = ONE_BLOCK
) -> DataFrame:
    """mid(t + h rows) - mid(t) inside the key, NULL past its end, with up / down / flat flags."""
    d = shifted(df, keys, order, {f"_f_{o}": (F.col(mid), -n) for o, n in horizons.items()}, blocks)
    for o in horizons:
        move = F.col(f"_f_{o}") - F.col(mid)
        d = d.withColumns({o: move, f"{o}_dir": F.signum(move).cast("bigint")}).drop(f"_f_{o}")
    return d


def path_markouts(
    fills: DataFrame, path: DataFrame, keys: Sequence[str], fill_ts: str, end: str, horizons: dict[str, int],
    path_ts: str, mid_x2: str, price: str, blocks: Blocks = ONE_BLOCK,
) -> DataFrame:
    """Signed distance of the mid from the fill price at fill + h, NULL when that is past ``end``.

    In half ticks: side * (mid_x2 - 2 * price).
    """
    d = fills
    for o, h in horizons.items():
        d = d.withColumn("_at", F.col(fill_ts) + h)
        d = asof(d, path, keys, "_at", path_ts, {mid_x2: "_m"}, blocks, chained=True)
        seen = F.col("_at") <= F.col(end)
        d = d.withColumn(o, F.when(seen, direction() * (F.col("_m") - 2 * F.col(price)))).drop("_at", "_m")
    return d


def next_move(
    df: DataFrame, path: DataFrame, keys: Sequence[str], ts: str, path_ts: str, mid: str, cap: int, blocks: Blocks = ONE_BLOCK
) -> DataFrame:
    """Direction and latency of the first mid change strictly after each row, if within ``cap``."""
    d = asof(df, path, keys, ts, path_ts, {path_ts: "_t", mid: "_m"}, blocks, forward=True, strict=True)
    near = F.col("_t") - F.col(ts) <= cap
    return d.withColumns(
        {
            "move_us": F.when(near, F.col("_t") - F.col(ts)),
            "move_dir": F.when(near, F.signum(F.col("_m") - F.col(mid)).cast("bigint")),
        }
    ).drop("_t", "_m")


def moved_within(latency: Column, remaining: Column, horizon: int) -> Column:
    """1 when it happened in time, 0 only when the whole horizon was watched, else NULL."""
    return F.when(latency <= horizon, 1).when(remaining >= horizon, 0)


def executable_returns(
    book: DataFrame, keys: Sequence[str], ts: str, step: int, hold: int, blocks: Blocks = ONE_BLOCK,
    latency: int = 1, fee_bps: float = 0.0, price_scale: float = 1.0,
) -> DataFrame:
    """Enter ``latency`` rows later and leave ``hold`` rows after that, both at the opposite touch.

    Long and short returns in bp of the entry price, gross and after fees on both legs; NULL unless
    the rows in between are gapless.
    """
    quote = F.struct(F.col(ts).alias("t"), F.col("bid").alias("b"), F.col("ask").alias("a"))
    d = shifted(book, keys, ts, {"_in": (quote, -latency), "_out": (quote, -(latency + hold))}, blocks)
    whole = (F.col("_in.t") == F.col(ts) + latency * step) & (F.col("_out.t") == F.col(ts) + (latency + hold) * step)
    fee = fee_bps / 10_000

    def legs(buy: Column, sell: Column, base: Column, cost: float) -> Column:
        return F.when(whole, ratio((sell - buy - cost * (buy + sell)) * 10_000 * price_scale, base))

    long_in, long_out = F.col("_in.a"), F.col("_out.b")
    short_in, short_out = F.col("_in.b"), F.col("_out.a")
    return d.withColumns(
        {
            "long_gross": legs(long_in, long_out, long_in, 0.0),
            "short_gross": legs(short_out, short_in, short_in, 0.0),
            "long_net": legs(long_in, long_out, long_in, fee),
            "short_net": legs(short_out, short_in, short_in, fee),
        }
    ).drop("_in", "_out")


def ceil_grid_markouts(
    fills: DataFrame, grid: DataFrame, keys: Sequence[str], fill_ts: str, grid_ts: str, segment: str, mid_x2: str,
    price: str, step: int, horizons: dict[str, int],
) -> DataFrame:
    """Markouts from the first grid row at or after the fill; markout = advantage + later move."""
    at = (F.ceil(F.col(fill_ts) / F.lit(step)) * F.lit(step)).cast("bigint")
    d = fills.withColumn("fill_grid", at)
    g0 = grid.select(*keys, F.col(grid_ts).alias("fill_grid"), F.col(mid_x2).alias("_m0"), F.col(segment).alias("_s0"))
    d = d.join(g0, [*keys, "fill_grid"], "left")
    d = d.withColumn("advantage", direction() * (F.col("_m0") - 2 * F.col(price)))
    for o, h in horizons.items():
        g = grid.select(*keys, (F.col(grid_ts) - h).alias("fill_grid"), F.col(mid_x2).alias("_m"), F.col(segment).alias("_s"))
        d = d.join(g, [*keys, "fill_grid"], "left")
        ok = F.col("_s") == F.col("_s0")
        d = d.withColumns(
            {
                f"{o}_markout": F.when(ok, direction() * (F.col("_m") - 2 * F.col(price))),
                f"{o}_move": F.when(ok, direction() * (F.col("_m") - F.col("_m0"))),
            }
        ).drop("_m", "_s")
    return d.drop("_m0", "_s0")


def level_survival(
    rows: DataFrame, ts: str, end: str, reason: str, segment_end: str, horizons: dict[str, int], open_reason: str = "segment_end"
) -> DataFrame:
    """1 when the level really ended within h, 0 when it was watched for all of h, else NULL."""
    genuine = (F.col(reason) != open_reason) & F.col(end).isNotNull()
    left = F.col(end) - F.col(ts)
    watched = F.col(segment_end) - F.col(ts)
    out = {}
    for o, h in horizons.items():
        soon = F.coalesce(left <= h, F.lit(False))
        out[o] = F.when(genuine & soon, 1).when((watched >= h) & ~soon, 0)
    return rows.withColumns(out)


def tail_targets(markout: Column, thresholds: Sequence[int]) -> dict[str, Column]:
    """Flags markout <= -k, the downside part and its depth; NULL markouts stay NULL."""
    seen = markout.isNotNull()
    out = {f"tail_{k}": F.when(seen, (markout <= -k).cast("bigint")) for k in thresholds}
    out["downside"] = F.when(seen, F.least(markout, F.lit(0)))
    out["severity"] = F.when(seen, F.greatest(-markout, F.lit(0)))
    return out


def first_of(events: dict[str, str]) -> Column:
    """Name of the earliest non-NULL stamp column (listed order on ties), NULL when all are NULL."""
    best = F.array_min(F.array(*[F.struct(F.coalesce(F.col(c), F.lit(2**62)).alias("t"), F.lit(i).alias("i")) for i, c in enumerate(events.values())]))
    names = F.array(*[F.lit(n) for n in events])
    return F.when(best["t"] < 2**62, F.element_at(names, best["i"] + 1))


def quote_events(
    quotes: DataFrame, keys: Sequence[str], qid: Sequence[str], horizon: int, prints: DataFrame, touch: DataFrame,
    mids: DataFrame, removals: DataFrame, ts: str, blocks: Blocks = ONE_BLOCK,
) -> DataFrame:
    """When, within ``horizon`` of ``at_us``, a quote is reached by a print, loses the mid, stops being
    best on its side, or its price empties: stamps ``fill``, ``mid_adverse``, ``best_adverse``, ``gone``."""
    until = F.col("at_us") + horizon
    toward = -direction()
    both = [*keys, "side"]
    d = first_beyond(quotes, prints, both, qid, "at_us", until, F.col("quote_px") - toward, toward, ts, "px", "fill", blocks, closed=True)
    d = first_beyond(d, mids, keys, qid, "at_us", until, F.col("mid_x2"), toward, ts, "mid_x2", "mid_adverse", blocks, closed=True)
    d = first_beyond(d, touch, both, qid, "at_us", until, F.col("quote_px"), toward, ts, "px", "best_adverse", blocks, closed=True)
    gone = removals.select(*both, F.col("px").alias("quote_px"), F.col(ts).alias("_z"))
    d = asof(d, gone, [*both, "quote_px"], "at_us", "_z", {"_z": "_g"}, blocks, forward=True, strict=True)
    return d.withColumn("gone", F.when(F.col("_g") <= until, F.col("_g"))).drop("_g")


def event_paths(
    events: DataFrame, path: DataFrame, keys: Sequence[str], at: str, start: str, end: str, taus: Sequence[int],
    path_ts: str, mid: str, blocks: Blocks = ONE_BLOCK,
) -> DataFrame:
    """Signed mid displacement at fixed offsets around each event, NULL outside its segment."""
    d = asof(events, path, keys, at, path_ts, {mid: "_base"}, blocks)
    d = d.withColumn("tau", F.explode(F.array(*[F.lit(t).cast("bigint") for t in taus])))
    d = d.withColumn("_when", F.col(at) + F.col("tau"))
    d = asof(d, path, keys, "_when", path_ts, {mid: "_m"}, blocks)
    inside = (F.col("_when") >= F.col(start)) & (F.col("_when") <= F.col(end))
    return d.withColumn("move", F.when(inside, direction() * (F.col("_m") - F.col("_base")))).drop("_when", "_m", "_base")

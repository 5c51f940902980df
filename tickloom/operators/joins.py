"""Joins with market meaning: containment, threshold fills, crossings, cancellation, policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.intervals import first_beyond
from tickloom.operators.labels import direction
from tickloom.operators.ordered import ONE_BLOCK, Blocks, asof, running


def contained_in(
    events: DataFrame, spans: DataFrame, keys: Sequence[str], ts: str, start: str, end: str, values: dict[str, str],
    blocks: Blocks = ONE_BLOCK,
) -> DataFrame:
    """Events inside one of the key's non-overlapping [start, end] spans, with the span's ``values``."""
    d = asof(events, spans, keys, ts, start, {start: "_s", end: "_e", **values}, blocks)
    return d.where((F.col("_s").isNotNull()) & (F.col(ts) <= F.col("_e"))).drop("_s", "_e")


def first_event_per_span(
    events: DataFrame, spans: DataFrame, keys: Sequence[str], ts: str, start: str, end: str, span_id: str,
    blocks: Blocks = ONE_BLOCK,
) -> DataFrame:
    d = contained_in(events, spans, keys, ts, start, end, {span_id: span_id}, blocks)
    return d.groupBy(*keys, span_id).agg(F.min(ts).alias("first_ts"))


def threshold_fills(
    orders: DataFrame, prints: DataFrame, keys: Sequence[str], oid: Sequence[str], blocks: Blocks = ONE_BLOCK,
    queues: Column | None = None, ends: Column | None = None,
) -> DataFrame:
    """When resting orders fill against prints in the open window (place_us, end_us).

    A print beyond the price fills at once. At the price, the order starts to fill when the volume
    since placement exceeds ``ahead`` and is done at ``ahead + qty``: with the running volume V of the
    price level, at the first print whose V reaches V(placement) + ahead + 1 or + qty. That is an
    as-of lookup on the volume axis, so orders are never paired with prints. Ties go to the earlier
    ordinal. ``prints`` carries the book side it hits. Adds first_us, full_us, filled, mechanism, state.

    An order may stand for several: ``queues`` is an array of structs with ``ahead`` and the names of its
    assumption, ``ends`` one with ``end_us`` and what describes the window; the result has every pair of them. V at
    placement and the first print beyond the price are looked up once an order, up to its last end, the volume
    marks once a queue, V at the end once a window. Only then are they put together, and stamps cut by the end.
    """
    both = [*keys, "side"]
    level = [*both, "px"]
    cum = running(prints, level, "ts_us", {"cum": ("sum", F.col("qty"))}, blocks, ["ord"])
    volume = ONE_BLOCK if blocks.single else Blocks.fit(cum, "cum")
    d = asof(orders, cum, level, "place_us", "ts_us", {"cum": "_base"}, blocks, ["ord"])
    d = d.withColumn("_base", F.coalesce("_base", F.lit(0)))
    if queues is not None:
        d = d.withColumn("_queues", queues).drop("ahead")
    if ends is not None:
        d = d.withColumn("_ends", ends).drop("end_us")
    last = F.col("end_us") if ends is None else F.array_max(F.transform("_ends", lambda x: x["end_us"]))

    def marked(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"_want_first": F.col("_base") + F.col("ahead") + 1, "_want_full": F.col("_base") + F.col("ahead") + F.col("qty")})
        for c in ("_first", "_full"):
            # The second lookup reads the first once; with ``queues`` the only reader of both is a join.
            one_reader = c == "_first" or queues is not None
            rows = asof(rows, cum, level, f"_want{c}", "cum", {"ts_us": c, "ord": f"{c}_ord"}, volume, forward=True, chained=one_reader)
        return rows

    def ended(rows: DataFrame) -> DataFrame:
        return asof(rows, cum, level, "end_us", "ts_us", {"cum": "_upto"}, blocks, ["ord"], strict=True)

    whole = d
    d = ended(marked(d) if queues is None else d) if ends is None else marked(d) if queues is None else d
    d = first_beyond(d, prints, both, oid, "place_us", last, F.col("px"), -direction(), "ts_us", "px", "_thru", blocks, "ord")
    if queues is not None:
        one = marked(whole.select(*dict.fromkeys([*oid, *level]), "qty", "_base", F.inline("_queues")))
        d = d.drop("_queues").join(one.drop(*[c for c in (*level, "qty", "_base") if c not in oid]), list(oid))
    if ends is not None:
        one = ended(whole.select(*dict.fromkeys([*oid, *level]), F.inline("_ends")))
        d = d.drop("_ends").join(one.drop(*[c for c in level if c not in oid]), list(oid))
    d = d.withColumns({c: F.when(F.col(c) < F.col("end_us"), F.col(c)) for c in ("_first", "_full", "_thru")})

    def stamp(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("t"), F.col(f"{c}_ord").alias("o")))

    thru, first, full = stamp("_thru"), stamp("_first"), stamp("_full")
    by_thru = thru.isNotNull() & (full.isNull() | (thru < full))
    over = F.coalesce(F.col("_upto"), F.lit(0)) - (F.col("_want_first") - 1)
    done = by_thru | full.isNotNull()
    filled = F.when(done, F.col("qty")).otherwise(F.least(F.greatest(over, F.lit(0)), F.col("qty")))
    d = d.withColumns(
        {
            "first_us": F.least(thru, first)["t"],
            "full_us": F.least(thru, full)["t"],
            "filled": filled,
            "mechanism": F.when(by_thru, "through").when(full.isNotNull(), "at_quote"),
            "state": F.when(done, "full").when(filled > 0, "partial").otherwise("unfilled"),
        }
    )
    return d.drop("_base", "_upto", "_want_first", "_want_full", *[f"{c}{x}" for c in ("_first", "_full", "_thru") for x in ("", "_ord")])


def lifetime_grid(
    orders: DataFrame, snapshots: DataFrame, keys: Sequence[str], lifetimes: Sequence[int], day: int, ts: str,
    blocks: Blocks = ONE_BLOCK,
) -> tuple[DataFrame, Column, Column]:
    """Orders with their next snapshot, and the ``queues`` and ``ends`` of ``threshold_fills`` for lifetimes x queue
    model; a window ends at expiry, next snapshot or day end."""
    d = asof(orders, snapshots, keys, "place_us", ts, {ts: "_snap"}, blocks, forward=True, strict=True)
    day_end = ((F.floor(F.col("place_us") / F.lit(day)) + 1) * F.lit(day)).cast("bigint")

    def window(life: int) -> Column:
        expiry = F.col("place_us") + life
        return F.struct(
            F.lit(life).cast("bigint").alias("lifetime"),
            F.coalesce(F.col("_snap") < expiry, F.lit(False)).alias("snap_cut"),
            (day_end < expiry).alias("day_cut"),
            F.least(expiry, F.coalesce("_snap", expiry), day_end).alias("end_us"),
        )

    zero = F.lit(0).cast("bigint")
    queues = F.array(*[F.struct(F.lit(n).alias("queue"), a.cast("bigint").alias("ahead")) for n, a in (("full", F.col("ahead")), ("none", zero))])
    return d, queues, F.array(*[window(x) for x in lifetimes])


def cut_status(state: Column, snap_cut: Column, day_cut: Column) -> Column:
    partial = state == "partial"
    return (
        F.when(state == "full", "full")
        .when(snap_cut & partial, "partial_invalid_snapshot")
        .when(snap_cut, "invalid_snapshot")
        .when(day_cut & partial, "partial_invalid_day_boundary")
        .when(day_cut, "invalid_day_boundary")
        .otherwise(state)
    )


def first_true(
    df: DataFrame, keys: Sequence[str], ts: str, cond: Column, out: str, blocks: Blocks = ONE_BLOCK, strict: bool = False
) -> DataFrame:
    """Stamp of the first row at or after (``strict``: after) each row meeting ``cond`` in its key."""
    return running(df, keys, ts, {out: ("last", F.when(cond, F.col(ts)))}, blocks, exclusive=strict, reverse=True)


def crossings(
    orders: DataFrame, scores: DataFrame, keys: Sequence[str], place: str, end: str, ts: str, score: str, thresholds: Sequence[float],
    blocks: Blocks = ONE_BLOCK,
) -> DataFrame:
    """Per order and threshold: first score >= threshold strictly after placement and not after the
    observed end, plus how many score instants the order saw."""
    n = running(scores, keys, ts, {"_n": ("count", F.lit(1))}, blocks)
    d = asof(orders, n, keys, place, ts, {"_n": "_n0"}, blocks)
    d = asof(d, n, keys, end, ts, {"_n": "_n1"}, blocks)
    d = d.withColumn("instants", F.coalesce("_n1", F.lit(0)) - F.coalesce("_n0", F.lit(0))).drop("_n0", "_n1")
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    d = d.withColumn("threshold", grid)
    hits = scores.withColumn("threshold", grid).where(F.col(score) >= F.col("threshold"))
    d = asof(d, hits, [*keys, "threshold"], place, ts, {ts: "_c"}, blocks, forward=True, strict=True)
    return d.withColumn("crossing", F.when(F.col("_c") <= F.col(end), F.col("_c"))).drop("_c")


def cancel_outcomes(orders: DataFrame, latencies: Sequence[int], fill: str, markout: str) -> DataFrame:
    """Orders (one row per threshold, with ``crossing``) x latencies: what cancelling would have done.

    A fill at the effective instant survives.
    """
    d = orders.withColumn("latency", F.explode(F.array(*[F.lit(x).cast("bigint") for x in latencies])))
    signalled = F.col("crossing").isNotNull()
    filled = F.col(fill).isNotNull()
    effective = F.col("crossing") + F.col("latency")
    prevented = signalled & filled & (F.col(fill) > effective)
    m = F.col(markout)
    seen = F.coalesce(prevented, F.lit(False)) & m.isNotNull()
    d = d.withColumns({"signalled": signalled, "prevented": F.coalesce(prevented, F.lit(False)), "effective": effective})
    disposition = (
        F.when(~signalled, "unaffected")
        .when(~filled, "cancel_without_fill")
        .when(~F.col("prevented"), "too_late")
        .when(m.isNull(), "prevented_censored")
        .when(m < 0, "adverse_avoided")
        .when(m > 0, "favourable_sacrificed")
        .otherwise("neutral_sacrificed")
    )
    return d.withColumns(
        {
            "survives": filled & ~F.col("prevented"),
            "disposition": disposition,
            "avoided_ticks": F.when(seen, -F.least(m, F.lit(0))).otherwise(F.lit(0)),
            "sacrificed_ticks": F.when(seen, F.greatest(m, F.lit(0))).otherwise(F.lit(0)),
        }
    )


def pair_legs(
    entries: DataFrame, exits: DataFrame, keys: Sequence[str], at: str, fill: str, segment: str, delay: int, step: int, fee_bps: float
) -> DataFrame:
    """Entry fills with the opposite-side exit probe on the first grid instant after fill + delay."""
    target = (F.ceil((F.col(fill) + delay) / F.lit(step)) * F.lit(step)).cast("bigint")
    e = entries.where(F.col(fill).isNotNull()).withColumns(
        {"target": target, "exit_side": F.when(F.col("side") == "bid", "ask").otherwise("bid")}
    )
    x = exits.where(F.col(fill).isNotNull()).select(
        *keys, F.col(at).alias("target"), F.col("side").alias("exit_side"), F.col("px").alias("exit_px"), F.col(fill).alias("exit_fill"), F.col(segment).alias("_xs")
    )
    d = e.join(x, [*keys, "target", "exit_side"]).where((F.col("_xs") == F.col(segment)) & (F.col("exit_fill") > F.col(fill)))
    cash = direction() * (F.col("exit_px") - F.col("px"))
    fee = F.lit(fee_bps / 10_000) * (F.col("px") + F.col("exit_px"))
    base = F.nullif(F.col("px"), F.lit(0))
    return d.withColumns({"gross_bps": F.try_divide(cash * 10_000.0, base), "net_bps": F.try_divide((cash - fee) * 10_000.0, base)}).drop("_xs")


def interval_sums(
    spans: DataFrame, events: DataFrame, keys: Sequence[str], start: str, end: str, ts: str, value: str, out: str, blocks: Blocks = ONE_BLOCK
) -> DataFrame:
    """Sum of event values with start < ts <= end, as a difference of running sums."""
    cum = running(events, keys, ts, {"_c": ("sum", F.col(value))}, blocks)
    d = asof(spans, cum, keys, start, ts, {"_c": "_c0"}, blocks)
    d = asof(d, cum, keys, end, ts, {"_c": "_c1"}, blocks)
    return d.withColumn(out, F.coalesce("_c1", F.lit(0)) - F.coalesce("_c0", F.lit(0))).drop("_c0", "_c1")


def reconcile_executions(
    executions: DataFrame, events: DataFrame, key: str, ts: str, window: int, blocks: Blocks = ONE_BLOCK
) -> DataFrame:
    """Each execution against its maker's order events within +/- ``window``.

    Counts are differences of running counts and the first placement and last cancellation are as-of
    lookups, so a busy maker's executions and events are never paired.
    """
    kinds = {"n": F.lit(True), "p": F.col("kind") == "placed", "t": F.col("kind").isin("cancelled", "filled"), "c": F.col("kind") == "cancelled"}
    cum = running(events, [key], ts, {f"_{k}": ("sum", c.cast("bigint")) for k, c in kinds.items()}, blocks)
    e = executions.select("ord", key, F.col(ts).alias("exec_us"), "exec_qty")
    e = e.withColumns({"_lo": F.col("exec_us") - window, "_hi": F.col("exec_us") + window})

    def counts(tag: str) -> dict[str, str]:
        return {f"_{k}": f"_{k}_{tag}" for k in kinds}

    d = asof(e, cum, [key], "_hi", ts, counts("hi"), blocks)
    d = asof(d, cum, [key], "_lo", ts, counts("lo"), blocks, strict=True)
    d = asof(d, cum, [key], "exec_us", ts, {"_c": "_c_at"}, blocks, strict=True)
    placed = events.where("kind = 'placed'").select(key, ts, "qty")
    d = asof(d, placed, [key], "_lo", ts, {ts: "_pt", "qty": "_pq"}, blocks, forward=True)
    gone = events.where("kind = 'cancelled'").select(key, ts, "qty")
    d = asof(d, gone, [key], "_hi", ts, {ts: "_ct", "qty": "_cq"}, blocks)

    def between(k: str, low: str) -> Column:
        return F.coalesce(F.col(f"_{k}_hi"), F.lit(0)) - F.coalesce(F.col(low), F.lit(0))

    first = F.when(F.col("_pt") <= F.col("_hi"), F.col("_pq"))
    left = F.when(F.col("_ct") >= F.col("_lo"), F.col("_cq"))
    kind = F.when(first == F.col("exec_qty"), "full").when(first == F.col("exec_qty") + left, "partial_then_cancel").otherwise("unknown")
    return d.select(
        "ord", key, "exec_us", "exec_qty", between("n", "_n_lo").alias("window_events"), between("p", "_p_lo").alias("n_placed"),
        between("t", "_t_lo").alias("n_terminal"), between("c", "_c_at").alias("n_cancel_after"), kind.alias("fill_class"),
    )


def eligible_policies(df: DataFrame, policies: dict[str, Column]) -> DataFrame:
    """(row, policy) pairs of a catalogue of named conditions, a row once per policy it meets."""
    named = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in policies.items()])
    return df.withColumn("policy", F.explode(F.array_compact(named)))

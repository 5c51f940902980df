"""Trade tapes: one-position simulation, cost layers, tape and performance metrics, carry trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.book import ratio, walk_book
from tickloom.operators.joins import interval_sums
from tickloom.operators.ordered import ONE_BLOCK, Blocks, asof, halo_range, row_numbers, running, shifted
from tickloom.operators.selection import spaced
from tickloom.operators.stats import attach, mean_if, safe_corr, share


def one_position_trades(
    book: DataFrame, keys: Sequence[str], ts: str, segment: str, signal: str, least: float, latency: int, hold: int, step: int,
    qty: int, blocks: Blocks = ONE_BLOCK,
) -> DataFrame:
    """Every signal with its fate when only one position may be open per key.

    A tradable signal enters ``latency`` rows and leaves ``hold`` rows later against visible depth;
    otherwise the reason is boundary, gap or depth. While a position is open later signals are
    ``overlap``. Completed trades carry the price of each cost layer, in ticks.
    """
    side = F.signum(F.col(signal)).cast("int")
    state = F.struct(
        F.col(ts).alias("t"), F.col(segment).alias("s"), *[F.col(c) for c in ("bid_px", "bid_qty", "ask_px", "ask_qty")]
    )
    d = book.withColumn("_now", state)
    d = shifted(d, keys, ts, {"_in": (F.col("_now"), -latency), "_out": (F.col("_now"), -hold)}, blocks)
    d = d.where(F.col(signal).isNotNull() & (F.abs(signal) >= least) & (F.col(signal) != 0)).withColumn("direction", side)
    want = F.lit(qty).cast("bigint")

    def fill(row: str, buying: bool) -> Column:
        s = "ask" if buying else "bid"
        return walk_book(F.col(f"{row}.{s}_px"), F.col(f"{row}.{s}_qty"), want, buying)["vwap"]

    up = F.col("direction") > 0
    d = d.withColumns(
        {
            "zero_in": F.when(up, fill("_now", True)).otherwise(fill("_now", False)),
            "entry": F.when(up, fill("_in", True)).otherwise(fill("_in", False)),
            "exit": F.when(up, fill("_out", False)).otherwise(fill("_out", True)),
            "touch_in": F.when(up, F.col("_now.ask_px")[0]).otherwise(F.col("_now.bid_px")[0]),
            "touch_out": F.when(up, F.col("_out.bid_px")[0]).otherwise(F.col("_out.ask_px")[0]),
            "mid_move": ((F.col("_out.bid_px")[0] + F.col("_out.ask_px")[0]) - (F.col("_now.bid_px")[0] + F.col("_now.ask_px")[0])) / 2.0,
            "entry_us": F.col("_in.t"),
            "exit_us": F.col("_out.t"),
        }
    )
    same = (F.col("_in.s") == F.col(segment)) & (F.col("_out.s") == F.col(segment)) & (F.col("exit_us") - F.col(ts) == hold * step)
    reason = (
        F.when(F.col("_in").isNull() | F.col("_out").isNull(), "boundary")
        .when(~same, "gap")
        .when(F.col("zero_in").isNull() | F.col("entry").isNull() | F.col("exit").isNull(), "depth")
        .otherwise("tradable")
    )
    d = d.withColumn("_reason", reason).drop("_now", "_in", "_out", "bid_px", "bid_qty", "ask_px", "ask_qty")
    taken = spaced(d.where("_reason = 'tradable'"), keys, ts, hold * step, blocks).select(*keys, F.col(ts).alias("_open"))
    d = asof(d, taken, keys, ts, "_open", {"_open": "_open"}, blocks)
    is_trade = F.col("_open") == F.col(ts)
    busy = F.col("_open").isNotNull() & (F.col(ts) < F.col("_open") + hold * step)
    status = F.when(is_trade, "trade").when(busy, "overlap").otherwise(F.col("_reason"))
    s = F.col("direction")
    layers = {
        "mid_ticks": s * F.col("mid_move"), "touch_ticks": (s * (F.col("touch_out") - F.col("touch_in"))).cast("double"),
        "zero_ticks": s * (F.col("exit") - F.col("zero_in")), "gross_ticks": s * (F.col("exit") - F.col("entry")),
    }
    d = d.withColumn("status", F.coalesce(status, F.col("_reason")))
    return d.withColumns({o: F.when(F.col("status") == "trade", c) for o, c in layers.items()}).drop("_open", "_reason", "mid_move", "touch_in", "touch_out")


def cost_layers(trades: DataFrame, fee_bps: float, penalty: float) -> DataFrame:
    """Mid, touch, depth, fee, delay and stress PnL of each trade in ticks, and the drag of each step."""
    rate = fee_bps / 10_000
    s = F.col("direction")
    fee0 = rate * (F.col("zero_in") + F.col("exit"))
    fee = rate * (F.col("entry") + F.col("exit"))
    stress_in, stress_out = F.col("entry") + s * penalty, F.col("exit") - s * penalty
    return trades.withColumns(
        {
            "after_fee_ticks": F.col("zero_ticks") - fee0,
            "after_delay_ticks": F.col("gross_ticks") - fee,
            "stress_ticks": s * (stress_out - stress_in) - rate * (stress_in + stress_out),
            "spread_drag": F.col("mid_ticks") - F.col("touch_ticks"),
            "depth_drag": F.col("touch_ticks") - F.col("zero_ticks"),
            "delay_drag": F.col("zero_ticks") - F.col("gross_ticks"),
            "fee_drag": fee,
            "turnover": F.col("entry") + F.col("exit"),
        }
    )


def tape_metrics(trades: DataFrame, keys: Sequence[str], order: str, tie: str, day: str, gross: str, costs: Sequence[float], blocks: Blocks = ONE_BLOCK) -> DataFrame:
    """Edge, hit rate, Sharpe, concentration in the best day and best 5 % of trades, per cost."""
    ks = [*keys, "cost"]
    # A cost is the same for every trade, so trades rank alike before and after it.
    d = attach(trades, trades.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    d = row_numbers(d, keys, gross, "_r", blocks, [tie], reverse=True)
    d = d.withColumn("cost", F.explode(F.array(*[F.lit(float(c)) for c in costs])))
    d = d.withColumn("_net", F.col(gross) - 2 * F.col("cost"))
    best = F.col("_r") <= F.greatest(F.ceil(F.col("_n") * F.lit(0.05)), F.lit(1))
    by_day = d.groupBy(*ks, day).agg(F.sum("_net").alias("_d")).groupBy(*ks).agg(
        F.max("_d").alias("_best_day"), F.count_if(F.col("_d") > 0).alias("positive_days"), F.count("*").alias("days")
    )
    m = d.groupBy(*ks).agg(
        F.count("*").alias("trades"), F.avg(gross).alias("gross_edge"), F.avg("_net").alias("net_edge"), share(F.col("_net") > 0).alias("hit_rate"),
        F.stddev_samp("_net").alias("_sd"), F.sum("_net").alias("total"), F.sum(F.when(best, F.col("_net"))).alias("_top"),
    ).join(by_day, ks)
    won = F.col("total") > 0
    return m.withColumns(
        {
            "sharpe": ratio(F.col("net_edge") * F.sqrt("trades"), F.nullif("_sd", F.lit(0.0))),
            "best_day_share": F.when(won, F.col("_best_day") / F.col("total")),
            "best_5pct_share": F.when(won, F.col("_top") / F.col("total")),
        }
    ).drop("_sd", "_top", "_best_day")


def performance(trades: DataFrame, keys: Sequence[str], order: str, day: str, pnl: str, blocks: Blocks = ONE_BLOCK, ties: Sequence[str] = ()) -> DataFrame:
    """Totals, win rate, profit factor, turnover, exposure, drawdown of the trade curve, daily Sharpe."""
    p = F.col(pnl)
    d = running(trades, keys, order, {"_cum": ("sum", p)}, blocks, ties)
    d = running(d, keys, order, {"_peak": ("max", F.col("_cum"))}, blocks, ties)
    down = F.greatest(F.col("_peak"), F.lit(0)) - F.col("_cum")
    m = d.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.sum(p).alias("total"), F.avg(p).alias("average"), share(p > 0).alias("win_rate"),
        F.sum(F.greatest(p, F.lit(0))).alias("_gain"), F.sum(F.greatest(-p, F.lit(0))).alias("_loss"), F.sum("turnover").alias("turnover"),
        (F.sum("exposure_us") / 1e6).alias("exposure_s"), F.max(down).alias("max_drawdown"), F.avg(down).alias("average_drawdown"), F.min(p).alias("worst"), F.max(p).alias("best"),
    )
    m = m.withColumn("profit_factor", ratio(F.col("_gain"), F.nullif(F.col("_loss"), F.lit(0)))).drop("_gain", "_loss")
    daily = trades.groupBy(*keys, day).agg(F.sum(p).alias("_d")).groupBy(*keys).agg(
        F.count("*").alias("days"), ratio(F.avg("_d"), F.nullif(F.stddev_samp("_d"), F.lit(0.0))).alias("daily_sharpe")
    )
    return attach(m, daily, keys).withColumn("pnl_per_turnover", ratio(F.col("total"), F.nullif("turnover", F.lit(0.0))))


def daily_economics(days: DataFrame, keys: Sequence[str], day: str, blocks: Blocks = ONE_BLOCK) -> DataFrame:
    """Day rows (gross, fee, notional, fills) pooled: net bp, drawdown of the daily curve, Sharpe, break-even fee."""
    net = F.col("gross") - F.col("fee")
    d = days.withColumn("_net", net)
    d = running(d, keys, day, {"_cum": ("sum", F.col("_net"))}, blocks)
    d = running(d, keys, day, {"_peak": ("max", F.col("_cum"))}, blocks)
    return d.groupBy(*keys).agg(
        F.count("*").alias("days"), F.sum("gross").alias("gross"), F.sum("_net").alias("net"), ratio(F.sum("_net") * 10_000, F.nullif(F.sum("notional"), F.lit(0))).alias("net_bps"),
        F.count_if(F.col("_net") > 0).alias("positive_days"), F.min("_net").alias("worst_day"), F.avg("fills").alias("fills_per_day"),
        F.max(F.greatest(F.col("_peak"), F.lit(0)) - F.col("_cum")).alias("max_drawdown"),
        ratio(F.avg("_net") * F.sqrt(F.lit(365.0)), F.nullif(F.stddev_samp("_net"), F.lit(0.0))).alias("daily_sharpe"),
        ratio(F.sum("gross") * 10_000, F.nullif(F.sum("notional"), F.lit(0))).alias("break_even_bps"),
    )


def compounded(df: DataFrame, keys: Sequence[str], order: str, growth: Column, out: str, blocks: Blocks = ONE_BLOCK) -> DataFrame:
    """Running product of ``growth`` through sums of logs; a negative factor flips the sign and a
    zero factor stays zero."""
    g = growth.cast("double")
    parts = {
        "_log": ("sum", F.when(g != 0, F.log(F.abs(g))).otherwise(F.lit(0.0))),
        "_neg": ("sum", (g < 0).cast("bigint")),
        "_zero": ("sum", (g == 0).cast("bigint")),
    }
    d = running(df, keys, order, parts, blocks)
    value = F.exp("_log") * F.when(F.col("_neg") % 2 == 0, 1.0).otherwise(-1.0)
    return d.withColumn(out, F.when(F.col("_zero") > 0, 0.0).otherwise(value)).drop(*parts)


def carry_trades(markets: DataFrame, funding: DataFrame, hold: int, blocks: Blocks = ONE_BLOCK) -> DataFrame:
    """Spot-perp holds opened at every ``hold``-th common stamp: funding, basis PnL, basis widening in bp."""
    basis = (F.col("perp") / F.col("spot") - 1) * 10_000
    d = markets.withColumn("basis", basis)
    d = row_numbers(d, [], "day", "_n", blocks)
    f = halo_range(d, [], "day", blocks, fwd=hold)
    d = f.close(f.df.withColumn("_widest", F.max("basis").over(f.window.rangeBetween(0, hold))))
    exits = markets.select((F.col("day") - hold).alias("day"), F.col("spot").alias("_s1"), F.col("perp").alias("_p1"))
    t = d.where((F.col("_n") - 1) % hold == 0).join(exits, "day").withColumn("closed", F.col("day") + hold)
    t = interval_sums(t, funding, [], "day", "closed", "f_day", "rate", "_paid", blocks)
    pair = F.col("_s1") / F.col("spot") - F.col("_p1") / F.col("perp")
    return t.select(
        F.col("day").alias("opened"), (-F.col("_paid") / 100.0).alias("funding_bps"), (pair * 10_000).alias("basis_bps"),
        (-F.col("_paid") / 100.0 + pair * 10_000).alias("gross_bps"), (F.col("_widest") - F.col("basis")).alias("widening_bps"),
    )


def carry_summary(trades: DataFrame, keys: Sequence[str], leg_cost: float, blocks: Blocks = ONE_BLOCK) -> DataFrame:
    """Means, share of positive trades and the drawdown of compounded equity (half the pair notional)."""
    net = F.col("gross_bps") - 2 * leg_cost
    d = compounded(trades.withColumn("_net", net), keys, "opened", 1 + F.col("_net") / 20_000, "_eq", blocks)
    d = running(d, keys, "opened", {"_pk": ("max", F.col("_eq"))}, blocks)
    peak = F.greatest(F.col("_pk"), F.lit(1.0))
    return d.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.avg("funding_bps").alias("funding_bps"), F.avg("basis_bps").alias("basis_bps"), F.avg("gross_bps").alias("gross_bps"),
        F.avg("_net").alias("net_bps"), share(F.col("_net") > 0).alias("positive_share"), F.max("widening_bps").alias("worst_widening"),
        F.max((peak - F.col("_eq")) / peak).alias("max_drawdown"),
    )


def sign_reversals(events: DataFrame, keys: Sequence[str], order: str, value: str, blocks: Blocks = ONE_BLOCK) -> DataFrame:
    """Sign changes between neighbouring events that are both non-zero."""
    d = shifted(events, keys, order, {"_p": (F.col(value), 1)}, blocks)
    both = (F.col("_p") != 0) & (F.col(value) != 0)
    flip = both & ((F.col("_p") > 0) != (F.col(value) > 0))
    return d.groupBy(*keys).agg(F.count_if(both).alias("pairs"), F.count_if(flip).alias("changes")).withColumn("frequency", ratio(F.col("changes"), F.nullif("pairs", F.lit(0))))


def pooled(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Day partials pooled: ratios from summed counts, day medians weighted by labelled rows."""
    n = F.sum("labelled")
    return days.groupBy(*keys).agg(
        F.count_distinct("day").alias("days"), F.sum("candidates").alias("candidates"), F.sum("fills").alias("fills"), n.alias("labelled"),
        ratio(F.sum("fills"), F.nullif(F.sum("candidates"), F.lit(0))).alias("fill_probability"), ratio(F.sum("markout_sum"), F.nullif(n, F.lit(0))).alias("mean"),
        ratio(F.sum(F.col("median") * F.col("labelled")), F.nullif(n, F.lit(0))).alias("weighted_median"),
    )


def versus_baseline(table: DataFrame, keys: Sequence[str], by: str, baseline: str, cols: Sequence[str]) -> DataFrame:
    """Each column minus the baseline row's, and the share of the baseline's rows kept."""
    b = table.where(F.col(by) == baseline).select(*keys, *[F.col(c).alias(f"_b_{c}") for c in cols], F.col("labelled").alias("_bn"))
    d = attach(table, b, keys)
    d = d.withColumns({f"{c}_gain": F.col(c) - F.col(f"_b_{c}") for c in cols} | {"retention": ratio(F.col("labelled"), F.nullif("_bn", F.lit(0)))})
    return d.drop("_bn", *[f"_b_{c}" for c in cols])


def prefix_metrics(df: DataFrame, keys: Sequence[str], signal: str, gross: str, cost: float, thresholds: Sequence[float]) -> DataFrame:
    """For each cut of |signal|: rows at or beyond it, mean gross and net, total net, win rate."""
    levels = F.array_compact(F.array(*[F.when(F.abs(signal) >= t, F.lit(float(t))) for t in thresholds]))
    net = F.col(gross) - cost
    d = df.withColumn("threshold", F.explode(levels))
    return d.groupBy(*keys, "threshold").agg(
        F.count(gross).alias("n"), F.avg(gross).alias("mean_gross"), F.avg(net).alias("mean_net"), F.sum(net).alias("total_net"), share(net > 0).alias("win_rate")
    )


def gate_table(days: DataFrame, keys: Sequence[str], net: str, least: int, baseline: float) -> DataFrame:
    """Named checks per policy: every day positive, enough activity each day, pooled gain over a baseline."""
    d = days.groupBy(*keys).agg(
        F.bool_and(F.col(net) > 0).alias("all_days_positive"), F.bool_and(F.col("labelled") >= least).alias("enough_activity"),
        ratio(F.sum("markout_sum"), F.nullif(F.sum("labelled"), F.lit(0))).alias("pooled"),
    )
    d = d.withColumn("beats_baseline", F.coalesce(F.col("pooled") > baseline, F.lit(False)))
    return d.withColumn("passes", F.coalesce(F.col("all_days_positive"), F.lit(False)) & F.col("enough_activity") & F.col("beats_baseline"))


def bar_metrics(df: DataFrame, keys: Sequence[str], order: str, hold: int, least: float, cost: float, blocks: Blocks = ONE_BLOCK) -> DataFrame:
    """Score against forward log return on all rows, and the every-``hold``-rows tape of strong scores."""
    score, target = F.col("score"), F.col("target")
    rows = df.groupBy(*keys).agg(
        F.count("*").alias("n"), share(F.signum(score) == F.signum(target)).alias("accuracy"), safe_corr("score", "target").alias("ic"),
        (mean_if(F.col("decile") == 9, target) - mean_if(F.col("decile") == 0, target)).alias("decile_gap"),
    )
    t = row_numbers(df, keys, order, "_n", blocks).where(((F.col("_n") - 1) % hold == 0) & (F.abs(score) >= least))
    t = t.withColumn("_gross", F.signum(score) * target).withColumn("_net", F.col("_gross") - cost)
    t = compounded(t, keys, order, 1 + F.col("_net"), "_w", blocks)
    t = running(t, keys, order, {"_pk": ("max", F.col("_w"))}, blocks)
    t = attach(t, t.groupBy(*keys).agg(F.count("*").alias("_t")), keys)
    t = row_numbers(t, keys, "_net", "_r", ONE_BLOCK if blocks.single else Blocks.fit(t, "_net"), [order], reverse=True)
    top = F.col("_r") <= F.greatest(F.floor(F.col("_t") * F.lit(0.05)), F.lit(1))
    tape = t.groupBy(*keys).agg(
        F.count("*").alias("trade_count"), F.avg("_gross").alias("gross_edge"), F.avg("_net").alias("net_edge"),
        ratio(F.avg("_gross"), F.nullif(F.stddev_samp("_gross"), F.lit(0.0))).alias("gross_sharpe"), ratio(F.avg("_net"), F.nullif(F.stddev_samp("_net"), F.lit(0.0))).alias("net_sharpe"),
        F.min(F.col("_w") / F.col("_pk") - 1).alias("max_drawdown"), mean_if(score > 0, F.col("_net")).alias("long_edge"), mean_if(score < 0, F.col("_net")).alias("short_edge"),
        ratio(F.sum(F.when(top, F.col("_net"))), F.nullif(F.sum("_net"), F.lit(0.0))).alias("top_share"),
        (F.count("*") * 365.25 / F.greatest(F.max(order) - F.min(order), F.lit(1))).alias("turnover"),
    )
    return rows.join(tape, list(keys))

"""Queries for fills, policies, tapes, carry and order life."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import signals as sg
from tickloom.operators import stats as st
from tickloom.operators import trades as tr
from tickloom.operators.joins import eligible_policies
from tickloom.operators.ordered import shifted
from tickloom.operators.selection import spaced, tail_select
from tickloom.operators.windows import bar_features, rank_deciles
from tickloom.plans.joins import ALPHAS, LIVES, STATUS, aligned, lifetimes, marked_fills
from tickloom.plans.registry import query
from tickloom.plans.stats_base import fills_cut, rank_sql
from tickloom.plans.stats_signal import class_sql, study
from tickloom.plans.views import DAY, HOUR


@query(
    "fill_probability",
    f"""SELECT side, lifetime, queue, ahead_bin, count(*) AS candidates, count(*) FILTER (WHERE status IN ('full', 'partial', 'unfilled')) AS resolved, count(*) FILTER (WHERE status = 'full') AS full_n,
               count(*) FILTER (WHERE status LIKE 'partial%') AS partial_n, count(*) FILTER (WHERE status = 'full') / nullif(count(*) FILTER (WHERE status IN ('full', 'partial', 'unfilled')), 0) AS p_full,
               quantile_cont((full_us - place_us) / 6e7, 0.5) AS median_min
        FROM (SELECT *, least(ahead // 10, 3) AS ahead_bin FROM ({STATUS})) GROUP BY 1, 2, 3, 4""",
    dbl="p_full median_min",
)
def fill_probability(v):
    d = lifetimes(v).withColumns({"ahead_bin": F.least(F.expr("ahead div 10"), F.lit(3)), "wait": (F.col("full_us") - F.col("place_us")) / 6e7})
    resolved = F.count_if(F.col("status").isin("full", "partial", "unfilled"))
    full = F.count_if(F.col("status") == "full")
    aggs = {
        "candidates": F.count("*"), "resolved": resolved, "full_n": full, "partial_n": F.count_if(F.col("status").startswith("partial")),
        "p_full": F.try_divide(full.cast("double"), F.nullif(resolved, F.lit(0)).cast("double")),
    }
    return st.grouped(d, ["side", "lifetime", "queue", "ahead_bin"], aggs, {"median_min": ("wait", 0.5)}, v.cut(d, "events", 8))


@query(
    "fee_envelope",
    """SELECT side, alpha, fee::DOUBLE AS fee, count(e) AS labelled, avg(e) AS gross_bps, avg(e - fee) AS net_bps, avg(e) AS break_even_bps, greatest(0, -avg(e)) AS required_rebate
       FROM (SELECT side, alpha, m1 * 10000.0 / nullif(2 * price, 0) AS e FROM fills WHERE m1 IS NOT NULL), (VALUES (-0.5), (0.0), (2.0)) f(fee) GROUP BY 1, 2, 3""",
    dbl="fee gross_bps net_bps break_even_bps required_rebate",
)
def fee_envelope(v):
    e = F.try_divide(F.col("m1") * 10_000.0, F.nullif(2 * F.col("price"), F.lit(0)))
    d = marked_fills(v).where("m1 IS NOT NULL").withColumns({"e": e, "fee": F.explode(F.array(F.lit(-0.5), F.lit(0.0), F.lit(2.0)))})
    return d.groupBy("side", "alpha", "fee").agg(
        F.count("e").alias("labelled"), F.avg("e").alias("gross_bps"), F.avg(F.col("e") - F.col("fee")).alias("net_bps"), F.avg("e").alias("break_even_bps"),
        F.greatest(F.lit(0.0), -F.avg("e")).alias("required_rebate"),
    )


POL = {"all": "true", "cheap": "px = 0", "short_queue": "ahead < 10", "cheap_short": "px = 0 AND ahead < 10"}
POLICY_DAYS = (
    f"""SELECT policy, place_us // {DAY} AS day, side, count(*) AS candidates, count(*) FILTER (WHERE filled) AS fills, count(m1) AS labelled, coalesce(sum(m1), 0)::BIGINT AS markout_sum, avg(m1) AS mean,
               quantile_cont(m1, 0.5) AS median, avg((m1 < 0)::INT) AS negative_share FROM (SELECT *, unnest([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in POL.items())}]) AS policy FROM fills WHERE alpha = 100) WHERE policy IS NOT NULL GROUP BY 1, 2, 3"""
)


def policy_days(v, alphas=(100,), keys=("policy", "day", "side")):
    """Metrics of the policies under some queue shares; a policy sees the displayed queue, not the share assumed of it."""
    d = marked_fills(v, alphas, shown="shown")
    d = eligible_policies(d, {n: F.expr(c.replace("ahead", "shown")) for n, c in POL.items()}).withColumn("day", F.expr(f"place_us div {DAY}"))
    m = F.col("m1")
    aggs = {
        "candidates": F.count("*"), "fills": F.count_if("filled"), "labelled": F.count(m), "markout_sum": F.coalesce(F.sum(m), F.lit(0)), "mean": F.avg(m), "negative_share": st.share(m < 0),
    }
    return st.grouped(d, keys, aggs, {"median": ("m1", 0.5)}, v.cut(d, "events", 4 * len(alphas)))


@query("policy_metrics", POLICY_DAYS, dbl="mean median negative_share")
def policy_metrics(v):
    return policy_days(v)


@query(
    "policy_queue_metrics",
    f"""SELECT alpha, policy, place_us // {DAY} AS day, side, count(*) AS candidates, count(*) FILTER (WHERE filled) AS fills, count(m1) AS labelled, coalesce(sum(m1), 0)::BIGINT AS markout_sum, avg(m1) AS mean,
               quantile_cont(m1, 0.5) AS median, avg((m1 < 0)::INT) AS negative_share
        FROM (SELECT *, unnest([{", ".join(f"CASE WHEN {c.replace('ahead', 'shown')} THEN '{n}' END" for n, c in POL.items())}]) AS policy FROM fills JOIN (SELECT oid, ahead % 40 AS shown FROM orders_p) USING (oid))
        WHERE policy IS NOT NULL GROUP BY 1, 2, 3, 4""",
    dbl="mean median negative_share",
)
def policy_queue_metrics(v):
    return policy_days(v, ALPHAS, ("alpha", "policy", "day", "side"))


@query(
    "pooled_reaggregation",
    f"""WITH p AS (SELECT policy, side, count(DISTINCT day) AS days, sum(candidates)::BIGINT AS candidates, sum(fills)::BIGINT AS fills, sum(labelled)::BIGINT AS labelled, sum(fills) / nullif(sum(candidates), 0) AS fill_probability,
                          sum(markout_sum) / nullif(sum(labelled), 0) AS mean, sum(median * labelled) / nullif(sum(labelled), 0) AS weighted_median FROM ({POLICY_DAYS}) GROUP BY 1, 2)
        SELECT p.*, p.mean - b.mean AS mean_gain, p.labelled / nullif(b.labelled, 0) AS retention FROM p LEFT JOIN (SELECT * FROM p WHERE policy = 'all') b ON b.side = p.side""",
    dbl="fill_probability mean weighted_median mean_gain retention",
)
def pooled_reaggregation(v):
    return tr.versus_baseline(tr.pooled(policy_days(v), ["policy", "side"]), ["side"], "policy", "all", ["mean"])


CUTS = [20, 50, 100, 200]


@query(
    "tail_prefix_metrics",
    """SELECT horizon, day, t.threshold::DOUBLE AS threshold, count(g) AS n, avg(g) AS mean_gross, avg(g - 1.0) AS mean_net, sum(g - 1.0) AS total_net, avg((g - 1.0 > 0)::INT) AS win_rate
       FROM (SELECT horizon, day, sig, sign(sig) * y AS g FROM study), (VALUES (20), (50), (100), (200)) t(threshold) WHERE abs(sig) >= t.threshold GROUP BY 1, 2, 3""",
    dbl="threshold mean_gross mean_net total_net win_rate",
)
def tail_prefix_metrics(v):
    d = study(v).withColumn("g", F.signum("sig") * F.col("y"))
    return tr.prefix_metrics(d, ["horizon", "day"], "sig", "g", 1.0, CUTS)


REG = {"low_mid": "mid_x2 < 50", "high_mid": "mid_x2 >= 150", "falling": "sig < 0", "rising": "sig > 0", "night": f"g_us // {HOUR} % 24 < 8"}


@query(
    "regime_totals",
    f"""SELECT policy AS regime, count(*) AS n, sum(y)::BIGINT AS total, count(*) FILTER (WHERE y > 0) AS wins FROM (SELECT y, unnest([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in REG.items())}]) AS policy FROM study WHERE horizon = 6)
        WHERE policy IS NOT NULL GROUP BY 1""",
)
def regime_totals(v):
    d = eligible_policies(study(v).where("horizon = 6"), {n: F.expr(c.replace("//", "div")) for n, c in REG.items()})
    return d.groupBy(F.col("policy").alias("regime")).agg(F.count("*").alias("n"), F.sum("y").alias("total"), F.count_if(F.col("y") > 0).alias("wins"))


TAPE = f"""
    WITH RECURSIVE s AS (SELECT * FROM study WHERE horizon = 6), c AS (SELECT day, quantile_cont(sig, 0.9) AS cut FROM s GROUP BY 1),
    sel AS (SELECT s.seg, s.g_us, s.day, s.uid, s.y / 10.0 AS gross FROM s JOIN c USING (day) WHERE s.sig >= c.cut),
    nx AS (SELECT a.seg, a.g_us, min(b.g_us) AS nxt FROM sel a JOIN sel b ON a.seg = b.seg AND b.g_us >= a.g_us + {7 * HOUR} GROUP BY 1, 2),
    kept AS (SELECT seg, min(g_us) AS g_us FROM sel GROUP BY 1 UNION ALL SELECT k.seg, n.nxt FROM kept k JOIN nx n ON n.seg = k.seg AND n.g_us = k.g_us),
    tape AS (SELECT sel.* FROM sel JOIN kept USING (seg, g_us))"""


def selected(v):
    d = study(v).where("horizon = 6")
    return tail_select(d, ["day"], "sig", 0.1, v.cut(d, "events", 10)("sig")).withColumn("gross", F.col("y") / 10.0)


def tape(v):
    chosen = v.settled(selected(v), "selected", v.time)
    return v.settled(spaced(chosen, ["seg"], "g_us", 7 * HOUR, v.time), "tape", v.time)


@query(
    "trade_tape_metrics",
    TAPE + """, n AS (SELECT t.*, cost, gross - 2 * cost AS net FROM tape t, (VALUES (0.0::DOUBLE), (1.0::DOUBLE), (5.0::DOUBLE)) c(cost)),
      r AS (SELECT *, row_number() OVER (PARTITION BY cost ORDER BY net DESC, uid DESC) AS r, count(*) OVER (PARTITION BY cost) AS n FROM n), d AS (SELECT cost, day, sum(net) AS d FROM n GROUP BY 1, 2),
      e AS (SELECT cost, max(d) AS best, count(*) FILTER (WHERE d > 0) AS positive_days, count(*) AS days FROM d GROUP BY 1)
      SELECT r.cost, count(*) AS trades, avg(gross) AS gross_edge, avg(net) AS net_edge, avg((net > 0)::INT) AS hit_rate, sum(net) AS total, max(positive_days) AS positive_days, max(days) AS days,
             avg(net) * sqrt(count(*)) / nullif(stddev_samp(net), 0) AS sharpe, CASE WHEN sum(net) > 0 THEN max(best) / sum(net) END AS best_day_share,
             CASE WHEN sum(net) > 0 THEN sum(net) FILTER (WHERE r <= greatest(ceil(n * 0.05), 1)) / sum(net) END AS best_5pct_share FROM r JOIN e USING (cost) GROUP BY 1""",
    dbl="cost gross_edge net_edge hit_rate total sharpe best_day_share best_5pct_share",
)
def trade_tape_metrics(v):
    d = tape(v)
    return tr.tape_metrics(d, [], "g_us", "uid", "day", "gross", [0, 1, 5], v.blocks(d, "gross", "events", 10, tie="uid"))


OFF = "1000 + mid_x2 // 8"
TRADES = f"""
    WITH RECURSIVE b AS (SELECT seg, sid, g_us, (list_sum(bid_qty[1:5]) - list_sum(ask_qty[1:5]))::BIGINT AS sig, mid_x2 // 8 AS off, bid_qty, ask_qty FROM book10),
    l AS (SELECT *, lead(g_us, 1) OVER w AS t1, lead(sid, 1) OVER w AS s1, lead(off, 1) OVER w AS o1, lead(bid_qty, 1) OVER w AS b1, lead(ask_qty, 1) OVER w AS a1,
                 lead(g_us, 6) OVER w AS t6, lead(sid, 6) OVER w AS s6, lead(off, 6) OVER w AS o6, lead(bid_qty, 6) OVER w AS b6, lead(ask_qty, 6) OVER w AS a6 FROM b WINDOW w AS (PARTITION BY seg ORDER BY g_us)),
    s AS (SELECT *, sign(sig)::BIGINT AS direction FROM l WHERE abs(sig) >= 40),
    legs AS (SELECT seg, g_us, 'zero' AS leg, off AS o, CASE WHEN direction > 0 THEN 1 ELSE -1 END AS out, CASE WHEN direction > 0 THEN ask_qty ELSE bid_qty END AS q FROM s
             UNION ALL SELECT seg, g_us, 'entry', o1, CASE WHEN direction > 0 THEN 1 ELSE -1 END, CASE WHEN direction > 0 THEN a1 ELSE b1 END FROM s
             UNION ALL SELECT seg, g_us, 'exit', o6, CASE WHEN direction > 0 THEN -1 ELSE 1 END, CASE WHEN direction > 0 THEN b6 ELSE a6 END FROM s),
    lv AS (SELECT seg, g_us, leg, 1000 + o + out * i AS px, q[i] AS q, list_sum(q[1:i]) AS cum, list_sum(q) AS total FROM legs, range(1, 11) r(i) WHERE q IS NOT NULL),
    f AS (SELECT seg, g_us, leg, CASE WHEN max(total) >= 200 THEN sum(px * greatest(least(q, 200 - (cum - q)), 0)) / 200.0 END AS vwap FROM lv GROUP BY 1, 2, 3),
    p AS (SELECT seg, g_us, max(vwap) FILTER (WHERE leg = 'zero') AS zero_in, max(vwap) FILTER (WHERE leg = 'entry') AS entry, max(vwap) FILTER (WHERE leg = 'exit') AS exit FROM f GROUP BY 1, 2),
    x AS (SELECT s.*, p.zero_in, p.entry, p.exit, CASE WHEN t1 IS NULL OR t6 IS NULL THEN 'boundary' WHEN s1 <> sid OR s6 <> sid OR t6 - s.g_us <> {6 * HOUR} THEN 'gap'
                      WHEN p.zero_in IS NULL OR p.entry IS NULL OR p.exit IS NULL THEN 'depth' ELSE 'tradable' END AS reason FROM s LEFT JOIN p ON p.seg = s.seg AND p.g_us = s.g_us),
    c AS (SELECT seg, g_us FROM x WHERE reason = 'tradable'), nx AS (SELECT a.seg, a.g_us, min(b.g_us) AS nxt FROM c a JOIN c b ON a.seg = b.seg AND b.g_us >= a.g_us + {6 * HOUR} GROUP BY 1, 2),
    kept AS (SELECT seg, min(g_us) AS g_us FROM c GROUP BY 1 UNION ALL SELECT k.seg, n.nxt FROM kept k JOIN nx n ON n.seg = k.seg AND n.g_us = k.g_us),
    o AS (SELECT x.seg, x.g_us, max(k.g_us) AS open FROM x LEFT JOIN kept k ON k.seg = x.seg AND k.g_us <= x.g_us GROUP BY 1, 2),
    y AS (SELECT x.*, CASE WHEN o.open = x.g_us THEN 'trade' WHEN x.g_us < o.open + {6 * HOUR} THEN 'overlap' ELSE reason END AS status FROM x JOIN o ON o.seg = x.seg AND o.g_us = x.g_us),
    t AS (SELECT seg, sid, g_us, sig, direction, zero_in, entry, exit, t1 AS entry_us, t6 AS exit_us, status, CASE WHEN status = 'trade' THEN direction * (o6 - off) END::DOUBLE AS mid_ticks,
                 CASE WHEN status = 'trade' THEN direction * (o6 - direction - off - direction) END::DOUBLE AS touch_ticks, CASE WHEN status = 'trade' THEN direction * (exit - zero_in) END AS zero_ticks,
                 CASE WHEN status = 'trade' THEN direction * (exit - entry) END AS gross_ticks FROM y)"""


def trades(v):
    off = F.expr("mid_x2 div 8")
    d = v.book10.withColumns(
        {"bid_px": F.transform("bid_px", lambda x: x + off), "ask_px": F.transform("ask_px", lambda x: x + off), "sig": F.expr("aggregate(slice(bid_qty, 1, 5), 0L, (a, x) -> a + x) - aggregate(slice(ask_qty, 1, 5), 0L, (a, x) -> a + x)")}
    ).drop("mid_x2")
    return tr.one_position_trades(d, ["seg"], "g_us", "sid", "sig", 40, 1, 6, HOUR, 200, v.time)


LAY = "mid_ticks touch_ticks zero_ticks gross_ticks"


@query("one_position_trades", TRADES + f" SELECT seg, g_us, direction, status, zero_in, entry, exit, entry_us, exit_us, {LAY.replace(' ', ', ')} FROM t", dbl=f"zero_in entry exit {LAY}")
def one_position_trades(v):
    return trades(v).select("seg", "g_us", "direction", "status", "zero_in", "entry", "exit", "entry_us", "exit_us", *LAY.split())


COSTED = TRADES + """, k AS (SELECT *, zero_ticks - 0.0005 * (zero_in + exit) AS after_fee_ticks, gross_ticks - 0.0005 * (entry + exit) AS after_delay_ticks,
       direction * (exit - direction * 0.5 - entry - direction * 0.5) - 0.0005 * (entry + exit) AS stress_ticks, mid_ticks - touch_ticks AS spread_drag, touch_ticks - zero_ticks AS depth_drag,
       zero_ticks - gross_ticks AS delay_drag, 0.0005 * (entry + exit) AS fee_drag, entry + exit AS turnover FROM t WHERE status = 'trade')"""
LAYERS = ["mid_ticks", "touch_ticks", "zero_ticks", "after_fee_ticks", "after_delay_ticks", "stress_ticks", "spread_drag", "depth_drag", "delay_drag", "fee_drag"]


def costed(v):
    return tr.cost_layers(trades(v).where("status = 'trade'"), 5.0, 0.5)


@query("cost_layers", COSTED + " SELECT seg, count(*) AS trades, " + ", ".join(f"avg({c}) AS {c}" for c in LAYERS) + " FROM k GROUP BY 1", dbl=" ".join(LAYERS))
def cost_layers(v):
    return costed(v).groupBy("seg").agg(F.count("*").alias("trades"), *[F.avg(c).alias(c) for c in LAYERS])


@query(
    "performance_metrics",
    COSTED + f""", k2 AS (SELECT *, g_us // {DAY} AS day, sum(after_delay_ticks) OVER (PARTITION BY seg ORDER BY g_us) AS cum FROM k), e AS (SELECT *, greatest(max(cum) OVER (PARTITION BY seg ORDER BY g_us), 0) - cum AS dd FROM k2),
      d AS (SELECT seg, count(*) AS days, avg(d) / nullif(stddev_samp(d), 0) AS daily_sharpe FROM (SELECT seg, day, sum(after_delay_ticks) AS d FROM k2 GROUP BY 1, 2) GROUP BY 1),
      m AS (SELECT seg, count(*) AS trades, sum(after_delay_ticks) AS total, avg(after_delay_ticks) AS average, avg((after_delay_ticks > 0)::INT) AS win_rate, sum(turnover) AS turnover, sum(exit_us - g_us) / 1e6 AS exposure_s, max(dd) AS max_drawdown, avg(dd) AS average_drawdown,
              min(after_delay_ticks) AS worst, max(after_delay_ticks) AS best, sum(greatest(after_delay_ticks, 0)) / nullif(sum(greatest(-after_delay_ticks, 0)), 0) AS profit_factor FROM e GROUP BY 1)
      SELECT m.*, d.days, d.daily_sharpe, total / nullif(turnover, 0) AS pnl_per_turnover FROM m JOIN d USING (seg)""",
    dbl="total average win_rate turnover exposure_s max_drawdown average_drawdown worst best profit_factor daily_sharpe pnl_per_turnover",
)
def performance_metrics(v):
    d = costed(v).withColumns({"day": F.expr(f"g_us div {DAY}"), "exposure_us": F.col("exit_us") - F.col("g_us")})
    return tr.performance(d, ["seg"], "g_us", "day", "after_delay_ticks", v.time)


@query(
    "daily_to_economics",
    COSTED + f""", d AS (SELECT seg, g_us // {DAY} AS day, sum(gross_ticks) AS gross, sum(fee_drag) AS fee, sum(turnover) AS notional, count(*) AS fills FROM k GROUP BY 1, 2),
      k2 AS (SELECT *, gross - fee AS net, sum(gross - fee) OVER (PARTITION BY seg ORDER BY day) AS cum FROM d), e AS (SELECT *, greatest(max(cum) OVER (PARTITION BY seg ORDER BY day), 0) - cum AS dd FROM k2)
      SELECT seg, count(*) AS days, sum(gross) AS gross, sum(net) AS net, sum(net) * 10000 / nullif(sum(notional), 0) AS net_bps, count(*) FILTER (WHERE net > 0) AS positive_days, min(net) AS worst_day, avg(fills) AS fills_per_day,
             max(dd) AS max_drawdown, avg(net) * sqrt(365) / nullif(stddev_samp(net), 0) AS daily_sharpe, sum(gross) * 10000 / nullif(sum(notional), 0) AS break_even_bps FROM e GROUP BY 1""",
    dbl="gross net net_bps worst_day fills_per_day max_drawdown daily_sharpe break_even_bps",
)
def daily_to_economics(v):
    d = costed(v).groupBy("seg", F.expr(f"g_us div {DAY}").alias("day")).agg(
        F.sum("gross_ticks").alias("gross"), F.sum("fee_drag").alias("fee"), F.sum("turnover").alias("notional"), F.count("*").alias("fills")
    )
    return tr.daily_economics(d, ["seg"], "day")


CARRY = """
    WITH m AS (SELECT s.day, s.close AS spot, p.close AS perp, (p.close / s.close - 1) * 10000 AS basis, row_number() OVER (ORDER BY s.day) AS n FROM (SELECT * FROM bars WHERE market = 0) s JOIN (SELECT * FROM bars WHERE market = 1) p USING (day)),
    t AS (SELECT a.*, b.spot AS s1, b.perp AS p1, (SELECT max(x.basis) FROM m x WHERE x.day BETWEEN a.day AND a.day + 30) AS widest, (SELECT coalesce(sum(f.rate), 0) FROM funding f WHERE f.day > a.day AND f.day <= a.day + 30) AS paid
          FROM m a JOIN m b ON b.day = a.day + 30 WHERE (a.n - 1) % 30 = 0),
    c AS (SELECT day AS opened, -paid / 100.0 AS funding_bps, (s1 / spot - p1 / perp) * 10000 AS basis_bps, -paid / 100.0 + (s1 / spot - p1 / perp) * 10000 AS gross_bps, widest - basis AS widening_bps FROM t)"""


def carry(v):
    f = v.funding.withColumnRenamed("day", "f_day")
    return tr.carry_trades(aligned(v), f, 30, v.blocks(f, "f_day", "lineitem", tag="f_day"))


@query(
    "carry_trades",
    CARRY + """, y AS (SELECT *, year(make_timestamp(opened * 86400000000)) AS yr, gross_bps - 20 AS net, 1 + (gross_bps - 20) / 20000 AS gr FROM c), e AS (SELECT *, exp(sum(ln(abs(gr))) OVER (PARTITION BY yr ORDER BY opened)) * CASE WHEN sum((gr < 0)::INT) OVER (PARTITION BY yr ORDER BY opened) % 2 = 0 THEN 1 ELSE -1 END AS eq FROM y),
      p AS (SELECT *, greatest(max(eq) OVER (PARTITION BY yr ORDER BY opened), 1) AS pk FROM e)
      SELECT yr AS year, count(*) AS trades, avg(funding_bps) AS funding_bps, avg(basis_bps) AS basis_bps, avg(gross_bps) AS gross_bps, avg(net) AS net_bps, avg((net > 0)::INT) AS positive_share, max(widening_bps) AS worst_widening, max((pk - eq) / pk) AS max_drawdown FROM p GROUP BY 1""",
    dbl="funding_bps basis_bps gross_bps net_bps positive_share worst_widening max_drawdown",
)
def carry_trades(v):
    d = carry(v).withColumn("year", F.year(F.timestamp_micros(F.col("opened") * DAY)))
    return tr.carry_summary(d, ["year"], 10.0)


@query(
    "sign_reversals",
    """SELECT count(*) FILTER (WHERE p <> 0 AND rate <> 0) AS pairs, count(*) FILTER (WHERE p <> 0 AND rate <> 0 AND (p > 0) <> (rate > 0)) AS changes,
              count(*) FILTER (WHERE p <> 0 AND rate <> 0 AND (p > 0) <> (rate > 0)) / nullif(count(*) FILTER (WHERE p <> 0 AND rate <> 0), 0) AS frequency FROM (SELECT rate, lag(rate) OVER (ORDER BY day) AS p FROM funding)""",
    dbl="frequency",
)
def sign_reversals(v):
    f = v.funding
    return tr.sign_reversals(f, [], "day", "rate", v.blocks(f.withColumnRenamed("day", "f_day"), "f_day", "lineitem", tag="f_day"))


@query("coverage_by_year", "SELECT market, year(make_timestamp(day * 86400000000)) AS year, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM bars GROUP BY 1, 2")
def coverage_by_year(v):
    year = F.year(F.timestamp_micros(F.col("day") * DAY)).alias("year")
    return v.bars.groupBy("market", year).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n"))


BARS = "SELECT market, day, ln(lead(close, 6) OVER w / lead(open, 1) OVER w) AS target, close / lag(close, 5) OVER w - 1 AS score FROM bars WINDOW w AS (PARTITION BY market ORDER BY day)"
BARM = f"""
    WITH r AS (SELECT * FROM ({BARS}) WHERE target IS NOT NULL AND score IS NOT NULL), q AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY day) AS n, row_number() OVER (PARTITION BY market ORDER BY score, day) AS rs, count(*) OVER (PARTITION BY market) AS total FROM r),
    dc AS (SELECT market, avg(target) FILTER (WHERE (rs - 1) * 10 // total = 9) - avg(target) FILTER (WHERE (rs - 1) * 10 // total = 0) AS decile_gap FROM q GROUP BY 1),
    t AS (SELECT *, sign(score) * target - 0.001 AS net, sign(score) * target AS gross, exp(sum(ln(abs((1 + sign(score) * target - 0.001)))) OVER (PARTITION BY market ORDER BY day)) * CASE WHEN sum(((1 + sign(score) * target - 0.001) < 0)::INT) OVER (PARTITION BY market ORDER BY day) % 2 = 0 THEN 1 ELSE -1 END AS wealth FROM q WHERE (n - 1) % 6 = 0 AND abs(score) >= 0.05),
    u AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY market ORDER BY day) - 1 AS dd, row_number() OVER (PARTITION BY market ORDER BY net DESC, day DESC) AS rn, count(*) OVER (PARTITION BY market) AS nt FROM t),
    v AS (SELECT market, count(*) AS trade_count, avg(gross) AS gross_edge, avg(net) AS net_edge, avg(gross) / nullif(stddev_samp(gross), 0) AS gross_sharpe, avg(net) / nullif(stddev_samp(net), 0) AS net_sharpe, min(dd) AS max_drawdown, avg(net) FILTER (WHERE score > 0) AS long_edge,
                 avg(net) FILTER (WHERE score < 0) AS short_edge, sum(net) FILTER (WHERE rn <= greatest(floor(nt * 0.05), 1)) / nullif(sum(net), 0) AS top_share, count(*) * 365.25 / greatest(max(day) - min(day), 1) AS turnover FROM u GROUP BY 1),
    w AS (SELECT market, count(*) AS n, avg((sign(score) = sign(target))::INT) AS accuracy, corr(score, target) AS ic FROM r GROUP BY 1)
    SELECT w.*, dc.decile_gap, v.* EXCLUDE (market) FROM w JOIN dc USING (market) JOIN v USING (market)"""


@query("bar_strategy_metrics", BARM, dbl="accuracy ic decile_gap gross_edge net_edge gross_sharpe net_sharpe max_drawdown long_edge short_edge top_share turnover")
def bar_strategy_metrics(v):
    days = v.blocks(v.bars, "day", "orders", tag="day")
    d = shifted(v.bars, ["market"], "day", {"_in": (F.col("open"), -1), "_out": (F.col("close"), -6), "_c5": (F.col("close"), 5)}, days)
    d = d.withColumns({"target": F.log(F.col("_out") / F.col("_in")), "score": F.col("close") / F.col("_c5") - 1})
    d = d.where("target IS NOT NULL AND score IS NOT NULL").select("market", "day", "target", "score")
    d = rank_deciles(d, ["market"], "score", "day", "decile", 10, v.blocks(d, "score", "orders", tie="day"))
    return tr.bar_metrics(d, ["market"], "day", 6, 0.05, 0.001, days)


@query("bar_score_auc", class_sql(f"SELECT market, (target > 0)::INT AS t, greatest(least(score + 0.5, 1), 0) AS p FROM ({BARS}) WHERE target IS NOT NULL AND score IS NOT NULL", ["market"]), dbl="base_rate log_loss brier accuracy roc_auc pr_auc pr_lift")
def bar_score_auc(v):
    days = v.blocks(v.bars, "day", "orders", tag="day")
    d = shifted(v.bars, ["market"], "day", {"_in": (F.col("open"), -1), "_out": (F.col("close"), -6), "_c5": (F.col("close"), 5)}, days)
    d = d.withColumns({"target": F.log(F.col("_out") / F.col("_in")), "score": F.col("close") / F.col("_c5") - 1}).where("target IS NOT NULL AND score IS NOT NULL")
    d = d.withColumns({"t": (F.col("target") > 0).cast("int"), "p": F.greatest(F.least(F.col("score") + 0.5, F.lit(1.0)), F.lit(0.0))})
    return sg.classification_scores(d, ["market"], "t", "p", v.blocks(d, "p", "orders"))


@query(
    "collision_cohorts",
    f"""WITH p AS (SELECT ts_us // {HOUR} AS slot, ord % 2 AS side, floor(value)::BIGINT // 10 AS px, uid, k AS qty FROM lifecycle WHERE kind = 'placed'),
        c AS (SELECT slot, side, px, count(*) AS size, sum(qty) AS qty, count(DISTINCT uid) AS makers FROM p GROUP BY 1, 2, 3 HAVING count(*) > 1)
        SELECT count(*) AS cohorts, sum(size)::BIGINT AS orders, max(size) AS largest, count(*) FILTER (WHERE makers > 1) AS ambiguous, quantile_cont(size, 0.5) AS median_size, quantile_cont(qty, 0.5) AS median_qty, quantile_cont(qty, 0.9) AS p90_qty FROM c""",
    dbl="median_size median_qty p90_qty",
)
def collision_cohorts(v):
    p = v.lifecycle.where("kind = 'placed'").selectExpr(f"ts_us div {HOUR} AS slot", "ord % 2 AS side", "floor(value) div 10 AS px", "uid", "k AS qty")
    c = p.groupBy("slot", "side", "px").agg(F.count("*").alias("size"), F.sum("qty").alias("qty"), F.count_distinct("uid").alias("makers")).where("size > 1")
    aggs = {"cohorts": F.count("*"), "orders": F.sum("size"), "largest": F.max("size"), "ambiguous": F.count_if(F.col("makers") > 1)}
    return st.grouped(c, [], aggs, {"median_size": ("size", 0.5), "median_qty": ("qty", 0.5), "p90_qty": ("qty", 0.9)}, v.cut(c, "events"))


@query(
    "order_lifetimes",
    f"""WITH o AS (SELECT uid, ts_us // {DAY} AS day, min(ts_us) FILTER (WHERE kind = 'placed') AS placed, min(ts_us) FILTER (WHERE kind IN ('cancelled', 'filled')) AS ended FROM lifecycle GROUP BY 1, 2),
        l AS (SELECT (ended - placed) / 3.6e9 AS h FROM o WHERE ended >= placed)
        SELECT count(*) AS observed, avg(h) AS mean_h, quantile_cont(h, 0.1) AS p10, quantile_cont(h, 0.5) AS p50, quantile_cont(h, 0.9) AS p90 FROM l""",
    dbl="mean_h p10 p50 p90",
)
def order_lifetimes(v):
    end = F.col("kind").isin("cancelled", "filled")
    o = v.lifecycle.groupBy("uid", F.expr(f"ts_us div {DAY}").alias("day")).agg(
        F.min(F.when(F.col("kind") == "placed", F.col("ts_us"))).alias("placed"), F.min(F.when(end, F.col("ts_us"))).alias("ended")
    )
    life = o.where("ended >= placed").withColumn("h", (F.col("ended") - F.col("placed")) / 3.6e9)
    return st.grouped(life, [], {"observed": F.count("*"), "mean_h": F.avg("h")}, {"p10": ("h", 0.1), "p50": ("h", 0.5), "p90": ("h", 0.9)}, v.cut(life, "events"))


@query(
    "gate_checks",
    f"""SELECT policy, side, bool_and(mean > 0) AS all_days_positive, bool_and(labelled >= 5) AS enough_activity, sum(markout_sum) / nullif(sum(labelled), 0) AS pooled, coalesce(sum(markout_sum) / nullif(sum(labelled), 0) > 10, false) AS beats_baseline,
               coalesce(bool_and(mean > 0), false) AND bool_and(labelled >= 5) AND coalesce(sum(markout_sum) / nullif(sum(labelled), 0) > 10, false) AS passes FROM ({POLICY_DAYS}) GROUP BY 1, 2""",
    dbl="pooled",
)
def gate_checks(v):
    return tr.gate_table(policy_days(v), ["policy", "side"], "mean", 5, 10.0)

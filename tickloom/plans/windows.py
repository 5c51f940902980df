"""Queries for windows (W1-W19) and the flagship study."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.book import ratio
from tickloom.operators import windows as w
from tickloom.operators.ordered import asof, exact_quantiles, row_numbers
from tickloom.operators.selection import spaced
from tickloom.plans.registry import query
from tickloom.plans.state import OFI, ofi_frame
from tickloom.plans.views import HOUR



def volumes():
    """Bought and sold quantity of a print."""
    buy, qty = F.col("is_buy"), F.col("qty")
    return F.when(buy, qty).otherwise(0), F.when(~buy, qty).otherwise(0)


@query(
    "trailing_time_sum",
    f"""SELECT i.seg, i.g_us, """ + ", ".join(
        f"coalesce(sum(qty) FILTER (WHERE is_buy AND ts_us > g_us - {h} * {HOUR}), 0)::BIGINT AS buy_{h}h, coalesce(sum(qty) FILTER (WHERE NOT is_buy AND ts_us > g_us - {h} * {HOUR}), 0)::BIGINT AS sell_{h}h" for h in (1, 3, 12)
    ) + f" FROM instants i LEFT JOIN prints p ON p.seg = i.seg AND p.ts_us <= i.g_us AND p.ts_us > i.g_us - 12 * {HOUR} GROUP BY 1, 2",
)
def trailing_time_sum(v):
    buy, sell = volumes()
    sums = {}
    for h in (1, 3, 12):
        sums |= {f"buy_{h}h": (buy, h * HOUR), f"sell_{h}h": (sell, h * HOUR)}
    return w.trailing_sums(v.prints, ["seg"], "ts_us", sums, v.time, at=v.grid.select("seg", "g_us"), at_ts="g_us")


@query(
    "trailing_closed_sum",
    f"""SELECT seg, ord, sum(qty) OVER (PARTITION BY seg ORDER BY ts_us RANGE BETWEEN {3 * HOUR} PRECEDING AND CURRENT ROW)::BIGINT AS qty_3h,
               count(*) OVER (PARTITION BY seg ORDER BY ts_us RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW) AS n_6h FROM prints""",
)
def trailing_closed_sum(v):
    sums = {"qty_3h": (F.col("qty"), 3 * HOUR), "n_6h": (F.lit(1), 6 * HOUR)}
    return w.trailing_sums(v.prints, ["seg"], "ts_us", sums, v.time, closed_left=True).select("seg", "ord", "qty_3h", "n_6h")


@query(
    "rolling_rows_full",
    """SELECT seg, sid, g_us, CASE WHEN row_number() OVER w > 10 THEN (sum(mid_x2) OVER (PARTITION BY seg, sid ORDER BY g_us ROWS 9 PRECEDING))::BIGINT END AS s10
       FROM grid WINDOW w AS (PARTITION BY seg, sid ORDER BY g_us)""",
)
def rolling_rows_full(v):
    return w.rolling_sum(v.grid, ["seg", "sid"], "g_us", F.col("mid_x2"), 10, "s10", v.time).select("seg", "sid", "g_us", "s10")


@query(
    "trailing_mean_complete",
    """SELECT seg, sid, g_us, CASE WHEN count(sig) OVER w = 8 THEN avg(sig) OVER w END AS m8 FROM marks
       WINDOW w AS (PARTITION BY seg, sid ORDER BY g_us ROWS 7 PRECEDING)""",
    dbl="m8",
)
def trailing_mean_complete(v):
    return w.rolling_mean_complete(v.marks, ["seg", "sid"], "g_us", F.col("sig"), 8, "m8", v.time).select("seg", "sid", "g_us", "m8")


@query(
    "sign_persistence",
    """SELECT seg, sid, g_us, CASE WHEN count(sig) OVER w = 12 THEN avg(sign(sig)) OVER w END AS persistence FROM marks
       WINDOW w AS (PARTITION BY seg, sid ORDER BY g_us ROWS 11 PRECEDING)""",
    dbl="persistence",
)
def sign_persistence(v):
    d = w.rolling_mean_complete(v.marks, ["seg", "sid"], "g_us", F.signum("sig"), 12, "persistence", v.time)
    return d.select("seg", "sid", "g_us", "persistence")


def flow_windows(v):
    buy, sell = volumes()
    sums = {"buy": (buy, 6 * HOUR), "sell": (sell, 6 * HOUR), "n": (F.lit(1), 6 * HOUR)}
    return w.trailing_sums(v.prints, ["seg"], "ts_us", sums, v.time, at=v.marks, at_ts="g_us")


FLOW = f"""
    SELECT m.*, coalesce(sum(qty) FILTER (WHERE is_buy), 0) AS buy, coalesce(sum(qty) FILTER (WHERE NOT is_buy), 0) AS sell, count(p.ord) AS n
    FROM marks m LEFT JOIN prints p ON p.seg = m.seg AND p.ts_us <= m.g_us AND p.ts_us > m.g_us - {6 * HOUR} GROUP BY ALL"""


@query(
    "window_ratios",
    f"""SELECT seg, g_us, (buy - sell) / nullif(buy + sell, 0) AS imbalance, (buy + sell) / nullif(n, 0) AS avg_size, n / 6.0 AS intensity, n > 0 AS valid FROM ({FLOW})""",
    dbl="imbalance avg_size intensity",
)
def window_ratios(v):
    t = F.nullif(F.col("buy") + F.col("sell"), F.lit(0))
    return flow_windows(v).select(
        "seg", "g_us", ratio(F.col("buy") - F.col("sell"), t).alias("imbalance"),
        ratio(F.col("buy") + F.col("sell"), F.nullif(F.col("n"), F.lit(0))).alias("avg_size"), (F.col("n") / 6.0).alias("intensity"), (F.col("n") > 0).alias("valid"),
    )


@query(
    "window_flow_ratios",
    f"""WITH o AS (SELECT seg, ts_us, CASE WHEN ord % 100 = 0 THEN 0 ELSE coalesce(ofi, 0) END AS ofi, bid_qty + ask_qty AS depth FROM ({OFI})),
        f AS (SELECT m.seg, m.g_us, coalesce(sum(o.ofi), 0) AS ofi FROM marks m LEFT JOIN o ON o.seg = m.seg AND o.ts_us <= m.g_us AND o.ts_us > m.g_us - {6 * HOUR} GROUP BY 1, 2),
        w AS (SELECT *, row_number() OVER (PARTITION BY seg, sid ORDER BY g_us) > 6 AS window_valid FROM ({FLOW})),
        d AS (SELECT w.*, o.depth FROM w ASOF LEFT JOIN o ON o.seg = w.seg AND w.g_us >= o.ts_us)
        SELECT seg, g_us, (buy - sell) / nullif(buy + sell, 0) AS imbalance, CASE WHEN window_valid THEN f.ofi / nullif(depth, 0) END AS normalized_ofi, (buy + sell) / nullif(n, 0) AS avg_size,
               n / 6.0 AS intensity, n > 0 AS valid, window_valid FROM d JOIN f USING (seg, g_us)""",
    dbl="imbalance normalized_ofi avg_size intensity",
)
def window_flow_ratios(v):
    """The ratios of ``window_ratios`` with the order flow at the touch over the touch's depth, once six rows of the span lie behind."""
    flow = F.when(F.col("ord") % 100 == 0, F.lit(0)).otherwise(F.coalesce("ofi", F.lit(0))).cast("bigint")
    o = v.settled(ofi_frame(v).select("seg", "ts_us", "ord", flow.alias("flow"), (F.col("bid_qty") + F.col("ask_qty")).alias("depth")), "touch-flow", v.time)
    d = w.trailing_sums(o, ["seg"], "ts_us", {"ofi": (F.col("flow"), 6 * HOUR)}, v.time, at=flow_windows(v), at_ts="g_us")
    d = asof(d, o, ["seg"], "g_us", "ts_us", {"depth": "depth"}, v.time, ["ord"])
    d = row_numbers(d, ["seg", "sid"], "g_us", "_n", v.time)
    t, warm = F.nullif(F.col("buy") + F.col("sell"), F.lit(0)), F.col("_n") > 6
    return d.select(
        "seg", "g_us", ratio(F.col("buy") - F.col("sell"), t).alias("imbalance"),
        F.when(warm, ratio(F.col("ofi"), F.nullif(F.col("depth"), F.lit(0)))).alias("normalized_ofi"),
        ratio(F.col("buy") + F.col("sell"), F.nullif(F.col("n"), F.lit(0))).alias("avg_size"), (F.col("n") / 6.0).alias("intensity"),
        (F.col("n") > 0).alias("valid"), warm.alias("window_valid"),
    )


@query(
    "flow_decile_study",
    f"""WITH f AS (SELECT (buy - sell) / (buy + sell) AS x, m6 FROM ({FLOW}) WHERE buy + sell > 0),
        e AS (SELECT list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges FROM f)
        SELECT greatest(len(list_filter(edges, lambda q: q < x)), 1) - 1 AS decile, count(*) AS n, count(m6) AS labelled,
               avg(x) AS mean_imbalance, avg(m6) AS mean_move, avg((m6 > 0)::INT) AS share_up FROM f, e GROUP BY 1""",
    dbl="mean_imbalance mean_move share_up",
)
def flow_decile_study(v):
    f = flow_windows(v).where("buy + sell > 0").withColumn("x", ratio(F.col("buy") - F.col("sell"), F.col("buy") + F.col("sell")))
    d = w.quantile_buckets(f, [], "x", "decile", 10, v.blocks(f, "x", "events"))
    return d.groupBy("decile").agg(
        F.count("*").alias("n"), F.count("m6").alias("labelled"), F.avg("x").alias("mean_imbalance"),
        F.avg("m6").alias("mean_move"), F.avg((F.col("m6") > 0).cast("int")).alias("share_up"),
    )


@query(
    "time_since_last",
    """SELECT seg, ord, ts_us - last_value(CASE WHEN event_type = 'purchase' THEN ts_us END IGNORE NULLS) OVER w AS since_purchase,
              ts_us - last_value(CASE WHEN event_type = 'error' THEN ts_us END IGNORE NULLS) OVER w AS since_error
       FROM ev WINDOW w AS (PARTITION BY seg ORDER BY ts_us)""",
)
def time_since_last(v):
    classes = {"since_purchase": F.col("event_type") == "purchase", "since_error": F.col("event_type") == "error"}
    return w.time_since_last(v.ev, ["seg"], "ts_us", classes, v.time).select("seg", "ord", *classes)


@query(
    "trade_streak",
    """WITH a AS (SELECT *, CASE WHEN is_buy IS DISTINCT FROM lag(is_buy) OVER (PARTITION BY seg ORDER BY ts_us) THEN 1 ELSE 0 END AS st FROM prints),
       b AS (SELECT *, sum(st) OVER (PARTITION BY seg ORDER BY ts_us) AS run FROM a)
       SELECT seg, ord, CASE WHEN is_buy THEN 1 ELSE -1 END * row_number() OVER (PARTITION BY seg, run ORDER BY ts_us) AS streak FROM b""",
)
def trade_streak(v):
    return w.signed_streak(v.prints, ["seg"], "ts_us", F.col("is_buy"), "streak", v.time, ["ord"]).select("seg", "ord", "streak")


@query("backward_move", "SELECT seg, sid, g_us, mid_x2 - lag(mid_x2, 5) OVER (PARTITION BY seg, sid ORDER BY g_us) AS move FROM grid")
def backward_move(v):
    return w.backward_move(v.grid, ["seg", "sid"], "g_us", "mid_x2", 5, "move", v.time).select("seg", "sid", "g_us", "move")


@query("demean_by_block", "SELECT id, x1 - avg(x1) OVER (PARTITION BY blk) AS x1_d, y - avg(y) OVER (PARTITION BY blk) AS y_d FROM wide", dbl="x1_d y_d")
def demean_by_block(v):
    return w.demean(v.wide, ["blk"], {"x1": "x1_d", "y": "y_d"}, v.value_blocks(v.wide, "x1")).select("id", "x1_d", "y_d")


@query("anchor_rows", "SELECT seg, sid, g_us FROM (SELECT *, row_number() OVER (PARTITION BY seg, sid ORDER BY g_us) AS rn FROM grid) WHERE (rn - 1) % 6 = 0")
def anchor_rows(v):
    return w.every_kth(v.grid, ["seg", "sid"], "g_us", 6, v.time).select("seg", "sid", "g_us")


@query(
    "rank_deciles",
    "SELECT id, CASE WHEN y IS NOT NULL THEN floor((row_number() OVER (PARTITION BY y IS NULL ORDER BY y, id) - 1) * 10 / count(*) OVER (PARTITION BY y IS NULL))::BIGINT END AS decile FROM wide",
)
def rank_deciles(v):
    return w.rank_deciles(v.wide, [], "y", "id", "decile", 10, v.value_blocks(v.wide, "y", tie="id")).select("id", "decile")


QS = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"


@query(
    "quantile_bucket",
    f"""WITH e AS (SELECT grp, list_distinct(quantile_cont(x2, {QS})) AS edges FROM wide GROUP BY 1)
        SELECT id, grp, greatest(len(list_filter(edges, lambda q: q < x2)), 1) - 1 AS bucket FROM wide JOIN e USING (grp)""",
)
def quantile_bucket(v):
    return w.quantile_buckets(v.wide, ["grp"], "x2", "bucket", 10, v.value_blocks(v.wide, "x2")).select("id", "grp", "bucket")


QT = "[" + ", ".join(f"{i / 10}" for i in range(1, 10)) + "]"


@query(
    "frozen_bins",
    f"""WITH t AS (SELECT quantile_cont(x1, {QT}) AS th FROM wide WHERE blk < 15)
        SELECT id, len(list_filter(th, lambda q: q <= x1)) + 1 AS bin FROM wide, t""",
)
def frozen_bins(v):
    train = v.wide.where("blk < 15")
    probs = {f"q{i}": i / 10 for i in range(1, 10)}
    th = exact_quantiles(train, [], "x1", probs, v.value_blocks(train, "x1")).select(F.array(*probs).alias("thresholds"))
    return w.frozen_bins(v.wide, th, [], "x1", "bin").select("id", "bin")


@query(
    "lag_sequence",
    """SELECT seg, sid, g_us, 10 - len(l) AS padded, list_sum(l)::BIGINT AS total, l[1] * (len(l) = 10)::INT AS first_value
       FROM (SELECT seg, sid, g_us, list(mid_x2) OVER (PARTITION BY seg, sid ORDER BY g_us ROWS 9 PRECEDING) AS l FROM grid)""",
    dbl="total first_value",
)
def lag_sequence(v):
    d = w.lag_sequences(v.grid, ["seg", "sid"], "g_us", ["mid_x2"], 10, "seqs", v.time)
    total = F.aggregate("seqs", F.lit(0.0), lambda a, x: a + x[0])
    d = w.lag_sequences(d.withColumn("one", F.lit(1)), ["seg", "sid"], "g_us", ["one"], 10, "ones", v.time)
    padded = F.size(F.filter("ones", lambda x: x[0] == 0.0))
    return d.select("seg", "sid", "g_us", padded.alias("padded"), total.alias("total"), F.col("seqs")[0][0].alias("first_value"))


@query(
    "drawdown_curve",
    """WITH p AS (SELECT seg, ord, ts_us, CAST(floor(value) AS BIGINT) - 50 AS pnl FROM ev),
       c AS (SELECT *, sum(pnl) OVER (PARTITION BY seg ORDER BY ts_us) AS cum FROM p),
       k AS (SELECT *, greatest(max(cum) OVER (PARTITION BY seg ORDER BY ts_us), 0) AS peak FROM c)
       SELECT seg, ord, cum::BIGINT AS cum, peak::BIGINT AS peak, (peak - cum)::BIGINT AS drawdown FROM k""",
)
def drawdown_curve(v):
    d = v.ev.select("seg", "ord", "ts_us", (F.floor("value") - 50).alias("pnl"))
    return w.drawdown_curve(d, ["seg"], "ts_us", "pnl", v.time).select("seg", "ord", "cum", "peak", "drawdown")


BARF = """
    SELECT market, day, close / lag(close, 1) OVER o - 1 AS ret_1, close / lag(close, 5) OVER o - 1 AS ret_5, close / lag(close, 20) OVER o - 1 AS ret_20,
           ln(close / lag(close) OVER o) AS logret, volume, close, open FROM bars WINDOW o AS (PARTITION BY market ORDER BY day)"""


@query(
    "bar_features",
    f"""SELECT market, day, ret_1, ret_5, ret_20, logret, CASE WHEN count(logret) OVER r = 20 THEN stddev_samp(logret) OVER r END AS vol_20,
               CASE WHEN count(*) OVER r = 20 THEN median(volume) OVER r END AS median_volume_20,
               CASE WHEN count(*) OVER r = 20 THEN ln(volume / median(volume) OVER r) END AS volume_shock
        FROM ({BARF}) WINDOW r AS (PARTITION BY market ORDER BY day ROWS 19 PRECEDING)""",
    dbl="ret_1 ret_5 ret_20 logret vol_20 median_volume_20 volume_shock",
)
def bar_features(v):
    cols = ["ret_1", "ret_5", "ret_20", "logret", "vol_20", "median_volume_20", "volume_shock"]
    return w.bar_features(v.bars, ["market"], "day", v.blocks(v.bars, "day", "orders", tag="day")).select("market", "day", *cols)


@query(
    "above_threshold_run",
    """WITH f AS (SELECT *, p >= 0.4 AS f, lag(p >= 0.4) OVER (PARTITION BY seg, side ORDER BY g_us) AS pf FROM scores),
       r AS (SELECT *, sum(CASE WHEN f IS DISTINCT FROM pf THEN 1 ELSE 0 END) OVER (PARTITION BY seg, side ORDER BY g_us) AS run FROM f)
       SELECT seg, side, g_us, min(g_us) OVER w AS run_start, row_number() OVER w AS run_index, g_us - min(g_us) OVER w AS run_age
       FROM r WHERE f WINDOW w AS (PARTITION BY seg, side, run ORDER BY g_us)""",
)
def above_threshold_run(v):
    d = w.runs_above(v.scores, ["seg", "side"], "g_us", F.col("p") >= 0.4, v.time)
    return d.select("seg", "side", "g_us", "run_start", "run_index", "run_age")


@query(
    "decision_cooldown",
    f"""WITH RECURSIVE d AS (SELECT seg, ts_us AS t FROM prints WHERE is_buy),
        nx AS (SELECT a.seg, a.t, min(b.t) AS nxt FROM d a JOIN d b ON a.seg = b.seg AND a.t + {2 * HOUR} <= b.t GROUP BY 1, 2),
        kept AS (SELECT seg, min(t) AS t FROM d GROUP BY 1 UNION ALL SELECT k.seg, n.nxt FROM kept k JOIN nx n ON n.seg = k.seg AND n.t = k.t)
        SELECT p.seg, p.ord, p.ts_us FROM prints p JOIN kept k ON p.seg = k.seg AND p.ts_us = k.t""",
)
def decision_cooldown(v):
    buys = v.prints.where("is_buy")
    return spaced(buys, ["seg"], "ts_us", 2 * HOUR, v.time).select("seg", "ord", "ts_us")

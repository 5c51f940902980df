"""Queries for event hygiene."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import hygiene as h
from tickloom.operators.ordered import row_numbers
from tickloom.plans.registry import query
from tickloom.plans.views import DAY, HOUR, SPAN

AUDIT = """
    SELECT *, CASE WHEN seen_u IS NULL THEN 'initial' WHEN last_u <= seen_u THEN 'stale'
                   WHEN prev_u = seen_u THEN 'contiguous' ELSE 'pu_break' END AS status
    FROM (SELECT *, max(last_u) OVER (PARTITION BY seg ORDER BY ts_us, ord, dup
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_u FROM updates)"""


def _audited(v):
    return h.sequence_audit(v.updates, ["seg"], "ts_us", v.time, ["ord", "dup"])


@query(
    "to_ticks",
    """SELECT event_id, CASE WHEN CAST(value AS DECIMAL(18,4)) % 0.05 = 0
                             THEN CAST(CAST(value AS DECIMAL(18,4)) / 0.05 AS BIGINT) END AS steps FROM events""",
)
def to_ticks(v):
    return v.read("events").select("event_id", h.to_ticks(F.col("value"), "0.05").alias("steps"))


@query(
    "rows_to_messages",
    """WITH f AS (SELECT *, qty >= 50 AS big FROM levels),
       g AS (SELECT *, CASE WHEN big IS DISTINCT FROM lag(big) OVER (PARTITION BY seg ORDER BY ts_us) THEN 1 ELSE 0 END AS st FROM f),
       i AS (SELECT *, sum(st) OVER (PARTITION BY seg ORDER BY ts_us) AS msg FROM g)
       SELECT seg, msg::BIGINT AS msg, big, min(ts_us) AS first_ts, count(*) AS n_rows,
              coalesce(string_agg(px || 'x' || qty, ',' ORDER BY ts_us) FILTER (WHERE side = 'bid'), '') AS bids,
              coalesce(string_agg(px || 'x' || qty, ',' ORDER BY ts_us) FILTER (WHERE side = 'ask'), '') AS asks
       FROM i GROUP BY 1, 2, 3""",
)
def rows_to_messages(v):
    m = h.rows_to_messages(v.levels.withColumn("big", F.col("qty") >= 50), ["seg"], "ts_us", ["big"], v.time, ["ord"])

    def text(c):
        return F.array_join(F.transform(c, lambda x: F.concat_ws("x", x.px, x.qty)), ",")

    return m.withColumns({"bids": text("bids"), "asks": text("asks")})


def _messages(v):
    return v.updates.withColumn("is_update", F.when(F.col("ord") % 53 == 0, F.lit(0)).otherwise(F.lit(1)))


@query(
    "order_messages",
    """SELECT seg, ord, dup, row_number() OVER (PARTITION BY seg ORDER BY ts_us // 3600000000, last_u,
              CASE WHEN ord % 53 = 0 THEN 0 ELSE 1 END, first_u, prev_u, ord, dup) AS pos FROM updates""",
)
def order_messages(v):
    m = _messages(v).withColumn("hour", F.expr(f"ts_us div {HOUR}"))
    hours = v.blocks(m, "hour", "events", 1.1, tag="hour")
    ties = ["last_u", "is_update", "first_u", "prev_u", "ord", "dup"]
    return row_numbers(m, ["seg"], "hour", "pos", hours, ties).select("seg", "ord", "dup", "pos")


@query(
    "group_by_receive_time",
    """WITH f AS (SELECT seg, ord, ts_us, ts_us // 3600000000 AS recv, ord % 5 = 0 AS snap FROM levels),
       g AS (SELECT *, CASE WHEN recv IS DISTINCT FROM lag(recv) OVER w OR snap IS DISTINCT FROM lag(snap) OVER w THEN 1 ELSE 0 END AS st
             FROM f WINDOW w AS (PARTITION BY seg ORDER BY ord)),
       i AS (SELECT *, sum(st) OVER (PARTITION BY seg ORDER BY ord) AS event FROM g)
       SELECT seg, event::BIGINT AS event, recv, snap, count(*) AS n_rows, max(ts_us) AS exchange_us FROM i GROUP BY 1, 2, 3, 4""",
)
def group_by_receive_time(v):
    d = v.levels.selectExpr("seg", "ord", "ts_us", f"ts_us div {HOUR} AS recv", "ord % 5 = 0 AS snap")
    ids = v.blocks(d, "ord", "events", tag="ord")
    g = h.consecutive_groups(d, ["seg"], "ord", ["recv", "snap"], "event", ids)
    return g.groupBy("seg", "event", "recv", "snap").agg(
        F.count("*").alias("n_rows"), F.max("ts_us").alias("exchange_us")
    )


@query(
    "merge_sorted_sources",
    """SELECT seg, ts_us, ord, src, row_number() OVER (PARTITION BY seg ORDER BY ts_us, src, ord) AS pos
       FROM (SELECT seg, ts_us, ord, 'a' AS src FROM levels WHERE side = 'bid'
             UNION ALL SELECT seg, ts_us, ord, 'b' FROM levels WHERE side = 'ask')""",
)
def merge_sorted_sources(v):
    cols = ["seg", "ts_us", "ord"]
    a = v.levels.where("side = 'bid'").select(*cols, F.lit("a").alias("src"))
    b = v.levels.where("side = 'ask'").select(*cols, F.lit("b").alias("src"))
    return row_numbers(a.unionByName(b), ["seg"], "ts_us", "pos", v.time, ["src", "ord"])


@query("sequence_audit", f"SELECT seg, ord, dup, seen_u, status FROM ({AUDIT})")
def sequence_audit(v):
    return _audited(v).select("seg", "ord", "dup", "seen_u", "status")


@query(
    "sequence_bridge",
    """WITH o AS (SELECT *, last_u < 300 AS old FROM updates),
       s AS (SELECT *, max(last_u) FILTER (WHERE NOT old) OVER (PARTITION BY seg ORDER BY ts_us, ord, dup
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_u FROM o)
       SELECT seg, CASE WHEN old THEN 'stale_before_snapshot'
                        WHEN seen_u IS NULL AND first_u <= 300 AND 300 <= last_u THEN 'snapshot_bridge'
                        WHEN seen_u IS NULL THEN 'snapshot_gap' WHEN last_u <= seen_u THEN 'stale'
                        WHEN prev_u = seen_u THEN 'contiguous' ELSE 'pu_break' END AS status, count(*) AS n
       FROM s GROUP BY 1, 2""",
)
def sequence_bridge(v):
    a = h.sequence_audit(v.updates, ["seg"], "ts_us", v.time, ["ord", "dup"], F.lit(300))
    return a.groupBy("seg", "status").agg(F.count("*").alias("n"))


@query(
    "missing_ranges",
    f"""WITH a AS ({AUDIT}),
        p AS (SELECT *, last_value(CASE WHEN status <> 'stale' THEN ts_us END IGNORE NULLS) OVER
                 (PARTITION BY seg ORDER BY ts_us, ord, dup ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_ts FROM a)
        SELECT seg, seen_u AS after_u, first_u AS next_first_u, last_u AS next_last_u, prev_u AS next_prev_u,
               ts_us - prev_ts AS receive_gap, greatest(prev_u - seen_u, 0) AS missing_ids
        FROM p WHERE status = 'pu_break'""",
)
def missing_ranges(v):
    return h.missing_ranges(_audited(v), ["seg"], "ts_us", v.time, ["ord", "dup"])


@query(
    "source_boundary_report",
    f"""SELECT seg, ts_us // {DAY} AS day, count(*) AS n, min(ts_us) AS first_ts, max(ts_us) AS last_ts,
               arg_min(first_u, (ts_us, ord)) AS first_first_u, arg_max(last_u, (ts_us, ord)) AS last_last_u,
               arg_min(status, (ts_us, ord)) AS first_status
        FROM ({AUDIT}) GROUP BY 1, 2""",
)
def source_boundary_report(v):
    a = _audited(v).withColumn("day", F.expr(f"ts_us div {DAY}"))
    return h.source_boundaries(a, ["seg", "day"], "ts_us", "ord")


@query(
    "snapshot_lookup",
    f"""WITH s AS (SELECT seg, ts_us // 7200000000 * 7200000000 AS snap_us,
                          max(px) FILTER (WHERE side = 'bid') AS best_bid, min(px) FILTER (WHERE side = 'ask') AS best_ask
                   FROM levels_x WHERE qty > 0 GROUP BY 1, 2),
        u AS (SELECT * FROM s WHERE best_bid < best_ask)
        SELECT i.seg, i.g_us, CASE WHEN u.snap_us >= i.g_us - 21600000000 THEN u.snap_us END AS snapshot_ts,
               CASE WHEN u.snap_us >= i.g_us - 21600000000 THEN u.best_bid END AS best_bid,
               CASE WHEN u.snap_us >= i.g_us - 21600000000 THEN u.best_ask END AS best_ask
        FROM instants i ASOF LEFT JOIN u ON i.seg = u.seg AND i.g_us >= u.snap_us""",
)
def snapshot_lookup(v):
    d = v.levels_x.withColumn("snap_us", F.expr("ts_us div 7200000000 * 7200000000"))
    snaps = h.usable_snapshots(d, ["seg", "snap_us"])
    return h.snapshot_lookup(
        v.grid.select("seg", "g_us"), snaps, ["seg"], "g_us", "snap_us",
        {"best_bid": "best_bid", "best_ask": "best_ask"}, 6 * HOUR, v.time,
    )


@query("drop_stale", f"SELECT seg, ord, dup FROM ({AUDIT}) WHERE status <> 'stale'")
def drop_stale(v):
    return h.drop_stale(_audited(v)).select("seg", "ord", "dup")


@query(
    "order_regressions",
    """SELECT seg, count(*) AS n, count(*) FILTER (WHERE ts_us < p1) AS ts_us_regressions,
              count(*) FILTER (WHERE u < p2) AS u_regressions
       FROM (SELECT seg, ts_us, u, lag(ts_us) OVER w AS p1, lag(u) OVER w AS p2
             FROM (SELECT seg, ts_us, last_u AS u, ord * 2 + dup * 400 AS pos, ord FROM updates)
             WINDOW w AS (PARTITION BY seg ORDER BY pos, ord)) GROUP BY 1""",
)
def order_regressions(v):
    d = v.updates.selectExpr("seg", "ts_us", "last_u AS u", "ord * 2 + dup * 400 AS pos", "ord")
    pos = v.blocks(d, "pos", "events", 1.1, tag="pos")
    return h.order_regressions(d, ["seg"], "pos", ["ts_us", "u"], pos, ["ord"])


@query(
    "max_gap",
    """SELECT seg, max(gap) AS max_gap, arg_max(ts_us, (gap, -ts_us)) AS gap_end
       FROM (SELECT seg, ts_us, ts_us - lag(ts_us) OVER (PARTITION BY seg ORDER BY ts_us) AS gap FROM prints)
       WHERE gap IS NOT NULL GROUP BY 1""",
)
def max_gap(v):
    return h.max_gap(v.prints, ["seg"], "ts_us", v.time)


DAILY = f"""
    SELECT ts_us // {DAY} AS day, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us,
           count(*) FILTER (WHERE ord % 17 = 0) AS unknown_n,
           count(*) FILTER (WHERE ord % 17 <> 0 AND is_buy) AS buy_n,
           count(*) FILTER (WHERE ord % 17 <> 0 AND NOT is_buy) AS sell_n,
           coalesce(sum(CAST(qty AS DECIMAL(18,3)) / 1000) FILTER (WHERE ord % 17 <> 0 AND is_buy), 0) AS buy_qty,
           coalesce(sum(CAST(qty AS DECIMAL(18,3)) / 1000) FILTER (WHERE ord % 17 <> 0 AND NOT is_buy), 0) AS sell_qty
    FROM prints GROUP BY 1"""


def daily_trade_qc_frame(v):
    lots = (F.col("qty").cast("decimal(18,3)") / 1000).cast("decimal(18,6)")
    side = F.when(F.col("ord") % 17 == 0, "unknown").when(F.col("is_buy"), "buy").otherwise("sell")
    d = v.prints.withColumns({"side": side, "lots": lots, "day": F.expr(f"ts_us div {DAY}")})

    def total(s):
        return F.coalesce(F.sum(F.when(F.col("side") == s, F.col("lots"))), F.lit(0)).alias(f"{s}_qty")

    return d.groupBy("day").agg(
        F.count("*").alias("n"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        *[F.count_if(F.col("side") == s).alias(f"{s}_n") for s in ("unknown", "buy", "sell")],
        total("buy"),
        total("sell"),
    )


@query("daily_trade_qc", DAILY, dbl="buy_qty sell_qty")
def daily_trade_qc(v):
    return daily_trade_qc_frame(v)


@query(
    "manifest_rollup",
    f"""WITH d AS ({DAILY}),
        g AS (SELECT ts_us // {DAY} AS day, sum(gap) FILTER (WHERE gap > {HOUR}) AS gap_us
              FROM (SELECT ts_us, ts_us - lag(ts_us) OVER (PARTITION BY ts_us // {DAY} ORDER BY ts_us) AS gap FROM prints) GROUP BY 1)
        SELECT d.day, sum(n)::BIGINT AS n, sum(buy_n)::BIGINT AS buy_n, sum(sell_n)::BIGINT AS sell_n,
               sum(last_us - first_us)::BIGINT AS span_us, coalesce(sum(gap_us), 0)::BIGINT AS gap_us,
               100.0 * (sum(last_us - first_us) - coalesce(sum(gap_us), 0)) / sum(last_us - first_us) AS valid_pct
        FROM d LEFT JOIN g ON d.day = g.day GROUP BY ROLLUP (d.day)""",
    dbl="valid_pct",
)
def manifest_rollup(v):
    from tickloom.operators.ordered import shifted

    p = v.prints.select("ts_us", F.expr(f"ts_us div {DAY}").alias("day"))
    gaps = shifted(p, ["day"], "ts_us", {"_prev": (F.col("ts_us"), 1)}, v.time)
    gap = F.col("ts_us") - F.col("_prev")
    gaps = gaps.groupBy("day").agg(F.sum(F.when(gap > HOUR, gap)).alias("gap_us"))
    d = daily_trade_qc_frame(v).join(gaps, "day", "left")
    span, lost = F.sum(F.col("last_us") - F.col("first_us")), F.coalesce(F.sum("gap_us"), F.lit(0))
    return d.rollup("day").agg(
        F.sum("n").alias("n"),
        F.sum("buy_n").alias("buy_n"),
        F.sum("sell_n").alias("sell_n"),
        span.alias("span_us"),
        lost.alias("gap_us"),
        (100.0 * (span - lost) / span).alias("valid_pct"),
    )


@query(
    "grid_check",
    f"""SELECT seg, count(*) AS n, count(*) FILTER (WHERE step <> {HOUR}) AS violations
        FROM (SELECT seg, g_us - lag(g_us) OVER (PARTITION BY seg ORDER BY g_us) AS step FROM grid WHERE mid_x2 % 7 <> 0)
        GROUP BY 1""",
)
def grid_check(v):
    return h.irregular_steps(v.grid.where("mid_x2 % 7 <> 0"), ["seg"], "g_us", HOUR, v.time)


@query(
    "leakage_check",
    f"""SELECT count(*) AS n, count(*) FILTER (WHERE book_us > sample_us) AS book_us_future,
               count(*) FILTER (WHERE trade_us > sample_us) AS trade_us_future
        FROM (SELECT ts_us AS book_us, ts_us + k AS trade_us, ts_us + 50 AS sample_us FROM ev)""",
)
def leakage_check(v):
    d = v.ev.selectExpr("ts_us AS book_us", "ts_us + k AS trade_us", "ts_us + 50 AS sample_us")
    return h.future_rows(d, ["book_us", "trade_us"], "sample_us")


@query("key_uniqueness", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def key_uniqueness(v):
    return h.duplicate_keys(v.read("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "invalid_intervals",
    f"""WITH f AS (SELECT seg, g_us, mid_x2 % 3 = 0 AS bad, lead(g_us) OVER w AS nxt, lag(mid_x2 % 3 = 0) OVER w AS pb
                   FROM grid WINDOW w AS (PARTITION BY seg ORDER BY g_us)),
        r AS (SELECT *, sum(CASE WHEN bad IS DISTINCT FROM pb THEN 1 ELSE 0 END) OVER (PARTITION BY seg ORDER BY g_us) AS run FROM f)
        SELECT seg, min(g_us) AS start_ts, max(coalesce(nxt, g_us + {HOUR})) AS end_ts,
               max(coalesce(nxt, g_us + {HOUR})) - min(g_us) AS duration, count(*) AS n
        FROM r WHERE bad GROUP BY seg, run""",
)
def invalid_intervals(v):
    return h.runs_where(v.grid, ["seg"], "g_us", F.col("mid_x2") % 3 == 0, HOUR, v.time)


@query(
    "embargo_check",
    f"""SELECT label, horizon, count(*) FILTER (WHERE g_us + horizon > (sid + 1) * {SPAN}) AS past_edge,
               count(*) FILTER (WHERE g_us + horizon > (sid + 1) * {SPAN} AND y IS NOT NULL) AS violations
        FROM (SELECT g_us, sid, unnest(['m1', 'm6', 'm24']) AS label,
                     unnest([{HOUR}, {6 * HOUR}, {24 * HOUR}])::BIGINT AS horizon, unnest([m1, m6, m24]) AS y FROM marks)
        GROUP BY 1, 2""",
)
def embargo_check(v):
    hs = {"m1": HOUR, "m6": 6 * HOUR, "m24": 24 * HOUR}
    return h.embargo_violations(v.marks, "g_us", (F.col("sid") + 1) * SPAN, hs)


@query(
    "data_quality_report",
    """SELECT count(*) AS n, count(*) FILTER (WHERE mid_x2 % 3 <> 0) AS valid_rows,
              count(DISTINCT (seg, sid)) AS segments, count(m1) AS m1_labels, count(m6) AS m6_labels, count(m24) AS m24_labels
       FROM marks""",
)
def data_quality_report(v):
    return v.marks.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("mid_x2") % 3 != 0).alias("valid_rows"),
        F.count_distinct(F.struct("seg", "sid")).alias("segments"),
        *[F.count(c).alias(f"{c}_labels") for c in ("m1", "m6", "m24")],
    )


@query(
    "side_symmetry_audit",
    """SELECT count(*) AS pairs, count(*) FILTER (WHERE nb <> 1 OR na <> 1) AS unpaired,
              count(*) FILTER (WHERE abs(b + a) > 0.5) AS signed_broken
       FROM (SELECT ord, count(*) FILTER (WHERE side = 'bid') AS nb, count(*) FILTER (WHERE side = 'ask') AS na,
                    sum(signed) FILTER (WHERE side = 'bid') AS b, sum(signed) FILTER (WHERE side = 'ask') AS a
             FROM (SELECT ord, side, CASE WHEN ord % 41 = 0 AND side = 'ask' THEN signed + 1 ELSE signed END AS signed FROM opps
                   WHERE NOT (ord % 61 = 0 AND side = 'bid')) GROUP BY 1)""",
)
def side_symmetry_audit(v):
    is_ask = F.col("side") == "ask"
    d = v.opps.where(~((F.col("ord") % 61 == 0) & ~is_ask))
    d = d.withColumn("signed", F.when((F.col("ord") % 41 == 0) & is_ask, F.col("signed") + 1).otherwise(F.col("signed")))
    return h.paired_imbalance(d, ["ord"], "side", ["signed"], 0.5)


@query(
    "target_agreement",
    f"""SELECT count(*) AS compared, count(*) FILTER (WHERE (a.m1 IS NULL) <> (b.y IS NULL)) AS m1_null_diff,
               count(*) FILTER (WHERE a.m1 IS DISTINCT FROM b.y) AS m1_differing, max(abs(a.m1 - b.y)) AS m1_max_abs
        FROM marks a JOIN (SELECT g.seg, g.g_us, n.mid_x2 - g.mid_x2 AS y FROM grid g
                           LEFT JOIN grid n ON n.seg = g.seg AND n.g_us = g.g_us + {HOUR}) b
        ON a.seg = b.seg AND a.g_us = b.g_us""",
)
def target_agreement(v):
    nxt = v.grid.select("seg", (F.col("g_us") - HOUR).alias("g_us"), F.col("mid_x2").alias("_n"))
    b = v.grid.join(nxt, ["seg", "g_us"], "left").select("seg", "g_us", (F.col("_n") - F.col("mid_x2")).alias("m1"))
    return h.agreement(v.marks, b, ["seg", "g_us"], ["m1"])

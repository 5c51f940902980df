"""Queries for joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import joins as j
from tickloom.operators.intervals import first_beyond
from tickloom.operators.labels import path_markouts
from tickloom.operators.ordered import asof, running
from tickloom.operators.queue import queue_grid_fills
from tickloom.plans.labels import NEAR, TQ, near_prints, quoted_sides, seg_ends, side_prints, touch_quotes
from tickloom.plans.registry import query
from tickloom.plans.state import book
from tickloom.plans.views import DAY, HOUR, SPAN


@query(
    "exact_key_join",
    """SELECT l.l_orderkey, l.l_linenumber::BIGINT AS l_linenumber, l.l_partkey, o.o_custkey, p.p_brand, l.l_quantity FROM lineitem l
       JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON l.l_partkey = p.p_partkey""",
    dbl="l_quantity",
)
def exact_key_join(v):
    lines = v.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    orders = v.read("orders").select("o_orderkey", "o_custkey")
    part = v.read("part").select("p_partkey", "p_brand")
    d = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(part, lines.l_partkey == part.p_partkey, "left")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "p_brand", "l_quantity")


@query("asof_backward", "SELECT o.oid, m.ts_us AS mid_us, m.mid_x2 FROM orders_p o ASOF LEFT JOIN mid_path m ON m.seg = o.seg AND o.place_us - 1800000000 >= m.ts_us")
def asof_backward(v):
    q = v.orders_p.withColumn("want", F.col("place_us") - 1_800_000_000)
    return asof(q, v.mid_path, ["seg"], "want", "ts_us", {"ts_us": "mid_us", "mid_x2": "mid_x2"}, v.time).select("oid", "mid_us", "mid_x2")


@query("asof_forward_strict", "SELECT o.oid, m.ts_us AS next_us, m.px FROM orders_p o ASOF LEFT JOIN prints m ON m.seg = o.seg AND o.place_us < m.ts_us")
def asof_forward_strict(v):
    d = asof(v.orders_p.drop("px"), v.prints, ["seg"], "place_us", "ts_us", {"ts_us": "next_us", "px": "px"}, v.time, ["ord"], forward=True, strict=True)
    return d.select("oid", "next_us", "px")


@query("interval_containment", "SELECT p.ord, s.sid FROM levels p JOIN segs s ON s.seg = p.seg AND p.ts_us BETWEEN s.start_us AND s.end_us")
def interval_containment(v):
    return j.contained_in(v.levels, v.segs, ["seg"], "ts_us", "start_us", "end_us", {"sid": "sid"}, v.time).select("ord", "sid")


@query(
    "asof_then_bound",
    """SELECT e.seg, e.eid, min(p.ts_us) AS first_ts FROM episodes e JOIN prints p
       ON p.seg = e.seg AND p.ts_us >= e.start_us AND p.ts_us <= e.end_us
       WHERE NOT EXISTS (SELECT 1 FROM episodes n WHERE n.seg = p.seg AND n.start_us = p.ts_us AND n.eid <> e.eid) GROUP BY 1, 2""",
)
def asof_then_bound(v):
    return j.first_event_per_span(v.prints, v.episodes, ["seg"], "ts_us", "start_us", "end_us", "eid", v.time)


def fill_orders(v):
    """Orders on a coarse price grid, so that prints reach them at and beyond their price."""
    return v.orders_p.withColumns({"px": F.expr("px div 25"), "ahead": F.col("ahead") % 40})


def fill_prints(v):
    return side_prints(v).withColumn("px", F.expr("px div 25"))


def fills_sql(orders, extra=""):
    """Brute-force fills: every print of the order's window, running volume at its price."""
    return f"""
    WITH o AS ({orders}),
    w AS (SELECT o.*, p.ts_us AS pts, p.ord AS pord, p.px AS ppx,
                 sum(CASE WHEN p.px = o.px THEN p.qty ELSE 0 END) OVER (PARTITION BY o.oid{extra} ORDER BY p.ts_us, p.ord) AS cum
          FROM o LEFT JOIN fill_prints p ON p.seg = o.seg AND p.side = o.side AND p.ts_us > o.place_us AND p.ts_us < o.end_us),
    a AS (SELECT * EXCLUDE (pts, pord, ppx, cum), min((pts, pord)) FILTER (WHERE ppx = px AND cum >= ahead + 1) AS f1,
                 min((pts, pord)) FILTER (WHERE ppx = px AND cum >= ahead + qty) AS f2,
                 min((pts, pord)) FILTER (WHERE CASE WHEN side = 'bid' THEN ppx < px ELSE ppx > px END) AS th, coalesce(max(cum), 0) AS total
          FROM w GROUP BY ALL),
    b AS (SELECT *, th IS NOT NULL AND (f2 IS NULL OR th < f2) AS by_thru FROM a)
    SELECT * EXCLUDE (f1, f2, th, total, by_thru), least(th[1], f1[1]) AS first_us, least(th[1], f2[1]) AS full_us,
           CASE WHEN by_thru OR f2 IS NOT NULL THEN qty ELSE least(greatest(total - ahead, 0), qty) END::BIGINT AS filled,
           CASE WHEN by_thru THEN 'through' WHEN f2 IS NOT NULL THEN 'at_quote' END AS mechanism,
           CASE WHEN by_thru OR f2 IS NOT NULL THEN 'full' WHEN total > ahead THEN 'partial' ELSE 'unfilled' END AS state
    FROM b"""


FO = "SELECT * REPLACE (px // 25 AS px, ahead % 40 AS ahead) FROM orders_p"


@query("threshold_fill", f"SELECT oid, first_us, full_us, filled, mechanism, state FROM ({fills_sql(FO)})")
def threshold_fill(v):
    d = j.threshold_fills(fill_orders(v), fill_prints(v), ["seg"], ["oid"], v.time)
    return d.select("oid", "first_us", "full_us", "filled", "mechanism", "state")


LIVES = [HOUR, 2 * HOUR, 6 * HOUR, 12 * HOUR]
GRIDO = f"""
    SELECT o.* REPLACE (least(o.place_us + l.lifetime, coalesce(s.ts_us, o.place_us + l.lifetime), (o.place_us // {DAY} + 1) * {DAY}) AS end_us, CASE WHEN k.queue = 'full' THEN o.ahead ELSE 0 END AS ahead),
           l.lifetime, k.queue, coalesce(s.ts_us < o.place_us + l.lifetime, false) AS snap_cut, (o.place_us // {DAY} + 1) * {DAY} < o.place_us + l.lifetime AS day_cut
    FROM ({FO}) o ASOF LEFT JOIN (SELECT seg, ts_us FROM levels WHERE ord % 40 = 0) s ON s.seg = o.seg AND o.place_us < s.ts_us,
         (SELECT unnest({LIVES})::BIGINT AS lifetime) l, (VALUES ('full'), ('none')) k(queue)"""


def lifetimes(v):
    snaps = v.levels.where("ord % 40 = 0").select("seg", "ts_us")
    o, queues, ends = j.lifetime_grid(fill_orders(v), snaps, ["seg"], LIVES, DAY, "ts_us", v.time)
    d = j.threshold_fills(o, fill_prints(v), ["seg"], ["oid"], v.time, queues, ends).drop("_snap")
    return v.settled(d.withColumn("status", j.cut_status(F.col("state"), F.col("snap_cut"), F.col("day_cut"))), "lifetimes", v.time)


STATUS = f"""
    SELECT *, CASE WHEN state = 'full' THEN 'full' WHEN snap_cut AND state = 'partial' THEN 'partial_invalid_snapshot' WHEN snap_cut THEN 'invalid_snapshot'
                   WHEN day_cut AND state = 'partial' THEN 'partial_invalid_day_boundary' WHEN day_cut THEN 'invalid_day_boundary' ELSE state END AS status
    FROM ({fills_sql(GRIDO, ', o.lifetime, o.queue')})"""


@query("fill_lifetimes", f"SELECT oid, lifetime, queue, first_us, full_us, filled, status FROM ({STATUS})")
def fill_lifetimes(v):
    return lifetimes(v).select("oid", "lifetime", "queue", "first_us", "full_us", "filled", "status")


ALPHAS = (0, 25, 50, 75, 100)
MARKOUTS = {"m1": HOUR, "m6": 6 * HOUR}


QUEUE = f"""
    WITH RECURSIVE q AS (SELECT *, row_number() OVER (ORDER BY seg, at_us, side) AS qid FROM ({TQ}) t),
    p AS ({NEAR}), c AS (SELECT s.seg, s.side, s.px, s.ts_us, s.ord, s.qty - coalesce(lag(s.qty) OVER (PARTITION BY s.seg, s.side, s.px ORDER BY s.ts_us, s.ord), 0) AS delta FROM levels s),
    e AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY ts_us, k, ord) AS n, ts_us, k, x FROM (
          SELECT q.qid, p.ts_us, 0 AS k, p.ord, p.qty AS x FROM q JOIN p ON p.seg = q.seg AND p.side = q.side AND p.px = q.quote_px AND p.ts_us > q.at_us AND p.ts_us < q.at_us + {6 * HOUR}
          UNION ALL
          SELECT q.qid, c.ts_us, 1, c.ord, c.delta FROM q JOIN c ON c.seg = q.seg AND c.side = q.side AND c.px = q.quote_px AND c.ts_us > q.at_us AND c.ts_us < q.at_us + {6 * HOUR} WHERE c.delta <> 0)),
    th AS (SELECT q.qid, min(p.ts_us) AS thru FROM q JOIN p ON p.seg = q.seg AND p.side = q.side AND p.ts_us > q.at_us AND p.ts_us < q.at_us + {6 * HOUR}
           AND CASE q.side WHEN 'bid' THEN p.px < q.quote_px ELSE p.px > q.quote_px END GROUP BY 1),
    s(qid, alpha, beta, n, ahead, behind, pool, got, hit) AS (
      SELECT qid, a.x, b.x, 0::BIGINT, (quote_qty * a.x // 100)::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT FROM q, (SELECT unnest({list(ALPHAS)})::BIGINT AS x) a, (SELECT unnest({list(ALPHAS)})::BIGINT AS x) b
      UNION ALL
      SELECT qid, alpha, beta, n,
        CASE WHEN k = 0 THEN greatest(ahead - x, 0) ELSE greatest(ahead - free * beta // 100, 0) END::BIGINT,
        CASE WHEN k = 0 THEN behind WHEN x > 0 THEN behind + x ELSE behind - drawn END::BIGINT,
        CASE WHEN k = 0 THEN pool + x WHEN x > 0 THEN pool ELSE pool - greatest(least(pool, -x - drawn), 0) END::BIGINT,
        (got + CASE WHEN k = 0 THEN greatest(x - ahead, 0) ELSE 0 END)::BIGINT,
        CASE WHEN k = 0 AND x > ahead AND got + x - ahead >= 5 THEN ts_us END
      FROM (SELECT s.qid, s.alpha, s.beta, e.n, e.k, e.x, e.ts_us, s.ahead, s.behind, s.pool, s.got, least(s.behind, greatest(-e.x, 0)) AS drawn,
                   greatest(greatest(-e.x, 0) - least(s.behind, greatest(-e.x, 0)) - s.pool, 0) AS free
            FROM s JOIN e ON e.qid = s.qid AND e.n = s.n + 1 WHERE s.hit IS NULL)),
    f AS (SELECT qid, alpha, beta, max(hit) AS hit FROM s GROUP BY 1, 2, 3)
    SELECT q.seg, q.at_us, q.side, q.quote_px AS px, q.quote_qty AS displayed, f.alpha, f.beta, least(thru, hit) AS fill_us,
           CASE WHEN thru IS NOT NULL AND (hit IS NULL OR thru < hit) THEN 'through' WHEN hit IS NOT NULL THEN 'at_quote' END AS mechanism
    FROM q JOIN f USING (qid) LEFT JOIN th USING (qid)"""


@query("queue_assumption_grid", QUEUE)
def queue_assumption_grid(v):
    b, q = touch_quotes(v)
    deltas = b.select("seg", "side", "px", "ts_us", "ord", (F.col("qty") - F.col("old_qty")).alias("delta"))
    quotes = q.select("seg", "at_us", "side", F.col("quote_px").alias("px"), F.col("quote_qty").alias("displayed"))
    return queue_grid_fills(quotes, near_prints(v), deltas, ["seg"], ["seg", "at_us", "side"], 6 * HOUR, 5, ALPHAS, ALPHAS, v.time)


@query("next_boundary", "SELECT o.oid, s.ts_us AS boundary_us FROM orders_p o ASOF LEFT JOIN (SELECT * FROM levels WHERE ord % 100 = 0) s ON s.seg = o.seg AND o.place_us < s.ts_us")
def next_boundary(v):
    snaps = v.levels.where("ord % 100 = 0")
    return asof(v.orders_p, snaps, ["seg"], "place_us", "ts_us", {"ts_us": "boundary_us"}, v.time, forward=True, strict=True).select("oid", "boundary_us")


@query(
    "first_true_after",
    f"""SELECT seg, sid, g_us, least(coalesce(min(CASE WHEN mid_x2 % 10 = 0 THEN g_us END) OVER (PARTITION BY seg, sid ORDER BY g_us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), g_us + {12 * HOUR}), g_us + {12 * HOUR}) AS exit_us FROM grid""",
)
def first_true_after(v):
    cap = F.col("g_us") + 12 * HOUR
    d = j.first_true(v.grid, ["seg", "sid"], "g_us", F.col("mid_x2") % 10 == 0, "hit", v.time)
    return d.select("seg", "sid", "g_us", F.least(F.coalesce("hit", cap), cap).alias("exit_us"))


@query(
    "next_unsafe",
    """SELECT seg, sid, g_us, coalesce(min(CASE WHEN mid_x2 < 20 THEN g_us END) OVER (PARTITION BY seg, sid ORDER BY g_us ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
              max(g_us) OVER (PARTITION BY seg, sid)) AS unsafe_us FROM grid""",
)
def next_unsafe(v):
    d = j.first_true(v.grid, ["seg", "sid"], "g_us", F.col("mid_x2") < 20, "hit", v.time, strict=True)
    last = v.grid.groupBy("seg", "sid").agg(F.max("g_us").alias("last_g"))
    return d.join(last, ["seg", "sid"]).select("seg", "sid", "g_us", F.coalesce("hit", "last_g").alias("unsafe_us"))


THRESHOLDS = [0.5, 0.7, 0.9]
TIMELINE = """
    SELECT o.oid, t.threshold, count(s.g_us) AS instants, min(s.g_us) FILTER (WHERE s.p >= t.threshold) AS crossing
    FROM orders_p o CROSS JOIN (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) t(threshold)
    LEFT JOIN scores s ON s.seg = o.seg AND s.side = o.side AND s.g_us > o.place_us AND s.g_us <= o.end_us GROUP BY 1, 2"""


def timeline(v, orders):
    return j.crossings(orders, v.scores, ["seg", "side"], "place_us", "end_us", "g_us", "p", THRESHOLDS, v.time)


@query("decision_timeline", TIMELINE, dbl="threshold")
def decision_timeline(v):
    return timeline(v, v.orders_p).select("oid", "threshold", "instants", "crossing")


FIRSTX = """
    WITH s AS (SELECT s.*, e.eid, e.end_us, e.close_reason, t.threshold FROM scores s ASOF JOIN episodes e ON e.seg = s.seg AND s.g_us >= e.start_us,
                    (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) t(threshold) WHERE s.p >= t.threshold)
    SELECT seg, side, eid, threshold, min(g_us) AS crossing, min(end_us) - min(g_us) AS lead_us, min(close_reason) AS close_reason FROM s GROUP BY 1, 2, 3, 4"""


def first_crossings(v):
    cols = {"eid": "eid", "end_us": "end_us", "close_reason": "close_reason"}
    s = asof(v.scores, v.episodes, ["seg"], "g_us", "start_us", cols, v.time).where("eid IS NOT NULL")
    s = s.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS]))).where("p >= threshold")
    first = F.min("g_us")
    return s.groupBy("seg", "side", "eid", "threshold").agg(
        first.alias("crossing"), (F.min("end_us") - first).alias("lead_us"), F.min("close_reason").alias("close_reason")
    )


@query("first_crossing_per_episode", FIRSTX, dbl="threshold")
def first_crossing_per_episode(v):
    return first_crossings(v)


FQ = f"""
    SELECT s.seg, s.sid, s.g_us, s.side, g.mid_x2 // 2 AS px,
           (SELECT min(p.ts_us) FROM (SELECT *, CASE WHEN is_buy THEN 'ask' ELSE 'bid' END AS side FROM prints) p WHERE p.seg = s.seg AND p.side = s.side AND p.ts_us > s.g_us
              AND p.ts_us < s.g_us + {6 * HOUR} AND CASE s.side WHEN 'bid' THEN p.px <= g.mid_x2 // 2 ELSE p.px >= g.mid_x2 // 2 END) AS fill_us
    FROM scores s JOIN grid g USING (seg, g_us)"""


def filled_quotes(v):
    q = quoted_sides(v).withColumn("sid", F.expr(f"g_us div {SPAN}"))
    toward = F.when(F.col("side") == "bid", -1).otherwise(1)
    return first_beyond(q, side_prints(v), ["seg", "side"], ["seg", "g_us", "side"], "g_us", F.col("g_us") + 6 * HOUR, F.col("px") - toward, toward, "ts_us", "px", "fill_us", v.time)


LEGS = f"""
    WITH q AS ({FQ}), e AS (SELECT *, CAST(ceil((fill_us + {HOUR}) / {HOUR}) AS BIGINT) * {HOUR} AS target FROM q WHERE fill_us IS NOT NULL)
    SELECT e.seg, e.g_us, e.side, e.target, x.fill_us AS exit_fill, (CASE WHEN e.side = 'bid' THEN 1 ELSE -1 END) * (x.px - e.px) * 10000.0 / nullif(e.px, 0) AS gross_bps,
           ((CASE WHEN e.side = 'bid' THEN 1 ELSE -1 END) * (x.px - e.px) - 0.0002 * (e.px + x.px)) * 10000.0 / nullif(e.px, 0) AS net_bps
    FROM e JOIN q x ON x.seg = e.seg AND x.g_us = e.target AND x.side <> e.side AND x.fill_us > e.fill_us AND x.sid = e.sid"""


@query("exit_leg_pairing", LEGS, dbl="gross_bps net_bps")
def exit_leg_pairing(v):
    q = filled_quotes(v)
    d = j.pair_legs(q, q, ["seg"], "g_us", "fill_us", "sid", HOUR, HOUR, 2.0)
    return d.select("seg", "g_us", "side", "target", "exit_fill", "gross_bps", "net_bps")


@query(
    "event_sum_in_interval",
    "SELECT b.day, coalesce(sum(f.rate), 0)::BIGINT AS paid FROM (SELECT day FROM bars WHERE market = 0) b LEFT JOIN funding f ON f.day > b.day AND f.day <= b.day + 30 GROUP BY 1",
)
def event_sum_in_interval(v):
    spans = v.bars.where("market = 0").select("day", (F.col("day") + 30).alias("exit_day"))
    f = v.funding.withColumnRenamed("day", "f_day")
    days = v.blocks(f, "f_day", "lineitem", tag="f_day")
    return j.interval_sums(spans, f, [], "day", "exit_day", "f_day", "rate", "paid", days).select("day", "paid")


@query("asof_funding", "SELECT b.market, b.day, f.rate FROM bars b ASOF LEFT JOIN funding f ON b.day >= f.day")
def asof_funding(v):
    f = v.funding.withColumnRenamed("day", "f_day")
    days = v.blocks(f, "f_day", "lineitem", tag="f_day")
    return asof(v.bars, f, [], "day", "f_day", {"rate": "rate"}, days).select("market", "day", "rate")


@query("aligned_markets", "SELECT s.day, (p.close / s.close - 1) * 10000 AS basis_bps FROM (SELECT * FROM bars WHERE market = 0) s JOIN (SELECT * FROM bars WHERE market = 1) p USING (day)", dbl="basis_bps")
def aligned_markets(v):
    return aligned(v).select("day", ((F.col("perp") / F.col("spot") - 1) * 10_000).alias("basis_bps"))


def aligned(v):
    s = v.bars.where("market = 0").select("day", F.col("close").alias("spot"))
    p = v.bars.where("market = 1").select("day", F.col("close").alias("perp"))
    return s.join(p, "day")


LIFE = "SELECT *, k % 4 AS qty FROM lifecycle"


@query(
    "execution_reconciliation",
    f"""WITH l AS ({LIFE}), e AS (SELECT * FROM l WHERE kind = 'execution'), o AS (SELECT * FROM l WHERE kind <> 'execution'),
        p AS (SELECT e.ord, e.uid, e.ts_us AS exec_us, e.qty AS exec_qty, o.kind, o.ts_us, o.qty AS oq FROM e LEFT JOIN o ON o.uid = e.uid AND abs(o.ts_us - e.ts_us) <= {24 * HOUR}),
        g AS (SELECT ord, uid, exec_us, exec_qty, count(kind) AS window_events, count(*) FILTER (WHERE kind = 'placed') AS n_placed, count(*) FILTER (WHERE kind IN ('cancelled', 'filled')) AS n_terminal,
                     arg_min(oq, ts_us) FILTER (WHERE kind = 'placed') AS pq, arg_max(oq, ts_us) FILTER (WHERE kind = 'cancelled') AS lq,
                     count(*) FILTER (WHERE kind = 'cancelled' AND ts_us >= exec_us) AS n_cancel_after FROM p GROUP BY 1, 2, 3, 4)
        SELECT * EXCLUDE (pq, lq), CASE WHEN pq = exec_qty THEN 'full' WHEN pq = exec_qty + lq THEN 'partial_then_cancel' ELSE 'unknown' END AS fill_class FROM g""",
)
def execution_reconciliation(v):
    life = v.lifecycle.withColumn("qty", F.col("k") % 4)
    ex = life.where("kind = 'execution'").withColumn("exec_qty", F.col("qty"))
    return j.reconcile_executions(ex, life.where("kind <> 'execution'"), "uid", "ts_us", 24 * HOUR, v.time)


@query(
    "lifecycle_anti",
    """WITH l AS (SELECT *, uid * 1000 + ord % 40 AS oid FROM lifecycle), p AS (SELECT DISTINCT oid FROM l WHERE kind = 'placed'),
       t AS (SELECT DISTINCT oid FROM l WHERE kind IN ('cancelled', 'filled')), c AS (SELECT DISTINCT oid FROM l WHERE kind IN ('updated', 'cancelled')), x AS (SELECT DISTINCT oid FROM l WHERE kind = 'execution')
       SELECT 'no_placement' AS cls, count(*) AS n FROM c WHERE oid NOT IN (SELECT oid FROM p) UNION ALL
       SELECT 'no_terminal', count(*) FROM p WHERE oid NOT IN (SELECT oid FROM t) UNION ALL SELECT 'executed', count(*) FROM p WHERE oid IN (SELECT oid FROM x)""",
)
def lifecycle_anti(v):
    d = v.lifecycle.withColumn("oid", F.col("uid") * 1000 + F.col("ord") % 40)

    def of(*kinds):
        return d.where(F.col("kind").isin(*kinds)).select("oid").distinct()

    placed = of("placed")
    parts = {
        "no_placement": of("updated", "cancelled").join(placed, "oid", "left_anti"),
        "no_terminal": placed.join(of("cancelled", "filled"), "oid", "left_anti"),
        "executed": placed.join(of("execution"), "oid", "left_semi"),
    }
    out = None
    for name, part in parts.items():
        row = part.agg(F.count("*").alias("n")).select(F.lit(name).alias("cls"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "wide_oof_merge",
    """SELECT coalesce(a.id, b.id, c.id) AS id, a.x1 AS p_a, b.x2 AS p_b, c.x3 AS p_c FROM (SELECT * FROM wide WHERE id % 3 <> 0) a
       FULL JOIN (SELECT * FROM wide WHERE id % 4 <> 0) b ON a.id = b.id FULL JOIN (SELECT * FROM wide WHERE id % 5 <> 0) c ON c.id = coalesce(a.id, b.id)""",
)
def wide_oof_merge(v):
    a = v.wide.where("id % 3 <> 0").select("id", F.col("x1").alias("p_a"))
    b = v.wide.where("id % 4 <> 0").select("id", F.col("x2").alias("p_b"))
    c = v.wide.where("id % 5 <> 0").select("id", F.col("x3").alias("p_c"))
    return a.join(b, "id", "full_outer").join(c, "id", "full_outer")


def marked_fills(v, alphas=ALPHAS, horizons=("m1",), shown=None):
    """Fills of coarse orders under some queue shares, with markouts at the fill price for the horizons that are read.

    ``shown`` names a column with the whole queue that was displayed, whatever share of it is assumed.
    """
    shares = F.array(*[F.struct(F.lit(a).cast("bigint").alias("alpha"), F.expr(f"ahead * {a}L div 100").alias("ahead")) for a in alphas])
    orders = fill_orders(v).withColumn(shown, F.col("ahead")) if shown else fill_orders(v)
    d = j.threshold_fills(orders, fill_prints(v), ["seg"], ["oid"], v.time, shares).join(seg_ends(v), "seg")
    d = d.withColumns({"fill_us": F.col("full_us"), "price": F.col("px") * 25})
    m = path_markouts(d, v.mid_path, ["seg"], "fill_us", "last_us", {h: MARKOUTS[h] for h in horizons}, "ts_us", "mid_x2", "price", v.time)
    m = m.withColumns({"sid": F.expr(f"place_us div {SPAN}"), "filled": F.col("fill_us").isNotNull()})
    return v.settled(m, "fills", v.time)


CANCEL = f"""
    WITH t AS ({TIMELINE}), f AS (SELECT oid, fill_us, m1 FROM fills WHERE alpha = 50),
    c AS (SELECT f.oid, t.threshold, l.latency, t.crossing, f.fill_us, f.m1, t.crossing + l.latency AS effective, coalesce(f.fill_us > t.crossing + l.latency, false) AS prevented
          FROM f JOIN t USING (oid), (VALUES (0::BIGINT), ({HOUR}::BIGINT)) l(latency))
    SELECT oid, threshold, latency, crossing IS NOT NULL AS signalled, prevented, effective, fill_us IS NOT NULL AND NOT prevented AS survives,
           CASE WHEN crossing IS NULL THEN 'unaffected' WHEN fill_us IS NULL THEN 'cancel_without_fill' WHEN NOT prevented THEN 'too_late' WHEN m1 IS NULL THEN 'prevented_censored'
                WHEN m1 < 0 THEN 'adverse_avoided' WHEN m1 > 0 THEN 'favourable_sacrificed' ELSE 'neutral_sacrificed' END AS disposition,
           CASE WHEN prevented AND m1 IS NOT NULL THEN greatest(-m1, 0) ELSE 0 END::BIGINT AS avoided_ticks, CASE WHEN prevented AND m1 IS NOT NULL THEN greatest(m1, 0) ELSE 0 END::BIGINT AS sacrificed_ticks,
           fill_us IS NOT NULL AS filled, m1
    FROM c"""


def cancelled(v):
    f = marked_fills(v, (50,))
    return j.cancel_outcomes(timeline(v, f), [0, HOUR], "fill_us", "m1")


@query("counterfactual_cancel", f"SELECT * EXCLUDE (filled, m1) FROM ({CANCEL})", dbl="threshold")
def counterfactual_cancel(v):
    return cancelled(v).select("oid", "threshold", "latency", "signalled", "prevented", "effective", "survives", "disposition", "avoided_ticks", "sacrificed_ticks")


POLICIES = {
    "x1_high": "x1 >= 100",
    "x2_low": "x2 < 15",
    "consensus": "(x1 >= 80)::INT + (x2 >= 20)::INT + (x3 >= 16)::INT >= 2",
    "joint": "x1 >= 100 AND x3 >= 16",
    "early_session": "blk < 10 AND n_lines > 3",
}


@query(
    "policy_cross",
    "SELECT id, policy FROM (SELECT id, unnest([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in POLICIES.items()) + "]) AS policy FROM wide) WHERE policy IS NOT NULL",
)
def policy_cross(v):
    conds = {n: F.expr(c.replace("::INT", "")) if "::INT" not in c else F.expr("int(x1 >= 80) + int(x2 >= 20) + int(x3 >= 16) >= 2") for n, c in POLICIES.items()}
    return j.eligible_policies(v.wide, conds).select("id", "policy")

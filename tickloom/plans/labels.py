"""Queries for forward labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import labels as lb
from tickloom.operators.intervals import first_beyond, window_volume
from tickloom.operators.ordered import asof, shifted
from tickloom.operators.state import touch_path
from tickloom.plans.registry import query
from tickloom.plans.state import book
from tickloom.plans.views import HOUR

SEG_END = "SELECT seg, max(ts_us) AS last_us FROM ev GROUP BY 1"


def seg_ends(v):
    return v.ev.groupBy("seg").agg(F.max("ts_us").alias("last_us"))


@query("grid_markout", """SELECT seg, sid, g_us, m1, sign(m1)::BIGINT AS m1_dir, m6, sign(m6)::BIGINT AS m6_dir FROM marks""")
def grid_markout(v):
    d = lb.grid_markouts(v.grid, ["seg", "sid"], "g_us", "mid_x2", {"m1": 1, "m6": 6}, v.time)
    return d.select("seg", "sid", "g_us", "m1", "m1_dir", "m6", "m6_dir")


def path_sql(h):
    return f"""CASE WHEN f.place_us + {h * HOUR} <= f.last_us THEN (CASE WHEN f.side = 'bid' THEN 1 ELSE -1 END) * (p{h}.mid_x2 - 2 * f.px) END AS m{h}"""


PATHM = f"""
    SELECT f.oid, f.seg, f.side, {path_sql(1)}, {path_sql(6)}
    FROM (SELECT * FROM orders_p JOIN ({SEG_END}) USING (seg)) f
    ASOF LEFT JOIN mid_path p1 ON p1.seg = f.seg AND f.place_us + {HOUR} >= p1.ts_us
    ASOF LEFT JOIN mid_path p6 ON p6.seg = f.seg AND f.place_us + {6 * HOUR} >= p6.ts_us"""


def marked_orders(v):
    f = v.orders_p.join(seg_ends(v), "seg")
    return lb.path_markouts(f, v.mid_path, ["seg"], "place_us", "last_us", {"m1": HOUR, "m6": 6 * HOUR}, "ts_us", "mid_x2", "px", v.time)


@query("path_markout", PATHM)
def path_markout(v):
    return marked_orders(v).select("oid", "seg", "side", "m1", "m6")


NEXT = f"""
    SELECT g.*, CASE WHEN p.ts_us - g.g_us <= {2 * HOUR} THEN p.ts_us - g.g_us END AS move_us,
           CASE WHEN p.ts_us - g.g_us <= {2 * HOUR} THEN sign(p.mid_x2 - g.mid_x2)::BIGINT END AS move_dir
    FROM grid g ASOF LEFT JOIN mid_path p ON p.seg = g.seg AND g.g_us < p.ts_us"""


def with_next(v):
    return lb.next_move(v.grid, v.mid_path, ["seg"], "g_us", "ts_us", "mid_x2", 2 * HOUR, v.time)


@query("next_move", f"SELECT seg, g_us, move_us, move_dir FROM ({NEXT})")
def next_move(v):
    return with_next(v).select("seg", "g_us", "move_us", "move_dir")


@query(
    "first_passage",
    f"""SELECT g.seg, g.g_us, min(p.ts_us) FILTER (WHERE p.mid_x2 > g.mid_x2) - g.g_us AS up_us, min(p.ts_us) FILTER (WHERE p.mid_x2 < g.mid_x2) - g.g_us AS down_us
        FROM grid g LEFT JOIN mid_path p ON p.seg = g.seg AND p.ts_us > g.g_us AND p.ts_us < g.g_us + {12 * HOUR} GROUP BY 1, 2""",
)
def first_passage(v):
    d = v.grid
    for name, sign in (("up", 1), ("down", -1)):
        d = first_beyond(d, v.mid_path, ["seg"], ["seg", "g_us"], "g_us", F.col("g_us") + 12 * HOUR, F.col("mid_x2"), F.lit(sign), "ts_us", "mid_x2", name, v.time)
    return d.select("seg", "g_us", (F.col("up") - F.col("g_us")).alias("up_us"), (F.col("down") - F.col("g_us")).alias("down_us"))


@query(
    "move_within_h",
    f"""SELECT seg, g_us, """ + ", ".join(f"CASE WHEN move_us <= {h} THEN 1 WHEN last_us - g_us >= {h} THEN 0 END::BIGINT AS y_{n}" for n, h in (("30m", HOUR // 2), ("2h", 2 * HOUR)))
    + f" FROM ({NEXT}) JOIN ({SEG_END}) USING (seg)",
)
def move_within_h(v):
    d = with_next(v).join(seg_ends(v), "seg")
    left = F.col("last_us") - F.col("g_us")
    return d.select("seg", "g_us", lb.moved_within(F.col("move_us"), left, HOUR // 2).alias("y_30m"), lb.moved_within(F.col("move_us"), left, 2 * HOUR).alias("y_2h"))


@query(
    "conditional_labels",
    f"""SELECT oid, CASE WHEN filled THEN through::INT END::BIGINT AS through_given_fill, CASE WHEN filled AND m1 IS NOT NULL THEN (m1 > 0)::INT END::BIGINT AS good_fill
        FROM (SELECT *, oid % 3 <> 0 AS filled, oid % 2 = 0 AS through FROM ({PATHM}))""",
)
def conditional_labels(v):
    filled, through = F.col("oid") % 3 != 0, (F.col("oid") % 2 == 0).cast("bigint")
    good = F.when(F.col("m1").isNotNull(), (F.col("m1") > 0).cast("bigint"))
    return marked_orders(v).select("oid", F.when(filled, through).alias("through_given_fill"), F.when(filled, good).alias("good_fill"))


QUOTES = "SELECT seg, sid, g_us, 1000 + mid_x2 // 8 AS bid, 1002 + mid_x2 // 8 AS ask FROM grid WHERE mid_x2 % 23 <> 0"


def quote_grid(v):
    return v.grid.where("mid_x2 % 23 <> 0").selectExpr("seg", "sid", "g_us", "1000 + mid_x2 div 8 AS bid", "1002 + mid_x2 div 8 AS ask")


def exec_sql(lat, hold, fee):
    whole = f"t1 = g_us + {lat * HOUR} AND t2 = g_us + {(lat + hold) * HOUR}"
    return f"""SELECT seg, g_us, CASE WHEN {whole} THEN (b2 - a1) * 10000.0 / a1 END AS long_gross, CASE WHEN {whole} THEN (b1 - a2) * 10000.0 / b1 END AS short_gross,
               CASE WHEN {whole} THEN (b2 - a1 - {fee} * (a1 + b2)) * 10000.0 / a1 END AS long_net, CASE WHEN {whole} THEN (b1 - a2 - {fee} * (a2 + b1)) * 10000.0 / b1 END AS short_net
        FROM (SELECT *, lead(g_us, {lat}) OVER w AS t1, lead(bid, {lat}) OVER w AS b1, lead(ask, {lat}) OVER w AS a1,
                     lead(g_us, {lat + hold}) OVER w AS t2, lead(bid, {lat + hold}) OVER w AS b2, lead(ask, {lat + hold}) OVER w AS a2
              FROM ({QUOTES}) WINDOW w AS (PARTITION BY seg, sid ORDER BY g_us))"""


RET = ["long_gross", "short_gross", "long_net", "short_net"]


@query("executable_return", f"SELECT seg, g_us, long_gross, short_gross FROM ({exec_sql(1, 6, 0.0)})", dbl="long_gross short_gross")
def executable_return(v):
    return lb.executable_returns(quote_grid(v), ["seg", "sid"], "g_us", HOUR, 6, v.time).select("seg", "g_us", *RET[:2])


@query("bbo_return_with_fee", exec_sql(2, 4, 0.0005), dbl=" ".join(RET))
def bbo_return_with_fee(v):
    d = lb.executable_returns(quote_grid(v), ["seg", "sid"], "g_us", HOUR, 4, v.time, latency=2, fee_bps=5.0)
    return d.select("seg", "g_us", *RET)


@query(
    "ceil_grid_fill_markout",
    f"""WITH f AS (SELECT *, CAST(ceil(place_us / {HOUR}) AS BIGINT) * {HOUR} AS fill_grid, CASE WHEN side = 'bid' THEN 1 ELSE -1 END AS sg FROM orders_p)
        SELECT f.oid, f.fill_grid, sg * (a.mid_x2 - 2 * px) AS advantage, CASE WHEN b.sid = a.sid THEN sg * (b.mid_x2 - 2 * px) END AS h2_markout,
               CASE WHEN b.sid = a.sid THEN sg * (b.mid_x2 - a.mid_x2) END AS h2_move
        FROM f LEFT JOIN grid a ON a.seg = f.seg AND a.g_us = f.fill_grid LEFT JOIN grid b ON b.seg = f.seg AND b.g_us = f.fill_grid + {2 * HOUR}""",
)
def ceil_grid_fill_markout(v):
    d = lb.ceil_grid_markouts(v.orders_p, v.grid, ["seg"], "place_us", "g_us", "sid", "mid_x2", "px", HOUR, {"h2": 2 * HOUR})
    return d.select("oid", "fill_grid", "advantage", "h2_markout", "h2_move")


@query(
    "level_survival",
    f"""SELECT g.seg, g.g_us, """ + ", ".join(
        f"CASE WHEN e.close_reason <> 'segment_end' AND e.end_us - g.g_us <= {h} THEN 1 WHEN last_us - g.g_us >= {h} AND NOT coalesce(e.end_us - g.g_us <= {h}, false) THEN 0 END::BIGINT AS {n}" for n, h in (("gone_1h", HOUR), ("gone_6h", 6 * HOUR))
    ) + f" FROM instants g ASOF JOIN episodes e ON e.seg = g.seg AND g.g_us >= e.start_us JOIN ({SEG_END}) z ON z.seg = g.seg",
)
def level_survival(v):
    cols = {"end_us": "end_us", "close_reason": "close_reason"}
    d = asof(v.grid.select("seg", "g_us"), v.episodes, ["seg"], "g_us", "start_us", cols, v.time).join(seg_ends(v), "seg")
    d = lb.level_survival(d, "g_us", "end_us", "close_reason", "last_us", {"gone_1h": HOUR, "gone_6h": 6 * HOUR})
    return d.select("seg", "g_us", "gone_1h", "gone_6h")


def quoted_sides(v):
    """Grid rows as one bid and one ask quote at the integer mid."""
    return v.scores.select("seg", "g_us", "side").join(v.grid.selectExpr("seg", "g_us", "mid_x2 div 2 AS px", "mid_x2"), ["seg", "g_us"])


def side_prints(v):
    """Prints with the book side they hit: aggressive buys hit the ask."""
    return v.prints.withColumn("side", F.when(F.col("is_buy"), "ask").otherwise("bid"))


SIDE_PRINTS = "SELECT *, CASE WHEN is_buy THEN 'ask' ELSE 'bid' END AS side FROM prints"


@query(
    "sweep_within_h",
    f"""WITH q AS (SELECT s.seg, s.g_us, s.side, g.mid_x2 // 2 AS px, z.last_us - s.g_us >= {4 * HOUR} AS seen FROM scores s JOIN grid g USING (seg, g_us) JOIN ({SEG_END}) z USING (seg)),
        j AS (SELECT q.*, p.qty, CASE WHEN p.px = q.px THEN 'at' WHEN (q.side = 'bid') = (p.px < q.px) THEN 'through' END AS kind
              FROM q LEFT JOIN ({SIDE_PRINTS}) p ON p.seg = q.seg AND p.side = q.side AND p.ts_us > q.g_us AND p.ts_us <= q.g_us + {4 * HOUR})
        SELECT seg, g_us, side, CASE WHEN seen THEN coalesce(max((kind = 'through')::INT), 0) END::BIGINT AS swept,
               CASE WHEN seen THEN coalesce(sum(qty) FILTER (WHERE kind = 'at'), 0) END::BIGINT AS at_volume, CASE WHEN seen THEN coalesce(sum(qty) FILTER (WHERE kind = 'through'), 0) END::BIGINT AS through_volume
        FROM j GROUP BY seg, g_us, side, seen""",
)
def sweep_within_h(v):
    d = window_volume(quoted_sides(v), side_prints(v), ["seg", "side"], ["seg", "g_us", "side"], "g_us", F.col("g_us") + 4 * HOUR, F.col("px"), "ts_us", "px", "qty", v.time)
    d = d.join(seg_ends(v), "seg")
    seen = F.col("last_us") - F.col("g_us") >= 4 * HOUR
    through = F.when(F.col("side") == "bid", F.col("below")).otherwise(F.col("above"))
    return d.select(
        "seg", "g_us", "side", F.when(seen, (through > 0).cast("bigint")).alias("swept"), F.when(seen, F.col("at")).alias("at_volume"),
        F.when(seen, through).alias("through_volume"),
    )


@query(
    "tail_targets",
    f"""SELECT oid, (m1 <= -50)::INT::BIGINT AS tail_50, (m1 <= -200)::INT::BIGINT AS tail_200, least(m1, 0 * m1) AS downside, greatest(-m1, 0 * m1) AS severity FROM ({PATHM})""",
)
def tail_targets(v):
    t = lb.tail_targets(F.col("m1"), [50, 200])
    return marked_orders(v).select("oid", *[c.alias(n) for n, c in t.items()])


def touch_quotes(v):
    """Both sides of the reconstructed touch at every grid instant."""
    b = book(v).withColumn("b_ts", F.col("ts_us"))
    cols = {c: c for c in ("best_bid", "best_ask", "bid_qty", "ask_qty")}
    g = asof(v.grid.select("seg", "g_us"), b, ["seg"], "g_us", "ts_us", cols, v.time, ["ord"]).where("best_bid IS NOT NULL AND best_ask IS NOT NULL")
    sides = F.inline(
        F.array(
            F.struct(F.lit("bid").alias("side"), F.col("best_bid").alias("quote_px"), F.col("bid_qty").alias("quote_qty")),
            F.struct(F.lit("ask").alias("side"), F.col("best_ask").alias("quote_px"), F.col("ask_qty").alias("quote_qty")),
        )
    )
    return b, g.select("seg", F.col("g_us").alias("at_us"), (F.col("best_bid") + F.col("best_ask")).alias("mid_x2"), sides)


def near_prints(v):
    near = F.when(F.col("is_buy"), 1001 + F.col("ord") % 3).otherwise(1000 - F.col("ord") % 3)
    return side_prints(v).withColumn("px", near)


NEAR = "SELECT seg, ts_us, ord, qty, CASE WHEN is_buy THEN 'ask' ELSE 'bid' END AS side, CASE WHEN is_buy THEN 1001 + ord % 3 ELSE 1000 - ord % 3 END AS px FROM prints"
TQ = """
    SELECT s.seg, s.g_us AS at_us, s.best_bid + s.best_ask AS mid_x2, x.side, CASE x.side WHEN 'bid' THEN best_bid ELSE best_ask END AS quote_px,
           CASE x.side WHEN 'bid' THEN bid_qty ELSE ask_qty END AS quote_qty
    FROM (SELECT i.seg, i.g_us, s.best_bid, s.best_ask, s.bid_qty, s.ask_qty FROM instants i ASOF JOIN swept s ON s.seg = i.seg AND i.g_us >= s.ts_us) s, (VALUES ('bid'), ('ask')) x(side)
    WHERE s.best_bid IS NOT NULL AND s.best_ask IS NOT NULL"""


def races(h):
    def less(a, b):
        return f"CASE q.side WHEN 'bid' THEN {a} < {b} ELSE {a} > {b} END"

    def first(table, alias, cond):
        return f"(SELECT min({alias}.ts_us) FROM {table} {alias} WHERE {alias}.seg = q.seg AND {alias}.ts_us > q.at_us AND {alias}.ts_us <= q.at_us + {h} AND {cond})"

    sw = "CASE q.side WHEN 'bid' THEN s.best_bid ELSE s.best_ask END"
    return f"""SELECT q.*, {first(f'({NEAR})', 'p', "p.side = q.side AND CASE q.side WHEN 'bid' THEN p.px <= q.quote_px ELSE p.px >= q.quote_px END")} AS fill,
        {first('swept', 's', less('s.best_bid + s.best_ask', 'q.mid_x2'))} AS mid_adverse, {first('swept', 's', less(sw, 'q.quote_px'))} AS best_adverse,
        {first('levels', 'l', 'l.side = q.side AND l.px = q.quote_px AND l.qty = 0')} AS gone FROM ({TQ}) q"""


def raced(v):
    b, q = touch_quotes(v)
    mids = b.select("seg", "ts_us", (F.col("best_bid") + F.col("best_ask")).alias("mid_x2"))
    return lb.quote_events(
        q, ["seg"], ["seg", "at_us", "side"], 6 * HOUR, near_prints(v), touch_path(b, ["seg"], "ts_us"), mids, v.levels.where("qty = 0"), "ts_us", v.time
    )


RACES = races(6 * HOUR)


@query(
    "competing_events",
    f"""SELECT seg, at_us, side, fill - at_us AS fill_us, mid_adverse - at_us AS mid_us, best_adverse - at_us AS best_us, gone - at_us AS gone_us,
               CASE WHEN least(fill, mid_adverse, best_adverse, gone) IS NULL THEN NULL WHEN fill = least(fill, mid_adverse, best_adverse, gone) THEN 'fill'
                    WHEN mid_adverse = least(fill, mid_adverse, best_adverse, gone) THEN 'mid_adverse' WHEN best_adverse = least(fill, mid_adverse, best_adverse, gone) THEN 'best_adverse' ELSE 'gone' END AS first_event
        FROM ({RACES})""",
)
def competing_events(v):
    d = raced(v)
    names = {n: n for n in ("fill", "mid_adverse", "best_adverse", "gone")}
    at = F.col("at_us")
    return d.select(
        "seg", "at_us", "side", (F.col("fill") - at).alias("fill_us"), (F.col("mid_adverse") - at).alias("mid_us"), (F.col("best_adverse") - at).alias("best_us"),
        (F.col("gone") - at).alias("gone_us"), lb.first_of(names).alias("first_event"),
    )


@query(
    "feed_reaction_latency",
    f"""WITH q AS (SELECT p.seg, p.ord, p.side, p.ts_us AS at_us, t.px AS quote_px, t.qty AS quote_qty, s.best_bid + s.best_ask AS mid_x2
                   FROM ({NEAR}) p ASOF JOIN touch t ON t.seg = p.seg AND t.side = p.side AND p.ts_us >= t.ts_us ASOF JOIN swept s ON s.seg = p.seg AND p.ts_us >= s.ts_us WHERE t.px IS NOT NULL)
        SELECT q.seg, q.ord, q.side,
          (SELECT min(l.ts_us) FROM levels l WHERE l.seg = q.seg AND l.side = q.side AND l.px = q.quote_px AND l.ts_us > q.at_us AND l.ts_us <= q.at_us + {5 * HOUR} AND l.qty < q.quote_qty) - q.at_us AS drop_us,
          (SELECT min(l.ts_us) FROM levels l WHERE l.seg = q.seg AND l.side = q.side AND l.px = q.quote_px AND l.ts_us > q.at_us AND l.ts_us <= q.at_us + {5 * HOUR} AND l.qty = 0) - q.at_us AS removal_us,
          (SELECT min(t.ts_us) FROM touch t WHERE t.seg = q.seg AND t.side = q.side AND t.ts_us > q.at_us AND t.ts_us <= q.at_us + {5 * HOUR} AND t.px <> q.quote_px) - q.at_us AS best_us,
          (SELECT min(s.ts_us) FROM swept s WHERE s.seg = q.seg AND s.ts_us > q.at_us AND s.ts_us <= q.at_us + {5 * HOUR} AND CASE q.side WHEN 'ask' THEN s.best_bid + s.best_ask > q.mid_x2 ELSE s.best_bid + s.best_ask < q.mid_x2 END) - q.at_us AS adverse_us
        FROM q""",
)
def feed_reaction_latency(v):
    b = book(v)
    touch = touch_path(b, ["seg"], "ts_us")
    mids = b.select("seg", "ts_us", (F.col("best_bid") + F.col("best_ask")).alias("mid_x2"))
    both, until = ["seg", "side"], F.col("ts_us") + 5 * HOUR
    q = asof(near_prints(v).drop("px"), touch, both, "ts_us", "ts_us", {"px": "quote_px", "qty": "quote_qty"}, v.time).where("quote_px IS NOT NULL")
    q = asof(q, mids, ["seg"], "ts_us", "ts_us", {"mid_x2": "mid_x2"}, v.time)
    lv = v.levels.withColumnRenamed("px", "quote_px")
    common = {"qid": ["seg", "ord"], "after": "ts_us", "until": until, "ts": "ts_us", "blocks": v.time, "closed": True}
    toward = F.when(F.col("side") == "ask", 1).otherwise(-1)
    q = first_beyond(q, lv, [*both, "quote_px"], bound=F.col("quote_qty"), sign=F.lit(-1), value="qty", out="drop", **common)
    q = first_beyond(q, lv, [*both, "quote_px"], bound=F.lit(1), sign=F.lit(-1), value="qty", out="removal", **common)
    q = first_beyond(q, touch, both, bound=F.col("quote_px"), sign=F.lit(1), value="px", out="up", **common)
    q = first_beyond(q, touch, both, bound=F.col("quote_px"), sign=F.lit(-1), value="px", out="down", **common)
    q = first_beyond(q, mids, ["seg"], bound=F.col("mid_x2"), sign=toward, value="mid_x2", out="adverse", **common)
    at = F.col("ts_us")
    return q.select(
        "seg", "ord", "side", (F.col("drop") - at).alias("drop_us"), (F.col("removal") - at).alias("removal_us"), (F.least("up", "down") - at).alias("best_us"), (F.col("adverse") - at).alias("adverse_us")
    )


@query("print_category", "SELECT seg, ord, side, kind FROM touch_hits")
def print_category(v):
    from tickloom.plans.state import flow_rows, hits

    return hits(v, flow_rows(v)).select("seg", "ord", "side", "kind")


TAUS = [-HOUR, HOUR, 3 * HOUR]


@query(
    "event_path",
    f"""WITH e AS (SELECT o.*, z.first_us, z.last_us, t.tau FROM orders_p o JOIN (SELECT seg, min(ts_us) AS first_us, max(ts_us) AS last_us FROM ev GROUP BY 1) z USING (seg),
                   (VALUES ({-HOUR}), ({HOUR}), ({3 * HOUR})) t(tau))
        SELECT e.oid, e.tau::BIGINT AS tau, CASE WHEN e.place_us + tau BETWEEN first_us AND last_us THEN CASE WHEN side = 'bid' THEN 1 ELSE -1 END * (b.mid_x2 - a.mid_x2) END AS move
        FROM e ASOF LEFT JOIN mid_path a ON a.seg = e.seg AND e.place_us >= a.ts_us ASOF LEFT JOIN mid_path b ON b.seg = e.seg AND e.place_us + e.tau >= b.ts_us""",
)
def event_path(v):
    spans = v.ev.groupBy("seg").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    d = lb.event_paths(v.orders_p.join(spans, "seg"), v.mid_path, ["seg"], "place_us", "first_us", "last_us", TAUS, "ts_us", "mid_x2", v.time)
    return d.select("oid", "tau", "move")


@query(
    "bar_target",
    "SELECT market, day, ln(lead(close, 6) OVER w / lead(open, 1) OVER w) AS target FROM bars WINDOW w AS (PARTITION BY market ORDER BY day)",
    dbl="target",
)
def bar_target(v):
    days = v.blocks(v.bars, "day", "orders", tag="day")
    d = shifted(v.bars, ["market"], "day", {"_in": (F.col("open"), -1), "_out": (F.col("close"), -6)}, days)
    return d.select("market", "day", F.log(F.col("_out") / F.col("_in")).alias("target"))

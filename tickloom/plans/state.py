"""Queries for segments, grids, books and episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.book import l1_ofi
from tickloom.operators import state as s
from tickloom.operators.ordered import asof, running, shifted
from tickloom.plans.registry import query
from tickloom.plans.views import HOUR


def ends(v):
    return v.levels.groupBy("seg").agg(F.max("ts_us").alias("end_us"))


def books_on_grid(v, levels, n):
    spans = levels.groupBy("seg").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
    instants = s.aligned_grid(spans, "start_us", "end_us", HOUR, "g_us").select("seg", "g_us")
    return s.books_at(levels, instants, ["seg"], "ts_us", "ord", "g_us", n, v.time)


def state_on_grid(v):
    return s.book_on_grid(s.level_intervals(v.levels, ["seg"], "ts_us", v.time), ends(v), ["seg"], HOUR)


def book(v):
    return v.settled(s.book_after_updates(v.levels, ["seg"], "ts_us", "ord", v.time), "book", v.time)


def flow_rows(v):
    touch = s.touch_path(book(v), ["seg"], "ts_us")
    return s.episode_flow(s.episode_rows(touch, ["seg"], "ts_us", v.time), ["seg"], "ts_us", v.time)


def hits(v, rows):
    """Prints placed near the touch of ``levels`` so that all three kinds of hit occur."""
    near = F.when(F.col("is_buy"), 1001 + F.col("ord") % 3).otherwise(1000 - F.col("ord") % 3)
    return s.episode_prints(v.prints.withColumn("px", near), rows, ["seg"], "ts_us", v.time)


SESSIONS = """
    WITH c AS (SELECT *, last_value(CASE WHEN stream = 'depth' THEN is_open END IGNORE NULLS) OVER w AS d,
                      last_value(CASE WHEN stream = 'trade' THEN is_open END IGNORE NULLS) OVER w AS t
               FROM conn WINDOW w AS (PARTITION BY seg ORDER BY ts_us)),
    u AS (SELECT *, coalesce(d AND t, false) AS up, lead(ts_us) OVER w AS nts, lead(stream) OVER w AS nstream,
                 lag(coalesce(d AND t, false)) OVER w AS pup FROM c WINDOW w AS (PARTITION BY seg ORDER BY ts_us)),
    r AS (SELECT *, sum(CASE WHEN up IS DISTINCT FROM pup THEN 1 ELSE 0 END) OVER (PARTITION BY seg ORDER BY ts_us) AS run FROM u)
    SELECT seg, min(ts_us) AS start_us, max(coalesce(nts, ts_us)) AS end_us,
           arg_max(CASE WHEN nts IS NULL THEN 'end_of_data' ELSE nstream || '_down' END, ts_us) AS close_reason, count(*) AS n
    FROM r WHERE up GROUP BY seg, run"""


def sessions(v):
    return s.both_up_segments(v.conn, ["seg"], "ts_us", "stream", "is_open", ["depth", "trade"], v.time)


@query("segment_sessions", SESSIONS)
def segment_sessions(v):
    return sessions(v)


@query(
    "segment_qc",
    f"""SELECT g.seg, g.start_us, g.end_us - g.start_us AS duration_us, g.close_reason, count(p.ord) AS events,
               count(*) FILTER (WHERE p.is_buy) AS buys, count(*) FILTER (WHERE NOT p.is_buy) AS sells,
               min(p.ord) AS first_id, max(p.ord) AS last_id
        FROM ({SESSIONS}) g LEFT JOIN prints p ON p.seg = g.seg AND p.ts_us >= g.start_us AND p.ts_us < g.end_us
        GROUP BY 1, 2, 3, 4""",
)
def segment_qc(v):
    g = sessions(v)
    cols = {"start_us": "start_us", "end_us": "end_us"}
    p = asof(v.prints, g, ["seg"], "ts_us", "start_us", cols, v.time).where("ts_us < end_us")
    qc = p.groupBy("seg", "start_us").agg(
        F.count("*").alias("events"), F.count_if("is_buy").alias("buys"), F.count_if(~F.col("is_buy")).alias("sells"),
        F.min("ord").alias("first_id"), F.max("ord").alias("last_id"),
    )
    out = g.join(qc, ["seg", "start_us"], "left").na.fill(0, ["events", "buys", "sells"])
    return out.select(
        "seg", "start_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "close_reason",
        "events", "buys", "sells", "first_id", "last_id",
    )


@query(
    "valid_run_id",
    """SELECT seg, sid, g_us, CASE WHEN ok THEN (sum(CASE WHEN ok AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER w)::BIGINT END AS run_id
       FROM (SELECT *, mid_x2 % 4 <> 0 AS ok, lag(mid_x2 % 4 <> 0) OVER (PARTITION BY seg, sid ORDER BY g_us) AS p FROM grid)
       WINDOW w AS (PARTITION BY seg, sid ORDER BY g_us)""",
)
def valid_run_id(v):
    d = s.valid_run_ids(v.grid, ["seg", "sid"], "g_us", F.col("mid_x2") % 4 != 0, "run_id", v.time)
    return d.select("seg", "sid", "g_us", "run_id")


@query(
    "aligned_grid",
    f"""SELECT seg, sid, unnest(range(CAST(ceil(start_us / {HOUR}) AS BIGINT) * {HOUR}, end_us + 1, {HOUR})) AS g_us FROM segs""",
)
def aligned_grid(v):
    return s.aligned_grid(v.segs, "start_us", "end_us", HOUR, "g_us").select("seg", "sid", "g_us")


IV = """SELECT seg, side, px, qty, ts_us AS f, lead(ts_us) OVER (PARTITION BY seg, side, px ORDER BY ts_us) AS t FROM {lv}"""


def live(lv="levels"):
    return f"""SELECT i.seg, i.g_us, x.side, x.px, x.qty FROM instants i JOIN ({IV.format(lv=lv)}) x
               ON x.seg = i.seg AND x.qty > 0 AND x.f <= i.g_us AND (x.t IS NULL OR i.g_us < x.t)"""


@query("book_state_at", live())
def book_state_at(v):
    return state_on_grid(v)


@query(
    "top_n_levels",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY seg, g_us, side ORDER BY CASE WHEN side = 'bid' THEN -px ELSE px END) AS rk FROM ({live()})),
        j AS (SELECT * FROM r WHERE rk <= 5)
        SELECT seg, g_us, coalesce(string_agg(px::VARCHAR, ',' ORDER BY rk) FILTER (WHERE side = 'bid'), '') AS bid_px,
               coalesce(string_agg(qty::VARCHAR, ',' ORDER BY rk) FILTER (WHERE side = 'bid'), '') AS bid_qty,
               coalesce(string_agg(px::VARCHAR, ',' ORDER BY rk) FILTER (WHERE side = 'ask'), '') AS ask_px,
               coalesce(string_agg(qty::VARCHAR, ',' ORDER BY rk) FILTER (WHERE side = 'ask'), '') AS ask_qty
        FROM j GROUP BY 1, 2""",
)
def top_n_levels(v):
    t = books_on_grid(v, v.levels, 5)
    return t.select("seg", "g_us", *[F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) for c in ("bid_px", "bid_qty", "ask_px", "ask_qty")])


def bbo_sql(lv):
    return f"""SELECT seg, g_us, max(px) FILTER (WHERE side = 'bid') AS best_bid, arg_max(qty, px) FILTER (WHERE side = 'bid') AS bid_qty,
                      min(px) FILTER (WHERE side = 'ask') AS best_ask, arg_min(qty, px) FILTER (WHERE side = 'ask') AS ask_qty
               FROM ({live(lv)}) GROUP BY 1, 2"""


@query(
    "bbo_mid_spread",
    f"SELECT *, best_ask - best_bid AS spread_ticks, best_ask + best_bid AS mid_x2 FROM ({bbo_sql('levels')})",
)
def bbo_mid_spread(v):
    return s.touch_of(books_on_grid(v, v.levels, 1)).drop("validity")


@query(
    "book_validity",
    f"""SELECT seg, CASE WHEN best_bid IS NULL THEN 'empty_bid' WHEN best_ask IS NULL THEN 'empty_ask'
                         WHEN best_bid >= best_ask THEN 'crossed' ELSE 'valid' END AS validity, count(*) AS n
        FROM ({bbo_sql('levels_x')}) GROUP BY 1, 2""",
)
def book_validity(v):
    return s.touch_of(books_on_grid(v, v.levels_x, 1)).groupBy("seg", "validity").agg(F.count("*").alias("n"))


@query("mid_change_path", "SELECT * FROM mid_path")
def mid_change_path(v):
    return v.mid_path


@query(
    "trade_buckets",
    f"""SELECT i.seg, i.g_us, coalesce(sum(qty) FILTER (WHERE is_buy), 0)::BIGINT AS buy_qty,
               coalesce(sum(qty) FILTER (WHERE NOT is_buy), 0)::BIGINT AS sell_qty,
               coalesce(sum(qty * px) FILTER (WHERE is_buy), 0)::BIGINT AS buy_notional,
               coalesce(sum(qty * px) FILTER (WHERE NOT is_buy), 0)::BIGINT AS sell_notional,
               count(*) FILTER (WHERE is_buy) AS buy_count, count(*) FILTER (WHERE NOT is_buy) AS sell_count, max(ts_us) AS last_trade_us
        FROM instants i LEFT JOIN prints p ON p.seg = i.seg AND p.ts_us > i.g_us - {HOUR} AND p.ts_us <= i.g_us GROUP BY 1, 2""",
)
def trade_buckets(v):
    return s.trade_buckets(v.prints, v.grid, ["seg"], "ts_us", "g_us", HOUR)


PREV = {"pb": "best_bid", "pbq": "bid_qty", "pa": "best_ask", "paq": "ask_qty"}


def ofi_frame(v):
    b = shifted(book(v), ["seg"], "ts_us", {k: (F.col(c), 1) for k, c in PREV.items()}, v.time, ["ord"])
    prev = {"bid": F.col("pb"), "bid_qty": F.col("pbq"), "ask": F.col("pa"), "ask_qty": F.col("paq")}
    cur = {"bid": F.col("best_bid"), "bid_qty": F.col("bid_qty"), "ask": F.col("best_ask"), "ask_qty": F.col("ask_qty")}
    known = F.col("pb").isNotNull() & F.col("pa").isNotNull() & F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull()
    return b.withColumn("ofi", F.when(known, l1_ofi(prev, cur)))


OFI = """
    SELECT *, CASE WHEN pb IS NOT NULL AND pa IS NOT NULL AND best_bid IS NOT NULL AND best_ask IS NOT NULL THEN
           (CASE WHEN best_bid >= pb THEN bid_qty ELSE 0 END) - (CASE WHEN best_bid <= pb THEN pbq ELSE 0 END)
           - (CASE WHEN best_ask <= pa THEN ask_qty ELSE 0 END) + (CASE WHEN best_ask >= pa THEN paq ELSE 0 END) END AS ofi
    FROM (SELECT *, lag(best_bid) OVER w AS pb, lag(bid_qty) OVER w AS pbq, lag(best_ask) OVER w AS pa, lag(ask_qty) OVER w AS paq
          FROM swept WINDOW w AS (PARTITION BY seg ORDER BY ts_us))"""


@query(
    "book_event_buckets",
    f"""SELECT seg, CAST(ceil(ts_us / {HOUR}) AS BIGINT) * {HOUR} AS g_us, count(DISTINCT ts_us) AS messages, count(*) AS level_updates,
               sum(CASE WHEN ord % 100 = 0 THEN 0 ELSE coalesce(ofi, 0) END)::BIGINT AS ofi FROM ({OFI}) GROUP BY 1, 2""",
)
def book_event_buckets(v):
    snapshot = F.col("ord") % 100 == 0
    ofi = F.when(snapshot, F.lit(0)).otherwise(F.coalesce("ofi", F.lit(0)))
    g = (F.ceil(F.col("ts_us") / F.lit(HOUR)) * F.lit(HOUR)).cast("bigint")
    msgs = ofi_frame(v).groupBy("seg", "ts_us").agg(F.count("*").alias("n"), F.sum(ofi).alias("ofi"))
    return msgs.groupBy("seg", g.alias("g_us")).agg(
        F.count("*").alias("messages"), F.sum("n").alias("level_updates"), F.sum("ofi").alias("ofi")
    )


@query(
    "reconnect_gaps",
    """SELECT seg, count(gap) AS reconnects, coalesce(sum(gap), 0)::BIGINT AS gap_us, max(gap) AS max_gap_us,
              100.0 * (max(ts_us) - min(ts_us) - coalesce(sum(gap), 0)) / (max(ts_us) - min(ts_us)) AS valid_pct
       FROM (SELECT seg, ts_us, CASE WHEN ord % 100 = 0 THEN ts_us - lag(ts_us) OVER (PARTITION BY seg ORDER BY ts_us) END AS gap FROM levels)
       GROUP BY 1""",
    dbl="valid_pct",
)
def reconnect_gaps(v):
    d = v.levels.withColumn("snap", F.col("ord") % 100 == 0)
    return s.reconnect_gaps(d, ["seg"], "ts_us", "snap", v.time)


@query(
    "level_episodes",
    """SELECT seg, side, episode, px, min(ts_us) AS start_us, max(coalesce(next_ts, ts_us)) AS end_us,
              arg_min(qty, ts_us) AS initial_qty, arg_max(qty, ts_us) AS final_qty, max(qty) AS max_qty, min(qty) AS min_qty,
              sum(added)::BIGINT AS cum_add, sum(removed)::BIGINT AS cum_remove, sum(replenished)::BIGINT AS cum_replenish,
              count(*) FILTER (WHERE added > 0) AS add_events, count(*) FILTER (WHERE removed > 0) AS remove_events,
              count(*) FILTER (WHERE replenished > 0) AS replenish_events,
              arg_max(CASE WHEN next_ts IS NULL THEN 'segment_end' WHEN next_px IS NULL THEN 'book_side_empty'
                           WHEN (side = 'bid') = (next_px > px) THEN 'improved' ELSE 'stepped_away' END, ts_us) AS close_reason
       FROM touch_flow WHERE px IS NOT NULL GROUP BY 1, 2, 3, 4""",
)
def level_episodes(v):
    return s.level_episodes(flow_rows(v), ["seg"], "ts_us")


@query("episode_flow", "SELECT seg, side, ts_us, episode, px, qty, added, removed, replenished FROM touch_flow")
def episode_flow(v):
    return flow_rows(v).select("seg", "side", "ts_us", "episode", "px", "qty", "added", "removed", "replenished")


@query(
    "explained_removal",
    """WITH e AS (SELECT seg, side, episode, ts_us, removed, 0 AS printed, 1 AS k FROM touch_flow WHERE removed > 0
                  UNION ALL SELECT seg, side, episode, ts_us, 0, qty, 0 FROM touch_hits WHERE kind = 'at_quote'),
       c AS (SELECT *, sum(removed) OVER w - sum(printed) OVER w AS short FROM e WINDOW w AS (PARTITION BY seg, side, episode ORDER BY ts_us, k)),
       u AS (SELECT *, greatest(coalesce(max(CASE WHEN removed > 0 THEN short END) OVER w, 0), 0) AS u FROM c WINDOW w AS (PARTITION BY seg, side, episode ORDER BY ts_us, k)),
       d AS (SELECT *, u - coalesce(lag(u) OVER (PARTITION BY seg, side, episode ORDER BY ts_us, k), 0) AS un FROM u)
       SELECT seg, side, episode, ts_us, removed, (removed - un)::BIGINT AS explained, un::BIGINT AS unexplained FROM d WHERE removed > 0""",
)
def explained_removal(v):
    rows = flow_rows(v)
    return s.explained_removals(rows, hits(v, rows), ["seg"], "ts_us", v.time)


@query(
    "episode_grid_state",
    """WITH c AS (SELECT seg, side, ts_us, episode, px, qty, min(ts_us) OVER w AS start_us, sum(added) OVER w AS ca, sum(removed) OVER w AS cr,
                         max(CASE WHEN added > 0 THEN ts_us END) OVER w AS la, max(CASE WHEN removed > 0 THEN ts_us END) OVER w AS lr
                  FROM touch_flow WINDOW w AS (PARTITION BY seg, side, episode ORDER BY ts_us)),
       h AS (SELECT seg, side, episode, ts_us, sum(qty) OVER w AS vol, ts_us AS last_print FROM touch_hits WHERE kind <> 'outside'
             WINDOW w AS (PARTITION BY seg, side, episode ORDER BY ts_us)),
       i AS (SELECT seg, g_us, unnest(['bid', 'ask']) AS side FROM instants),
       a AS (SELECT i.seg, i.side, i.g_us, c.* EXCLUDE (seg, side) FROM i ASOF JOIN c ON i.seg = c.seg AND i.side = c.side AND i.g_us >= c.ts_us)
       SELECT a.seg, a.side, a.g_us, a.episode, a.px, a.qty, a.g_us - a.start_us AS age_us, a.ca::BIGINT AS cum_add, a.cr::BIGINT AS cum_remove,
              a.g_us - a.la AS since_add_us, a.g_us - a.lr AS since_remove_us, coalesce(h.vol, 0)::BIGINT AS cum_printed, a.g_us - h.last_print AS since_print_us
       FROM a ASOF LEFT JOIN h ON a.seg = h.seg AND a.side = h.side AND a.episode = h.episode AND a.g_us >= h.ts_us WHERE a.px IS NOT NULL""",
)
def episode_grid_state(v):
    rows = flow_rows(v)
    keys = ["seg", "side", "episode"]
    stamp = F.col("ts_us")
    c = running(
        rows, keys, "ts_us",
        {
            "start_us": ("min", stamp), "cum_add": ("sum", F.col("added")), "cum_remove": ("sum", F.col("removed")),
            "_la": ("max", F.when(F.col("added") > 0, stamp)), "_lr": ("max", F.when(F.col("removed") > 0, stamp)),
        },
        v.time,
    )
    h = running(
        hits(v, rows).where("kind <> 'outside'"), keys, "ts_us", {"cum_printed": ("sum", F.col("qty"))}, v.time
    )
    i = v.grid.select("seg", "g_us", F.explode(F.array(F.lit("bid"), F.lit("ask"))).alias("side"))
    cols = ["episode", "px", "qty", "start_us", "cum_add", "cum_remove", "_la", "_lr"]
    a = asof(i, c, ["seg", "side"], "g_us", "ts_us", {k: k for k in cols}, v.time).where("px IS NOT NULL")
    a = asof(a, h, keys, "g_us", "ts_us", {"cum_printed": "cum_printed", "ts_us": "_lp"}, v.time)
    g = F.col("g_us")
    return a.select(
        "seg", "side", "g_us", "episode", "px", "qty", (g - F.col("start_us")).alias("age_us"), "cum_add", "cum_remove",
        (g - F.col("_la")).alias("since_add_us"), (g - F.col("_lr")).alias("since_remove_us"),
        F.coalesce("cum_printed", F.lit(0)).alias("cum_printed"), (g - F.col("_lp")).alias("since_print_us"),
    )

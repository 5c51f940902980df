"""DuckDB text of the fixture views that queries share; written independently of views.py."""

HOUR = 3_600_000_000
SPAN = 5 * 24 * HOUR

VIEWS: dict[str, str] = {
    "ev": """
        SELECT event_id AS ord, user_id % 10 AS seg, epoch_us(ts) AS ts_us, event_type, value,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id
        FROM events""",
    "prints": """
        SELECT seg, ts_us, ord, event_type IN ('purchase', 'click') AS is_buy,
               CAST(floor(value) AS BIGINT) AS px, k + 1 AS qty
        FROM ev""",
    "updates": """
        WITH n AS (
          SELECT seg, ts_us, ord, row_number() OVER (PARTITION BY seg ORDER BY ts_us) AS rn FROM ev),
        kept AS (
          SELECT seg, ts_us, ord, rn * 3 AS first_u, rn * 3 + 2 AS last_u, rn * 3 - 1 AS prev_u
          FROM n WHERE ord % 97 <> 0)
        SELECT seg, ts_us, ord, first_u, last_u, prev_u, CAST(0 AS BIGINT) AS dup FROM kept
        UNION ALL
        SELECT seg, ts_us + 3600000000, ord, first_u, last_u, prev_u, CAST(1 AS BIGINT)
        FROM kept WHERE ord % 53 = 0""",
    "levels": """
        SELECT seg, ts_us, ord,
               CASE WHEN event_type IN ('view', 'signup') THEN 'bid' ELSE 'ask' END AS side,
               CASE WHEN event_type IN ('view', 'signup') THEN 1000 - k % 20 ELSE 1001 + k % 20 END AS px,
               CASE WHEN CAST(floor(value) AS BIGINT) % 7 = 0 THEN 0
                    ELSE CAST(floor(value) AS BIGINT) END AS qty
        FROM ev""",
    "levels_x": """
        SELECT seg, ts_us, ord,
               CASE WHEN event_type IN ('view', 'signup') THEN 'bid' ELSE 'ask' END AS side,
               1000 + (k % 41 - 20) AS px,
               CASE WHEN CAST(floor(value) AS BIGINT) % 7 = 0 THEN 0
                    ELSE CAST(floor(value) AS BIGINT) END AS qty
        FROM ev""",
    "mids": "SELECT seg, ts_us, CAST(round(value * 2) AS BIGINT) AS mid_x2 FROM ev",
    "instants": f"""
        SELECT seg, unnest(range(CAST(ceil(min(ts_us) / {HOUR}) AS BIGINT) * {HOUR},
                                 max(ts_us) + 1, {HOUR})) AS g_us
        FROM mids GROUP BY seg""",
    "grid": f"""
        SELECT i.seg, i.g_us, i.g_us // {SPAN} AS sid, m.mid_x2
        FROM instants i ASOF JOIN mids m ON i.seg = m.seg AND i.g_us >= m.ts_us""",
    "conn": """
        SELECT seg, ts_us, CASE WHEN k < 50 THEN 'depth' ELSE 'trade' END AS stream,
               CAST(floor(value) AS BIGINT) % 9 <> 0 AS is_open
        FROM ev""",
    "segs": f"""
        SELECT seg, ts_us // {SPAN} AS sid, min(ts_us) AS start_us, max(ts_us) AS end_us
        FROM prints GROUP BY 1, 2""",
    "book10": f"""
        SELECT seg, g_us, sid, mid_x2,
               list_transform(range(1, 11), lambda i: 1000 - i) AS bid_px,
               list_transform(range(1, 11), lambda i: 1000 + i) AS ask_px,
               list_transform(range(1, 11), lambda i: 1 + (seg * 31 + g_us // {HOUR} * 7 + i * 13) % 50) AS bid_qty,
               list_transform(range(1, 11), lambda i: 1 + (seg * 17 + g_us // {HOUR} * 11 + i * 29) % 50) AS ask_qty
        FROM grid""",
    "orders_p": """
        SELECT ord AS oid, seg, ts_us AS place_us, ts_us + 21600000000 AS end_us,
               CASE WHEN ord % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
               CAST(floor(value) AS BIGINT) AS px, k AS ahead, CAST(5 AS BIGINT) AS qty
        FROM ev WHERE event_type = 'signup'""",
    "scores": f"""
        SELECT g.seg, g.g_us, g.sid, s.side,
               ((g.g_us // {HOUR} * 7 + g.seg * 13 + s.n * 29) % 100) / 100.0::DOUBLE AS p
        FROM grid g, (VALUES ('bid', 0), ('ask', 1)) s(side, n)""",
    "mid_path": """
        SELECT seg, ts_us, mid_x2 FROM (
          SELECT *, lag(mid_x2) OVER (PARTITION BY seg ORDER BY ts_us) AS prev FROM mids)
        WHERE mid_x2 IS DISTINCT FROM prev""",
    "episodes": """
        SELECT seg, start_us, end_us, mid_x2, start_us AS eid,
               CASE WHEN nxt > mid_x2 THEN 'improved' WHEN nxt < mid_x2 THEN 'stepped_away'
                    ELSE 'segment_end' END AS close_reason
        FROM (SELECT seg, ts_us AS start_us, mid_x2,
                     lead(ts_us) OVER w AS end_us, lead(mid_x2) OVER w AS nxt
              FROM mid_path WINDOW w AS (PARTITION BY seg ORDER BY ts_us))""",
    "opps": """
        SELECT e.ord, e.seg, e.ts_us, s.side, s.sgn * CAST(round(e.value * 100) AS BIGINT) AS signed
        FROM ev e, (VALUES ('bid', 1), ('ask', -1)) s(side, sgn)""",
    "bars": """
        SELECT o_orderkey % 2 AS market, epoch_us(o_orderdate) // 86400000000 AS day,
               arg_min(o_totalprice, o_orderkey) AS open, arg_max(o_totalprice, o_orderkey) AS close,
               count(*) AS volume
        FROM orders GROUP BY 1, 2""",
    "funding": """
        SELECT epoch_us(l_shipdate) // 86400000000 AS day,
               CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) - 5 * count(*) AS rate
        FROM lineitem GROUP BY 1""",
    "lifecycle": """
        SELECT ord, user_id AS uid, ts_us, value, k,
               CASE event_type WHEN 'signup' THEN 'placed' WHEN 'view' THEN 'updated'
                    WHEN 'error' THEN 'cancelled' WHEN 'purchase' THEN 'filled'
                    ELSE 'execution' END AS kind
        FROM ev""",
    "wide": """
        SELECT l_orderkey AS id, l_orderkey % 8 AS grp, l_orderkey % 30 AS blk,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS x1,
               CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS x2,
               CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS x3,
               count(*) AS n_lines,
               CASE WHEN l_orderkey % 11 = 0 THEN NULL
                    ELSE CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) % 2001 - 1000
               END AS y
        FROM lineitem GROUP BY l_orderkey""",
    "marks": f"""
        SELECT seg, sid, g_us, mid_x2,
               mid_x2 - lag(mid_x2, 3) OVER w AS sig,
               lead(mid_x2, 1) OVER w - mid_x2 AS m1, lead(mid_x2, 6) OVER w - mid_x2 AS m6,
               lead(mid_x2, 24) OVER w - mid_x2 AS m24
        FROM grid WINDOW w AS (PARTITION BY seg, sid ORDER BY g_us)""",
    "level_spans": """
        SELECT seg, side, px, qty, ts_us AS f, lead(ts_us) OVER (PARTITION BY seg, side, px ORDER BY ts_us) AS t FROM levels""",
    "swept": """
        SELECT e.seg, e.ts_us, e.ord, e.side, e.px, e.qty,
               max(x.px) FILTER (WHERE x.side = 'bid') AS best_bid,
               coalesce(arg_max(x.qty, x.px) FILTER (WHERE x.side = 'bid'), 0) AS bid_qty,
               min(x.px) FILTER (WHERE x.side = 'ask') AS best_ask,
               coalesce(arg_min(x.qty, x.px) FILTER (WHERE x.side = 'ask'), 0) AS ask_qty
        FROM levels e LEFT JOIN level_spans x ON x.seg = e.seg AND x.qty > 0 AND x.f <= e.ts_us AND (x.t IS NULL OR e.ts_us < x.t)
        GROUP BY ALL""",
    "touch": """
        SELECT seg, ts_us, 'bid' AS side, best_bid AS px, bid_qty AS qty FROM swept
        UNION ALL SELECT seg, ts_us, 'ask', best_ask, ask_qty FROM swept""",
    "touch_flow": """
        WITH a AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR px IS DISTINCT FROM lag(px) OVER w THEN 1 ELSE 0 END AS st
                   FROM touch WINDOW w AS (PARTITION BY seg, side ORDER BY ts_us)),
        b AS (SELECT *, (sum(st) OVER (PARTITION BY seg, side ORDER BY ts_us))::BIGINT AS episode FROM a),
        c AS (SELECT *, CASE WHEN st = 1 THEN 0 ELSE qty - lag(qty) OVER w END AS delta, lead(ts_us) OVER w AS next_ts, lead(px) OVER w AS next_px
              FROM b WINDOW w AS (PARTITION BY seg, side ORDER BY ts_us))
        SELECT *, greatest(delta, 0) AS added, greatest(-delta, 0) AS removed,
               CASE WHEN coalesce(sum(CASE WHEN delta < 0 THEN 1 ELSE 0 END) OVER
                    (PARTITION BY seg, side, episode ORDER BY ts_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0
                    THEN greatest(delta, 0) ELSE 0 END AS replenished FROM c""",
    "touch_hits": """
        SELECT p.seg, p.ts_us, p.ord, p.qty, p.side, t.episode,
               CASE WHEN p.px = t.px THEN 'at_quote'
                    WHEN (p.side = 'bid' AND p.px < t.px) OR (p.side = 'ask' AND p.px > t.px) THEN 'through' ELSE 'outside' END AS kind
        FROM (SELECT seg, ts_us, ord, qty, CASE WHEN is_buy THEN 'ask' ELSE 'bid' END AS side,
                     CASE WHEN is_buy THEN 1001 + ord % 3 ELSE 1000 - ord % 3 END AS px FROM prints) p
        ASOF JOIN touch_flow t ON p.seg = t.seg AND p.side = t.side AND p.ts_us >= t.ts_us WHERE t.px IS NOT NULL""",
    "fill_prints": "SELECT * REPLACE (px // 25 AS px), CASE WHEN is_buy THEN 'ask' ELSE 'bid' END AS side FROM prints",
    "fills": f"""
        WITH o AS (SELECT * REPLACE (px // 25 AS px, (ahead % 40) * alpha // 100 AS ahead) FROM orders_p, (SELECT unnest([0, 25, 50, 75, 100])::BIGINT AS alpha)),
        w AS (SELECT o.*, p.ts_us AS pts, p.ord AS pord, p.px AS ppx,
                     sum(CASE WHEN p.px = o.px THEN p.qty ELSE 0 END) OVER (PARTITION BY o.oid, o.alpha ORDER BY p.ts_us, p.ord) AS cum
              FROM o LEFT JOIN fill_prints p ON p.seg = o.seg AND p.side = o.side AND p.ts_us > o.place_us AND p.ts_us < o.end_us),
        a AS (SELECT * EXCLUDE (pts, pord, ppx, cum), min(pts) FILTER (WHERE ppx = px AND cum >= ahead + qty) AS f2,
                     min(pts) FILTER (WHERE CASE WHEN side = 'bid' THEN ppx < px ELSE ppx > px END) AS th FROM w GROUP BY ALL),
        b AS (SELECT *, least(th, f2) AS fill_us, px * 25 AS price, CASE WHEN th IS NOT NULL AND (f2 IS NULL OR th < f2) THEN 'through' WHEN f2 IS NOT NULL THEN 'at_quote' END AS mechanism FROM a),
        z AS (SELECT seg, max(ts_us) AS last_us FROM ev GROUP BY 1), c AS (SELECT b.*, z.last_us FROM b JOIN z USING (seg))
        SELECT c.* EXCLUDE (f2, th), c.fill_us IS NOT NULL AS filled, c.place_us // {SPAN} AS sid,
               CASE WHEN c.fill_us + {HOUR} <= last_us THEN CASE WHEN side = 'bid' THEN 1 ELSE -1 END * (p1.mid_x2 - 2 * price) END AS m1,
               CASE WHEN c.fill_us + {6 * HOUR} <= last_us THEN CASE WHEN side = 'bid' THEN 1 ELSE -1 END * (p6.mid_x2 - 2 * price) END AS m6
        FROM c ASOF LEFT JOIN mid_path p1 ON p1.seg = c.seg AND c.fill_us + {HOUR} >= p1.ts_us ASOF LEFT JOIN mid_path p6 ON p6.seg = c.seg AND c.fill_us + {6 * HOUR} >= p6.ts_us""",
    "study_rows": f"""
        SELECT m.*, row_number() OVER (PARTITION BY seg, sid ORDER BY g_us) AS pos FROM marks m""",
    "study": f"""
        WITH l AS (SELECT h.h AS horizon, seg, sid, g_us // {24 * HOUR} AS day, g_us, (g_us // {HOUR}) * 10 + seg AS uid, sig, m1, mid_x2, (pos - 1) % h.h = 0 AS anchor,
                          CASE h.h WHEN 1 THEN m1 WHEN 6 THEN m6 ELSE m24 END AS y FROM study_rows, (SELECT unnest([1, 6, 24])::BIGINT AS h) h)
        SELECT *, floor((row_number() OVER (PARTITION BY horizon ORDER BY sig, uid) - 1) * 10 / count(*) OVER (PARTITION BY horizon))::BIGINT AS decile,
               y - avg(y) OVER (PARTITION BY horizon, day) AS y_d, (y - m1) - avg(y - m1) OVER (PARTITION BY horizon, day) AS inc_d
        FROM l WHERE sig IS NOT NULL AND y IS NOT NULL""",
}

"""Queries for scalar, array and per-row features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import book as b
from tickloom.operators.features import event_contributions, rank_flow, side_rows
from tickloom.operators.ordered import shifted
from tickloom.operators.stats import add_standard_scores
from tickloom.plans.registry import query
from tickloom.plans.state import book, ofi_frame
from tickloom.plans.views import HOUR

KEY = ["seg", "g_us"]


def ladders():
    """Bid sizes, ask sizes, bid prices and ask prices of ``book10``, best level first."""
    return tuple(F.col(c) for c in ("bid_qty", "ask_qty", "bid_px", "ask_px"))


def S(q, n):
    return f"list_sum({q}[1:{n}])"


@query(
    "obi_depth",
    "SELECT seg, g_us, " + ", ".join(f"({S('bid_qty', n)} - {S('ask_qty', n)}) / ({S('bid_qty', n)} + {S('ask_qty', n)}) AS obi_l{n}" for n in (1, 5, 10)) + " FROM book10",
    dbl="obi_l1 obi_l5 obi_l10",
)
def obi_depth(v):
    BQ, AQ, _, _ = ladders()
    return v.book10.select(*KEY, *[b.obi(BQ, AQ, n).alias(f"obi_l{n}") for n in (1, 5, 10)])


def WS(q, n):
    return f"list_sum(list_transform({q}[1:{n}], lambda x, i: x * exp(-0.5 * (i - 1))))"


@query(
    "weighted_obi",
    "SELECT seg, g_us, " + ", ".join(f"({WS('bid_qty', n)} - {WS('ask_qty', n)}) / ({WS('bid_qty', n)} + {WS('ask_qty', n)}) AS wobi_l{n}" for n in (1, 5, 10)) + " FROM book10",
    dbl="wobi_l1 wobi_l5 wobi_l10",
)
def weighted_obi(v):
    BQ, AQ, _, _ = ladders()
    return v.book10.select(*KEY, *[b.weighted_obi(BQ, AQ, n).alias(f"wobi_l{n}") for n in (1, 5, 10)])


@query(
    "microprice",
    """SELECT seg, g_us, m AS micro, m - (bid_px[1] + ask_px[1]) / 2.0 AS micro_minus_mid
       FROM (SELECT *, (ask_qty[1] * bid_px[1] + bid_qty[1] * ask_px[1]) / (bid_qty[1] + ask_qty[1]) AS m FROM book10)""",
    dbl="micro micro_minus_mid",
)
def microprice(v):
    BQ, AQ, BP, AP = ladders()
    m = b.microprice(BP[0], BQ[0], AP[0], AQ[0])
    return v.book10.select(*KEY, m.alias("micro"), (m - (BP[0] + AP[0]) / 2).alias("micro_minus_mid"))


@query(
    "depth_totals",
    "SELECT seg, g_us, " + ", ".join(f"{S(q + '_qty', n)}::BIGINT AS {q}_l{n}" for q in ("bid", "ask") for n in (1, 5, 10))
    + f", {S('bid_qty', 10)} / {S('ask_qty', 10)} AS depth_ratio FROM book10",
    dbl="depth_ratio",
)
def depth_totals(v):
    BQ, AQ, _, _ = ladders()
    totals = [b.arr_sum(F.col(f"{q}_qty"), n).alias(f"{q}_l{n}") for q in ("bid", "ask") for n in (1, 5, 10)]
    return v.book10.select(*KEY, *totals, b.ratio(b.arr_sum(BQ, 10), b.arr_sum(AQ, 10)).alias("depth_ratio"))


@query(
    "concentration",
    "SELECT seg, g_us, " + ", ".join(f"{q}_qty[1] / {S(q + '_qty', n)} AS {q}_conc_l{n}" for q in ("bid", "ask") for n in (5, 10)) + " FROM book10",
    dbl="bid_conc_l5 bid_conc_l10 ask_conc_l5 ask_conc_l10",
)
def concentration(v):
    return v.book10.select(*KEY, *[
        b.ratio(F.col(f"{q}_qty")[0], b.arr_sum(F.col(f"{q}_qty"), n)).alias(f"{q}_conc_l{n}") for q in ("bid", "ask") for n in (5, 10)
    ])


def DISP(q):
    return f"list_sum(list_transform({q}_qty, lambda x, i: x * abs({q}_px[i] - {q}_px[1]))) / list_sum({q}_qty)"


@query(
    "dispersion",
    f"SELECT seg, g_us, {DISP('bid')} AS bid_disp, {DISP('ask')} AS ask_disp FROM book10",
    dbl="bid_disp ask_disp",
)
def dispersion(v):
    BQ, AQ, BP, AP = ladders()
    return v.book10.select(*KEY, b.dispersion(BP, BQ).alias("bid_disp"), b.dispersion(AP, AQ).alias("ask_disp"))


@query("l1_ofi", """SELECT seg, ord, ofi::BIGINT AS ofi FROM (
    SELECT *, CASE WHEN pb IS NOT NULL AND pa IS NOT NULL AND best_bid IS NOT NULL AND best_ask IS NOT NULL THEN
           (CASE WHEN best_bid >= pb THEN bid_qty ELSE 0 END) - (CASE WHEN best_bid <= pb THEN pbq ELSE 0 END)
           - (CASE WHEN best_ask <= pa THEN ask_qty ELSE 0 END) + (CASE WHEN best_ask >= pa THEN paq ELSE 0 END) END AS ofi
    FROM (SELECT *, lag(best_bid) OVER w AS pb, lag(bid_qty) OVER w AS pbq, lag(best_ask) OVER w AS pa, lag(ask_qty) OVER w AS paq
          FROM swept WINDOW w AS (PARTITION BY seg ORDER BY ts_us)))""")
def l1_ofi(v):
    return ofi_frame(v).select("seg", "ord", "ofi")


RANK = """
    SELECT e.seg, e.ts_us, e.ord, e.side, e.px, e.qty,
           count(x.px) FILTER (WHERE x.side = e.side AND ((e.side = 'bid' AND x.px > e.px) OR (e.side = 'ask' AND x.px < e.px))) AS rank,
           coalesce(max(x.qty) FILTER (WHERE x.side = e.side AND x.px = e.px), 0) AS old_qty
    FROM levels e LEFT JOIN level_spans x ON x.seg = e.seg AND x.qty > 0 AND x.f < e.ts_us AND (x.t IS NULL OR e.ts_us <= x.t)
    GROUP BY ALL"""


@query(
    "rank_depth_flow",
    f"""SELECT seg, CAST(ceil(ts_us / {HOUR}) AS BIGINT) * {HOUR} AS g_us, side, rank,
               sum(greatest(qty - old_qty, 0))::BIGINT AS added, sum(greatest(old_qty - qty, 0))::BIGINT AS removed
        FROM ({RANK}) WHERE rank < 10 GROUP BY 1, 2, 3, 4""",
)
def rank_depth_flow(v):
    return rank_flow(book(v), ["seg"], "ts_us", HOUR, 10)


@query(
    "flow_pressure",
    f"""WITH r AS (SELECT seg, CAST(ceil(ts_us / {HOUR}) AS BIGINT) * {HOUR} AS g_us, side, rank, sum(qty - old_qty) AS net, sum(abs(qty - old_qty)) AS gross
                   FROM ({RANK}) WHERE rank < 10 GROUP BY 1, 2, 3, 4)
        SELECT seg, g_us, side, """
    + ", ".join(f"sum(net * exp(-0.5 * rank)) FILTER (WHERE rank < {n}) / nullif(sum(gross * exp(-0.5 * rank)) FILTER (WHERE rank < {n}), 0) AS pressure_l{n}" for n in (5, 10))
    + " FROM r GROUP BY 1, 2, 3",
    dbl="pressure_l5 pressure_l10",
)
def flow_pressure(v):
    f = rank_flow(book(v), ["seg"], "ts_us", HOUR, 10)
    by_rank = F.map_from_entries(F.collect_list(F.struct("rank", F.struct("added", "removed"))))
    arrays = f.groupBy("seg", "g_us", "side").agg(by_rank.alias("m"))

    def series(c):
        return F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.coalesce(F.try_element_at("m", i.cast("bigint"))[c], F.lit(0)))

    arrays = arrays.withColumns({"adds": series("added"), "removes": series("removed")})
    return arrays.select("seg", "g_us", "side", *[b.pressure(F.col("adds"), F.col("removes"), n).alias(f"pressure_l{n}") for n in (5, 10)])


@query(
    "event_flow_contrib",
    f"""WITH r AS (SELECT r.*, s.best_bid, s.best_ask, s.bid_qty, s.ask_qty FROM ({RANK}) r JOIN swept s USING (ord)),
        l AS (SELECT *, lag(best_bid) OVER w AS pb, lag(best_ask) OVER w AS pa, lag(bid_qty) OVER w AS pbq, lag(ask_qty) OVER w AS paq,
                     CASE WHEN side = 'bid' THEN qty - old_qty ELSE old_qty - qty END AS sg, qty - old_qty AS df
              FROM r WINDOW w AS (PARTITION BY seg ORDER BY ts_us))
        SELECT seg, ts_us, sg AS ofi, CASE WHEN df > 0 THEN sg ELSE 0 END AS add_flow, CASE WHEN df < 0 THEN sg ELSE 0 END AS cancel_flow,
               CASE WHEN df > 0 AND px = CASE side WHEN 'bid' THEN pb ELSE pa END THEN sg ELSE 0 END AS replenish_flow,
               CASE WHEN df < 0 AND px = CASE side WHEN 'bid' THEN pb ELSE pa END THEN sg ELSE 0 END AS depletion_flow,
               CAST(1 AS BIGINT) AS depth_changes,
               CASE WHEN pb IS DISTINCT FROM best_bid OR pa IS DISTINCT FROM best_ask THEN 1 ELSE 0 END::BIGINT AS bbo_change,
               abs(best_bid + best_ask - pb - pa) / 2.0 AS abs_mid_move,
               (bid_qty - ask_qty) / nullif(bid_qty + ask_qty, 0) - (pbq - paq) / nullif(pbq + paq, 0) AS delta_obi
        FROM l""",
    dbl="abs_mid_move delta_obi",
)
def event_flow_contrib(v):
    return event_contributions(book(v), ["seg"], "ts_us", "ord", v.time)


@query("log_transforms", "SELECT event_id, ln(1 + value) AS l1, sign(50 - value) * ln(1 + abs(50 - value)) AS sl FROM events", dbl="l1 sl")
def log_transforms(v):
    return v.read("events").select("event_id", F.log1p("value").alias("l1"), b.signed_log(50 - F.col("value")).alias("sl"))


@query(
    "derived_pressure",
    f"""SELECT seg, g_us, bid_qty[5] - ask_qty[5] AS net_l5_level, ({S('bid_qty', 5)} - {S('ask_qty', 5)})::BIGINT AS net_l5_sum,
               ({S('bid_qty', 5)} - {S('ask_qty', 5)}) / ({S('bid_qty', 5)} + {S('ask_qty', 5)}) AS norm_l5,
               bid_qty[1] / {S('bid_qty', 10)} - ask_qty[1] / {S('ask_qty', 10)} AS conc_imbalance, {DISP('bid')} - {DISP('ask')} AS disp_imbalance FROM book10""",
    dbl="norm_l5 conc_imbalance disp_imbalance",
)
def derived_pressure(v):
    BQ, AQ, BP, AP = ladders()
    net = b.arr_sum(BQ, 5) - b.arr_sum(AQ, 5)
    return v.book10.select(
        *KEY, (BQ[4] - AQ[4]).alias("net_l5_level"), net.alias("net_l5_sum"), b.ratio(net, b.arr_sum(BQ, 5) + b.arr_sum(AQ, 5)).alias("norm_l5"),
        (b.ratio(BQ[0], b.arr_sum(BQ)) - b.ratio(AQ[0], b.arr_sum(AQ))).alias("conc_imbalance"),
        (b.dispersion(BP, BQ) - b.dispersion(AP, AQ)).alias("disp_imbalance"),
    )


@query(
    "side_view",
    """SELECT seg, g_us, 'bid' AS side, bid_px[1] AS own_px, bid_qty[1] AS own_qty, ask_px[1] AS opp_px, ask_qty[1] AS opp_qty, bid_qty[1] - ask_qty[1] AS lean FROM book10
       UNION ALL SELECT seg, g_us, 'ask', ask_px[1], ask_qty[1], bid_px[1], bid_qty[1], ask_qty[1] - bid_qty[1] FROM book10""",
)
def side_view(v):
    BQ, AQ, BP, AP = ladders()
    d = v.book10.select(*KEY, BP[0].alias("bid_px"), BQ[0].alias("bid_qty"), AP[0].alias("ask_px"), AQ[0].alias("ask_qty"), (BQ[0] - AQ[0]).alias("lean"))
    return side_rows(d, KEY, {"px": ("bid_px", "ask_px"), "qty": ("bid_qty", "ask_qty")}, ["lean"])


@query(
    "lifecycle_ratios",
    """SELECT seg, side, ts_us, qty / nullif(iq, 0) AS remaining, (mx - qty) / nullif(mx, 0) AS drawdown, cr / nullif(iq, 0) AS removal_ratio,
              rp / nullif(cr, 0) AS replenish_ratio, ln(1 + (ts_us - st) / 1000.0) AS log_age_ms
       FROM (SELECT seg, side, ts_us, qty, first_value(qty) OVER w AS iq, max(qty) OVER w AS mx, sum(removed) OVER w AS cr, sum(replenished) OVER w AS rp, min(ts_us) OVER w AS st
             FROM touch_flow WHERE px IS NOT NULL WINDOW w AS (PARTITION BY seg, side, episode ORDER BY ts_us))""",
    dbl="remaining drawdown removal_ratio replenish_ratio log_age_ms",
)
def lifecycle_ratios(v):
    from tickloom.operators.features import lifecycle_features
    from tickloom.plans.state import flow_rows

    return lifecycle_features(flow_rows(v), ["seg", "side", "episode"], "ts_us", v.time).select(
        "seg", "side", "ts_us", "remaining", "drawdown", "removal_ratio", "replenish_ratio", "log_age_ms"
    )


@query(
    "signal_composites",
    f"""WITH o AS (SELECT seg, sid, g_us, mid_x2, CASE WHEN (bid_qty[1] + g_us // {HOUR}) % 5 = 0 THEN NULL ELSE (bid_qty[1] - ask_qty[1]) / (bid_qty[1] + ask_qty[1]) END AS a,
                          ({S('bid_qty', 5)} - {S('ask_qty', 5)}) / ({S('bid_qty', 5)} + {S('ask_qty', 5)}) AS b FROM book10),
        z AS (SELECT *, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS za, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS zb,
                     abs(mid_x2 - lag(mid_x2, 50) OVER (PARTITION BY seg, sid ORDER BY g_us)) AS mv FROM o)
        SELECT seg, g_us, (coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0) AS depth_mean, (za + zb) / 2 AS consensus_z, mv AS abs_move FROM z""",
    dbl="depth_mean consensus_z",
)
def signal_composites(v):
    BQ, AQ, _, _ = ladders()
    a = F.when((BQ[0] + F.expr(f"g_us div {HOUR}")) % 5 != 0, b.obi(BQ, AQ, 1))
    d = v.book10.select("seg", "sid", "g_us", "mid_x2", a.alias("a"), b.obi(BQ, AQ, 5).alias("b"))
    d = add_standard_scores(d, {"a": "za", "b": "zb"}, blocks=v.blocks(d, "b", "events", 10))
    d = shifted(d, ["seg", "sid"], "g_us", {"old": (F.col("mid_x2"), 50)}, v.time)
    return d.select(
        *KEY, b.mean_present([F.col("a"), F.col("b")]).alias("depth_mean"), b.consensus([F.col("za"), F.col("zb")]).alias("consensus_z"),
        F.abs(F.col("mid_x2") - F.col("old")).alias("abs_move"),
    )


@query(
    "probability_centering",
    """SELECT seg, g_us, 2 * max(p) FILTER (WHERE side = 'bid') - 1 AS centred, max(p) FILTER (WHERE side = 'ask') - max(p) FILTER (WHERE side = 'bid') AS lean FROM scores GROUP BY 1, 2""",
    dbl="centred lean",
)
def probability_centering(v):
    p = v.scores.groupBy("seg", "g_us").pivot("side", ["bid", "ask"]).agg(F.max("p"))
    return p.select("seg", "g_us", (2 * F.col("bid") - 1).alias("centred"), (F.col("ask") - F.col("bid")).alias("lean"))


VOTES = ["value - 50", "k - 50", "ord % 7 - 3", "user_id % 5 - 2", "value - k", "k % 11 - 5"]


@query(
    "vote_score",
    "SELECT ord, (" + " + ".join(f"(({e}) > 0)::INT" for e in VOTES) + ") / 6.0 AS score, (" + " + ".join(f"(({e}) > 0)::INT" for e in VOTES) + ") >= 4 AS quote FROM ev",
    dbl="score",
)
def vote_score(v):
    s = b.vote_share([F.expr(e) for e in VOTES])
    return v.ev.select("ord", s.alias("score"), (F.round(s * 6) >= 4).alias("quote"))


@query(
    "session_bucket",
    """SELECT seg, CASE WHEN h < 8 THEN 'asia' WHEN h < 16 THEN 'europe' ELSE 'us' END AS session, count(*) AS n
       FROM (SELECT seg, ts_us // 3600000000 % 24 AS h FROM ev) GROUP BY 1, 2""",
)
def session_bucket(v):
    return v.ev.groupBy("seg", b.session_of(F.col("ts_us")).alias("session")).agg(F.count("*").alias("n"))


WALK = """
    SELECT seg, g_us, wanted, t.px, t.q, t.i, sum(t.q) OVER (PARTITION BY seg, g_us ORDER BY t.i) AS cum, total, p1, q1
    FROM (SELECT seg, g_us, ask_px, ask_qty, 20 + g_us // 3600000000 % 300 AS wanted, list_sum(ask_qty) AS total, ask_px[1] AS p1, ask_qty[1] AS q1,
                 unnest(list_transform(range(1, 11), lambda i: {'px': ask_px[i], 'q': ask_qty[i], 'i': i})) AS t FROM book10)"""


@query(
    "book_walk_vwap",
    f"""WITH w AS ({WALK}), x AS (SELECT *, greatest(least(q, wanted - (cum - q)), 0) AS take FROM w)
        SELECT seg, g_us, wanted, CASE WHEN total >= wanted THEN sum(take * px) / wanted END AS vwap,
               CASE WHEN total >= wanted THEN count(*) FILTER (WHERE take > 0) END AS levels, CASE WHEN total >= wanted THEN sum(take * px) / wanted - p1 END AS slippage,
               CASE WHEN total >= wanted THEN wanted / q1 END AS touch_part, CASE WHEN total >= wanted THEN wanted / total END AS visible_part
        FROM x GROUP BY seg, g_us, wanted, total, p1, q1""",
    dbl="vwap slippage touch_part visible_part",
)
def book_walk_vwap(v):
    _, AQ, _, AP = ladders()
    wanted = (20 + F.expr(f"g_us div {HOUR}") % 300).cast("bigint")
    d = v.book10.withColumn("wanted", wanted).withColumn("w", b.walk_book(AP, AQ, F.col("wanted"), True))
    return d.select(
        *KEY, "wanted", F.col("w.vwap").alias("vwap"), F.col("w.levels").alias("levels"), F.col("w.slippage_ticks").alias("slippage"),
        F.col("w.touch_participation").alias("touch_part"), F.col("w.visible_participation").alias("visible_part"),
    )


@query(
    "floor_to_step",
    "SELECT o_orderkey, floor(1000000 * 100 / round(o_totalprice * 100)::BIGINT / 0.001 + 1e-9) * 0.001 AS lots FROM orders WHERE o_totalprice > 0",
    dbl="lots",
)
def floor_to_step(v):
    d = v.read("orders").where("o_totalprice > 0")
    return d.select("o_orderkey", b.floor_to_step(F.lit("1000000"), F.round("o_totalprice", 2), "0.001").alias("lots"))


@query("ticks_to_bps", "SELECT seg, g_us, m6 * 10000.0 / nullif(mid_x2, 0) AS bps FROM marks", dbl="bps")
def ticks_to_bps(v):
    return v.marks.select(*KEY, b.ticks_to_bps(F.col("m6"), F.col("mid_x2")).alias("bps"))

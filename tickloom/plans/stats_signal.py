"""Queries for signal and model statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import signals as sg
from tickloom.operators import stats as st
from tickloom.operators import windows as w
from tickloom.operators.labels import event_paths
from tickloom.operators.ordered import row_numbers
from tickloom.plans.joins import ALPHAS, CANCEL, FIRSTX, cancelled, first_crossings, marked_fills
from tickloom.plans.labels import RACES, TAUS, raced
from tickloom.plans.registry import query
from tickloom.plans.stats_base import qcut, rank_sql
from tickloom.plans.views import DAY, HOUR


STUDY_ID = f"(g_us div {HOUR}) * 10 + seg"


def study(v):
    """Signal rows per horizon with rank decile, daily demeaned outcome and anchor flag."""
    d = row_numbers(v.marks, ["seg", "sid"], "g_us", "pos", v.time)
    hs = F.array(*[F.struct(F.lit(h).cast("bigint").alias("horizon"), F.col(f"m{h}").alias("y")) for h in (1, 6, 24)])
    d = d.select("seg", "sid", "g_us", "sig", "m1", "mid_x2", "pos", F.inline(hs)).where("sig IS NOT NULL AND y IS NOT NULL")
    d = d.withColumns(
        {
            "day": F.expr(f"g_us div {DAY}"), "uid": F.expr(STUDY_ID), "anchor": (F.col("pos") - 1) % F.col("horizon") == 0,
            "inc": F.col("y") - F.col("m1"),
        }
    )
    cut = v.blocks(v.marks.withColumn("uid", F.expr(STUDY_ID)), "sig", "events", 20, tie="uid")
    d = v.settled(w.rank_deciles(d, ["horizon"], "sig", "uid", "decile", 10, cut), "study", cut)
    return w.demean(d, ["horizon", "day"], {"y": "y_d", "inc": "inc_d"}, cut)


GAP = "avg({y}) FILTER (WHERE decile = 9) - avg({y}) FILTER (WHERE decile = 0)"


def gap(y):
    return GAP.format(y=y)


@query(
    "block_summary",
    f"""SELECT horizon, count(*) AS blocks, avg(s) AS mean, quantile_cont(s, 0.5) AS median, min(s) AS worst, max(s) AS best, avg((s > 0)::INT) AS share_positive
        FROM (SELECT horizon, day, {gap('y_d')} AS s FROM study GROUP BY 1, 2) WHERE s IS NOT NULL GROUP BY 1""",
    dbl="mean median worst best share_positive",
)
def block_summary(v):
    return sg.block_summary(sg.decile_gap(study(v), ["horizon", "day"], "y_d"), ["horizon"], "spread")


def bps(y):
    return f"{y} * 10000.0 / nullif(mid_x2, 0)"


def spread_sql(y):
    return f"""
    SELECT a.*, spread_bps / 2 AS edge_bps, b.blocks, b.block_sign_share, coalesce(sign(anchor_spread) = sign(spread), false) AS anchor_agrees FROM (
      SELECT horizon, count(*) AS rows, count(*) FILTER (WHERE anchor) AS anchors, avg({y}) FILTER (WHERE decile = 9) AS top_mean, avg({y}) FILTER (WHERE decile = 0) AS bottom_mean,
             {gap(bps(y))} AS spread_bps, avg({y}) FILTER (WHERE decile = 9 AND anchor) - avg({y}) FILTER (WHERE decile = 0 AND anchor) AS anchor_spread, {gap(y)} AS spread FROM study GROUP BY 1) a
    JOIN (SELECT x.horizon, count(*) AS blocks, avg((sign(x.s) = sign(t.s))::INT) AS block_sign_share FROM (SELECT horizon, day, {gap(y)} AS s FROM study GROUP BY 1, 2) x
          JOIN (SELECT horizon, {gap(y)} AS s FROM study GROUP BY 1) t USING (horizon) WHERE x.s IS NOT NULL GROUP BY 1) b USING (horizon)"""


SPREAD_D = "top_mean bottom_mean spread_bps anchor_spread spread edge_bps block_sign_share"


@query("decile_spread", spread_sql("y_d"), dbl=SPREAD_D)
def decile_spread(v):
    return sg.decile_spread(study(v), ["horizon"], "y_d", "mid_x2", "day", "anchor")


@query(
    "spread_reconciliation",
    f"""SELECT horizon, {gap('y')} AS cumulative, {gap('m1')} AS pivot_part, {gap('(y - m1)')} AS incremental, CAST(0 AS DOUBLE) AS residual FROM study GROUP BY 1""",
    dbl="cumulative pivot_part incremental residual",
)
def spread_reconciliation(v):
    return sg.reconcile_spreads(study(v), ["horizon"], "y", "m1")


@query(
    "signal_decay",
    f"""SELECT horizon, count(*) AS rows, count(*) FILTER (WHERE anchor) AS anchors, avg(s) AS mean, avg({bps('s')}) AS mean_bps, avg((s > 0)::INT) FILTER (WHERE s <> 0) AS hit_rate, quantile_cont(s, 0.5) AS median
        FROM (SELECT *, sign(sig) * y AS s FROM study) GROUP BY 1""",
    dbl="mean mean_bps hit_rate median",
)
def signal_decay(v):
    d = study(v)
    return sg.signal_decay(d, ["horizon"], "sig", "y", "mid_x2", v.cut(d.withColumn("_s", F.signum("sig") * F.col("y")), "events", 20))


@query(
    "up_down_legs",
    """SELECT horizon, CASE WHEN sig > 0 THEN 'long' ELSE 'short' END AS leg, count(*) AS rows, avg(sign(sig) * y) AS mean, avg((sign(sig) * y > 0)::INT) FILTER (WHERE y <> 0) AS hit_rate
       FROM study WHERE sig <> 0 GROUP BY 1, 2""",
    dbl="mean hit_rate",
)
def up_down_legs(v):
    return sg.signal_legs(study(v), ["horizon"], "sig", "y")


@query(
    "monotonicity",
    f"""WITH d AS (SELECT horizon, decile, avg(y_d) AS m FROM study GROUP BY 1, 2), s AS (SELECT *, m - lag(m) OVER (PARTITION BY horizon ORDER BY decile) AS step, {rank_sql('m', 'horizon')} AS rm FROM d)
        SELECT horizon, count(step) AS steps, bool_and(coalesce(step >= 0, true)) AS non_decreasing, bool_and(coalesce(step <= 0, true)) AS non_increasing, avg((step > 0)::INT) AS share_up, corr(rm, decile) AS spearman FROM s GROUP BY 1""",
    dbl="share_up spearman",
)
def monotonicity(v):
    means = study(v).groupBy("horizon", "decile").agg(F.avg("y_d").alias("m"))
    return sg.monotonicity(means, ["horizon"], "decile", "m")


@query(
    "stability_by_group",
    f"""SELECT horizon, count(*) AS groups, greatest(avg((s > 0)::INT), avg((s < 0)::INT)) AS dominant_share FROM (SELECT horizon, seg, sid, {gap('y_d')} AS s FROM study GROUP BY 1, 2, 3) WHERE s IS NOT NULL GROUP BY 1""",
    dbl="dominant_share",
)
def stability_by_group(v):
    return sg.sign_stability(sg.decile_gap(study(v), ["horizon", "seg", "sid"], "y_d"), ["horizon"], "spread")


@query(
    "threshold_table",
    """WITH s AS (SELECT s.side, s.p, CASE WHEN s.side = 'bid' THEN -1 ELSE 1 END * m.m6 AS r FROM scores s JOIN marks m USING (seg, g_us)), k AS (SELECT unnest([NULL, 0.5, 0.7, 0.9])::DOUBLE AS threshold),
       n AS (SELECT side, count(*) AS total FROM s GROUP BY 1)
       SELECT s.side, k.threshold, count(*) AS rows, count(*) / max(n.total) AS share, avg(p) AS mean_p, count(r) AS observed, avg(r) AS mean_r, avg((r > 0)::INT) AS favourable
       FROM s JOIN n USING (side) JOIN k ON k.threshold IS NULL OR s.p >= k.threshold GROUP BY 1, 2""",
    dbl="threshold share mean_p mean_r favourable",
)
def threshold_table(v):
    d = scored(v)
    aggs = {"mean_p": F.avg("p"), "observed": F.count("r"), "mean_r": F.avg("r"), "favourable": st.share(F.col("r") > 0)}
    return sg.threshold_table(d, ["side"], "p", [0.5, 0.7, 0.9], aggs)


def scored(v):
    """Scores with the signed 6-step outcome of acting on them."""
    d = v.scores.join(v.marks.select("seg", "g_us", "m6", "m1", "mid_x2"), ["seg", "g_us"])
    return d.withColumn("r", F.when(F.col("side") == "bid", -1).otherwise(1) * F.col("m6"))


@query(
    "probability_magnitude",
    """SELECT *, p_right * size_right AS part_right, p_wrong * size_wrong AS part_wrong, p_right - p_wrong AS edge FROM (
       SELECT decile, count(*) AS n, avg((y > 0)::INT) AS p_right, avg((y < 0)::INT) AS p_wrong, avg(y) FILTER (WHERE y > 0) AS size_right, avg(-y) FILTER (WHERE y < 0) AS size_wrong, avg(y) AS expected
       FROM study WHERE horizon = 6 GROUP BY 1)""",
    dbl="p_right p_wrong size_right size_wrong expected part_right part_wrong edge",
)
def probability_magnitude(v):
    return sg.probability_magnitude(study(v).where("horizon = 6"), ["decile"], "y")


@query(
    "conditional_split",
    """WITH s AS (SELECT m6, m1, CASE WHEN m1 IS NOT NULL THEN m1 > 0 END AS ev FROM marks)
       SELECT population, count(*) AS n, count(m6) AS observed, avg(m6) AS mean_m6 FROM (SELECT 'all' AS population, * FROM s UNION ALL SELECT CASE WHEN ev THEN 'event' ELSE 'no_event' END, * FROM s WHERE ev IS NOT NULL) GROUP BY 1""",
    dbl="mean_m6",
)
def conditional_split(v):
    return sg.conditional_split(v.marks, F.col("m1") > 0, {"n": F.count("*"), "observed": F.count("m6"), "mean_m6": F.avg("m6")})


@query(
    "regime_table",
    f"""WITH b AS ({qcut('mid_x2', "SELECT s.seg, s.g_us, s.p, m.mid_x2, CASE WHEN s.side = 'bid' THEN -1 ELSE 1 END * m.m6 AS r FROM scores s JOIN marks m USING (seg, g_us)")}), k AS (SELECT unnest([NULL, 0.5, 0.9])::DOUBLE AS threshold),
        n AS (SELECT bucket, count(*) AS total FROM b GROUP BY 1)
        SELECT b.bucket, k.threshold, count(*) AS rows, count(*) / max(n.total) AS share, avg(r) AS mean_r FROM b JOIN n USING (bucket) JOIN k ON k.threshold IS NULL OR b.p >= k.threshold GROUP BY 1, 2""",
    dbl="threshold share mean_r",
)
def regime_table(v):
    d = scored(v)
    d = w.quantile_buckets(d, [], "mid_x2", "bucket", 10, v.cut(d, "events", 20)("mid_x2"))
    return sg.threshold_table(d, ["bucket"], "p", [0.5, 0.9], {"mean_r": F.avg("r")})


@query(
    "daily_regimes",
    f"""WITH d AS (SELECT g_us // {DAY} AS day, avg(abs(sig)) AS vol, avg(m6) AS mean_m6 FROM marks GROUP BY 1), t AS (SELECT quantile_cont(vol, 0.5) AS med FROM d WHERE day % 2 = 0)
        SELECT CASE WHEN vol > med THEN 'high' ELSE 'low' END AS regime, count(*) AS days, avg(mean_m6) AS mean_m6 FROM d, t GROUP BY 1""",
    dbl="mean_m6",
)
def daily_regimes(v):
    d = v.marks.groupBy(F.expr(f"g_us div {DAY}").alias("day")).agg(F.avg(F.abs("sig")).alias("vol"), F.avg("m6").alias("mean_m6"))
    med = d.where("day % 2 = 0").agg(F.percentile("vol", F.lit(0.5)).alias("med"))
    d = d.crossJoin(F.broadcast(med)).withColumn("regime", F.when(F.col("vol") > F.col("med"), "high").otherwise("low"))
    return d.groupBy("regime").agg(F.count("*").alias("days"), F.avg("mean_m6").alias("mean_m6"))


@query(
    "cost_hurdle",
    f"""SELECT horizon, edge_bps, hurdle::DOUBLE AS hurdle, edge_bps - hurdle AS net_one_way, edge_bps - 2 * hurdle AS net_round_trip, edge_bps > hurdle AS clears_one_way, edge_bps > 2 * hurdle AS clears_round_trip,
               edge_bps / 2 AS break_even_round_trip, CASE WHEN edge_bps < 1 THEN '<1bp' WHEN edge_bps <= 5 THEN '1-5bp' ELSE '>5bp' END AS band
        FROM ({spread_sql('y_d')}), (VALUES (0.5), (1.0), (2.0), (5.0)) h(hurdle)""",
    dbl="edge_bps hurdle net_one_way net_round_trip break_even_round_trip",
)
def cost_hurdle(v):
    t = sg.decile_spread(study(v), ["horizon"], "y_d", "mid_x2", "day", "anchor").select("horizon", "edge_bps")
    return sg.cost_hurdles(t, "edge_bps", [0.5, 1, 2, 5])


EDGES = [0, 30, 120, 360]


@query(
    "lead_time_hist",
    """SELECT threshold, count(*) AS rows, count(lead) AS resolved, avg((lead IS NOT NULL)::INT) AS resolved_share, avg(lead) AS mean, avg((lead <= 0)::INT) AS le_0, """
    + ", ".join(f"avg((lead > {a} AND lead <= {b})::INT) AS in_{a}_{b}" for a, b in zip(EDGES[:-1], EDGES[1:]))
    + f""", avg((lead > 360)::INT) AS gt_360, quantile_cont(lead, 0.1) AS p10, quantile_cont(lead, 0.5) AS p50, quantile_cont(lead, 0.9) AS p90
    FROM (SELECT threshold, lead_us / 60e6 AS lead FROM ({FIRSTX})) GROUP BY 1""",
    dbl="threshold resolved_share mean le_0 in_0_30 in_30_120 in_120_360 gt_360 p10 p50 p90",
)
def lead_time_hist(v):
    d = first_crossings(v).withColumn("lead", F.col("lead_us") / 60e6)
    return sg.binned_lead(d, ["threshold"], "lead", EDGES, v.cut(d, "events", 20))


LAT = {"30m": 30, "2h": 120}


@query(
    "latency_distribution",
    f"""SELECT side, count(*) AS population, count(l) AS observed, avg((l IS NULL)::INT) AS never, avg(coalesce(l <= 30, false)::INT) AS within_30m, avg(coalesce(l <= 120, false)::INT) AS within_2h,
               quantile_cont(l, 0.25) AS p25, quantile_cont(l, 0.5) AS p50, quantile_cont(l, 0.75) AS p75 FROM (SELECT side, (best_adverse - at_us) / 60e6 AS l FROM ({RACES})) GROUP BY 1""",
    dbl="never within_30m within_2h p25 p50 p75",
)
def latency_distribution(v):
    d = raced(v).withColumn("l", (F.col("best_adverse") - F.col("at_us")) / 60e6)
    return sg.latency_distribution(d, ["side"], "l", LAT, v.cut(d, "events", 20))


@query(
    "race_table",
    f"""WITH r AS ({RACES}), l AS (SELECT side, fill - at_us AS fill, unnest(['mid_adverse', 'best_adverse', 'gone']) AS race, unnest([mid_adverse, best_adverse, gone]) - at_us AS rival FROM r),
        h AS (SELECT l.*, handicap, fill + handicap AS late FROM l, (VALUES (0::BIGINT), (600000000::BIGINT), (3600000000::BIGINT)) h(handicap))
        SELECT side, race, handicap, count(*) AS eligible, count(*) FILTER (WHERE late IS NOT NULL OR rival IS NOT NULL) AS resolved, count(*) FILTER (WHERE late IS NULL AND rival IS NULL) AS censored,
               count(*) FILTER (WHERE late < coalesce(rival, late + 1)) AS fill_first, avg(coalesce(late < coalesce(rival, late + 1), false)::INT) FILTER (WHERE late IS NOT NULL OR rival IS NOT NULL) AS fill_first_rate
        FROM h GROUP BY 1, 2, 3""",
    dbl="fill_first_rate",
)
def race_table(v):
    at = F.col("at_us")
    d = raced(v).withColumns({c: F.col(c) - at for c in ("fill", "mid_adverse", "best_adverse", "gone")})
    return sg.race_table(d, ["side"], "fill", ["mid_adverse", "best_adverse", "gone"], [0, 600_000_000, HOUR])


@query(
    "cancel_surface",
    f"""WITH c AS ({CANCEL}), a AS (SELECT threshold, latency, count(*) AS eligible, count(*) FILTER (WHERE filled) AS fills, count(*) FILTER (WHERE signalled) AS cancels, count(*) FILTER (WHERE prevented) AS prevented,
          count(*) FILTER (WHERE survives) AS surviving, count(*) FILTER (WHERE disposition = 'too_late') AS too_late, count(*) FILTER (WHERE disposition = 'cancel_without_fill') AS without_fill,
          sum(avoided_ticks)::BIGINT AS avoided, sum(sacrificed_ticks)::BIGINT AS sacrificed, coalesce(sum(-least(m1, 0)), 0)::BIGINT AS base_negative, coalesce(sum(greatest(m1, 0)), 0)::BIGINT AS base_positive,
          count(*) FILTER (WHERE prevented AND m1 <= -100) AS tail_100_avoided, count(*) FILTER (WHERE m1 <= -100) AS tail_100_base FROM c GROUP BY 1, 2),
        b AS (SELECT *, prevented / nullif(fills, 0) AS taken, avoided - sacrificed AS net FROM a)
        SELECT * EXCLUDE (taken), cancels / nullif(eligible, 0) AS cancel_rate, net / nullif(eligible, 0) AS net_per_opportunity, avoided / nullif(sacrificed, 0) AS efficiency, (base_negative - base_positive) * taken AS random_net,
               net / nullif((base_negative - base_positive) * taken, 0) AS lift_over_random, (avoided / nullif(sacrificed, 0)) / nullif(base_negative / nullif(base_positive, 0), 0) AS efficiency_lift,
               tail_100_avoided / nullif(tail_100_base * taken, 0) AS tail_100_lift FROM b""",
    dbl="threshold cancel_rate net_per_opportunity efficiency random_net lift_over_random efficiency_lift tail_100_lift",
)
def cancel_surface(v):
    d = cancelled(v).withColumn("filled", F.col("fill_us").isNotNull())
    return sg.cancel_surface(d, ["threshold", "latency"], "m1", [100])


@query(
    "false_positive_table",
    f"""SELECT threshold, close_reason <> 'segment_end' AND lead_us <= {6 * HOUR} AS consumed, count(*) AS crossings, avg(lead_us / 6e7) AS mean_lead_min, min(lead_us) AS min_lead_us, max(lead_us) AS max_lead_us
        FROM (SELECT threshold, coalesce(close_reason, 'segment_end') AS close_reason, lead_us FROM ({FIRSTX}) WHERE lead_us IS NOT NULL) GROUP BY 1, 2""",
    dbl="threshold mean_lead_min",
)
def false_positive_table(v):
    d = first_crossings(v).where("lead_us IS NOT NULL")
    consumed = (F.col("close_reason") != "segment_end") & (F.col("lead_us") <= 6 * HOUR)
    return d.groupBy("threshold", consumed.alias("consumed")).agg(
        F.count("*").alias("crossings"), F.avg(F.col("lead_us") / 6e7).alias("mean_lead_min"), F.min("lead_us").alias("min_lead_us"), F.max("lead_us").alias("max_lead_us")
    )


@query(
    "transport_pivot",
    """WITH m AS (SELECT side, alpha, avg(m1) AS m FROM fills GROUP BY 1, 2) SELECT side, """
    + ", ".join(f"max(m) FILTER (WHERE alpha = {a}) AS m_{a}" for a in ALPHAS)
    + ", min(m) AS low, max(m) AS high, max(m) - min(m) AS range, sign(min(m)) = sign(max(m)) AS signs_agree FROM m GROUP BY 1",
    dbl=" ".join(f"m_{a}" for a in ALPHAS) + " low high range",
)
def transport_pivot(v):
    t = marked_fills(v).groupBy("side", "alpha").agg(F.avg("m1").alias("m"))
    return sg.transport(t, ["side"], "alpha", ALPHAS, "m")


PRED = "SELECT id, blk, grp, (y > 0)::INT AS t, y, (x1 * 7 + x2 * 3) % 97 / 97.0 AS p, (x1 * 11 + x3) % 401 - 200 AS f FROM wide WHERE y IS NOT NULL"


def predictions(v):
    return v.wide.where("y IS NOT NULL").selectExpr(
        "id", "blk", "grp", "cast(y > 0 as int) AS t", "y", "cast((x1 * 7 + x2 * 3) % 97 as double) / 97 AS p", "(x1 * 11 + x3) % 401 - 200 AS f"
    )


def class_sql(src, keys):
    k = ", ".join(keys) + ", " if keys else ""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    j = f"USING ({', '.join(keys)})" if keys else "ON true"
    return f"""
    WITH d AS (SELECT *, greatest(least(p, 1 - 1e-6), 1e-6) AS q FROM ({src})),
    c AS (SELECT {k}q, count(*) AS n, sum(t) AS pos FROM d GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER ({part}ORDER BY q) AS cn, sum(n) OVER ({part}ORDER BY q DESC) AS tn, sum(pos) OVER ({part}ORDER BY q DESC) AS tp FROM c),
    a AS (SELECT {k}sum(n) AS nn, sum(pos) AS pp, (sum(pos * (cn - (n - 1) / 2.0)) - sum(pos) * (sum(pos) + 1) / 2) / nullif(sum(pos) * (sum(n) - sum(pos)), 0) AS roc_auc, sum(pos * tp / tn) / nullif(sum(pos), 0) AS pr_auc FROM r GROUP BY ALL),
    s AS (SELECT {k}count(*) AS n, sum(t)::BIGINT AS positives, avg(t) AS base_rate, -avg(t * ln(q) + (1 - t) * ln(1 - q)) AS log_loss, avg((q - t) * (q - t)) AS brier, avg(((q >= 0.5) = (t > 0.5))::INT) AS accuracy FROM d GROUP BY ALL)
    SELECT s.*, CASE WHEN pp > 0 AND pp < nn THEN roc_auc END AS roc_auc, CASE WHEN pp > 0 AND pp < nn THEN pr_auc END AS pr_auc, CASE WHEN pp > 0 AND pp < nn THEN pr_auc END / nullif(base_rate, 0) AS pr_lift FROM s JOIN a {j}"""


CD = "base_rate log_loss brier accuracy roc_auc pr_auc pr_lift"


@query("classification_metrics", class_sql(PRED, ["grp"]), dbl=CD)
def classification_metrics(v):
    d = predictions(v)
    return sg.classification_scores(d, ["grp"], "t", "p", v.cut(d, "lineitem")("p"))


@query(
    "regression_metrics",
    f"""SELECT grp, count(*) AS n, avg(abs(f - y)) AS mae, sqrt(avg((f - y) * (f - y))) AS rmse, corr(rf, ry) AS spearman, avg(((f > 0) = (y > 0))::INT) AS sign_accuracy,
               1 - sum((f - y) * (f - y)) / nullif(var_pop(y) * count(*), 0) AS r2, quantile_cont(abs(f - y), 0.5) AS median_ae
        FROM (SELECT *, {rank_sql('f', 'grp')} AS rf, {rank_sql('y', 'grp')} AS ry FROM ({PRED})) GROUP BY 1""",
    dbl="mae rmse spearman sign_accuracy r2 median_ae",
)
def regression_metrics(v):
    d = predictions(v)
    wide = d.select("*", F.col("y").cast("double").alias("_y"), F.col("f").cast("double").alias("_p")).withColumn("_ae", F.abs(F.col("_p") - F.col("_y")))
    return sg.regression_scores(d, ["grp"], "y", "f", v.cut(wide, "lineitem"))


@query(
    "pooled_block_metrics",
    f"""WITH b AS ({class_sql(PRED, ['blk'])}), g AS (SELECT * FROM b WHERE n >= 20), a AS ({class_sql(PRED, [])})
        SELECT a.n, a.roc_auc, a.brier, (SELECT count(*) FROM g) AS blocks, (SELECT avg(roc_auc) FROM g) AS block_mean, (SELECT quantile_cont(roc_auc, 0.5) FROM g) AS block_median,
               (SELECT min(roc_auc) FROM g) AS block_worst, (SELECT max(roc_auc) FROM g) AS block_best FROM a""",
    dbl="roc_auc brier block_mean block_median block_worst block_best",
)
def pooled_block_metrics(v):
    d = predictions(v)
    p = v.cut(d, "lineitem")("p")
    pooled = sg.classification_scores(d, [], "t", "p", p).select("n", "roc_auc", "brier")
    b = sg.classification_scores(d, ["blk"], "t", "p", p).where("n >= 20")
    s = sg.block_summary(b, [], "roc_auc").select(
        "blocks", F.col("mean").alias("block_mean"), F.col("median").alias("block_median"), F.col("worst").alias("block_worst"), F.col("best").alias("block_best")
    )
    return pooled.crossJoin(F.broadcast(s))


@query("calibration_table", f"SELECT bucket, count(*) AS n, avg(p) AS predicted, avg(t) AS realised FROM ({qcut('p', PRED)}) GROUP BY 1", dbl="predicted realised")
def calibration_table(v):
    d = predictions(v)
    d = w.quantile_buckets(d, [], "p", "bucket", 10, v.cut(d, "lineitem")("p"))
    return d.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("t").alias("realised"))


@query(
    "magnitude_buckets",
    f"SELECT bucket, count(*) AS n, avg(f) AS predicted, avg(y) AS mean, quantile_cont(y, 0.1) AS p10, quantile_cont(y, 0.5) AS p50, quantile_cont(y, 0.9) AS p90 FROM ({qcut('f', PRED)}) GROUP BY 1",
    dbl="predicted mean p10 p50 p90",
)
def magnitude_buckets(v):
    d = predictions(v)
    cut = v.cut(d, "lineitem")
    d = w.quantile_buckets(d, [], "f", "bucket", 10, cut("f"))
    return st.grouped(d, ["bucket"], {"n": F.count("*"), "predicted": F.avg("f"), "mean": F.avg("y")}, {"p10": ("y", 0.1), "p50": ("y", 0.5), "p90": ("y", 0.9)}, cut)


@query(
    "event_study_summary",
    f"""WITH e AS (SELECT o.*, z.first_us, z.last_us, t.tau FROM orders_p o JOIN (SELECT seg, min(ts_us) AS first_us, max(ts_us) AS last_us FROM ev GROUP BY 1) z USING (seg), (VALUES ({-HOUR}), ({HOUR}), ({3 * HOUR})) t(tau)),
        m AS (SELECT e.side, e.tau::BIGINT AS tau, CASE WHEN e.place_us + tau BETWEEN first_us AND last_us THEN CASE WHEN side = 'bid' THEN 1 ELSE -1 END * (b.mid_x2 - a.mid_x2) END AS move
              FROM e ASOF LEFT JOIN mid_path a ON a.seg = e.seg AND e.place_us >= a.ts_us ASOF LEFT JOIN mid_path b ON b.seg = e.seg AND e.place_us + e.tau >= b.ts_us),
        s AS (SELECT side, tau, count(move) AS observed, avg(move) AS mean, quantile_cont(move, 0.25) AS p25, quantile_cont(move, 0.5) AS median, quantile_cont(move, 0.75) AS p75 FROM m GROUP BY 1, 2)
        SELECT s.*, -b.mean / nullif(l.mean - b.mean, 0) AS share_before FROM s JOIN s b ON b.side = s.side AND b.tau = {-HOUR} JOIN s l ON l.side = s.side AND l.tau = {3 * HOUR}""",
    dbl="mean p25 median p75 share_before",
)
def event_study_summary(v):
    spans = v.ev.groupBy("seg").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    p = event_paths(v.orders_p.join(spans, "seg"), v.mid_path, ["seg"], "place_us", "first_us", "last_us", TAUS, "ts_us", "mid_x2", v.time)
    s = st.grouped(p, ["side", "tau"], {"observed": F.count("move"), "mean": F.avg("move")}, {"p25": ("move", 0.25), "median": ("move", 0.5), "p75": ("move", 0.75)}, v.cut(p, "events", 3))
    ends = s.groupBy("side").agg(F.max(F.when(F.col("tau") == TAUS[0], F.col("mean"))).alias("_b"), F.max(F.when(F.col("tau") == TAUS[-1], F.col("mean"))).alias("_l"))
    before = -F.col("_b") / F.nullif(F.col("_l") - F.col("_b"), F.lit(0.0))
    return s.join(ends, "side").withColumn("share_before", before).drop("_b", "_l")


DECAY = f"""
    WITH c AS ({spread_sql('y_d')}), i AS ({spread_sql('inc_d')}), r AS (SELECT horizon, {gap('(y - m1)')} AS raw FROM study GROUP BY 1),
    t AS (SELECT 'cumulative' AS kind, c.horizon, anchor_agrees AS resolved, block_sign_share >= 0.6 AS stable, spread, spread AS raw FROM c
          UNION ALL SELECT 'incremental', i.horizon, anchor_agrees, block_sign_share >= 0.6, spread, r.raw FROM i JOIN r USING (horizon) WHERE i.horizon > 1)"""


@query(
    "decay_classification",
    DECAY + """, f AS (SELECT coalesce(bool_or(kind = 'incremental' AND resolved AND spread > 0), false) AS up, coalesce(bool_or(kind = 'incremental' AND resolved AND spread < 0), false) AS down,
        coalesce(bool_or(kind = 'incremental' AND resolved AND spread > 0 AND stable AND horizon > 6), false) AS stable_medium, coalesce(bool_or(kind = 'incremental' AND resolved AND spread > 0 AND horizon <= 6), false) AS up_short,
        coalesce(bool_or(kind = 'cumulative' AND resolved AND horizon <= 6), false) AS short_resolved, coalesce(bool_or(kind = 'incremental' AND resolved AND sign(spread) <> sign(raw)), false) AS flip,
        coalesce(bool_or(kind = 'incremental' AND resolved AND NOT stable), false) AS unstable FROM t)
      SELECT 'sig' AS signal, *, CASE WHEN up AND down THEN 'ambiguous' WHEN flip OR (unstable AND NOT stable_medium) THEN 'ambiguous' WHEN down THEN 'reversal' WHEN stable_medium THEN 'medium_horizon_persistence'
             WHEN up_short THEN 'short_continuation' WHEN short_resolved THEN 'ultra_short_only' ELSE 'ambiguous' END AS label FROM f""",
)
def decay_classification(v):
    d = study(v)
    cols = ["horizon", F.col("anchor_agrees").alias("resolved"), (F.col("block_sign_share") >= 0.6).alias("stable"), "spread"]
    cum = sg.decile_spread(d, ["horizon"], "y_d", "mid_x2", "day", "anchor").select(F.lit("cumulative").alias("kind"), *cols, F.col("spread").alias("raw"))
    raw = sg.decile_gap(d, ["horizon"], "inc").select("horizon", F.col("spread").alias("raw"))
    inc = sg.decile_spread(d.where("horizon > 1"), ["horizon"], "inc_d", "mid_x2", "day", "anchor").select(F.lit("incremental").alias("kind"), *cols).join(raw, "horizon")
    table = cum.unionByName(inc).withColumn("signal", F.lit("sig"))
    return sg.decay_class(table, ["signal"], 6)

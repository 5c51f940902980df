"""Queries for descriptive and population statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import stats as st
from tickloom.operators import windows as w
from tickloom.operators.labels import level_survival
from tickloom.operators.ordered import asof, row_numbers
from tickloom.operators.state import level_episodes
from tickloom.plans.joins import marked_fills
from tickloom.plans.labels import seg_ends
from tickloom.plans.registry import query
from tickloom.plans.state import flow_rows, hits
from tickloom.plans.views import DAY, HOUR
from tickloom.operators.state import explained_removals

P7 = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@query(
    "describe_columns",
    "SELECT name, count(*) AS rows, count(value) AS observed, count(*) FILTER (WHERE value IS NULL) AS missing, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, "
    + ", ".join(f"quantile_cont(value, {p}) AS p{int(p * 100):02d}" for p in P7)
    + " FROM (SELECT unnest(['x1', 'x2', 'x3', 'y']) AS name, unnest([x1, x2, x3, y])::DOUBLE AS value FROM wide) GROUP BY 1",
    dbl="mean std min max " + " ".join(f"p{int(p * 100):02d}" for p in P7),
)
def describe_columns(v):
    long = st.long_columns(v.wide, [], ["x1", "x2", "x3", "y"])
    return st.describe_columns(v.wide, ["x1", "x2", "x3", "y"], v.cut(long, "lineitem", 4))


def fills_cut(v, df):
    return v.cut(df, "events", 5)


def markout_sql(m):
    return f"""count({m}) AS {m}_observed, count(wait) - count({m}) AS {m}_censored, avg({m}) AS {m}_mean, avg(({m} > 0)::INT) AS {m}_favourable, -avg({m}) AS {m}_required,
        avg(-{m} * 10000.0 / nullif(2 * price, 0)) AS {m}_required_bps, quantile_cont({m}, 0.1) AS {m}_p10, quantile_cont({m}, 0.5) AS {m}_median, quantile_cont({m}, 0.9) AS {m}_p90"""


MD = " ".join(f"{m}_{s}" for m in ("m1", "m6") for s in ("mean", "favourable", "required", "required_bps", "p10", "median", "p90"))


@query(
    "population_stats",
    f"""SELECT side, alpha, count(*) AS eligible, count(wait) AS filled, avg((wait IS NOT NULL)::INT) AS fill_rate, count(*) FILTER (WHERE mechanism = 'at_quote') AS at_quote_fills,
               count(*) FILTER (WHERE mechanism = 'through') AS through_fills, avg((mechanism = 'through')::INT) FILTER (WHERE wait IS NOT NULL) AS through_share,
               count(*) FILTER (WHERE wait IS NOT NULL OR seen >= {HOUR}) AS evaluable_1h, avg(coalesce(wait <= {HOUR}, false)::INT) FILTER (WHERE wait IS NOT NULL OR seen >= {HOUR}) AS fill_rate_1h,
               quantile_cont(wait, 0.5) AS median_wait, {markout_sql('m1')}, {markout_sql('m6')}
        FROM (SELECT *, fill_us - place_us AS wait, last_us - place_us AS seen FROM fills) GROUP BY 1, 2""",
    dbl="fill_rate through_share fill_rate_1h median_wait " + MD,
)
def population_stats(v):
    f = marked_fills(v, horizons=("m1", "m6")).withColumn("wait", F.col("fill_us") - F.col("place_us"))
    seen = F.col("last_us") - F.col("place_us")
    return st.population_stats(f, ["side", "alpha"], "wait", {"1h": HOUR}, ["m1", "m6"], seen, fills_cut(v, f))


@query(
    "multi_grain",
    """SELECT side, mechanism, sid, seg, grouping_id(side, mechanism, sid, seg) AS grain, count(*) AS fills, avg(m1) AS mean_m1, avg((m1 > 0)::INT) AS favourable
       FROM fills WHERE alpha = 50 AND filled GROUP BY GROUPING SETS ((), (side), (mechanism), (sid), (seg, sid))""",
    dbl="mean_m1 favourable",
)
def multi_grain(v):
    f = marked_fills(v, (50,)).where("filled").select("side", "mechanism", "sid", "seg", "m1")
    aggs = {"fills": F.count("*"), "mean_m1": F.avg("m1"), "favourable": st.share(F.col("m1") > 0)}
    d = st.multi_grain(f, [["side", "mechanism", "sid", "seg"], [], ["side"], ["mechanism"], ["sid"], ["seg", "sid"]], aggs)
    return d.where("grain > 0").select("side", "mechanism", "sid", "seg", "grain", *aggs)


@query(
    "mechanism_decomposition",
    """SELECT *, abs(mean - coalesce(p_through * mean_through, 0) - coalesce(p_at_quote * mean_at_quote, 0)) AS error FROM (
         SELECT side, alpha, count(*) AS observed, avg(m1) AS mean, avg((mechanism = 'through')::INT) AS p_through, avg((mechanism = 'at_quote')::INT) AS p_at_quote,
                avg(m1) FILTER (WHERE mechanism = 'through') AS mean_through, avg(m1) FILTER (WHERE mechanism = 'at_quote') AS mean_at_quote
         FROM fills WHERE m1 IS NOT NULL AND mechanism IS NOT NULL GROUP BY 1, 2)""",
    dbl="mean p_through p_at_quote mean_through mean_at_quote error",
)
def mechanism_decomposition(v):
    return st.mechanism_parts(marked_fills(v), ["side", "alpha"], "m1")


@query(
    "markout_path",
    """SELECT side, horizon, count(y) AS observed, avg(y) AS mean, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.25) AS p25, quantile_cont(y, 0.75) AS p75, avg((y > 0)::INT) AS favourable
       FROM (SELECT side, unnest(['m1', 'm6']) AS horizon, unnest([m1, m6]) AS y FROM fills WHERE filled) GROUP BY 1, 2""",
    dbl="mean median p25 p75 favourable",
)
def markout_path(v):
    long = st.long_columns(marked_fills(v, horizons=("m1", "m6")).where("filled"), ["side"], ["m1", "m6"], "horizon", "y")
    y = F.col("y")
    return st.grouped(
        long, ["side", "horizon"], {"observed": F.count(y), "mean": F.avg(y), "favourable": st.share(y > 0)},
        {"median": ("y", 0.5), "p25": ("y", 0.25), "p75": ("y", 0.75)}, v.cut(long, "events", 10),
    )


@query(
    "passive_summary",
    """WITH a AS (SELECT alpha, count(*) AS n, count(*) FILTER (WHERE filled) AS f, count(*) FILTER (WHERE mechanism = 'through') AS t, count(m1) AS o, count(*) FILTER (WHERE m1 > 0) AS g,
                         avg(m1) AS am, avg(m1) FILTER (WHERE mechanism = 'through') AS tm FROM fills GROUP BY 1)
       SELECT alpha, 'filled' AS statistic, 'eligible' AS denominator_name, n AS denominator, f AS numerator, f / n AS rate, am AS conditional_mean FROM a
       UNION ALL SELECT alpha, 'through', 'filled', f, t, t / nullif(f, 0), tm FROM a UNION ALL SELECT alpha, 'favourable', 'observed', o, g, g / nullif(o, 0), am FROM a""",
    dbl="rate conditional_mean",
)
def passive_summary(v):
    a = marked_fills(v).groupBy("alpha").agg(
        F.count("*").alias("n"), F.count_if("filled").alias("f"), F.count_if(F.col("mechanism") == "through").alias("t"), F.count("m1").alias("o"),
        F.count_if(F.col("m1") > 0).alias("g"), F.avg("m1").alias("am"), st.mean_if(F.col("mechanism") == "through", F.col("m1")).alias("tm"),
    )
    rows = F.expr("stack(3, 'filled', 'eligible', n, f, am, 'through', 'filled', f, t, tm, 'favourable', 'observed', o, g, am) AS (statistic, denominator_name, denominator, numerator, conditional_mean)")
    return a.select("alpha", rows).withColumn("rate", F.try_divide(F.col("numerator").cast("double"), F.col("denominator").cast("double")))


def rank_sql(c, part=""):
    over = f"PARTITION BY {part} " if part else ""
    same = f"PARTITION BY {part + ', ' if part else ''}{c}"
    return f"rank() OVER ({over}ORDER BY {c}) + (count(*) OVER ({same}) - 1) / 2.0"


@query(
    "pearson_spearman_ic",
    f"""SELECT grp, name, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman
        FROM (SELECT *, {rank_sql('x', 'grp, name')} AS rx, {rank_sql('y', 'grp, name')} AS ry
              FROM (SELECT grp, unnest(['x1', 'x2', 'x3']) AS name, unnest([x1, x2, x3])::DOUBLE AS x, y FROM wide) WHERE y IS NOT NULL) GROUP BY 1, 2""",
    dbl="pearson spearman",
)
def pearson_spearman_ic(v):
    long = st.long_columns(v.wide, ["grp", "y"], ["x1", "x2", "x3"], "name", "x")
    return st.information_coefficients(long, ["grp", "name"], "x", "y", v.cut(long, "lineitem", 3))


def hac_sql(lags, step, keyed=False):
    lagcols = ", ".join(
        f"CASE WHEN g_us - lag(g_us, {k}) OVER r = {k * step} THEN lag(s0, {k}) OVER r END AS s0_{k}, CASE WHEN g_us - lag(g_us, {k}) OVER r = {k * step} THEN lag(s1, {k}) OVER r END AS s1_{k}"
        for k in range(1, lags + 1)
    )

    def total(a, b):
        return f"sum({a} * {b})" + "".join(f" + {1 - k / (lags + 1)} * coalesce(sum({a} * {b}_{k} + {b} * {a}_{k}), 0)" for k in range(1, lags + 1))

    return f"""
        WITH p AS (SELECT seg, sid, g_us, sig::DOUBLE AS x, m6::DOUBLE AS y FROM marks WHERE sig IS NOT NULL AND m6 IS NOT NULL),
        m AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, stddev_pop(x) AS sd FROM p),
        b AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope FROM m), c AS (SELECT *, (sy - slope * sx) / n AS icpt FROM b),
        e AS (SELECT p.*, y - icpt - slope * x AS s0, (y - icpt - slope * x) * x AS s1 FROM p, c),
        l AS (SELECT *, {lagcols} FROM e WINDOW r AS (PARTITION BY seg, sid ORDER BY g_us)),
        t AS (SELECT {total('s0', 's0')} AS m00, {total('s0', 's1')} AS m01, {total('s1', 's1')} AS m11 FROM l),
        v AS (SELECT c.*, sqrt(greatest((sx * sx * m00 - 2 * sx * n * m01 + n * n * m11) / ((n * sxx - sx * sx) * (n * sxx - sx * sx)), 0)) AS se FROM c, t)
        SELECT n, slope, se AS hac_se, slope / se AS hac_t, slope * sd AS effect_per_sd FROM v"""


@query("hac_slope", hac_sql(5, HOUR), dbl="slope hac_se hac_t effect_per_sd")
def hac_slope(v):
    return st.hac_slope(v.marks, [], ["seg", "sid"], "g_us", "sig", "m6", 5, HOUR, v.time)


@query(
    "univariate_report",
    f"""WITH h AS ({hac_sql(5, HOUR)}), p AS (SELECT sig, m6 FROM marks WHERE sig IS NOT NULL AND m6 IS NOT NULL),
        i AS (SELECT count(*) AS pairs, avg(sig) AS mean, stddev_pop(sig) AS std, corr(sig, m6) AS pearson, corr(rx, ry) AS spearman FROM (SELECT *, {rank_sql('sig')} AS rx, {rank_sql('m6')} AS ry FROM p))
        SELECT i.*, h.slope, h.hac_se, h.hac_t, h.effect_per_sd FROM h, i""",
    dbl="mean std pearson spearman slope hac_se hac_t effect_per_sd",
)
def univariate_report(v):
    cut = v.cut(v.marks, "events", 10)
    d = st.rank_pairs(v.marks, [], "sig", "m6", cut).agg(
        F.count("*").alias("pairs"), F.avg("sig").alias("mean"), F.stddev_pop("sig").alias("std"), st.safe_corr("sig", "m6").alias("pearson"), st.safe_corr("_rx", "_ry").alias("spearman")
    )
    return d.crossJoin(F.broadcast(hac_slope(v).drop("n")))


@query(
    "hac_mean_se",
    """WITH p AS (SELECT seg, g_us, g_us // 86400000000 AS day, m1, avg(m1) OVER (PARTITION BY seg) AS mu FROM marks WHERE m1 IS NOT NULL),
       l AS (SELECT *, m1 - mu AS c, """ + ", ".join(f"lag(m1 - mu, {k}) OVER r AS l{k}" for k in range(1, 4)) + """ FROM p WINDOW r AS (PARTITION BY seg, day ORDER BY g_us))
       SELECT seg, count(*) AS n, avg(m1) AS mean, sqrt(greatest(sum(c * c)""" + "".join(f" + 2 * {1 - k / 4} * coalesce(sum(c * l{k}), 0)" for k in range(1, 4)) + ", 0)) / count(*) AS hac_se FROM l GROUP BY 1",
    dbl="mean hac_se",
)
def hac_mean_se(v):
    d = v.marks.withColumn("day", F.expr(f"g_us div {DAY}"))
    return st.hac_mean_se(d, ["seg"], ["day"], "g_us", "m1", 3, v.time)


QS = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"


def qcut(x, src, keys=""):
    part = f"{keys}, " if keys else ""
    return f"SELECT s.*, greatest(len(list_filter(edges, lambda q: q < {x})), 1) - 1 AS bucket FROM ({src}) s JOIN (SELECT {part}list_distinct(quantile_cont({x}, {QS})) AS edges FROM ({src}) GROUP BY ALL) e " + (f"USING ({keys})" if keys else "ON true")


@query(
    "decile_report",
    f"""WITH b AS ({qcut('x1', 'SELECT * FROM wide WHERE y IS NOT NULL')}),
        d AS (SELECT bucket, count(*) AS n, avg(y) AS mean, quantile_cont(y, 0.5) AS median, stddev_samp(y) / sqrt(count(*)) AS se FROM b GROUP BY 1)
        SELECT d.*, mean >= coalesce(lag(mean) OVER (ORDER BY bucket), mean) AS rising, (SELECT arg_max(mean, bucket) - arg_min(mean, bucket) FROM d) AS top_minus_bottom FROM d""",
    dbl="mean median se top_minus_bottom",
)
def decile_report(v):
    d = v.wide.where("y IS NOT NULL")
    cut = v.cut(d, "lineitem")
    return st.decile_report(w.quantile_buckets(d, [], "x1", "bucket", 10, cut("x1")), "bucket", "y", cut)


@query(
    "bucket_study",
    f"SELECT grp, bucket, count(*) AS n, avg(y) AS mean_y, stddev_samp(y) AS std_y, avg(x2) AS mean_x2, stddev_samp(x2) AS std_x2 FROM ({qcut('x1', 'SELECT * FROM wide', 'grp')}) GROUP BY 1, 2",
    dbl="mean_y std_y mean_x2 std_x2",
)
def bucket_study(v):
    d = w.quantile_buckets(v.wide, ["grp"], "x1", "bucket", 10, v.cut(v.wide, "lineitem")("x1"))
    return d.groupBy("grp", "bucket").agg(
        F.count("*").alias("n"), F.avg("y").alias("mean_y"), F.stddev_samp("y").alias("std_y"), F.avg("x2").alias("mean_x2"), F.stddev_samp("x2").alias("std_x2")
    )


@query(
    "interaction_buckets",
    f"""WITH a AS (SELECT id, y, x2, bucket AS bucket_x1 FROM ({qcut('x1', 'SELECT * FROM wide')})), b AS ({qcut('x2', 'SELECT * FROM a')})
        SELECT bucket_x1, bucket AS bucket_x2, count(*) AS n, count(y) AS observed, avg(y) AS mean_y FROM b GROUP BY 1, 2""",
    dbl="mean_y",
)
def interaction_buckets(v):
    cut = v.cut(v.wide, "lineitem")
    d = w.quantile_buckets(v.wide, [], "x1", "bucket_x1", 10, cut("x1"))
    d = w.quantile_buckets(d, [], "x2", "bucket_x2", 10, cut("x2"))
    return d.groupBy("bucket_x1", "bucket_x2").agg(F.count("*").alias("n"), F.count("y").alias("observed"), F.avg("y").alias("mean_y"))


@query(
    "hazard_curve",
    f"""WITH g AS (SELECT g.seg, g.g_us, g.g_us - e.start_us AS age, CASE WHEN e.close_reason <> 'segment_end' AND e.end_us - g.g_us <= {HOUR} THEN 1 WHEN last_us - g.g_us >= {HOUR} AND NOT coalesce(e.end_us - g.g_us <= {HOUR}, false) THEN 0 END AS gone
                   FROM instants g ASOF JOIN episodes e ON e.seg = g.seg AND g.g_us >= e.start_us JOIN (SELECT seg, max(ts_us) AS last_us FROM ev GROUP BY 1) z ON z.seg = g.seg)
        SELECT bucket, count(*) AS n, avg(age / 1e6) AS mean_age_s, avg(gone) AS hazard FROM ({qcut('age', 'SELECT * FROM g WHERE gone IS NOT NULL')}) GROUP BY 1""",
    dbl="mean_age_s hazard",
)
def hazard_curve(v):
    cols = {"start_us": "start_us", "end_us": "end_us", "close_reason": "close_reason"}
    d = asof(v.grid.select("seg", "g_us"), v.episodes, ["seg"], "g_us", "start_us", cols, v.time).join(seg_ends(v), "seg")
    d = level_survival(d, "g_us", "end_us", "close_reason", "last_us", {"gone": HOUR}).where("gone IS NOT NULL")
    d = d.withColumn("age", F.col("g_us") - F.col("start_us"))
    d = w.quantile_buckets(d, [], "age", "bucket", 10, v.cut(d, "events", 10)("age"))
    return d.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(F.col("age") / 1e6).alias("mean_age_s"), F.avg("gone").alias("hazard"))


EPI = """SELECT seg, side, episode, max(coalesce(next_ts, ts_us)) - min(ts_us) AS duration, sum(added) AS added, sum(removed) AS removed, sum(replenished) AS replenished FROM touch_flow WHERE px IS NOT NULL GROUP BY 1, 2, 3"""


def episode_frame(v):
    e = v.settled(level_episodes(flow_rows(v), ["seg"], "ts_us"), "episodes", v.time)
    return e.withColumn("duration", F.col("end_us") - F.col("start_us"))


@query(
    "survival_summary",
    f"""SELECT side, seg, count(*) AS episodes, quantile_cont(duration / 3.6e9, 0.5) AS median_h, quantile_cont(duration / 3.6e9, 0.9) AS p90_h, sum(removed)::BIGINT AS removed, sum(replenished) / nullif(sum(removed), 0) AS replenish_ratio,
               count(*) FILTER (WHERE duration < {HOUR}) AS under_1h, count(*) FILTER (WHERE duration >= {HOUR} AND duration < {6 * HOUR}) AS h1_to_6, count(*) FILTER (WHERE duration >= {6 * HOUR}) AS over_6h
        FROM ({EPI}) GROUP BY 1, 2""",
    dbl="median_h p90_h replenish_ratio",
)
def survival_summary(v):
    e = episode_frame(v).withColumn("duration_h", F.col("duration") / 3.6e9)
    dur = F.col("duration")
    aggs = {
        "episodes": F.count("*"), "removed": F.sum("cum_remove"), "replenish_ratio": F.try_divide(F.sum("cum_replenish").cast("double"), F.nullif(F.sum("cum_remove"), F.lit(0)).cast("double")),
        "under_1h": F.count_if(dur < HOUR), "h1_to_6": F.count_if((dur >= HOUR) & (dur < 6 * HOUR)), "over_6h": F.count_if(dur >= 6 * HOUR),
    }
    return st.grouped(e, ["side", "seg"], aggs, {"median_h": ("duration_h", 0.5), "p90_h": ("duration_h", 0.9)}, v.cut(e, "events", 2))


@query(
    "depletion_summary",
    """WITH e AS (SELECT seg, side, episode, ts_us, removed, 0 AS printed, 1 AS k FROM touch_flow WHERE removed > 0
                  UNION ALL SELECT seg, side, episode, ts_us, 0, qty, 0 FROM touch_hits WHERE kind = 'at_quote'),
       c AS (SELECT *, sum(removed) OVER w - sum(printed) OVER w AS short FROM e WINDOW w AS (PARTITION BY seg, side, episode ORDER BY ts_us, k)),
       u AS (SELECT seg, side, episode, greatest(coalesce(max(CASE WHEN removed > 0 THEN short END), 0), 0) AS u, sum(removed) AS r FROM c GROUP BY 1, 2, 3),
       t AS (SELECT side, sum(r) AS removed, sum(u) AS unexplained FROM u GROUP BY 1), p AS (SELECT side, sum(replenished) AS rep FROM touch_flow WHERE px IS NOT NULL GROUP BY 1)
       SELECT side, removed::BIGINT AS removed, 1 - unexplained / removed AS explained_share, unexplained / removed AS unexplained_share, rep / removed AS replenished_share FROM t JOIN p USING (side)""",
    dbl="explained_share unexplained_share replenished_share",
)
def depletion_summary(v):
    rows = flow_rows(v)
    x = explained_removals(rows, hits(v, rows), ["seg"], "ts_us", v.time)
    x = x.groupBy("side").agg(F.sum("removed").alias("removed"), F.sum("unexplained").alias("u"))
    rep = rows.where("px IS NOT NULL").groupBy("side").agg(F.sum("replenished").alias("rep"))
    d = x.join(rep, "side")
    un = F.col("u") / F.col("removed")
    return d.select("side", "removed", (1 - un).alias("explained_share"), un.alias("unexplained_share"), (F.col("rep") / F.col("removed")).alias("replenished_share"))


TAIL = """count(m1) AS observed, avg(m1) AS mean, quantile_cont(m1, 0.01) AS p01, quantile_cont(m1, 0.05) AS p05, quantile_cont(m1, 0.5) AS p50, quantile_cont(m1, 0.95) AS p95,
          avg((m1 <= -100)::INT) AS tail_100, avg((m1 <= -200)::INT) AS tail_200"""
TAILD = "mean p01 p05 p50 p95 tail_100 tail_200"


@query("tail_distribution", f"SELECT side, mechanism, {TAIL} FROM fills WHERE filled GROUP BY 1, 2", dbl=TAILD)
def tail_distribution(v):
    f = marked_fills(v).where("filled")
    return st.tail_distribution(f, ["side", "mechanism"], "m1", [100, 200], fills_cut(v, f))


def worst(s):
    k = f"greatest(round_even(observed * {s}, 0), 1)"
    n = int(s * 100)
    return f"count(*) FILTER (WHERE r <= {k}) AS worst_{n}_n, avg(m1) FILTER (WHERE r <= {k}) AS worst_{n}_mean, sum(m1) FILTER (WHERE r <= {k}) / nullif(sum(least(m1, 0)), 0) AS worst_{n}_share"


@query(
    "tail_contribution",
    f"""WITH r AS (SELECT side, m1, row_number() OVER (PARTITION BY side ORDER BY m1, oid) AS r, count(*) OVER (PARTITION BY side) AS observed FROM fills WHERE alpha = 50 AND m1 IS NOT NULL)
        SELECT side, max(observed) AS observed, sum(m1)::BIGINT AS total, sum(least(m1, 0))::BIGINT AS total_negative, {worst(0.01)}, {worst(0.05)}, {worst(0.1)},
               avg(m1) FILTER (WHERE r > greatest(round_even(observed * 0.1, 0), 1)) AS best_90_mean FROM r WHERE observed >= 100 GROUP BY 1""",
    dbl=" ".join(f"worst_{n}_{s}" for n in (1, 5, 10) for s in ("mean", "share")) + " best_90_mean",
)
def tail_contribution(v):
    f = marked_fills(v, (50,))
    return st.tail_share(f, ["side"], "m1", "oid", (0.01, 0.05, 0.1), 100, v.blocks(f, "m1", "events", 5, tie="oid"))


CLASS = f"CASE WHEN fill_us IS NULL THEN 'unfilled' WHEN mechanism = 'at_quote' THEN 'queue' WHEN fill_us - place_us <= {HOUR} THEN 'fast_sweep' ELSE 'slow_sweep' END"


@query("lifecycle_class", f"SELECT {CLASS} AS cls, count(*) AS n, {TAIL} FROM fills WHERE alpha = 100 GROUP BY 1", dbl=TAILD)
def lifecycle_class(v):
    f = marked_fills(v, (100,)).withColumn("cls", F.expr(CLASS))
    n = f.groupBy("cls").agg(F.count("*").alias("n"))
    return st.tail_distribution(f, ["cls"], "m1", [100, 200], fills_cut(v, f)).join(n, "cls")


@query(
    "block_bootstrap",
    """WITH b AS (SELECT side, sid, sum(m1) AS s, count(*) AS n, row_number() OVER (PARTITION BY side ORDER BY sid) AS pos FROM fills WHERE m1 IS NOT NULL GROUP BY 1, 2),
       t AS (SELECT side, count(*) AS nb, sum(s) / sum(n) AS mean FROM b GROUP BY 1),
       d AS (SELECT t.side, t.nb, dr.i AS draw, CAST('0x' || substr(md5(dr.i || ':' || sl.i), 1, 8) AS BIGINT) % nb + 1 AS pos FROM t, range(1, 501) dr(i), range(1, 1000) sl(i) WHERE sl.i <= nb),
       m AS (SELECT d.side, draw, sum(s) / sum(n) AS m FROM d JOIN b ON b.side = d.side AND b.pos = d.pos GROUP BY 1, 2)
       SELECT t.side, t.nb AS blocks, t.mean, quantile_cont(m.m, 0.05) AS p05, quantile_cont(m.m, 0.95) AS p95 FROM t JOIN m USING (side) GROUP BY 1, 2, 3""",
    dbl="mean p05 p95",
)
def block_bootstrap(v):
    sums = marked_fills(v).where("m1 IS NOT NULL").groupBy("side", "sid").agg(F.sum("m1").alias("s"), F.count("*").alias("n"))
    return st.block_bootstrap(sums, ["side"], "sid", 500)

"""Queries for Structured Streaming jobs (T1-T6), run over the whole events file."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.plans.registry import query
from tickloom.plans.views import HOUR
from tickloom.streaming import streams as ss

LATE = "60 days"


def source(v):
    return ss.event_stream(v.spark, v.root, "events.parquet", LATE)


def stream_prints(v):
    return source(v).select("seg", "at", "ts_us", F.col("event_type").isin("purchase", "click").alias("is_buy"), (F.col("k") + 1).alias("qty"))


@query(
    "stream_trade_buckets",
    f"""SELECT seg, CAST(ceil(ts_us / {HOUR}) AS BIGINT) * {HOUR} AS g_us, coalesce(sum(qty) FILTER (WHERE is_buy), 0)::BIGINT AS buy_qty, coalesce(sum(qty) FILTER (WHERE NOT is_buy), 0)::BIGINT AS sell_qty, count(*) AS n FROM prints GROUP BY 1, 2""",
)
def stream_trade_buckets(v):
    return ss.run_to_table(ss.trade_buckets(stream_prints(v), ["seg"], "1 hour"), "update", ["seg", "g_us"])


@query(
    "stream_rolling_flow",
    f"""SELECT seg, (CAST(ceil(ts_us / {HOUR}) AS BIGINT) + i) * {HOUR} AS g_us, sum(qty)::BIGINT AS qty, count(*) AS n FROM prints, range(0, 3) t(i) GROUP BY 1, 2""",
)
def stream_rolling_flow(v):
    return ss.run_to_table(ss.rolling_flow(stream_prints(v), ["seg"], "3 hours", "1 hour"), "update", ["seg", "g_us"])


@query(
    "stream_sessions",
    f"""WITH a AS (SELECT seg, ts_us, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY seg ORDER BY ts_us) < {HOUR} THEN 0 ELSE 1 END AS st FROM prints), b AS (SELECT *, sum(st) OVER (PARTITION BY seg ORDER BY ts_us) AS s FROM a)
        SELECT seg, min(ts_us) AS start_us, max(ts_us) + {HOUR} AS end_us, count(*) AS n FROM b GROUP BY seg, s""",
)
def stream_sessions(v):
    return ss.run_to_table(ss.activity_sessions(stream_prints(v), ["seg"], "1 hour"), "complete")


@query(
    "stream_sequence_gap",
    """WITH e AS (SELECT ord // 100 AS seg, ts_us, ord, ord * 3 + 2 AS last_u, ord * 3 - CASE WHEN ord % 31 = 0 THEN 4 ELSE 1 END AS prev_u FROM ev WHERE ord % 97 <> 0),
            t AS (SELECT *, max(last_u) OVER (PARTITION BY seg ORDER BY ts_us, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e)
       SELECT seg, CASE WHEN top IS NULL THEN 'first' WHEN last_u <= top THEN 'stale' WHEN prev_u > top THEN 'gap' WHEN prev_u < top THEN 'overlap' ELSE 'contiguous' END AS status, count(*) AS n
       FROM t GROUP BY 1, 2""",
)
def stream_sequence_gap(v):
    # One symbol per hundred consecutive ids, so that ids run on inside a symbol.
    e = source(v).where("ord % 97 <> 0").select(
        F.expr("ord div 100").alias("seg"), "ts_us", "ord", (F.col("ord") * 3 + 2).alias("last_u"), (F.col("ord") * 3 - F.when(F.col("ord") % 31 == 0, 4).otherwise(1)).alias("prev_u")
    )
    return ss.sequence_status(e, ["seg"], ["ts_us", "ord"]).groupBy("seg", "status").agg(F.count("*").alias("n"))


@query("stream_dedupe", "SELECT seg, k, count(DISTINCT (event_type, ts_us // 86400000000)) AS n FROM ev GROUP BY 1, 2")
def stream_dedupe(v):
    e = source(v).select("seg", "k", "event_type", F.expr("ts_us div 86400000000").alias("day"), "at")
    d = ss.run_to_table(ss.first_sightings(e, ["seg", "k", "event_type", "day"]), "append")
    return d.groupBy("seg", "k").agg(F.count("*").alias("n"))


@query(
    "stream_quality_counters",
    "SELECT seg, count(*) AS events, count(*) FILTER (WHERE k IS NULL OR k % 10 = 9) AS parse_failures, count(*) FILTER (WHERE value < 1) AS small_values, max(ts_us) AS last_us FROM ev GROUP BY 1",
)
def stream_quality_counters(v):
    return ss.quality_counters(source(v))[0]

"""Queries for scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.plans.registry import query
from tickloom.sources import typed


def _level_rows(v):
    return v.levels.select(
        F.lit("demo").alias("exchange"),
        F.concat(F.lit("S"), F.col("seg")).alias("symbol"),
        F.col("ts_us").alias("timestamp"),
        F.col("ts_us").alias("local_timestamp"),
        (F.col("ord") % 10 == 0).alias("is_snapshot"),
        "side",
        F.col("px").cast("decimal(18,4)").alias("price"),
        F.col("qty").cast("decimal(18,4)").alias("amount"),
    )


def _trade_rows(v):
    side = F.when(F.col("ord") % 17 == 0, "unknown").when(F.col("is_buy"), "buy").otherwise("sell")
    return v.prints.select(
        F.lit("demo").alias("exchange"),
        F.concat(F.lit("S"), F.col("seg")).alias("symbol"),
        F.col("ts_us").alias("timestamp"),
        F.col("ts_us").alias("local_timestamp"),
        F.col("ord").cast("string").alias("id"),
        side.alias("side"),
        (F.col("px") + 1).cast("decimal(18,4)").alias("price"),
        F.col("qty").cast("decimal(18,4)").alias("amount"),
    )


def _as_csv(v, df, name, codec=None):
    path = typed.scratch_dir(v.spark, name)
    w = df.write.option("header", True)
    (w.option("compression", codec) if codec else w).csv(path)
    return path


@query(
    "scan_typed_csv",
    """SELECT 'S' || seg AS symbol, side, count(*) AS n, count(*) FILTER (WHERE ord % 10 = 0) AS snapshot_rows,
              min(ts_us) AS first_us, max(ts_us) AS last_us, sum(px)::BIGINT AS px_sum, sum(qty)::BIGINT AS qty_sum
       FROM levels GROUP BY 1, 2""",
)
def scan_typed_csv(v):
    df = typed.scan_levels(v.spark, _as_csv(v, _level_rows(v), "levels"))
    return df.groupBy("symbol", "side").agg(
        F.count("*").alias("n"),
        F.count_if("is_snapshot").alias("snapshot_rows"),
        F.min("timestamp").alias("first_us"),
        F.max("local_timestamp").alias("last_us"),
        F.sum("price").cast("bigint").alias("px_sum"),
        F.sum("amount").cast("bigint").alias("qty_sum"),
    )


@query(
    "scan_trades",
    """SELECT 'S' || seg AS symbol,
              CASE WHEN ord % 17 = 0 THEN 'unknown' WHEN is_buy THEN 'buy' ELSE 'sell' END AS side,
              count(*) AS n, sum((px + 1) * qty)::BIGINT AS notional, max(ord) AS last_id
       FROM prints GROUP BY 1, 2""",
)
def scan_trades(v):
    df = typed.scan_trades(v.spark, _as_csv(v, _trade_rows(v), "trades"))
    return df.groupBy("symbol", "side").agg(
        F.count("*").alias("n"),
        F.sum(F.col("price") * F.col("amount")).cast("bigint").alias("notional"),
        F.max(F.col("id").cast("bigint")).alias("last_id"),
    )


@query(
    "scan_required_columns",
    "SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1",
)
def scan_required_columns(v):
    need = {"event_id": "bigint", "event_type": "string"}
    df = typed.scan_required(v.spark, f"{v.root}/events.parquet", need)
    return df.groupBy("event_type").agg(
        F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query(
    "scan_pruned_filtered",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem
       WHERE l_returnflag = 'R' AND l_discount = 0.05 AND l_quantity >= 45""",
    dbl="l_quantity",
)
def scan_pruned_filtered(v):
    df = v.read("lineitem").where("l_returnflag = 'R' AND l_discount = 0.05D AND l_quantity >= 45")
    return df.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "scan_compressed_csv",
    "SELECT side, sum(px)::BIGINT AS px_sum, count(*) AS n FROM levels GROUP BY 1",
)
def scan_compressed_csv(v):
    path = _as_csv(v, _level_rows(v), "levels-gz", "gzip")
    df = typed.scan_csv(v.spark, path, typed.LEVEL_SCHEMA, ["side", "price"])
    return df.groupBy("side").agg(F.sum("price").cast("bigint").alias("px_sum"), F.count("*").alias("n"))


@query(
    "union_sources_tagged",
    """SELECT source_id, source_id || ':' || seg AS segment_key, count(*) AS n,
              min(ts_us) AS first_us, max(ts_us) AS last_us
       FROM (SELECT 'prints' AS source_id, seg, ts_us FROM prints UNION ALL SELECT 'levels', seg, ts_us FROM levels)
       GROUP BY 1, 2""",
)
def union_sources_tagged(v):
    cols = ["seg", "ts_us"]
    both = typed.union_tagged({"prints": v.prints.select(*cols), "levels": v.levels.select(*cols)}, "seg")
    return both.groupBy("source_id", "segment_key").agg(
        F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")
    )


@query(
    "sink_partitioned",
    """SELECT seg, strftime(make_timestamp(ts_us), '%Y-%m-%d') AS date, count(*) AS n, sum(qty)::BIGINT AS qty
       FROM prints GROUP BY 1, 2""",
)
def sink_partitioned(v):
    path = typed.scratch_dir(v.spark, "prints")
    dated = v.prints.withColumn("date", F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd"))
    typed.write_partitioned(dated, path, ["date"])
    back = v.spark.read.parquet(path).withColumn("date", F.col("date").cast("string"))
    return back.groupBy("seg", "date").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query(
    "parse_json_payload",
    """SELECT ord, ts_us AS event_time, ord * 2 AS first_u, ord * 2 + 1 AS last_u, ord * 2 - 1 AS prev_u,
              px AS bid_px, qty AS bid_qty, CAST(1 AS BIGINT) AS n_bids, CAST(0 AS BIGINT) AS n_asks FROM prints""",
    dbl="bid_px bid_qty",
)
def parse_json_payload(v):
    text = F.to_json(
        F.struct(
            F.col("ts_us").alias("E"),
            F.col("ts_us").alias("T"),
            (F.col("ord") * 2).alias("U"),
            (F.col("ord") * 2 + 1).alias("u"),
            (F.col("ord") * 2 - 1).alias("pu"),
            F.array(F.array(F.col("px").cast("string"), F.col("qty").cast("string"))).alias("b"),
            F.array().cast("array<array<string>>").alias("a"),
        )
    )
    parsed = typed.parse_depth(v.prints.select("ord", text.alias("payload")))
    return parsed.select(
        "ord",
        "event_time",
        "first_u",
        "last_u",
        "prev_u",
        F.col("bids")[0].px.alias("bid_px"),
        F.col("bids")[0].qty.alias("bid_qty"),
        F.size("bids").alias("n_bids"),
        F.size("asks").alias("n_asks"),
    )


@query(
    "scan_klines_normalized",
    """SELECT market, epoch_us(o_orderdate) // 1000 AS ts, arg_max(o_totalprice, o_orderkey) AS close
       FROM (SELECT *, o_orderkey % 2 AS market FROM orders) WHERE o_orderkey % 101 <> 0 GROUP BY 1, 2""",
    dbl="close",
)
def scan_klines_normalized(v):
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    stamp = F.when(F.col("o_orderkey") % 3 == 0, us).otherwise(F.floor(us / 1000))
    raw = v.read("orders").select(
        (F.col("o_orderkey") % 2).alias("market"),
        "o_orderkey",
        stamp.cast("string").alias("open_time"),
        F.when(F.col("o_orderkey") % 101 == 0, "close").otherwise(F.col("o_totalprice").cast("string")).alias("close"),
    )
    return typed.normalize_klines(raw, ["market"], "open_time", ["close"], "o_orderkey")


@query(
    "frame_fingerprint",
    """SELECT count(*) AS rows, bit_xor(h) AS xor_hash, sum(h % 1000003)::BIGINT AS sum_hash
       FROM (SELECT CAST('0x' || substr(md5(concat_ws('|', seg, ts_us, ord, px, qty)), 1, 12) AS BIGINT) AS h FROM prints)""",
)
def frame_fingerprint(v):
    return typed.fingerprint(v.prints, ["seg", "ts_us", "ord", "px", "qty"])

"""Streaming results equal batch results, across several micro-batches."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators.ordered import ROWS_CONF
from tickloom.plans.views import Views
from tickloom.streaming import streams as ss

DIR = "/root/testdata/sf0.001"
HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events file cut into four time-ordered files, one per micro-batch."""
    root = str(tmp_path_factory.mktemp("parts"))
    e = spark.read.parquet(f"{DIR}/events.parquet").orderBy("ts").toPandas()
    for i in range(4):
        chunk = e.iloc[i * 250 : (i + 1) * 250]
        spark.createDataFrame(chunk, ss.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(root)
    return root


def source(spark, parts, late="60 days"):
    return ss.event_stream(spark, parts, "*.parquet", late)


def test_buckets_equal_batch(spark, parts):
    s = source(spark, parts).select("seg", "at", F.col("event_type").isin("purchase", "click").alias("is_buy"), (F.col("k") + 1).alias("qty"))
    got = ss.run_to_table(ss.trade_buckets(s, ["seg"], "1 hour"), "update", ["seg", "g_us"])
    p = Views(spark, DIR).prints
    want = p.groupBy("seg", (F.ceil(F.col("ts_us") / HOUR) * HOUR).alias("g_us")).agg(
        F.sum(F.when(F.col("is_buy"), F.col("qty")).otherwise(0)).alias("buy_qty"), F.sum(F.when(~F.col("is_buy"), F.col("qty")).otherwise(0)).alias("sell_qty"), F.count("*").alias("n")
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_counters_equal_observed(spark, parts):
    total, seen = ss.quality_counters(source(spark, parts))
    t = total.agg(F.sum("events").alias("n"), F.sum("parse_failures").alias("bad")).first()
    assert (t.n, t.bad) == (seen["rows"], seen["bad"]) and t.n == 1000


def test_dedupe_across_batches(spark, parts):
    s = source(spark, parts).select("seg", "event_type", "at")
    got = ss.run_to_table(ss.first_sightings(s, ["seg", "event_type"]), "append").count()
    assert got == Views(spark, DIR).ev.select("seg", "event_type").distinct().count()


def sequence(stream):
    return stream.select(
        F.when(F.col("ord") % 4 > 0, F.col("ord") % 4).alias("seg"), "ts_us", "ord", (F.col("ord") - F.col("ord") % 7 * 3).alias("last_u"), F.when(F.col("ord") % 5 == 0, -1).otherwise(F.col("ord") - 2).alias("prev_u")
    )


def plain_status(spark):
    tops, want = {}, []
    for _, o in sorted(Views(spark, DIR).ev.select("ts_us", "ord").collect()):
        seg, last, prev = (o % 4 or None), o - o % 7 * 3, -1 if o % 5 == 0 else o - 2
        top = tops.get(seg)
        want.append((o, "first" if top is None else "stale" if last <= top else "gap" if prev > top else "overlap" if prev < top else "contiguous"))
        tops[seg] = last if top is None else max(top, last)
    return sorted(want)


@pytest.mark.parametrize("rows", [None, "40"])
def test_sequence_status_carries_ids_across_batches(spark, parts, rows):
    if rows:
        spark.conf.set(ROWS_CONF, rows)  # every symbol of every batch is split into blocks
    try:
        got = ss.sequence_status(sequence(source(spark, parts)), ["seg"], ["ts_us", "ord"]).collect()
    finally:
        spark.conf.unset(ROWS_CONF)
    want = plain_status(spark)
    assert sorted((r.ord, r.status) for r in got) == want
    assert {s for _, s in want} >= {"first", "stale", "gap", "overlap"}


def test_sequence_status_goes_on_after_a_restart(spark, tmp_path):
    e = spark.read.parquet(f"{DIR}/events.parquet").orderBy("ts").toPandas()
    root, folder = str(tmp_path / "in"), str(tmp_path / "job")
    for i in range(3):
        spark.createDataFrame(e.iloc[i * 334 : (i + 1) * 334], ss.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(root)
        got = ss.sequence_status(sequence(source(spark, root)), ["seg"], ["ts_us", "ord"], folder)
        assert got.count() == min(334 * (i + 1), 1000)
    assert sorted((r.ord, r.status) for r in got.collect()) == plain_status(spark)

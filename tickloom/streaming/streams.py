"""Structured Streaming forms of the ingest operators. Each takes and returns a streaming frame;
on the same rows their results equal the batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.ordered import Blocks, join_keys, running
from tickloom.sources.typed import scratch_dir

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, root: str, pattern: str, late: str, files_per_trigger: int = 1) -> DataFrame:
    """File stream of raw events with a watermark on the event time."""
    s = (
        spark.readStream.schema(EVENT_SCHEMA)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(root)
    )
    at = F.col("ts").cast("timestamp")
    return s.select(
        F.col("event_id").alias("ord"), (F.col("user_id") % 10).alias("seg"), at.alias("at"), F.unix_micros(at).alias("ts_us"),
        "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    ).withWatermark("at", late)


def _bucket_end(window: str):
    return F.unix_micros(F.col(f"{window}.end"))


def trade_buckets(prints: DataFrame, keys: Sequence[str], width: str) -> DataFrame:
    """Prints per bucket (end - width, end]; rows later than the watermark are dropped."""
    before = F.col("at") - F.expr("INTERVAL 1 MICROSECOND")
    return prints.groupBy(*keys, F.window(before, width).alias("w")).agg(
        F.sum(F.when(F.col("is_buy"), F.col("qty")).otherwise(0)).alias("buy_qty"),
        F.sum(F.when(~F.col("is_buy"), F.col("qty")).otherwise(0)).alias("sell_qty"), F.count("*").alias("n"),
    ).select(*keys, _bucket_end("w").alias("g_us"), "buy_qty", "sell_qty", "n")


def rolling_flow(prints: DataFrame, keys: Sequence[str], width: str, slide: str) -> DataFrame:
    before = F.col("at") - F.expr("INTERVAL 1 MICROSECOND")
    return prints.groupBy(*keys, F.window(before, width, slide).alias("w")).agg(
        F.sum("qty").alias("qty"), F.count("*").alias("n")
    ).select(*keys, _bucket_end("w").alias("g_us"), "qty", "n")


def activity_sessions(events: DataFrame, keys: Sequence[str], gap: str) -> DataFrame:
    """Runs of events without a silence of ``gap``; the end is the last event plus the gap."""
    return events.groupBy(*keys, F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select(
        *keys, F.unix_micros("w.start").alias("start_us"), _bucket_end("w").alias("end_us"), "n"
    )


def first_sightings(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(list(keys))


def sequence_status(updates: DataFrame, keys: Sequence[str], order: Sequence[str], folder: str | None = None) -> DataFrame:
    """``updates(..., last_u, prev_u)`` with ``status``: how each follows the largest id of its key so far.

    ``first`` (nothing before), ``stale`` (brings nothing new), ``gap`` (its predecessor was never seen),
    ``overlap`` (starts inside what is known) or ``contiguous``. A micro-batch is ranked by a running maximum in
    blocks of its own rows, so that a symbol with most of them is split, and compared with the keys' largest ids of
    the batches before, a table of one row per key. Batch folders are overwritten on a retry, so each batch counts
    once. A later call with the same ``folder`` goes on after the last batch with the ids carried so far.
    """
    spark = updates.sparkSession
    root = folder or scratch_dir(spark, "sequence")
    at, *ties = order
    top = F.greatest("_carried", "_seen")
    status = (
        F.when(top.isNull(), "first").when(F.col("last_u") <= top, "stale").when(F.col("prev_u") > top, "gap")
        .when(F.col("prev_u") < top, "overlap").otherwise("contiguous")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        now = batch.groupBy(*keys).agg(F.max("last_u").alias("_carried"))
        before = batch.sparkSession.read.schema(now.schema).parquet(f"{root}/tops/{batch_id - 1}") if batch_id else now.limit(0)
        blocks = Blocks.fit(batch, at, tie=ties[0] if ties else None)
        rows = running(batch, keys, at, {"_seen": ("max", F.col("last_u"))}, blocks, ties, exclusive=True)
        rows = join_keys(rows, before, keys).withColumn("status", status)
        rows.drop("_carried", "_seen").write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")
        both = before.unionByName(now).groupBy(*keys).agg(F.max("_carried").alias("_carried"))
        both.write.mode("overwrite").parquet(f"{root}/tops/{batch_id}")

    w = updates.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    w.start().awaitTermination()
    return spark.read.parquet(f"{root}/rows").drop("batch")


def run_to_table(stream: DataFrame, mode: str, keys: Sequence[str] = ()) -> DataFrame:
    """Run what is available and return the result as a batch frame read from the shared folder.

    Append results are read as written. Update and complete results are written per micro-batch;
    the latest row of each key wins.
    """
    spark = stream.sparkSession
    out, state = scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-state")
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        w.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    w.foreachBatch(write).start().awaitTermination()
    got = spark.read.parquet(out).drop("batch")
    if mode == "complete":
        last = got.agg(F.max("_batch").alias("_last"))
        return got.crossJoin(F.broadcast(last)).where("_batch = _last").drop("_batch", "_last")
    rest = [c for c in stream.columns if c not in keys]
    return got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")


def quality_counters(events: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Running counters per segment: each micro-batch adds its partial counts to the shared folder.

    Also returns the totals that ``observe`` reported for the batches.
    """
    spark = events.sparkSession
    out, state = scratch_dir(spark, "counters"), scratch_dir(spark, "counters-state")
    seen: dict[str, int] = {"rows": 0, "bad": 0}
    bad = F.col("k").isNull() | (F.col("k") % 10 == 9)
    watched = events.withColumn("bad", bad)

    def write(batch: DataFrame, batch_id: int) -> None:
        from pyspark.sql import Observation

        o = Observation(f"quality{batch_id}")
        d = batch.observe(o, F.count(F.lit(1)).alias("rows"), F.count_if("bad").alias("bad"))
        part = d.groupBy("seg").agg(
            F.count("*").alias("events"), F.count_if("bad").alias("parse_failures"), F.count_if(F.col("value") < 1).alias("small_values"), F.max("ts_us").alias("last_us")
        )
        part.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        got = o.get
        seen["rows"] += int(got["rows"])
        seen["bad"] += int(got["bad"])

    w = watched.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True)
    w.start().awaitTermination()
    total = spark.read.parquet(out).groupBy("seg").agg(
        F.sum("events").alias("events"), F.sum("parse_failures").alias("parse_failures"), F.sum("small_values").alias("small_values"), F.max("last_us").alias("last_us")
    )
    return total, seen

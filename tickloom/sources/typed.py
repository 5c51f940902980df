"""Typed, header-checked scans and partitioned sinks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k, True) for n, k in kinds.items()])


# File layouts of the two event feeds.
LEVEL_SCHEMA = _fields(
    exchange=T.StringType(),
    symbol=T.StringType(),
    timestamp=T.LongType(),
    local_timestamp=T.LongType(),
    is_snapshot=T.BooleanType(),
    side=T.StringType(),
    price=T.DecimalType(18, 4),
    amount=T.DecimalType(18, 4),
)
TRADE_SCHEMA = _fields(
    exchange=T.StringType(),
    symbol=T.StringType(),
    timestamp=T.LongType(),
    local_timestamp=T.LongType(),
    id=T.StringType(),
    side=T.StringType(),
    price=T.DecimalType(18, 4),
    amount=T.DecimalType(18, 4),
)
PAIRS = T.ArrayType(T.ArrayType(T.StringType()))
DEPTH_PAYLOAD = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("E", "T", "u", "pu")]
    + [T.StructField("b", PAIRS), T.StructField("a", PAIRS)]
)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """New folder below the cluster's shared checkpoint folder; a single-JVM session without one gets a local folder."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        root = sc.getCheckpointDir()
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def guard(value: Column, ok: Column, message: str) -> Column:
    """The value, or a job failure when ``ok`` does not hold."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] = ()) -> DataFrame:
    """CSV whose header must equal the schema; a value that does not parse fails the job."""
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return df.select(*columns) if columns else df


def scan_levels(spark: SparkSession, path: str) -> DataFrame:
    df = scan_csv(spark, path, LEVEL_SCHEMA)
    return df.withColumns(
        {
            "side": guard(F.col("side"), F.col("side").isin("bid", "ask"), "bad book side"),
            "amount": guard(F.col("amount"), F.col("amount") >= 0, "bad book amount"),
        }
    )


def scan_trades(spark: SparkSession, path: str) -> DataFrame:
    df = scan_csv(spark, path, TRADE_SCHEMA)
    positive = (F.col("price") > 0) & (F.col("amount") > 0)
    return df.withColumns(
        {
            "side": guard(F.col("side"), F.col("side").isin("buy", "sell", "unknown"), "bad trade side"),
            "amount": guard(F.col("amount"), positive, "bad trade price or amount"),
        }
    )


def scan_required(spark: SparkSession, path: str, required: dict[str, str]) -> DataFrame:
    """Parquet with the required columns and types (column -> simple type name), and only those."""
    df = spark.read.parquet(path)
    have = dict(df.dtypes)
    wrong = {c: t for c, t in required.items() if have.get(c) != t}
    if wrong:
        raise ValueError(f"required columns missing or of another type: {wrong}")
    return df.select(*required)


def union_tagged(parts: dict[str, DataFrame], segment: str) -> DataFrame:
    """Sources stacked by name, each row stamped with its source and a ``source:segment`` key."""
    out = None
    for source, df in parts.items():
        part = df.withColumn("source_id", F.lit(source)).withColumn(
            "segment_key", F.concat_ws(":", F.lit(source), F.col(segment).cast("string"))
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no sources")
    return out


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """zstd parquet, one folder per partition value; a hot value is spread over many files by AQE."""
    (
        df.hint("rebalance", *by)
        .write.mode("overwrite")
        .partitionBy(*by)
        .option("compression", "zstd")
        .parquet(path)
    )


def write_report_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Small ordered report table as CSV."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def parse_depth(df: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON depth payloads as typed rows; levels become arrays of (px, qty) decimals."""
    d = df.withColumn("_d", F.from_json(payload, DEPTH_PAYLOAD, {"mode": "FAILFAST"}))

    def side(name: str) -> Column:
        return F.transform(
            F.col(f"_d.{name}"),
            lambda p: F.struct(
                p[0].cast("decimal(18,4)").alias("px"), p[1].cast("decimal(18,4)").alias("qty")
            ),
        )

    return d.select(
        *[c for c in df.columns if c != payload],
        F.col("_d.E").alias("event_time"),
        # Field access ignores case, so "U" cannot share a struct with "u".
        F.get_json_object(payload, "$.U").cast("bigint").alias("first_u"),
        F.col("_d.u").alias("last_u"),
        F.col("_d.pu").alias("prev_u"),
        side("b").alias("bids"),
        side("a").alias("asks"),
    )


def normalize_klines(df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], order: str) -> DataFrame:
    """All-string kline rows as numbers: header and bad rows go, microsecond stamps become
    milliseconds, and the last row (by ``order``) of a repeated stamp wins."""
    at = F.col(ts).try_cast("bigint")
    at = F.when(at > 100_000_000_000_000, F.expr(f"try_cast({ts} as bigint) div 1000")).otherwise(at)
    d = df.select(*keys, order, at.alias("ts"), *[F.col(v).try_cast("double").alias(v) for v in values])
    good = F.col("ts").isNotNull()
    for v in values:
        good = good & F.col(v).isNotNull()
    last = F.max_by(F.struct(*values), order).alias("_v")
    return d.where(good).groupBy(*keys, "ts").agg(last).select(*keys, "ts", "_v.*")


def fingerprint(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Order-free content checksum: row count, xor and sum of a 60-bit hash of every row."""
    cols = list(cols or df.columns)
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])
    h = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")
    return df.select(h.alias("_h")).agg(
        F.count("*").alias("rows"), F.bit_xor("_h").alias("xor_hash"), (F.sum(F.col("_h") % 1_000_003)).alias("sum_hash")
    )

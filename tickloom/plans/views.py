"""Fixture views: market-shaped frames over the given tables, shared by the registered queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import Blocks, asof, row_numbers, shifted
from tickloom.sources.tables import Tables

HOUR = 3_600_000_000
DAY = 24 * HOUR
SPAN = 5 * DAY


class Views(Tables):
    @cached_property
    def ev(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("ord"),
            (F.col("user_id") % 10).alias("seg"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
            "event_type",
            "value",
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
            "user_id",
        )

    @cached_property
    def time(self) -> Blocks:
        """Blocks of the event time axis, shared by every frame that lives on it."""
        return self.blocks(self.ev, "ts_us", "events", tag="ts_us")

    @cached_property
    def prints(self) -> DataFrame:
        return self.ev.select(
            "seg",
            "ts_us",
            "ord",
            F.col("event_type").isin("purchase", "click").alias("is_buy"),
            F.floor("value").alias("px"),
            (F.col("k") + 1).alias("qty"),
        )

    @cached_property
    def updates(self) -> DataFrame:
        n = row_numbers(self.ev.select("seg", "ts_us", "ord"), ["seg"], "ts_us", "rn", self.time, ["ord"])
        kept = n.where("ord % 97 <> 0").selectExpr(
            "seg", "ts_us", "ord", "rn * 3 AS first_u", "rn * 3 + 2 AS last_u", "rn * 3 - 1 AS prev_u"
        )
        copies = F.when(F.col("ord") % 53 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
            F.array(F.lit(0))
        )
        return (
            kept.withColumn("dup", F.explode(copies))
            .withColumn("ts_us", F.col("ts_us") + F.col("dup") * F.lit(HOUR))
            .withColumn("dup", F.col("dup").cast("bigint"))
        )

    def _levels(self, crossing: bool) -> DataFrame:
        is_bid = F.col("event_type").isin("view", "signup")
        v = F.floor("value")
        if crossing:
            px = 1000 + (F.col("k") % 41 - 20)
        else:
            px = F.when(is_bid, 1000 - F.col("k") % 20).otherwise(1001 + F.col("k") % 20)
        return self.ev.select(
            "seg",
            "ts_us",
            "ord",
            F.when(is_bid, "bid").otherwise("ask").alias("side"),
            px.alias("px"),
            F.when(v % 7 == 0, F.lit(0)).otherwise(v).cast("bigint").alias("qty"),
        )

    @cached_property
    def levels(self) -> DataFrame:
        return self._levels(False)

    @cached_property
    def levels_x(self) -> DataFrame:
        return self._levels(True)

    @cached_property
    def mids(self) -> DataFrame:
        return self.ev.select("seg", "ts_us", F.round(F.col("value") * 2).cast("bigint").alias("mid_x2"))

    @cached_property
    def grid(self) -> DataFrame:
        from tickloom.operators.state import aligned_grid

        ends = self.mids.groupBy("seg").agg(
            F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us")
        )
        steps = aligned_grid(ends, "start_us", "end_us", HOUR, "g_us").select("seg", "g_us")
        g = asof(steps, self.mids, ["seg"], "g_us", "ts_us", {"mid_x2": "mid_x2"}, self.time)
        return self.settled(g.select("seg", "g_us", F.expr(f"g_us div {SPAN}").alias("sid"), "mid_x2"), "grid", self.time)

    @cached_property
    def conn(self) -> DataFrame:
        return self.ev.select(
            "seg",
            "ts_us",
            F.when(F.col("k") < 50, "depth").otherwise("trade").alias("stream"),
            (F.floor("value") % 9 != 0).alias("is_open"),
        )

    @cached_property
    def segs(self) -> DataFrame:
        return self.prints.groupBy("seg", F.expr(f"ts_us div {SPAN}").alias("sid")).agg(
            F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us")
        )

    @cached_property
    def book10(self) -> DataFrame:
        def q(a: int, b: int, c: int) -> str:
            return f"transform(sequence(1, 10), i -> 1 + (seg * {a} + g_us div {HOUR} * {b} + i * {c}) % 50)"

        return self.grid.selectExpr(
            "seg",
            "g_us",
            "sid",
            "mid_x2",
            "transform(sequence(1, 10), i -> cast(1000 - i AS bigint)) AS bid_px",
            "transform(sequence(1, 10), i -> cast(1000 + i AS bigint)) AS ask_px",
            f"{q(31, 7, 13)} AS bid_qty",
            f"{q(17, 11, 29)} AS ask_qty",
        )

    @cached_property
    def orders_p(self) -> DataFrame:
        return self.ev.where("event_type = 'signup'").select(
            F.col("ord").alias("oid"),
            "seg",
            F.col("ts_us").alias("place_us"),
            (F.col("ts_us") + 6 * HOUR).alias("end_us"),
            F.when(F.col("ord") % 2 == 0, "bid").otherwise("ask").alias("side"),
            F.floor("value").alias("px"),
            F.col("k").alias("ahead"),
            F.lit(5).cast("bigint").alias("qty"),
        )

    @cached_property
    def scores(self) -> DataFrame:
        sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(n).alias("n")) for n, s in enumerate(("bid", "ask"))]))
        return self.grid.withColumn("s", sides).select(
            "seg",
            "g_us",
            "sid",
            "s.side",
            F.expr(f"cast((g_us div {HOUR} * 7 + seg * 13 + s.n * 29) % 100 as double) / 100").alias("p"),
        )

    @cached_property
    def mid_path(self) -> DataFrame:
        from tickloom.operators.state import mid_change_path

        return self.settled(mid_change_path(self.mids, ["seg"], "ts_us", "mid_x2", self.time), "mid-path", self.time)

    @cached_property
    def episodes(self) -> DataFrame:
        p = shifted(
            self.mid_path,
            ["seg"],
            "ts_us",
            {"end_us": (F.col("ts_us"), -1), "_next": (F.col("mid_x2"), -1)},
            self.time,
        )
        reason = (
            F.when(F.col("_next") > F.col("mid_x2"), "improved")
            .when(F.col("_next") < F.col("mid_x2"), "stepped_away")
            .otherwise("segment_end")
        )
        return p.select(
            "seg",
            F.col("ts_us").alias("start_us"),
            "end_us",
            "mid_x2",
            F.col("ts_us").alias("eid"),
            reason.alias("close_reason"),
        )

    @cached_property
    def opps(self) -> DataFrame:
        cents = F.round(F.col("value") * 100).cast("bigint")
        both = F.array(
            F.struct(F.lit("bid").alias("side"), cents.alias("signed")),
            F.struct(F.lit("ask").alias("side"), (-cents).alias("signed")),
        )
        return self.ev.select("ord", "seg", "ts_us", F.inline(both))

    @cached_property
    def bars(self) -> DataFrame:
        day = F.expr("unix_micros(cast(o_orderdate as timestamp)) div 86400000000")
        return (
            self.read("orders")
            .groupBy((F.col("o_orderkey") % 2).alias("market"), day.alias("day"))
            .agg(
                F.min_by("o_totalprice", "o_orderkey").alias("open"),
                F.max_by("o_totalprice", "o_orderkey").alias("close"),
                F.count("*").alias("volume"),
            )
        )

    @cached_property
    def funding(self) -> DataFrame:
        day = F.expr("unix_micros(cast(l_shipdate as timestamp)) div 86400000000")
        rate = F.sum(F.round(F.col("l_discount") * 100).cast("bigint")) - 5 * F.count("*")
        return self.read("lineitem").groupBy(day.alias("day")).agg(rate.alias("rate"))

    @cached_property
    def lifecycle(self) -> DataFrame:
        kind = (
            F.when(F.col("event_type") == "signup", "placed")
            .when(F.col("event_type") == "view", "updated")
            .when(F.col("event_type") == "error", "cancelled")
            .when(F.col("event_type") == "purchase", "filled")
            .otherwise("execution")
        )
        return self.ev.select(
            "ord", F.col("user_id").alias("uid"), "ts_us", "value", "k", kind.alias("kind")
        )

    @cached_property
    def wide(self) -> DataFrame:
        def cents(c: str):
            return F.sum(F.round(F.col(c) * 100).cast("bigint"))

        g = self.read("lineitem").groupBy(F.col("l_orderkey").alias("id"))
        w = g.agg(
            F.sum(F.col("l_quantity").cast("bigint")).alias("x1"),
            cents("l_discount").alias("x2"),
            cents("l_tax").alias("x3"),
            F.count("*").alias("n_lines"),
            cents("l_extendedprice").alias("_p"),
        )
        w = w.select(
            "id",
            (F.col("id") % 8).alias("grp"),
            (F.col("id") % 30).alias("blk"),
            "x1",
            "x2",
            "x3",
            "n_lines",
            F.when(F.col("id") % 11 != 0, F.col("_p") % 2001 - 1000).alias("y"),
        )
        return self.written_if_large(w, "wide", "lineitem")

    @cached_property
    def marks(self) -> DataFrame:
        """Grid with a 3-step backward signal and markouts 1, 6 and 24 steps ahead, per (seg, sid)."""
        m = F.col("mid_x2")
        d = shifted(
            self.grid,
            ["seg", "sid"],
            "g_us",
            {"_b3": (m, 3), "_f1": (m, -1), "_f6": (m, -6), "_f24": (m, -24)},
            self.time,
        )
        d = d.select(
            "seg",
            "sid",
            "g_us",
            "mid_x2",
            (m - F.col("_b3")).alias("sig"),
            *[(F.col(f"_f{n}") - m).alias(f"m{n}") for n in (1, 6, 24)],
        )
        return self.settled(d, "marks", self.time)

    def value_blocks(self, df: DataFrame, col: str, table: str = "lineitem", per_row: float = 1.0, tie: str | None = None) -> Blocks:
        """Blocks of a value axis, for ranks and quantiles; sampled only when the source is large."""
        return self.blocks(df, col, table, per_row, tie=tie)

    def cut(self, df: DataFrame, table: str, per_row: float = 1.0):
        """Column -> Blocks of its values in ``df``, whose rows are bounded by a source table."""
        return lambda c: self.blocks(df, c, table, per_row)

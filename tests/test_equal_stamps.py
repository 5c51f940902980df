"""Rows of one stamp: SQL's default frame takes them together; where the order among them is open, ``ord`` decides."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators import hygiene as h
from tickloom.operators import ordered as o
from tickloom.operators import windows as w


@pytest.fixture(params=[False, True])
def cut(spark, request):
    if request.param:
        spark.conf.set(o.ROWS_CONF, "2")
    yield lambda df, c: o.Blocks.fit(df, c)
    spark.conf.unset(o.ROWS_CONF)


def frame(spark, rows, cols):
    return spark.createDataFrame(rows, "k long, t long, ord long, " + cols)


def by_ord(df, *cols):
    return [tuple(r) for r in df.orderBy("ord").select(*cols).collect()]


def test_drawdown_takes_equal_stamps_together(spark, cut):
    d = frame(spark, [(0, 1, 0, 4), (0, 2, 1, -3), (0, 2, 2, 5), (0, 3, 3, -2)], "x long")
    got = w.drawdown_curve(d, ["k"], "t", "x", cut(d, "t"))
    assert by_ord(got, "cum", "peak") == [(4, 4), (6, 6), (6, 6), (4, 6)]


def test_age_sees_rows_of_the_same_stamp(spark, cut):
    d = frame(spark, [(0, 1, 0, "a"), (0, 5, 1, "b"), (0, 5, 2, "a"), (0, 6, 3, "b")], "e string")
    got = w.time_since_last(d, ["k"], "t", {"since": F.col("e") == "a"}, cut(d, "t"))
    assert by_ord(got, "since") == [(0,), (0,), (0,), (1,)]


def test_messages_number_equal_stamps_together(spark, cut):
    rows = [(0, 1, 0, "bid", 9, 1, False), (0, 2, 1, "bid", 8, 9, True), (0, 2, 2, "bid", 7, 1, False), (0, 2, 3, "bid", 6, 9, True)]
    d = frame(spark, rows, "side string, px long, qty long, big boolean")
    got = h.rows_to_messages(d, ["k"], "t", ["big"], cut(d, "t"), ["ord"])
    got = [(r.msg, r.big, [x.px for x in r.bids]) for r in got.orderBy("msg", "big").collect()]
    assert got == [(1, False, [9]), (4, False, [7]), (4, True, [8, 6])]


def test_streaks_number_equal_stamps_together(spark, cut):
    d = frame(spark, [(0, 1, 0, True), (0, 2, 1, False), (0, 2, 2, True), (0, 3, 3, True)], "up boolean")
    got = w.signed_streak(d, ["k"], "t", F.col("up"), "s", cut(d, "t"), ["ord"])
    assert by_ord(got, "s") == [(1,), (-1,), (2,), (3,)]


def test_copies_and_rows_of_one_position_go_by_ord(spark, tmp_path):
    """The copy of row 53 has the position of row 253, which comes after it."""
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, 10::BIGINT AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{{"k": 1}}' AS props
        FROM (VALUES (53), (153), (253)) v(i)) TO '{tmp_path}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = [tuple(r) for r in entry.queries()["order_regressions"](spark, str(tmp_path)).collect()]
    assert got == con.execute(entry.oracle_sql()["order_regressions"]).fetchall() == [(0, 4, 1, 1)]


def test_next_row_of_equal_stamps_is_the_first_by_ord(spark, cut):
    d = frame(spark, [(0, 1, 0, 0)] + [(0, 2, i, i) for i in (5, 3, 9, 4)], "x long")
    got = o.asof(d.where("t = 1"), d, ["k"], "t", "t", {"x": "nx"}, cut(d, "t"), ["ord"], forward=True, strict=True)
    assert by_ord(got, "nx") == [(3,)]

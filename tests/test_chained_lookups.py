"""Chained lookups: left rows are read once, also in blocks where the other side has no row; same hits as one window."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import ordered as o
from tickloom.plans.joins import marked_fills
from tickloom.plans.views import Views


def leaves(df):
    return df._jdf.queryExecution().analyzed().collectLeaves().size()


@pytest.fixture
def sides(spark):
    rng = random.Random(5)
    near = [(rng.choice([None, 0, 1, 2]), rng.choice([None, *range(0, 900, 7)]), i) for i in range(500)]
    # Right rows only at few places, so most blocks hold left rows alone.
    far = [(rng.choice([None, 0, 1]), rng.choice([None, 3, 4, 450, 890]), i % 3, i) for i in range(40)]
    left = spark.createDataFrame(near, "k long, t long, i long")
    right = spark.createDataFrame(far, "k long, u long, tie long, x long").groupBy("k", "u", "tie").agg(F.max("x").alias("x"))
    spark.conf.set(o.ROWS_CONF, "60")
    try:
        yield left, right, o.Blocks.fit(left, "t")
    finally:
        spark.conf.unset(o.ROWS_CONF)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
def test_blocks_without_right_rows(sides, forward, strict):
    left, right, blocks = sides
    assert len(blocks.splits) > 5
    how = {"forward": forward, "strict": strict}
    got = o.asof(left, right, ["k"], "t", "u", {"x": "x"}, blocks, ["tie"], chained=True, **how)
    want = o.asof(left, right, ["k"], "t", "u", {"x": "x"}, right_ties=["tie"], **how)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_left_rows_are_read_once(sides):
    left, right, blocks = sides
    d = left
    for i in range(4):
        d = o.asof(d, right, ["k"], "t", "u", {"x": f"x{i}"}, blocks, ["tie"], chained=True)
    assert leaves(d) == 1 + 4 * 2


def test_fills_have_the_markouts_that_are_read(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    assert "m6" not in marked_fills(v, (50,)).columns
    assert {"m1", "m6"} <= set(marked_fills(v, (50,), ("m1", "m6")).columns)

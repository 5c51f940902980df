"""Blocks that divide equal values: order kept, no block much larger than the others, ranks as in one window."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import ordered as o
from tickloom.operators.stats import tail_share
from tickloom.operators.windows import rank_deciles


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    data = [(i % 2, 5.0 if rng.random() < 0.8 else rng.choice([None, float("nan"), float(rng.randrange(10))]), rng.randrange(-4000, 4000) * 1000 + i) for i in range(6000)]
    return spark.createDataFrame(data, "k long, x double, uid long").cache()


@pytest.fixture
def cut(spark, rows):
    spark.conf.set(o.ROWS_CONF, "500")
    yield o.Blocks.fit(rows, "x", tie="uid")
    spark.conf.unset(o.ROWS_CONF)


def test_equal_values_divide(rows, cut):
    got = cut.assign(rows.where("x IS NOT NULL AND NOT isnan(x)"), "x", ties=["uid"])
    sizes = [r["count"] for r in got.groupBy(o.BLOCK).count().collect()]
    assert len(sizes) >= 9 and max(sizes) < 2 * sum(sizes) / len(sizes)
    plain = [r["count"] for r in cut.assign(rows.where("x = 5"), "x").groupBy(o.BLOCK).count().collect()]
    assert len(plain) == 1  # without the tie one value is one block


def test_blocks_follow_the_order(rows, cut):
    got = cut.assign(rows.where("x IS NOT NULL"), "x", ties=["uid"]).groupBy(o.BLOCK).agg(F.min(F.struct("x", "uid")).alias("a"), F.max(F.struct("x", "uid")).alias("b")).orderBy(o.BLOCK).collect()
    key = lambda s: (s.x != s.x, s.x if s.x == s.x else 0, s.uid)
    assert all(key(p.b) < key(q.a) for p, q in zip(got, got[1:]))


@pytest.mark.parametrize("reverse", [False, True])
def test_row_numbers(rows, cut, reverse):
    one, many = (o.row_numbers(rows, ["k"], "x", "n", b, ["uid"], reverse) for b in (o.ONE_BLOCK, cut))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))


def test_deciles_and_tails(rows, cut):
    known = rows.where("NOT isnan(x) OR x IS NULL")
    one, many = (rank_deciles(known, ["k"], "x", "uid", "d", 10, b) for b in (o.ONE_BLOCK, cut))
    assert sorted(map(repr, one.select("k", "x", "uid", "d").collect())) == sorted(map(repr, many.select("k", "x", "uid", "d").collect()))
    signed = known.withColumn("y", 4 - F.col("x"))
    one, many = (tail_share(signed, ["k"], "x", "uid", (0.05, 0.1), 10, b).collect() for b in (o.ONE_BLOCK, cut))
    assert sorted(map(repr, one)) == sorted(map(repr, many))

"""Chains of steps in blocks: each step settles its rows, so a plan doesn't double with every step."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators import ordered as o


@pytest.fixture
def cut(spark):
    spark.conf.set(o.ROWS_CONF, "100")
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), (F.col("id") % 7).alias("x"))
    yield df, o.Blocks.fit(df, "t")
    spark.conf.unset(o.ROWS_CONF)


def leaves(df):
    return df._jdf.queryExecution().analyzed().collectLeaves().size()


def test_chain_has_few_readers(cut):
    df, blocks = cut
    d = df
    for i in range(4):
        d = o.running(d, ["k"], "t", {f"s{i}": ("sum", F.col("x"))}, blocks)
        d = o.asof(d, df, ["k"], "t", "t", {"x": f"x{i}"}, blocks)
        d = o.shifted(d, ["k"], "t", {f"p{i}": (F.col("x"), 1)}, blocks)
    assert leaves(d) == 1
    got = d.select("s3", "x3", "p3", "k", "t").collect()
    one = o.shifted(o.running(df, ["k"], "t", {"s3": ("sum", F.col("x"))}), ["k"], "t", {"p3": (F.col("x"), 1)})
    want = one.select("s3", F.col("x").alias("x3"), "p3", "k", "t").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_fills_are_read_from_one_table(spark):
    from tickloom.plans.joins import marked_fills
    from tickloom.plans.views import Views

    spark.conf.set(o.ROWS_CONF, "600")
    try:
        assert leaves(marked_fills(Views(spark, "/root/testdata/sf0.001"), (50,))) == 1
    finally:
        spark.conf.unset(o.ROWS_CONF)

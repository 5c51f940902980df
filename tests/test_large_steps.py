"""Large frames: rows of a step in blocks are shuffled once, Python steps get blocks of their own, wide frames are written."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import ordered, state
from tickloom.operators.ordered import ONE_BLOCK, Blocks, running
from tickloom.plans.views import Views


@pytest.fixture
def small_blocks(spark):
    spark.conf.set(ordered.ROWS_CONF, "1000")
    yield
    spark.conf.unset(ordered.ROWS_CONF)


def test_wide_is_written_once(spark, small_blocks):
    v = Views(spark, "/root/testdata/sf0.001")
    assert not any("lineitem" in f for f in v.wide.inputFiles())


def test_wide_stays_a_plan_where_it_fits(spark):
    assert all("lineitem" in f for f in Views(spark, "/root/testdata/sf0.001").wide.inputFiles())


def test_running_in_blocks_has_no_join(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, *range(40)]), i, rng.choice([None, *range(9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, o int, x int")
    outs = {n: (n, F.col("x")) for n in ("sum", "count", "min", "max", "first", "last")}
    blocks = Blocks((7.0, 20.0, 33.0), 10)
    for kind in ({}, {"exclusive": True}, {"reverse": True}, {"peers": True}, {"exclusive": True, "reverse": True}):
        cut = running(df, ["k"], "t", outs, blocks, ["o"], settle=False, **kind)
        whole = running(df, ["k"], "t", outs, ONE_BLOCK, ["o"], **kind)
        assert "Join" not in cut._jdf.queryExecution().optimizedPlan().toString()
        assert cut.dtypes == whole.dtypes
        assert sorted(cut.collect(), key=lambda r: r.o) == sorted(whole.collect(), key=lambda r: r.o)


def test_python_steps_have_smaller_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "PYTHON_ROWS", 50)
    rng = random.Random(4)
    rows = [("a", i, i, rng.choice(["bid", "ask"]), rng.randint(1, 9), rng.randint(0, 3)) for i in range(400)]
    levels = spark.createDataFrame(rows, "seg string, ts bigint, ord bigint, side string, px bigint, qty bigint")
    blocks = Blocks.fit(levels, "ts", python=True)
    assert blocks.single and len(blocks.for_python.splits) == 7
    assert Blocks.fit(levels, "ts", bound=40, python=True).for_python.single
    counts = blocks.for_python.assign(levels, "ts").groupBy(ordered.BLOCK).count().collect()
    assert max(r["count"] for r in counts) <= 60
    sweeps = [state.book_after_updates(levels, ["seg"], "ts", "ord", b).collect() for b in (blocks, ONE_BLOCK)]
    assert sorted(sweeps[0], key=lambda r: r.ord) == sorted(sweeps[1], key=lambda r: r.ord)

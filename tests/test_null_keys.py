"""Blocked and single-window forms give the same rows with NULL keys, NULL order values and ties."""

import random

from pyspark.sql import functions as F

from tickloom.operators import ordered as o
from tickloom.operators.stats import with_group_stats
from tickloom.operators.windows import quantile_buckets

ONE = o.ONE_BLOCK


def frame(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        at = None if i % 9 == 0 else 5 if i % 3 == 0 else rng.randrange(300)
        rows.append((rng.choice([None, "a", "b"]), at, i, rng.choice([None, float("nan"), 1.0, 2.5, 2.5, float(rng.randrange(9))])))
    return spark.createDataFrame(rows, "k string, at long, id long, x double")


def blocks(at):
    return o.Blocks(splits=at, rows=100)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    rows = [sorted(map(repr, d.select(sorted(d.columns)).collect())) for d in (a, b)]
    assert rows[0] == rows[1]


def test_running_forward_and_back(spark):
    d = frame(spark)
    outs = {"s": ("sum", F.col("id")), "c": ("count", F.col("x")), "l": ("last", F.col("x")), "f": ("first", F.col("id")), "m": ("max", F.col("id"))}
    for reverse in (False, True):
        for exclusive in (False, True):
            one, many = (o.running(d, ["k"], "at", outs, b, ["id"], exclusive, reverse) for b in (ONE, blocks((5.0, 80.0, 200.0))))
            same(one, many)


def test_shifted(spark):
    d = frame(spark)
    outs = {"p": (F.col("id"), 2), "n": (F.col("id"), -1)}
    same(*(o.shifted(d, ["k"], "at", outs, b, ["id"]) for b in (ONE, blocks((5.0, 80.0)))))


def test_ranks_buckets_and_group_stats(spark):
    d = frame(spark).where("x IS NULL OR NOT isnan(x)")
    cuts = blocks((2.0, 4.0))
    same(*(o.average_ranks(d, ["k"], "x", "r", b) for b in (ONE, cuts)))
    same(*(quantile_buckets(d, ["k"], "x", "q", 4, b) for b in (ONE, cuts)))
    same(*(with_group_stats(d, ["k"], {"n": F.count("*"), "m": F.max("id")}, b) for b in (ONE, cuts)))


def test_asof(spark):
    d = frame(spark)
    right = d.where("id % 4 = 0 AND at IS NOT NULL").select("k", F.col("at").alias("rat"), F.col("id").alias("rid"))
    same(*(o.asof(d, right, ["k"], "at", "rat", {"rid": "hit"}, b, ["rid"]) for b in (ONE, blocks((5.0, 80.0)))))

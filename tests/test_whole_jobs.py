"""Variants that do the whole of the survey's jobs where the text of a registered query leaves a part out."""

import pytest
from test_oracles import DIR, compare, duck  # noqa: F401

import __spark_entry__ as entry
from tickloom.operators.ordered import ROWS_CONF
from tickloom.plans.joins import ALPHAS


@pytest.mark.parametrize("rows", [None, "150"])
@pytest.mark.parametrize("key", ["policy_queue_metrics", "window_flow_ratios"])
def test_variant(spark, duck, key, rows):  # noqa: F811
    if rows:
        spark.conf.set(ROWS_CONF, rows)
    try:
        compare(spark, duck, key)
    finally:
        spark.conf.unset(ROWS_CONF)


def test_policies_under_every_queue_share(spark):
    got = entry.queries()["policy_queue_metrics"](spark, DIR).cache()
    assert {r.alpha for r in got.select("alpha").distinct().collect()} == set(ALPHAS)
    one = entry.queries()["policy_metrics"](spark, DIR)
    assert sorted(map(repr, got.where("alpha = 100").drop("alpha").collect())) == sorted(map(repr, one.collect()))
    # Who is eligible doesn't depend on the share assumed of the queue.
    assert got.groupBy("policy", "day", "side").agg({"candidates": "min"}).count() * len(ALPHAS) == got.count()


def test_windows_have_order_flow(spark):
    got = entry.queries()["window_flow_ratios"](spark, DIR).cache()
    assert got.where("normalized_ofi <> 0").count() > 0
    assert got.where("normalized_ofi IS NOT NULL AND NOT window_valid").count() == 0
    cols = ["seg", "g_us", "imbalance", "avg_size", "intensity", "valid"]
    one = entry.queries()["window_ratios"](spark, DIR)
    assert sorted(map(repr, got.select(cols).collect())) == sorted(map(repr, one.select(cols).collect()))

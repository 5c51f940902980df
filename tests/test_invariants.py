"""Rules every operator keeps: no crossing of gaps, censoring, causality, identities, mirror symmetry."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators import labels as lb
from tickloom.operators import windows as w
from tickloom.operators.ordered import asof
from tickloom.plans import joins, state, stats_signal
from tickloom.plans.views import HOUR, Views
from tickloom.sources import typed

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, DIR)


def test_labels_do_not_cross_segments(spark):
    rows = [(s, t, 100 + 7 * s + t) for s in (1, 2) for t in range(10)]
    df = spark.createDataFrame(rows, "seg bigint, t bigint, mid bigint")
    d = lb.grid_markouts(df, ["seg"], "t", "mid", {"m": 3})
    assert d.where("t >= 7 AND m IS NOT NULL").count() == 0
    assert d.where("t < 7 AND m <> 3").count() == 0


def test_unobserved_outcomes_are_null(spark):
    df = spark.createDataFrame([(5, 100), (None, 100), (None, 3)], "latency bigint, remaining bigint")
    got = [r.y for r in df.select(lb.moved_within(F.col("latency"), F.col("remaining"), 10).alias("y")).collect()]
    assert got == [1, 0, None]


def test_features_are_causal(v):
    """Later events never change a trailing sum."""
    cut = v.prints.agg(F.percentile("ts_us", F.lit(0.5)).cast("bigint").alias("c")).first()["c"]
    sums = {"q": (F.col("qty"), 12 * HOUR)}
    full = w.trailing_sums(v.prints, ["seg"], "ts_us", sums).where(F.col("ts_us") <= cut).select("ord", "q")
    part = w.trailing_sums(v.prints.where(F.col("ts_us") <= cut), ["seg"], "ts_us", sums).select("ord", "q")
    assert full.exceptAll(part).count() == 0


def test_print_at_placement_cannot_fill(spark):
    from tickloom.operators.joins import threshold_fills

    o = spark.createDataFrame([(1, 1, 10, 20, "bid", 100, 0, 1)], "oid bigint, seg bigint, place_us bigint, end_us bigint, side string, px bigint, ahead bigint, qty bigint")
    p = spark.createDataFrame([(1, 10, 0, "bid", 99, 5), (1, 20, 1, "bid", 99, 5)], "seg bigint, ts_us bigint, ord bigint, side string, px bigint, qty bigint")
    assert threshold_fills(o, p, ["seg"], ["oid"]).first()["state"] == "unfilled"


def test_removals_split_exactly(v):
    rows = state.flow_rows(v)
    x = state.s.explained_removals(rows, state.hits(v, rows), ["seg"], "ts_us")
    assert x.where("explained + unexplained <> removed OR explained < 0 OR unexplained < 0").count() == 0


def test_more_queue_never_fills_sooner(v):
    f = joins.marked_fills(v).select("oid", "alpha", F.coalesce("fill_us", F.lit(2**60)).alias("at"))
    a = f.where("alpha = 0").select("oid", F.col("at").alias("a0"))
    assert f.join(a, "oid").where("at < a0").count() == 0


def test_spread_parts_add_up(v):
    r = stats_signal.spread_reconciliation(v).where("abs(residual) > 1e-9")
    assert r.count() == 0


def test_mirrored_sides_cancel(v):
    s = stats_signal.scored(v)
    both = s.groupBy("seg", "g_us").agg(F.sum("r").alias("z"), F.count("r").alias("n")).where("n = 2 AND z <> 0")
    assert both.count() == 0


def test_asof_keeps_every_left_row(v):
    got = asof(v.orders_p, v.prints.where("px > 400"), ["seg"], "place_us", "ts_us", {"ord": "hit"})
    assert got.count() == v.orders_p.count()


def test_sources_reject_bad_rows(spark, tmp_path):
    bad = spark.createDataFrame([("x", "S", 1, 1, True, "middle", "1.0", "2.0")], "exchange string, symbol string, timestamp long, local_timestamp long, is_snapshot boolean, side string, price string, amount string")
    path = str(tmp_path / "bad")
    bad.write.option("header", True).csv(path)
    with pytest.raises(Exception, match="bad book side"):
        typed.scan_levels(spark, path).collect()
    with pytest.raises(Exception):
        typed.scan_csv(spark, path, typed.TRADE_SCHEMA).collect()
    with pytest.raises(ValueError):
        typed.scan_required(spark, f"{DIR}/events.parquet", {"event_id": "string"})


def test_fingerprint_ignores_order(v):
    a = typed.fingerprint(v.prints).first()
    b = typed.fingerprint(v.prints.orderBy(F.col("ord").desc()).repartition(5)).first()
    assert a == b


def test_filters_and_columns_reach_the_scan(v):
    from tickloom.plans.scans import scan_pruned_filtered

    plan = scan_pruned_filtered(v)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "l_extendedprice" not in plan

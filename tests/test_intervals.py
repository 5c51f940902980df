"""Window searches and fills against brute force."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.operators import intervals as iv
from tickloom.operators import joins as jn
from tickloom.operators import queue as qu
from tickloom.operators import selection as sel
from tickloom.operators.ordered import ONE_BLOCK, Blocks

SMALL = st.lists(st.integers(0, 6), min_size=1, max_size=25)


@settings(max_examples=60, deadline=None)
@given(SMALL, st.integers(0, 24), st.integers(0, 25), st.integers(-1, 7))
def test_first_index_and_split_sums(values, lo, hi, bound):
    v = np.array(values)
    lo = min(lo, len(v))
    hi = max(lo, min(hi, len(v)))
    one = [np.array([x]) for x in (lo, hi, bound)]
    want = next((i for i in range(lo, hi) if v[i] > bound), hi)
    assert iv.first_index_beyond(v, *one)[0] == want
    w = np.arange(1, len(v) + 1)
    got = iv.split_sums(v, w, one[0], one[1], one[2])[0]
    assert got == sum(w[i] for i in range(lo, hi) if v[i] < bound)


def cuts(many, top):
    return Blocks(tuple(float(x) for x in range(20, top, 20)), rows=15) if many else ONE_BLOCK


@pytest.fixture(scope="module")
def market():
    rng = np.random.default_rng(11)
    n = 300
    prints = pd.DataFrame(
        {"seg": rng.integers(0, 2, n), "ts_us": np.sort(rng.integers(0, 400, n)), "ord": np.arange(n), "side": rng.choice(["bid", "ask"], n),
         "px": rng.integers(98, 103, n), "qty": rng.integers(1, 6, n)}
    )
    m = 120
    orders = pd.DataFrame(
        {"oid": np.arange(m), "seg": rng.integers(0, 2, m), "place_us": rng.integers(0, 380, m), "side": rng.choice(["bid", "ask"], m),
         "px": rng.integers(98, 103, m), "ahead": rng.integers(0, 9, m), "qty": 4}
    )
    orders["end_us"] = orders.place_us + rng.integers(5, 120, m)
    return prints, orders


def brute_fill(o, prints):
    p = prints[(prints.seg == o.seg) & (prints.side == o.side) & (prints.ts_us > o.place_us) & (prints.ts_us < o.end_us)].sort_values(["ts_us", "ord"])
    vol, first, got = 0, None, 0
    for r in p.itertuples():
        if (r.px < o.px) if o.side == "bid" else (r.px > o.px):
            return first or r.ts_us, r.ts_us, 4, "through", "full"
        if r.px == o.px:
            vol += r.qty
            got = min(max(vol - o.ahead, 0), o.qty)
            if got and first is None:
                first = r.ts_us
            if got == o.qty:
                return first, r.ts_us, 4, "at_quote", "full"
    return first, None, got, None, "partial" if got else "unfilled"


@pytest.mark.parametrize("many", [False, True])
def test_threshold_fills(spark, market, many):
    prints, orders = market
    d = jn.threshold_fills(spark.createDataFrame(orders), spark.createDataFrame(prints), ["seg"], ["oid"], cuts(many, 400))
    got = d.toPandas().set_index("oid")
    for o in orders.itertuples():
        g = got.loc[o.oid]
        have = tuple(None if pd.isna(x) else x for x in (g.first_us, g.full_us, g.filled, g.mechanism, g.state))
        assert have == brute_fill(o, prints), o


def brute_queue(q, prints, deltas, window, lots, alpha, beta):
    """Event-by-event reference for one order and one assumption cell."""
    end = q.at_us + window
    ev = [(r.ts_us, 0, r.px, r.qty) for r in prints.itertuples() if r.seg == q.seg and r.side == q.side and q.at_us < r.ts_us < end]
    ev += [(r.ts_us, 1, r.px, r.delta) for r in deltas.itertuples() if r.seg == q.seg and r.side == q.side and q.at_us < r.ts_us < end and r.px == q.px]
    left, behind, pool, got = q.displayed * alpha // 100, 0, 0, 0
    for ts, kind, px, x in sorted(ev):
        if kind == 0:
            if (px < q.px) if q.side == "bid" else (px > q.px):
                return ts, "through"
            if px != q.px:
                continue
            pool += x
            use = min(left, x)
            left -= use
            got += x - use
            if x - use > 0 and got >= lots:
                return ts, "at_quote"
        elif x > 0:
            behind += x
        else:
            rem = -x
            use = min(behind, rem)
            behind -= use
            rem -= use
            use = min(pool, rem)
            pool -= use
            rem -= use
            if left > 0:
                left = max(0, left - rem * beta // 100)
    return None, None


def queue_market(n=240, span=600):
    rng = np.random.default_rng(3)
    stamps, half = rng.permutation(span)[:n], n // 2
    prints = pd.DataFrame({"seg": 0, "ts_us": stamps[:half], "ord": np.arange(half), "side": rng.choice(["bid", "ask"], half), "px": rng.choice([99, 100, 100, 101], half), "qty": rng.integers(1, 5, half)})
    deltas = pd.DataFrame({"seg": 0, "side": rng.choice(["bid", "ask"], half), "px": rng.choice([100, 101], half), "ts_us": stamps[half:], "ord": np.arange(half), "delta": rng.integers(-6, 5, half)})
    quotes = pd.DataFrame({"seg": 0, "at_us": rng.integers(0, span, 40), "side": rng.choice(["bid", "ask"], 40), "px": rng.choice([100, 101, 104], 40), "displayed": rng.integers(0, 12, 40)}).drop_duplicates(["at_us", "side"])
    return prints, deltas, quotes


@pytest.mark.parametrize("many", [False, True])
def test_queue_grid_fills(spark, many):
    prints, deltas, quotes = queue_market()
    cells = (0, 30, 50, 100)
    frames = [spark.createDataFrame(d) for d in (quotes, prints, deltas)]
    got = qu.queue_grid_fills(*frames, ["seg"], ["seg", "at_us", "side"], 150, 4, cells, cells, cuts(many, 600)).toPandas().set_index(["at_us", "side", "alpha", "beta"])
    assert len(got) == len(quotes) * 16
    for q in quotes.itertuples():
        for a in cells:
            for b in cells:
                g = got.loc[(q.at_us, q.side, a, b)]
                have = tuple(None if pd.isna(x) else x for x in (g.fill_us, g.mechanism))
                assert have == brute_queue(q, prints, deltas, 150, 4, a, b), (q, a, b)


def test_queue_plan_has_no_order_event_rows(spark):
    prints, deltas, quotes = queue_market()
    frames = [spark.createDataFrame(d) for d in (quotes, prints, deltas)]
    plan = qu.queue_grid_fills(*frames, ["seg"], ["seg", "at_us", "side"], 150, 4, (0, 50), (0, 50))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join ") == 2  # the two lookups by order id


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(-9, 9)), max_size=60), st.integers(0, 12), st.integers(0, 60), st.integers(1, 60), st.integers(1, 6))
def test_level_fills_equal_event_by_event(events, displayed, at, width, lots):
    ev = [(i + 1, 0, 100, abs(x) + 1) if p else (i + 1, 1, 100, x) for i, (p, x) in enumerate(events) if p or x]
    prints = pd.DataFrame([(t, 0, "bid", px, x) for t, k, px, x in ev if k == 0], columns=["ts_us", "seg", "side", "px", "qty"])
    deltas = pd.DataFrame([(t, 0, "bid", px, x) for t, k, px, x in ev if k == 1], columns=["ts_us", "seg", "side", "px", "delta"])
    q = pd.Series({"seg": 0, "at_us": at, "side": "bid", "px": 100, "displayed": displayed})
    alphas, betas = (0, 35, 100), (0, 35, 100)
    level = qu.Level(*(np.array([e[i] for e in ev], dtype="int64") for i in (0,)), np.array([e[1] == 0 for e in ev], dtype=bool), np.array([e[3] for e in ev], dtype="int64"))
    got = level.fills(np.array([at]), np.array([at + width]), np.array([displayed]), lots, alphas, betas)[0]
    want = [[brute_queue(q, prints, deltas, width, lots, a, b)[0] for b in betas] for a in alphas]
    assert [[None if x < 0 else x for x in row] for row in got.tolist()] == want


@settings(max_examples=60, deadline=None)
@given(SMALL)
def test_path_sums(values):
    v = np.array(values)
    step = qu.greater_next(v)
    w = np.arange(1, len(v) + 1)
    for i, total in enumerate(qu.path_sums(v, w)):
        want, at = 0, i
        while at < len(v):
            want, at = want + w[at], step[at]
        assert total == want


@pytest.mark.parametrize("hold", [1, 7, 45, 2000])
@pytest.mark.parametrize("many", [False, True])
def test_spaced(spark, hold, many):
    rng = np.random.default_rng(2)
    rows = sorted({(int(k), int(t)) for k, t in zip(rng.integers(0, 3, 400), rng.integers(0, 900, 400))} | {(5, t) for t in range(0, 900, 3)})
    df = spark.createDataFrame([(k, t, k * 10_000 + t) for k, t in rows] + [(0, None, -1)], "k bigint, t bigint, id bigint")
    got = {(r.k, r.t) for r in sel.spaced(df, ["k"], "t", hold, cuts(many, 900)).collect()}
    want, free = set(), {}
    for k, t in rows:
        if t >= free.get(k, -1):
            want.add((k, t))
            free[k] = t + hold
    assert got == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=40, unique=True), st.integers(1, 30), st.lists(st.integers(1, 60), max_size=5))
def test_block_maps_compose(stamps, hold, splits):
    stamps, edges = sorted(stamps), [0, *sorted(set(splits)), 99]
    blocks = [[t for t in stamps if a <= t < b] for a, b in zip(edges, edges[1:])]
    maps = [(i, *sel._free_map(pd.DataFrame({"t": b}), "t", hold)) for i, b in enumerate(blocks) if b]
    free = sel._free_from(pd.DataFrame(maps, columns=[sel.BLOCK, "_upto", "_out"])).set_index(sel.BLOCK)["_free"]
    got = [t for i, b in enumerate(blocks) if b for t in sel._keep(pd.DataFrame({"t": b}), "t", hold, None if pd.isna(free[i]) else int(free[i]))["t"]]
    want = []
    for t in stamps:
        if not want or t >= want[-1] + hold:
            want.append(t)
    assert got == want


def test_spacing_needs_no_job_and_one_exchange_of_stamps(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS t")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    d = sel.spaced(df, ["k"], "t", 5, cuts(True, 900))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    assert d.count() == 501


def test_window_volume(spark, market):
    prints, orders = market
    q = spark.createDataFrame(orders[["oid", "seg", "side", "place_us", "px"]])
    for many in (False, True):
        got = iv.window_volume(q, spark.createDataFrame(prints), ["seg", "side"], ["oid"], "place_us", F.col("place_us") + 60, F.col("px"), "ts_us", "px", "qty", cuts(many, 400)).toPandas().set_index("oid")
        for o in orders.itertuples():
            p = prints[(prints.seg == o.seg) & (prints.side == o.side) & (prints.ts_us > o.place_us) & (prints.ts_us <= o.place_us + 60)]
            want = [p[p.px < o.px].qty.sum(), p[p.px == o.px].qty.sum(), p[p.px > o.px].qty.sum()]
            assert got.loc[o.oid, ["below", "at", "above"]].tolist() == want

"""The book after every update against a dictionary of levels, in one block and in many."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.operators import state as s
from tickloom.operators.ordered import ONE_BLOCK, Blocks


def plain_book(rows, depth=10):
    """rows: (ts, ord, side, px, qty) in order."""
    book, out = {"bid": {}, "ask": {}}, []
    for ts, ord_, side, px, qty in rows:
        mine = book[side]
        better = (lambda p: p > px) if side == "bid" else (lambda p: p < px)
        rank, old = sum(better(p) for p in mine), mine.get(px, 0)
        mine.pop(px, None)
        if qty:
            mine[px] = qty
        row = [ts, ord_, side, px, qty]
        for name in ("bid", "ask"):
            levels = sorted(book[name].items(), reverse=name == "bid")
            row += [levels[0][0] if levels else None, levels[0][1] if levels else 0, sum(q for _, q in levels[:depth]), len(levels)]
        out.append((*row, rank, old))
    return out


UPDATES = st.lists(st.tuples(st.sampled_from(["bid", "ask"]), st.integers(0, 40), st.integers(0, 3)), min_size=1, max_size=80)


@settings(max_examples=80, deadline=None)
@given(UPDATES)
def test_sweep_side(updates):
    rows = [(i, i, side, px, q) for i, (side, px, q) in enumerate(updates)]
    for side, best_is in (("bid", -1), ("ask", 1)):
        mine = [r for r in rows if r[2] == side]
        if not mine:
            continue
        got = s._sweep_side(np.array([r[3] for r in mine]), np.array([r[4] for r in mine]), best_is)
        for i, w in enumerate(plain_book(mine)):
            best, qty, depth, live = w[5:9] if side == "bid" else w[9:13]
            assert (got["qty"][i], got["depth"][i], got["live"][i], got["rank"][i], got["old"][i]) == (qty, depth, live, w[13], w[14])
            assert best is None or got["best"][i] == best


@pytest.mark.parametrize("splits", [(), (40.0, 90.0, 91.0, 250.0)])
def test_book_after_updates(spark, splits):
    rng = np.random.default_rng(8)
    n = 400
    frames = []
    for seg in (0, 1):
        frames.append(pd.DataFrame({"seg": seg, "ts_us": np.sort(rng.integers(0, 300, n)), "ord": np.arange(n), "side": rng.choice(["bid", "ask"], n), "px": rng.integers(900, 960, n), "qty": rng.integers(0, 4, n)}))
    df = pd.concat(frames)
    blocks = Blocks(splits, rows=100) if splits else ONE_BLOCK
    got = s.book_after_updates(spark.createDataFrame(df), ["seg"], "ts_us", "ord", blocks).toPandas()
    for seg in (0, 1):
        mine = got[got.seg == seg].sort_values("ord").drop(columns="seg")
        have = [tuple(None if pd.isna(x) else x for x in r) for r in mine.itertuples(index=False)]
        assert have == plain_book(df[df.seg == seg].drop(columns="seg").itertuples(index=False))


def test_cost_does_not_grow_with_prices():
    """Doubling the prices adds one step to the split, not a pass over all updates."""
    import time

    rng = np.random.default_rng(1)
    n, seconds = 200_000, []
    for prices in (64, 16_384):
        px, qty = rng.integers(0, prices, n), rng.integers(0, 3, n)
        start = time.perf_counter()
        s._sweep_side(px, qty, 1)
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 8 * seconds[0] + 1


@pytest.mark.parametrize("splits", [(), (40.0, 90.0, 91.0, 250.0)])
def test_books_at(spark, splits):
    rng = np.random.default_rng(9)
    n = 500
    df = pd.DataFrame({"seg": 0, "ts_us": np.sort(rng.integers(20, 300, n)), "ord": np.arange(n), "side": rng.choice(["bid", "ask", "ask"], n), "px": rng.integers(900, 930, n), "qty": rng.integers(0, 4, n)})
    df = pd.concat([df, pd.DataFrame({"seg": [1, 1], "ts_us": [30, 200], "ord": [0, 1], "side": "bid", "px": 910, "qty": [2, 0]})])
    grid = pd.DataFrame([(seg, t) for seg in (0, 1, 2) for t in range(0, 320, 7)], columns=["seg", "at"])
    blocks = Blocks(splits, rows=100) if splits else ONE_BLOCK
    got = s.books_at(spark.createDataFrame(df), spark.createDataFrame(grid), ["seg"], "ts_us", "ord", "at", 3, blocks).collect()
    want = []
    for seg, t in grid.itertuples(index=False):
        book = {"bid": {}, "ask": {}}
        for r in df[(df.seg == seg) & (df.ts_us <= t)].sort_values(["ts_us", "ord"]).itertuples():
            book[r.side].pop(r.px, None)
            if r.qty:
                book[r.side][r.px] = r.qty
        best = [sorted(book[x].items(), reverse=x == "bid")[:3] for x in ("bid", "ask")]
        if any(best):
            want.append((seg, t, *[[v[i] for v in b] for b in best for i in (0, 1)]))
    assert sorted(tuple(r) for r in got) == want

"""Ordered primitives: one-block and blocked forms agree with pandas, also under a hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import ordered as o


@pytest.fixture(scope="module")
def events():
    rng = np.random.default_rng(5)
    n = 900
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 6, n))  # key 0 is hot
    ts = np.sort(rng.integers(0, 5_000, n))
    ts[200:260] = ts[200]  # many rows share one stamp
    v = rng.integers(-20, 20, n).astype(float)
    v[rng.random(n) < 0.2] = np.nan
    return pd.DataFrame({"k": key, "ts": ts, "id": np.arange(n), "v": v})


@pytest.fixture(scope="module")
def frame(spark, events):
    rows = [(int(k), int(t), int(i), None if np.isnan(v) else int(v)) for k, t, i, v in events.itertuples(index=False)]
    return spark.createDataFrame(rows, "k bigint, ts bigint, id bigint, v bigint")


def blocks(many):
    return o.Blocks(tuple(float(x) for x in range(250, 5000, 250)), rows=40) if many else o.ONE_BLOCK


def pdf(df, by="id"):
    return df.toPandas().sort_values(by).reset_index(drop=True)


@pytest.mark.parametrize("many", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
@pytest.mark.parametrize("reverse", [False, True])
def test_running(frame, events, many, exclusive, reverse):
    outs = {"s": ("sum", F.col("v")), "n": ("count", F.col("v")), "mx": ("max", F.col("v")), "la": ("last", F.col("v")), "fi": ("first", F.col("v"))}
    got = pdf(o.running(frame, ["k"], "ts", outs, blocks(many), ["id"], exclusive, reverse))
    e = events.sort_values(["ts", "id"], ascending=not reverse)
    want = {c: {} for c in outs}
    for _, g in e.groupby("k"):
        seen = []
        for _, r in g.iterrows():
            now = [x for x in (seen if exclusive else seen + [r.v]) if not np.isnan(x)]
            want["s"][r.id] = sum(now) if now else None
            want["n"][r.id] = len(now)
            want["mx"][r.id] = max(now) if now else None
            want["la"][r.id] = now[-1] if now else None
            want["fi"][r.id] = now[0] if now else None
            seen.append(r.v)
    for c in outs:
        for i, x in zip(got["id"], got[c]):
            w = want[c][i]
            assert (pd.isna(x) and w is None) or x == w, (c, i, x, w)


@pytest.mark.parametrize("many", [False, True])
def test_shift_and_islands(frame, events, many):
    got = pdf(o.shifted(frame, ["k"], "ts", {"a": (F.col("id"), 3), "b": (F.col("id"), -7)}, blocks(many), ["id"]))
    e = events.sort_values(["ts", "id"])
    want = pd.DataFrame({"id": e.id, "a": e.groupby("k")["id"].shift(3), "b": e.groupby("k")["id"].shift(-7)}).sort_values("id")
    np.testing.assert_array_equal(got["a"].to_numpy(float), want["a"].to_numpy(float))
    np.testing.assert_array_equal(got["b"].to_numpy(float), want["b"].to_numpy(float))
    sign = frame.withColumn("up", F.coalesce(F.col("v") > 0, F.lit(False)))
    got = pdf(o.island_ids(sign, ["k"], "ts", lambda prev: F.col("up") != prev("up"), ["up"], "run", blocks(many), ["id"]))
    e["up"] = e.v > 0
    e["run"] = e.groupby("k")["up"].transform(lambda s: (s != s.shift()).cumsum())
    np.testing.assert_array_equal(got["run"].to_numpy(int), e.sort_values("id")["run"].to_numpy(int))


@pytest.mark.parametrize("many", [False, True])
def test_range_halo(frame, events, many):
    f = o.halo_range(frame, ["k"], "ts", blocks(many), back=600, fwd=100)
    got = pdf(f.close(f.df.withColumn("n", F.count("*").over(f.window.rangeBetween(-600, 100)))))
    for i, n in zip(got["id"], got["n"]):
        r = events.loc[i]
        near = events[(events.k == r.k) & (events.ts >= r.ts - 600) & (events.ts <= r.ts + 100)]
        assert n == len(near)


@pytest.mark.parametrize("many", [False, True])
@pytest.mark.parametrize("forward,strict", [(False, False), (False, True), (True, False), (True, True)])
def test_asof(spark, frame, events, many, forward, strict):
    right = frame.where("id % 3 = 0").select("k", F.col("ts").alias("rts"), F.col("id").alias("rid"))
    got = pdf(o.asof(frame, right, ["k"], "ts", "rts", {"rid": "hit"}, blocks(many), ["rid"], forward, strict))
    r = events[events.id % 3 == 0]
    for i, hit in zip(got["id"], got["hit"]):
        e = events.loc[i]
        c = r[r.k == e.k]
        if forward:
            c = c[c.ts > e.ts] if strict else c[c.ts >= e.ts]
            want = c.sort_values(["ts", "id"])["id"].head(1)
        else:
            c = c[c.ts < e.ts] if strict else c[c.ts <= e.ts]
            want = c.sort_values(["ts", "id"])["id"].tail(1)
        assert (pd.isna(hit) and want.empty) or hit == want.iloc[0]


@pytest.mark.parametrize("many", [False, True])
def test_quantiles_and_ranks(frame, events, many):
    b = o.Blocks((-10.0, -3.0, 0.0, 4.0, 11.0), rows=40) if many else o.ONE_BLOCK
    known = frame.where("v IS NOT NULL")
    q = o.exact_quantiles(known, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.93}, b).toPandas().set_index("k")
    for k, g in events.dropna().groupby("k"):
        np.testing.assert_allclose(q.loc[k, ["a", "b", "c"]].to_numpy(float), np.quantile(g.v, [0.1, 0.5, 0.93]))
    got = pdf(o.average_ranks(frame, ["k"], "v", "r", b))
    np.testing.assert_allclose(got["r"].to_numpy(float), events.groupby("k")["v"].rank().to_numpy())
    whole = o.exact_quantiles(known, [], "v", {"m": 0.5}, b).first()["m"]
    assert whole == events.v.median()


def test_fit_splits_hot_axis(spark):
    spark.conf.set(o.ROWS_CONF, "100")
    try:
        df = spark.range(2000).selectExpr("id", "CASE WHEN id < 700 THEN 5 ELSE id END AS t")
        b = o.Blocks.fit(df, "t")
        n = b.assign(df, "t").groupBy(o.BLOCK).count().toPandas()
        assert len(n) > 8
        assert n.sort_values("count")["count"].iloc[-2] < 400  # only the single-stamp block is larger
        assert o.Blocks.fit(df, "t", bound=50).single
    finally:
        spark.conf.unset(o.ROWS_CONF)

"""Out-of-fold predictions: every validation row once per model, closed forms against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import folds as fd
from tickloom.operators import oof
from tickloom.operators.ordered import Blocks

SMALL = {"maxIter": 5, "minInstancesPerNode": 5}


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(i), float(a), float(b), float(round(2 * a - b + 0.3 * e, 1)) + 1000) for i, (a, b, e) in enumerate(rng.standard_normal((240, 3)))]
    rows += [(500 + i, 20 * i + 3, None if i % 3 == 0 else 0.5, 0.1, None if i % 2 else 1001.0) for i in range(12)]
    d = spark.createDataFrame(rows, "id long, ts long, a double, b double, y double").withColumn("up", (F.col("y") > 1000).cast("int"))
    return d, fd.fold_dimension(d.where("id < 500"), "ts", 6, 2, 5)


def sides(frames):
    d, ten = (x.toPandas() for x in frames)
    for f in ten.sort_values("fold").itertuples():
        yield f.fold, d[d.ts <= f.train_end], d[(d.ts >= f.val_start) & (d.ts < f.val_end)]


@pytest.mark.parametrize("blocks", [oof.ONE_BLOCK, Blocks((999.0, 1000.0, 1001.5), rows=40)])
def test_regressions(frames, blocks):
    got = oof.out_of_fold(*frames, "ts", ["id"], ["a", "b"], "y", ("naive", "ridge"), least=1, blocks=blocks).toPandas()
    assert sorted(got.fold.unique()) == [0, 1, 2, 3]
    for fold, train, val in sides(frames):
        mine = got[got.fold == fold]
        assert all(sorted(mine[mine.model == m].id) == sorted(val.id) for m in ("naive", "ridge"))
        assert np.allclose(mine[mine.model == "naive"].prediction, train.y.median())
        whole = train.dropna(subset=["a", "b", "y"])
        x, y = whole[["a", "b"]].to_numpy(), whole.y.to_numpy()
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
        v = val[["a", "b"]].fillna(dict(zip("ab", x.mean(axis=0)))).to_numpy()
        want = y.mean() + (v - x.mean(axis=0)) / x.std(axis=0) @ w
        assert np.allclose(mine[mine.model == "ridge"].set_index("id").prediction.loc[val.id], want, rtol=1e-9)


def test_classes(frames):
    got = oof.out_of_fold(*frames, "ts", ["id"], ["a", "b"], "up", least=1, boosted=SMALL).toPandas()
    assert sorted(got.model.unique()) == ["boosted", "logistic", "naive"] and got.prediction.between(0, 1).all()
    for fold, train, val in sides(frames):
        mine = got[got.fold == fold]
        assert all(sorted(mine[mine.model == m].id) == sorted(val.id) for m in mine.model.unique())
        assert np.allclose(mine[mine.model == "naive"].prediction, train.up.mean())
    known = got[got.model == "logistic"].dropna(subset=["up"])
    assert ((known.prediction > 0.5) == (known.up == 1)).mean() > 0.85


def test_boosted_values(frames):
    got = oof.out_of_fold(*frames, "ts", ["id"], ["a", "b"], "y", ("boosted",), least=1, boosted=SMALL).toPandas()
    assert got.groupby("fold").size().tolist() == [len(v) for _, _, v in sides(frames)]
    assert np.corrcoef(got.dropna().prediction, got.dropna().y)[0, 1] > 0.3


def test_thin_folds_and_overlaps(spark, frames):
    d, ten = frames
    got = oof.out_of_fold(d, ten, "ts", ["id"], ["a"], "y", ("naive",), least=120)
    assert sorted(r.fold for r in got.select("fold").distinct().collect()) == [2, 3]
    assert oof.out_of_fold(d, ten, "ts", ["id"], ["a"], "y", ("naive", "ridge"), least=10_000).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        oof.out_of_fold(d, ten.withColumn("val_end", F.col("val_end") + 1), "ts", ["id"], ["a"], "y", ("naive",))


def test_no_row_is_copied_into_folds(frames):
    plan = oof.staged(frames[0], frames[1].collect(), "ts")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_moments_add_up():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((50, 3)) + 1e6
    part = lambda v: oof.Moments(len(v), v.mean(axis=0) if len(v) else np.zeros(3), np.cov(v.T, ddof=0) * len(v) if len(v) else np.zeros((3, 3)))
    total = part(x[:7]) + part(x[:0]) + part(x[7:30]) + part(x[30:])
    assert total.n == 50 and np.allclose(total.mean, x.mean(axis=0)) and np.allclose(total.cross, np.cov(x.T, ddof=0) * 50)

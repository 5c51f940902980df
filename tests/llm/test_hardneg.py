import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import hardneg


def plain_mine(rows, is_anchor):
    """All scores of each anchor in Python integers."""
    good = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, [int(np.floor(256 * x)) for x in v], str(label)))
    out = []
    for k, (i, v, label) in enumerate(good):
        if not is_anchor(i):
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))
        others = [(-score(w), j, own == label) for m, (j, w, own) in enumerate(good) if m != k and len(w) == len(v)]
        positives = sorted((s, j) for s, j, same in others if same)[:5]
        for s, j in positives:
            ok = sorted((t, n) for t, n, same in others if not same and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(ok)]
    return sorted(out)


def vectors():
    rng = np.random.default_rng(9)
    rows = []
    centres = rng.standard_normal((6, 12))
    for i in range(400):
        v = centres[rng.integers(6)] + 0.6 * rng.standard_normal(12)
        rows.append((i, (v / np.linalg.norm(v)).tolist(), int(rng.integers(3)) if i % 3 else 0))
    rows += [(500 + i, rows[0][1], i % 2) for i in range(60)]  # equal texts: ties by id
    rows += [(600, [0.0] * 12, 1), (610, [-x for x in rows[10][1]], 0), (620, [1e4] * 12, 2)]
    rows += [(630, [1.0, 2.0], 0), (640, [2.0, 1.0], 0), (641, [1.0, 1.0], 1), (642, [], 1), (650, [], 1)]
    rows += [(None, [1.0] * 12, 0), (660, None, 0), (670, [1.0] * 12, None), (680, [float("nan")] + [1.0] * 11, 0), (690, [float("inf")] * 12, 0), (700, [None] + [1.0] * 11, 0)]
    return rows + [(20, rows[20][1], rows[20][2]), (20, rows[30][1], 2)]  # repeated ids


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("cell", [16_384, 100])
def test_equals_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(hardneg, "CELL_ROWS", cell)
    monkeypatch.setattr(hardneg, "CELL_ANCHORS", cell // 10)
    monkeypatch.setattr(hardneg, "SLAB", cell // 10 if cell == 100 else 1024)
    rows = vectors()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    clash = df.withColumn("row", F.lit("x")).withColumn("score", F.lit(1)).withColumn("r", F.lit(1)).withColumn("a", F.lit(2))
    got = hardneg.mine(clash, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_mine(rows, lambda i: i % 10 == 0)
    assert len(want) > 300 and sorted(tuple(r) for r in got.collect()) == want


def test_string_labels_and_empty_tables(spark):
    rows = [(i, [1.0, float(i % 5)], "a" if i % 2 else "b") for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    assert sorted(tuple(r) for r in hardneg.mine(df, F.col("vec_id") < 4).collect()) == plain_mine(rows, lambda i: i < 4)
    assert hardneg.mine(df.limit(0), F.lit(True)).count() == 0
    assert hardneg.mine(df, F.lit(None).cast("boolean")).count() == 0


def test_scores_beyond_a_long_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e8, 1.0], 0), (1, [1.0, 1e8], 1)], SCHEMA)
    with pytest.raises(Exception, match="fit a long"):
        hardneg.mine(df, F.lit(True)).collect()


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-(2**21), 2**21, 3) / 256 * 100).tolist(), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in hardneg.mine(df, F.col("vec_id") < 9).collect()) == plain_mine(rows, lambda i: i < 9)


def test_candidates_leave_before_the_last_dimension():
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(-3, 4, (32, 500)), rng.integers(90, 100, (32, 5))], axis=1)
    columns = hardneg.Columns.__new__(hardneg.Columns)
    columns.values, columns.type = values.astype(float), np.float64
    anchor = np.sort(rng.integers(1, 60, 32))
    seen = []
    keep = hardneg._keep_top(5)
    scan = hardneg.Scan(columns, values.min(axis=1), values.max(axis=1), anchor)
    at, score = scan.run(np.arange(505), lambda s, a, b: seen.append(len(s)) or keep(s, a, b))
    assert set(at) == set(range(500, 505)) and (score == anchor @ values[:, at]).all() and seen[-1] == 5

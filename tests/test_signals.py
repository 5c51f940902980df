"""Correlations without variance, and decay labels against the rule in plain code."""

import itertools

import pytest
from pyspark.sql import functions as F

from tickloom.operators import signals as sg
from tickloom.operators.stats import information_coefficients, safe_corr


def test_safe_corr(spark):
    rows = [("const", 1.0, float(i)) for i in range(5)] + [("one", 2.0, 3.0), ("none", None, 1.0), ("up", 1.0, 2.0), ("up", 2.0, 4.5), ("up", 3.0, None), ("up", 4.0, 5.0)]
    d = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r.k: r.c for r in d.groupBy("k").agg(safe_corr("x", "y").alias("c")).collect()}
    assert got["const"] is None and got["one"] is None and got["none"] is None
    want = d.where("k = 'up'").agg(F.corr("x", "y")).first()[0]
    assert got["up"] == pytest.approx(want)


def test_quiet_groups_have_no_correlation(spark):
    d = spark.createDataFrame([("quiet", 1.0, 1.0), ("quiet", 1.0, 2.0), ("loud", 1.0, 2.0), ("loud", 2.0, 1.0)], "k string, x double, y double")
    got = {r.k: (r.pearson, r.spearman) for r in information_coefficients(d, ["k"], "x", "y").collect()}
    assert got["quiet"] == (None, None) and got["loud"] == (pytest.approx(-1.0), pytest.approx(-1.0))
    scores = {r.k: r for r in sg.regression_scores(d, ["k"], "y", "x").collect()}
    assert scores["quiet"].spearman is None and scores["quiet"].n == 2


def plain_label(rows, pivot):
    inc = [r for r in rows if r["kind"] == "incremental" and r["resolved"]]
    sign = lambda x: (x > 0) - (x < 0)
    medium = any(r["spread"] > 0 and r["stable"] and r["horizon"] > pivot for r in inc)
    up, down = any(r["spread"] > 0 for r in inc), any(r["spread"] < 0 for r in inc)
    if (up and down) or any(sign(r["spread"]) != sign(r["raw"]) for r in inc) or (any(not r["stable"] for r in inc) and not medium):
        return "ambiguous"
    if down:
        return "reversal"
    if medium:
        return "medium_horizon_persistence"
    if any(r["spread"] > 0 and r["horizon"] <= pivot for r in inc):
        return "short_continuation"
    return "ultra_short_only" if any(r["kind"] == "cumulative" and r["resolved"] and r["horizon"] <= pivot for r in rows) else "ambiguous"


def test_decay_labels(spark):
    kinds = [dict(kind=k, horizon=h, resolved=r, stable=s, spread=x, raw=y) for k in ("incremental", "cumulative") for h in (1, 24) for r in (True, False) for s in (True, False) for x, y in ((1.0, 1.0), (-1.0, -2.0), (1.0, -1.0))]
    sets = [[a] for a in kinds] + [list(p) for p in itertools.combinations(kinds, 2)][::3] + [list(p) for p in itertools.combinations(kinds, 3)][::97]
    flat = [{"signal": i, **r} for i, rows in enumerate(sets) for r in rows]
    d = spark.createDataFrame(flat, "signal long, kind string, horizon long, resolved boolean, stable boolean, spread double, raw double")
    got = {r.signal: r.label for r in sg.decay_class(d, ["signal"], 6).collect()}
    assert [got[i] for i in range(len(sets))] == [plain_label(rows, 6) for rows in sets]
    assert set(got.values()) == {label for label, _, _ in sg.DECAY_RULES}

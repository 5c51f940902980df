"""Out-of-fold predictions over expanding folds: closed forms from one pass, iterative fits over masks.

Fold k trains on all rows up to its ``train_end``, so its training set is that of fold k - 1 and the rows of one more
stage. What mean, median and ridge need adds up over stages: counts, means, cross products, and counts per value. One
aggregation by stage gives them for every fold, with no row copied into a fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tickloom.operators.ordered import ONE_BLOCK, Blocks, running
from tickloom.sources.typed import scratch_dir

#: Rows a fold must train on, penalties, and the boosting schedule. Trees of depth 6 have 64 leaves.
LEAST = 1_000
RIDGE_ALPHA = 1.0
LOGISTIC_C = 1.0
BOOSTED = {
    "maxIter": 300,
    "stepSize": 0.05,
    "maxDepth": 6,
    "maxBins": 127,
    "minInstancesPerNode": 500,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "seed": 7,
}


class Moments:
    """Count, mean and centred cross products of some columns; two sets of rows add up without loss of precision."""

    def __init__(self, n: int, mean: np.ndarray, cross: np.ndarray):
        self.n, self.mean, self.cross = n, mean, cross

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not self.n or not other.n:
            return self if self.n else other
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.cross + other.cross + np.outer(gap, gap) * (self.n * other.n / n))


def staged(df: DataFrame, folds: Sequence[Row], ts: str) -> DataFrame:
    """Rows with ``_stage``, the number of folds that end training before the row, and ``fold``, which it validates."""
    spans = sorted((f["val_start"], f["val_end"]) for f in folds)
    if any(a[1] > b[0] for a, b in zip(spans, spans[1:])):
        raise ValueError("validation spans overlap")
    t = F.col(ts)
    stage = sum(((t > f["train_end"]).cast("int") for f in folds), F.lit(0))
    inside = [F.when((t >= f["val_start"]) & (t < f["val_end"]), F.lit(f["fold"])) for f in folds]
    return df.withColumns({"_stage": stage, "fold": F.coalesce(*inside, F.lit(None).cast("bigint")).cast("bigint")})


def stage_moments(rows: DataFrame, columns: Sequence[str]) -> dict[int, Moments]:
    """Moments of ``columns`` per stage over the rows that have all of them."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    got = rows.dropna(subset=list(columns)).groupBy("_stage").agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(c) for c in columns]).alias("mean"),
        F.array(*[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).alias("cov"),
    )
    out = {}
    for r in got.collect():
        cross = np.zeros((len(columns), len(columns)))
        for (i, j), c in zip(pairs, r["cov"]):
            cross[i, j] = cross[j, i] = c * r["n"]
        out[r["_stage"]] = Moments(r["n"], np.array(r["mean"]), cross)
    return out


def expanding(parts: dict[int, Moments], folds: int, columns: int) -> list[Moments]:
    """Moments of each fold's training rows: the sums over stages up to its own."""
    total, out = Moments(0, np.zeros(columns), np.zeros((columns, columns))), []
    for k in range(folds):
        total = total + parts[k] if k in parts else total
        out.append(total)
    return out


def expanding_medians(rows: DataFrame, folds: int, blocks: Blocks = ONE_BLOCK) -> list[float | None]:
    """Exact median of ``_y`` over each fold's training rows, from the counts of its values."""
    known = rows.where(F.col("_y").isNotNull() & (F.col("_stage") < folds))
    counts = known.groupBy("_y").agg(*[F.count_if(F.col("_stage") <= k).alias(f"_n{k}") for k in range(folds)])
    below = {f"_b{k}": ("sum", F.col(f"_n{k}")) for k in range(folds)}
    d = running(counts, [], "_y", below, blocks)
    total = known.agg(*[F.count_if(F.col("_stage") <= k).alias(f"_t{k}") for k in range(folds)])
    d = d.crossJoin(F.broadcast(total))

    def value_at(k: int, place: Column) -> Column:
        here = (place >= F.col(f"_b{k}") - F.col(f"_n{k}")) & (place < F.col(f"_b{k}"))
        return F.max(F.when(here, F.col("_y")))

    middle = [F.expr(f"_t{k} - 1") for k in range(folds)]
    got = d.agg(*[((value_at(k, F.floor(m / 2)) + value_at(k, F.ceil(m / 2))) / 2).alias(f"m{k}") for k, m in enumerate(middle)]).first()
    return [got[f"m{k}"] for k in range(folds)]


def ridge_fit(m: Moments, alpha: float = RIDGE_ALPHA) -> np.ndarray:
    """Intercept and coefficients of y (the last column): squared errors plus ``alpha`` times the squared weights of
    standardised features, the intercept free. A constant feature has weight 0."""
    x = m.cross[:-1, :-1]
    scale = np.sqrt(np.diag(x) / m.n)
    scale[scale == 0] = 1.0
    weight = np.linalg.solve(x / np.outer(scale, scale) + alpha * np.eye(len(scale)), m.cross[:-1, -1] / scale) / scale
    return np.append(m.mean[-1] - weight @ m.mean[:-1], weight)


def out_of_fold(
    df: DataFrame,
    folds: DataFrame,
    ts: str,
    ids: Sequence[str],
    features: Sequence[str],
    label: str,
    models: Sequence[str] = ("naive", "logistic", "boosted"),
    least: int = LEAST,
    boosted: dict | None = None,
    blocks: Blocks = ONE_BLOCK,
    threads: int = 4,
) -> DataFrame:
    """``(ids, fold, label, model, prediction)``: every validation row once per model, labelled or not.

    ``models``: naive and logistic and boosted give probabilities for a 0/1 label if logistic is among them or
    ``models`` says ``boosted_classes``; naive, ridge and boosted give values otherwise. Naive is the base rate of
    classes and the median of values. ``folds`` comes from ``fold_dimension``: a few rows, which reach the driver, as
    do one row of sums a stage. Folds with fewer than ``least`` labelled training rows have no predictions.

    Rows without a label or a feature train no model but naive; a missing feature counts as its training mean when a
    row is predicted. All passes read one saved table; iterative models mask it by stage.
    """
    plan = sorted(folds.collect(), key=lambda f: f["train_end"])
    classes = "logistic" in models or "boosted_classes" in models
    base = staged(df, plan, ts).withColumn("_y", F.col(label).cast("double")).select(*ids, "fold", "_stage", label, "_y", *features)
    iterative = [m for m in models if m not in ("naive", "ridge")]
    path = scratch_dir(df.sparkSession, "fold-rows")
    base.where(F.col("fold").isNotNull() | (F.col("_stage") < len(plan))).write.parquet(path)
    base = df.sparkSession.read.schema(base.schema).parquet(path)
    labelled = expanding(stage_moments(base, ["_y"]), len(plan), 1)
    whole = expanding(stage_moments(base, [*features, "_y"]), len(plan), len(features) + 1)
    ready = [k for k in range(len(plan)) if labelled[k].n >= least and whole[k].n > 0]
    none = base.limit(0).select(*ids, "fold", label, F.lit("").alias("model"), F.lit(0.0).alias("prediction"))
    parts = []
    if "naive" in models or "ridge" in models:
        medians = expanding_medians(base, len(plan), blocks) if "naive" in models and not classes else None
        rows = []
        for k in ready:
            means = [float(x) for x in whole[k].mean[:-1]]
            if "naive" in models:
                rows.append((plan[k]["fold"], "naive", float(labelled[k].mean[0]) if classes else medians[k], [0.0] * len(features), means))
            if "ridge" in models:
                b, *w = ridge_fit(whole[k]).tolist()
                rows.append((plan[k]["fold"], "ridge", b, w, means))
        fits = df.sparkSession.createDataFrame(rows, "fold bigint, model string, _b double, _w array<double>, _m array<double>")
        score = F.col("_b")
        for i, f in enumerate(features):
            score = score + F.coalesce(F.col(f).cast("double"), F.col("_m")[i]) * F.col("_w")[i]
        parts.append(base.join(F.broadcast(fits), "fold").select(*ids, "fold", label, "model", score.alias("prediction")))

    settings = {**BOOSTED, **(boosted or {})}
    common = {"featuresCol": "_x", "labelCol": "_y"}

    def fit(k: int) -> list[DataFrame]:
        filled = {f: F.coalesce(F.col(f).cast("double"), F.lit(float(m))) for f, m in zip(features, whole[k].mean)}
        assemble = VectorAssembler(inputCols=list(features), outputCol="_x").transform
        train = assemble(base.where(F.col("_stage") <= k).dropna(subset=["_y", *features]))
        val = assemble(base.where(F.col("fold") == plan[k]["fold"]).withColumns({f"_raw_{f}": F.col(f) for f in features}).withColumns(filled))
        found = []
        for name in iterative:
            if name == "logistic":
                model = LogisticRegression(maxIter=200, tol=1e-4, regParam=1 / (LOGISTIC_C * whole[k].n), **common)
            else:
                model = GBTClassifier(**settings, **common) if classes else GBTRegressor(lossType="absolute", **settings, **common)
            p = vector_to_array("probability")[1] if classes else F.col("prediction")
            scored = model.fit(train).transform(val)
            found.append(scored.select(*ids, "fold", label, F.lit(name.split("_")[0]).alias("model"), p.alias("prediction")))
        return found

    if iterative:
        with ThreadPoolExecutor(threads) as pool:
            parts += [d for found in pool.map(fit, ready) for d in found]
    return reduce(DataFrame.unionByName, parts, none)

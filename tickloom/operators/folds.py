"""Chronological folds with purging, train-only preprocessing, linear fits and what folds say about them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import ONE_BLOCK, exact_quantiles
from tickloom.operators.signals import classification_scores
from tickloom.operators.stats import attach, long_columns, safe_corr


def block_edges(df: DataFrame, ts: str, n: int) -> DataFrame:
    """One row: n + 1 equal wall-clock edges as an array, the last one just past the end."""
    d = df.agg(F.min(ts).alias("_a"), (F.max(ts) + 1).alias("_b"))
    edges = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.expr("_a") + F.floor(i * (F.col("_b") - F.col("_a")) / n))
    return d.select(edges.alias("edges"))


def assign_blocks(df: DataFrame, ts: str, n: int, out: str = "block") -> DataFrame:
    d = df.crossJoin(F.broadcast(block_edges(df, ts, n)))
    at = F.size(F.filter("edges", lambda e: e <= F.col(ts))) - 1
    return d.withColumn(out, F.greatest(F.least(at, F.lit(n - 1)), F.lit(0))).drop("edges")


def fold_dimension(df: DataFrame, ts: str, n: int, first: int, purge: int) -> DataFrame:
    """Expanding folds: train up to block start - purge, validate on the block. One row per fold."""
    e = block_edges(df, ts, n).withColumn("block", F.explode(F.sequence(F.lit(first), F.lit(n - 1))))
    start = F.element_at("edges", F.col("block") + 1)
    return e.select(
        (F.col("block") - first).alias("fold"), "block", (start - purge).alias("train_end"), start.alias("val_start"),
        F.element_at("edges", F.col("block") + 2).alias("val_end"),
    )


def fold_rows(df: DataFrame, folds: DataFrame, ts: str) -> DataFrame:
    """Rows once per fold in which they serve, with their ``role``; the folds table is a few rows."""
    t = F.col(ts)
    role = F.when(t <= F.col("train_end"), "train").when((t >= F.col("val_start")) & (t < F.col("val_end")), "val")
    return df.crossJoin(F.broadcast(folds)).withColumn("role", role).where("role IS NOT NULL")


def fold_table(df: DataFrame, folds: DataFrame, ts: str) -> DataFrame:
    n = fold_rows(df.select(ts), folds, ts).groupBy("fold").agg(
        F.count_if(F.col("role") == "train").alias("train_rows"), F.count_if(F.col("role") == "val").alias("val_rows")
    )
    return folds.join(n, "fold", "left").na.fill(0, ["train_rows", "val_rows"])


def purged_population(df: DataFrame, folds: DataFrame, ts: str, horizons: dict[str, int], margin: int) -> DataFrame:
    """Validation rows at least horizon + margin into their block, per label column."""
    val = fold_rows(df, folds, ts).where("role = 'val'")
    labels = F.array(*[F.struct(F.lit(c).alias("label"), F.lit(h).cast("bigint").alias("horizon"), F.col(c).alias("y")) for c, h in horizons.items()])
    d = val.select("fold", "val_start", ts, F.inline(labels))
    return d.where(F.col("y").isNotNull() & (F.col(ts) >= F.col("val_start") + F.col("horizon") + margin))


def calendar_splits(df: DataFrame, day: str, train: int, val: int, test: int, step: int) -> DataFrame:
    """Rolling day windows train / val / test, moved by ``step`` days until the test window leaves the data."""
    d = df.agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    room = F.greatest(F.floor((F.col("_b") + 1 - F.col("_a") - train - val - test) / step), F.lit(-1))
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("bigint"), room.cast("bigint"), F.lit(1).cast("bigint")))).where(room >= 0)
    start = F.col("_a") + F.col("fold") * step
    return d.select(
        "fold", start.alias("train_start"), (start + train).alias("val_start"), (start + train + val).alias("test_start"), (start + train + val + test).alias("test_end")
    )


def fit_scaler(train: DataFrame, cols: Sequence[str], low: float, high: float, cut=None) -> DataFrame:
    """Per column on training rows only: clip bounds, fill median of the clipped values, mean and
    population deviation after clipping and filling."""
    long = long_columns(train, [], cols)
    known = long.where("value IS NOT NULL")
    bounds = exact_quantiles(known, ["name"], "value", {"low": low, "high": high}, cut("value") if cut else ONE_BLOCK)
    d = long.join(F.broadcast(bounds), "name")
    d = d.withColumn("value", F.when(F.col("value").isNotNull(), F.greatest(F.least("value", "high"), "low")))
    mid = exact_quantiles(d.where("value IS NOT NULL"), ["name"], "value", {"median": 0.5}, cut("value") if cut else ONE_BLOCK)
    d = d.join(F.broadcast(mid), "name").withColumn("value", F.coalesce("value", "median"))
    scale = F.stddev_pop("value")
    return d.groupBy("name").agg(
        F.first("low").alias("low"), F.first("high").alias("high"), F.first("median").alias("median"), F.avg("value").alias("mean"),
        F.when(scale > 0, scale).otherwise(1.0).alias("scale"),
    )


def wide_params(params: DataFrame, cols: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """A parameter table (one row per column name) as a single row ``{column}_{field}``."""
    return params.agg(*[F.max(F.when(F.col("name") == c, F.col(f))).alias(f"{c}_{f}") for c in cols for f in fields])


def apply_scaler(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    p = wide_params(params, cols, ["low", "high", "median", "mean", "scale"])
    d = df.crossJoin(F.broadcast(p))

    def scaled(c: str) -> Column:
        v = F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c).cast("double"), F.col(f"{c}_high")), F.col(f"{c}_low")))
        return (F.coalesce(v, F.col(f"{c}_median")) - F.col(f"{c}_mean")) / F.col(f"{c}_scale")

    return d.withColumns({f"{c}_z": scaled(c) for c in cols}).drop(*p.columns)


def frozen_transforms(train: DataFrame, cols: Sequence[str], cut=None) -> DataFrame:
    """Development-only mean, population deviation, median and decile thresholds per column."""
    long = long_columns(train, [], cols).where("value IS NOT NULL")
    probs = {f"d{i}": i / 10 for i in range(1, 10)}
    q = exact_quantiles(long, ["name"], "value", probs, cut("value") if cut else ONE_BLOCK)
    m = long.groupBy("name").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("population_std"))
    return attach(m, q, ["name"]).withColumn("median", F.col("d5"))


def ols_fit(df: DataFrame, features: Sequence[str], y: str, ridge: float = 0.0) -> DataFrame:
    """Coefficients of a linear fit (normal equations in one distributed pass): name, value."""
    whole = df.select(*features, F.col(y).cast("double").alias("_y")).dropna()
    x = VectorAssembler(inputCols=list(features), outputCol="_x").transform(whole)
    model = LinearRegression(featuresCol="_x", labelCol="_y", solver="normal", regParam=ridge, standardization=False).fit(x)
    rows = [("intercept", float(model.intercept)), *[(f, float(c)) for f, c in zip(features, model.coefficients)]]
    return df.sparkSession.createDataFrame(rows, "name string, value double")


def linear_score(df: DataFrame, coefficients: DataFrame, features: Sequence[str], out: str = "score") -> DataFrame:
    """intercept + sum of feature * coefficient, NULL when any feature is NULL."""
    names = ["intercept", *features]
    row = coefficients.agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"_c_{n}") for n in names])
    d = df.crossJoin(F.broadcast(row))
    score = F.col("_c_intercept")
    for f in features:
        score = score + F.col(f) * F.col(f"_c_{f}")
    return d.withColumn(out, score).drop(*[f"_c_{n}" for n in names])


def coefficient_summary(coefficients: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Over folds: mean, median, range, share positive; and each feature's share of mean |value|."""
    c = F.col("value")
    d = coefficients.groupBy(*keys).agg(
        F.count("*").alias("folds"), F.avg(c).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.avg((c > 0).cast("int")).alias("share_positive"), F.avg(F.abs(c)).alias("_gain"),
    )
    return d.crossJoin(F.broadcast(d.agg(F.sum("_gain").alias("_all")))).withColumn("gain_share", F.col("_gain") / F.col("_all")).drop("_gain", "_all")


def nested_delta(base: DataFrame, extended: DataFrame, ids: Sequence[str], label: str, p: str, block: str, least: int, cut=None) -> DataFrame:
    """What extra features add out of fold: pooled AUC, log-loss and Brier changes and the block AUC change."""
    e = extended.select(*ids, F.col(p).alias("_e"))
    both = base.join(e, list(ids)).select(*ids, block, F.col(label).alias("t"), F.col(p).alias("_b"), "_e")
    b = cut("_b") if cut else ONE_BLOCK

    def scores(keys: Sequence[str], col: str, tag: str) -> DataFrame:
        s = classification_scores(both, keys, "t", col, b)
        return s.select(*keys, "n", *[F.col(m).alias(f"{m}_{tag}") for m in ("roc_auc", "log_loss", "brier")])

    pooled = scores([], "_b", "base").drop("n").crossJoin(scores([], "_e", "extended"))
    blocks = scores([block], "_b", "base").join(scores([block], "_e", "extended").drop("n"), block).where(F.col("n") >= least)
    change = F.col("roc_auc_extended") - F.col("roc_auc_base")
    s = blocks.where(change.isNotNull()).agg(
        F.count("*").alias("blocks"), F.avg(change).alias("block_mean"), F.min(change).alias("block_worst"), F.avg((change > 0).cast("int")).alias("share_positive")
    )
    d = pooled.crossJoin(s)
    return d.withColumns({f"delta_{m}": F.col(f"{m}_extended") - F.col(f"{m}_base") for m in ("roc_auc", "log_loss", "brier")})


def residual_diagnostic(df: DataFrame, signal: str, controls: Sequence[str], outcome: str) -> DataFrame:
    """R2 of the signal on controls, and how the signal and its residual correlate with an outcome."""
    known = df.where(F.col(signal).isNotNull()).dropna(subset=list(controls))
    d = linear_score(known, ols_fit(known, controls, signal), controls, "_fit")
    r = F.col(signal) - F.col("_fit")
    d = d.withColumn("_r", r)
    return d.agg(
        F.count("*").alias("n"), (1 - F.sum(r * r) / F.nullif(F.var_pop(signal) * F.count("*"), F.lit(0.0))).alias("r2"), safe_corr(signal, "_fit").alias("corr_fit"),
        safe_corr("_r", outcome).alias("corr_residual"), safe_corr(signal, outcome).alias("corr_signal"),
    )

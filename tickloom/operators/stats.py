"""Statistics tables: moments, ranks, buckets, correlations, robust errors, bootstrap, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ordered import (
    ONE_BLOCK,
    Blocks,
    average_ranks,
    exact_quantiles,
    join_keys,
    row_numbers,
    running,
    shifted,
)


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-key constants back onto the rows; without keys the table is one row."""
    return join_keys(df, table, keys) if keys else df.crossJoin(F.broadcast(table))


def with_group_stats(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column], blocks: Blocks) -> DataFrame:
    """Rows with aggregates of their whole key. A size-checked frame (one block) reads its input once
    through a window; a larger one pre-aggregates and joins, so a hot key never gathers in one task."""
    if blocks.single:
        w = Window.partitionBy(*keys)
        return df.withColumns({o: a.over(w) for o, a in aggs.items()})
    return attach(df, df.groupBy(*keys).agg(*[a.alias(o) for o, a in aggs.items()]), keys)


def add_standard_scores(
    df: DataFrame, cols: dict[str, str], keys: Sequence[str] = (), blocks: Blocks = ONE_BLOCK
) -> DataFrame:
    """Population z-scores (column -> output) over each key."""
    aggs = {}
    for c in cols:
        aggs |= {f"_m_{c}": F.avg(c), f"_s_{c}": F.stddev_pop(c)}
    d = with_group_stats(df, keys, aggs, blocks)
    z = {o: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.nullif(F.col(f"_s_{c}"), F.lit(0.0))) for c, o in cols.items()}
    return d.withColumns(z).drop(*[f"_{p}_{c}" for p in "ms" for c in cols])


def grouped(
    df: DataFrame,
    keys: Sequence[str],
    aggs: dict[str, Column],
    quantiles: dict[str, tuple[str, float]] | None = None,
    cut=None,
) -> DataFrame:
    """Aggregates and exact quantiles (output -> (column, p)) of each key in one table.

    ``cut`` maps a column to the Blocks of its values; one block means the built-in percentile.
    """
    quantiles = quantiles or {}
    blocks = {c: (cut(c) if cut else ONE_BLOCK) for c, _ in quantiles.values()}
    near = {o: q for o, q in quantiles.items() if blocks[q[0]].single}
    cols = [a.alias(o) for o, a in aggs.items()]
    cols += [F.percentile(F.col(c), F.lit(p)).alias(o) for o, (c, p) in near.items()]
    out = df.groupBy(*keys).agg(*cols)
    for c, b in blocks.items():
        if not b.single:
            probs = {o: p for o, (qc, p) in quantiles.items() if qc == c}
            out = attach(out, exact_quantiles(df.where(F.col(c).isNotNull()), keys, c, probs, b), keys)
    return out


def mean_if(cond: Column, value: Column) -> Column:
    return F.avg(F.when(cond, value))


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Correlation over the rows with both values; NULL, not an error, where one side has no variance."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def share(cond: Column) -> Column:
    """Share of rows meeting a condition, among rows where it is defined."""
    return F.avg(cond.cast("int"))


def long_columns(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    args = ", ".join(f"'{c}', cast({c} as double)" for c in cols)
    return df.select(*ids, F.expr(f"stack({len(cols)}, {args}) AS ({name}, {value})"))


def describe_columns(df: DataFrame, cols: Sequence[str], cut=None) -> DataFrame:
    long = long_columns(df, [], cols)
    q = {f"p{int(p * 100):02d}": ("value", p) for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)}
    v = F.col("value")
    aggs = {
        "rows": F.count("*"), "observed": F.count(v), "missing": F.count_if(v.isNull()), "mean": F.avg(v),
        "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v),
    }
    return grouped(long, ["name"], aggs, q, cut)


def population_stats(df: DataFrame, keys: Sequence[str], wait: str, fill_horizons: dict[str, int], markouts: Sequence[str], seen_us: Column, cut=None) -> DataFrame:
    """Fill, mechanism and markout statistics, each with the count it was conditioned on.

    ``wait`` is the time to fill (NULL when unfilled); a fill horizon is evaluable for filled rows
    and for rows observed at least that long.
    """
    w = F.col(wait)
    filled = w.isNotNull()
    aggs = {
        "eligible": F.count("*"),
        "filled": F.count(w),
        "fill_rate": share(filled),
        "at_quote_fills": F.count_if(F.col("mechanism") == "at_quote"),
        "through_fills": F.count_if(F.col("mechanism") == "through"),
        "through_share": mean_if(filled, (F.col("mechanism") == "through").cast("int")),
    }
    for o, h in fill_horizons.items():
        known = filled | (seen_us >= h)
        aggs[f"evaluable_{o}"] = F.count_if(known)
        aggs[f"fill_rate_{o}"] = mean_if(known, F.coalesce(w <= h, F.lit(False)).cast("int"))
    q = {"median_wait": (wait, 0.5)}
    for m in markouts:
        c = F.col(m)
        aggs |= {
            f"{m}_observed": F.count(c),
            f"{m}_censored": F.count(w) - F.count(c),
            f"{m}_mean": F.avg(c),
            f"{m}_favourable": share(c > 0),
            f"{m}_required": -F.avg(c),
            f"{m}_required_bps": F.avg(F.try_divide(-c * 10_000.0, F.nullif(2 * F.col("price"), F.lit(0)))),
        }
        q |= {f"{m}_p10": (m, 0.1), f"{m}_median": (m, 0.5), f"{m}_p90": (m, 0.9)}
    return grouped(df, keys, aggs, q, cut)


def multi_grain(df: DataFrame, grains: Sequence[Sequence[str]], aggs: dict[str, Column]) -> DataFrame:
    """The same statistics at several grains in one pass (GROUPING SETS); absent keys are NULL."""
    cols = list(dict.fromkeys(c for g in grains for c in g))
    sets = [[F.col(c) for c in g] for g in grains]
    return df.groupingSets(sets, *[F.col(c) for c in cols]).agg(
        F.grouping_id().alias("grain"), *[a.alias(o) for o, a in aggs.items()]
    )


def mechanism_parts(df: DataFrame, keys: Sequence[str], markout: str) -> DataFrame:
    """E[m] = P(through) E[m | through] + P(at quote) E[m | at quote], with the rebuild error."""
    m = F.col(markout)
    thru, quote = F.col("mechanism") == "through", F.col("mechanism") == "at_quote"
    d = df.where(m.isNotNull() & F.col("mechanism").isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("observed"), F.avg(m).alias("mean"), share(thru).alias("p_through"), share(quote).alias("p_at_quote"),
        mean_if(thru, m).alias("mean_through"), mean_if(quote, m).alias("mean_at_quote"),
    )
    part = F.coalesce(F.col("p_through") * F.col("mean_through"), F.lit(0.0)) + F.coalesce(F.col("p_at_quote") * F.col("mean_at_quote"), F.lit(0.0))
    return d.withColumn("error", F.abs(F.col("mean") - part))


def rank_pairs(df: DataFrame, keys: Sequence[str], x: str, y: str, cut=None) -> DataFrame:
    """Rows where both are known, with average ranks of each inside its key."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = average_ranks(known, keys, x, "_rx", cut(x) if cut else ONE_BLOCK)
    return average_ranks(d, keys, y, "_ry", cut(y) if cut else ONE_BLOCK)


def information_coefficients(df: DataFrame, keys: Sequence[str], x: str, y: str, cut=None) -> DataFrame:
    """Pairs, Pearson and Spearman (average ranks) per key."""
    return rank_pairs(df, keys, x, y, cut).groupBy(*keys).agg(
        F.count("*").alias("n"), safe_corr(x, y).alias("pearson"), safe_corr("_rx", "_ry").alias("spearman")
    )


def _lag_scores(df: DataFrame, run: Sequence[str], order: str, scores: Sequence[str], lags: int, step: int, blocks: Blocks) -> DataFrame:
    """Scores of the rows 1..lags steps earlier in the same gapless run, as ``_{score}_{lag}``."""
    outs = {f"_{s}_{k}": (F.col(s), k) for s in scores for k in range(1, lags + 1)}
    outs |= {f"_at_{k}": (F.col(order), k) for k in range(1, lags + 1)}
    d = shifted(df, run, order, outs, blocks)
    for k in range(1, lags + 1):
        whole = F.col(order) - F.col(f"_at_{k}") == k * step
        d = d.withColumns({f"_{s}_{k}": F.when(whole, F.col(f"_{s}_{k}")) for s in scores})
    return d


def hac_slope(
    df: DataFrame, keys: Sequence[str], run: Sequence[str], order: str, x: str, y: str, lags: int, step: int, blocks: Blocks = ONE_BLOCK
) -> DataFrame:
    """OLS slope with a Newey-West (Bartlett) standard error whose lags stay inside gapless runs.

    The 2 x 2 sandwich is spelled out over sums, so no matrix leaves the aggregate.
    """
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    known = df.where(X.isNotNull() & Y.isNotNull())
    m = known.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(X).alias("_sx"), F.sum(Y).alias("_sy"), F.sum(X * X).alias("_sxx"), F.sum(X * Y).alias("_sxy"),
        F.stddev_pop(X).alias("_sd"),
    )
    det = F.nullif(F.col("n") * F.col("_sxx") - F.col("_sx") * F.col("_sx"), F.lit(0.0))
    m = m.withColumn("slope", (F.col("n") * F.col("_sxy") - F.col("_sx") * F.col("_sy")) / det)
    m = m.withColumn("intercept", (F.col("_sy") - F.col("slope") * F.col("_sx")) / F.col("n"))
    e = attach(known, m.select(*keys, "slope", "intercept"), keys)
    resid = Y - F.col("intercept") - F.col("slope") * X
    e = e.withColumn("s0", resid).withColumn("s1", F.col("s0") * X)
    e = _lag_scores(e, [*keys, *run], order, ["s0", "s1"], lags, step, blocks)

    def total(a: str, b: str) -> Column:
        out = F.sum(F.col(a) * F.col(b))
        for k in range(1, lags + 1):
            weight = 1 - k / (lags + 1)
            pair = F.col(a) * F.col(f"_{b}_{k}") + F.col(b) * F.col(f"_{a}_{k}")
            out = out + weight * F.coalesce(F.sum(pair), F.lit(0.0))
        return out

    meat = e.groupBy(*keys).agg(total("s0", "s0").alias("_m00"), total("s0", "s1").alias("_m01"), total("s1", "s1").alias("_m11"))
    d = attach(m, meat, keys)
    a0, a1 = -F.col("_sx") / det, F.col("n") / det
    var = a0 * a0 * F.col("_m00") + 2 * a0 * a1 * F.col("_m01") + a1 * a1 * F.col("_m11")
    d = d.withColumn("hac_se", F.sqrt(F.greatest(var, F.lit(0.0))))
    return d.select(
        *keys, "n", "slope", "hac_se", F.try_divide(F.col("slope"), F.nullif("hac_se", F.lit(0.0))).alias("hac_t"),
        (F.col("slope") * F.col("_sd")).alias("effect_per_sd"),
    )


def hac_mean_se(df: DataFrame, keys: Sequence[str], run: Sequence[str], order: str, value: str, lags: int, blocks: Blocks = ONE_BLOCK) -> DataFrame:
    """Mean with a Newey-West standard error; lags count rows and restart with every run."""
    known = df.where(F.col(value).isNotNull())
    m = known.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    c = attach(known, m, keys).withColumn("s0", F.col(value) - F.col("mean"))
    c = shifted(c, [*keys, *run], order, {f"_l{k}": (F.col("s0"), k) for k in range(1, lags + 1)}, blocks)
    long_run = F.sum(F.col("s0") * F.col("s0"))
    for k in range(1, lags + 1):
        long_run = long_run + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("s0") * F.col(f"_l{k}")), F.lit(0.0))
    s = c.groupBy(*keys).agg(long_run.alias("_lr"))
    return attach(m, s, keys).select(*keys, "n", "mean", (F.sqrt(F.greatest("_lr", F.lit(0.0))) / F.col("n")).alias("hac_se"))


def tail_share(df: DataFrame, keys: Sequence[str], value: str, tie: str, shares: Sequence[float], least: int, blocks: Blocks = ONE_BLOCK) -> DataFrame:
    """How much of the total loss the worst shares of rows carry, and the mean of the other 90 %."""
    known = df.where(F.col(value).isNotNull())
    n = known.groupBy(*keys).agg(F.count("*").alias("observed")).where(F.col("observed") >= least)
    d = row_numbers(known, keys, value, "_r", blocks, [tie]).join(n, list(keys))
    v, r = F.col(value), F.col("_r")

    def size(s: float) -> Column:
        return F.greatest(F.bround(F.col("observed") * F.lit(s)), F.lit(1))

    loss = F.nullif(F.sum(F.least(v, F.lit(0))), F.lit(0))
    aggs = [F.max("observed").alias("observed"), F.sum(v).alias("total"), F.sum(F.least(v, F.lit(0))).alias("total_negative")]
    for s in shares:
        worst = r <= size(s)
        aggs += [
            F.count_if(worst).alias(f"worst_{int(s * 100)}_n"), mean_if(worst, v).alias(f"worst_{int(s * 100)}_mean"),
            (F.sum(F.when(worst, v)) / loss).alias(f"worst_{int(s * 100)}_share"),
        ]
    return d.groupBy(*keys).agg(*aggs, mean_if(r > size(0.1), v).alias("best_90_mean"))


def block_bootstrap(sums: DataFrame, keys: Sequence[str], block: str, draws: int) -> DataFrame:
    """Seeded resampling of whole blocks (one row per key and block: ``s`` = sum, ``n`` = count).

    Draw d takes, for each of its slots, the block whose position equals a hash of (d, slot). Only
    block totals are resampled; draws x blocks rows per key.
    """
    n_blocks = sums.groupBy(*keys).agg(F.count("*").alias("_b"), (F.sum("s") / F.sum("n")).alias("mean"))
    pos = row_numbers(sums, keys, block, "_pos")
    draws_ = n_blocks.withColumn("_slot", F.explode(F.sequence(F.lit(1), F.col("_b"))))
    draws_ = draws_.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    text = F.md5(F.concat_ws(":", F.col("_draw").cast("string"), F.col("_slot").cast("string")))
    pick = F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint") % F.col("_b") + 1
    got = draws_.withColumn("_pos", pick).join(pos.select(*keys, "_pos", "s", "n"), [*keys, "_pos"])
    means = got.groupBy(*keys, "_draw").agg((F.sum("s") / F.sum("n")).alias("_m"))
    band = means.groupBy(*keys).agg(F.percentile("_m", F.lit(0.05)).alias("p05"), F.percentile("_m", F.lit(0.95)).alias("p95"))
    return attach(n_blocks.withColumnRenamed("_b", "blocks"), band, keys)


def decile_report(df: DataFrame, bucket: str, y: str, cut=None) -> DataFrame:
    """Rows, mean, median and standard error per bucket, whether the mean rises, and top minus bottom."""
    d = grouped(
        df, [bucket],
        {"n": F.count("*"), "mean": F.avg(y), "se": F.stddev_samp(y) / F.sqrt(F.count(y))}, {"median": (y, 0.5)}, cut,
    )
    ends = d.agg((F.max_by("mean", bucket) - F.min_by("mean", bucket)).alias("top_minus_bottom"))
    d = shifted(d, [], bucket, {"_prev": (F.col("mean"), 1)})
    rising = F.col("mean") >= F.coalesce("_prev", "mean")
    return d.withColumn("rising", rising).drop("_prev").crossJoin(F.broadcast(ends))


def tail_distribution(df: DataFrame, keys: Sequence[str], m: str, limits: Sequence[int], cut=None) -> DataFrame:
    aggs = {"observed": F.count(m), "mean": F.avg(m), **{f"tail_{k}": share(F.col(m) <= -k) for k in limits}}
    q = {f"p{int(p * 100):02d}": (m, p) for p in (0.01, 0.05, 0.5, 0.95)}
    return grouped(df, keys, aggs, q, cut)

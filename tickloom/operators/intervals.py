"""Questions about the rows inside a bounded window after each query row.

Query rows are copied to every time block their window touches, meet the series rows of the same
(key, block) there, and answers of several blocks are merged by a small aggregate. No pair of
query and series row is ever emitted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import BLOCK, ONE_BLOCK, Blocks


def first_index_beyond(values: np.ndarray, start: np.ndarray, limit: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """First i in [start, limit) with values[i] > bound, else limit; all queries at once on a tree of maxima.

    The tree has two numbers a value. Each query climbs over stretches that hold nothing beyond its bound and, where
    one does, goes down to its first such value: as many steps as the tree has levels, twice.
    """
    n = len(values)
    out = limit.copy()
    open_ = np.flatnonzero(start < np.minimum(limit, n))
    if not len(open_):
        return out
    low = np.iinfo(values.dtype).min if values.dtype.kind in "iu" else -np.inf
    levels = [values]
    while len(levels[-1]) > 1:
        last = levels[-1]
        if len(last) % 2:
            last = levels[-1] = np.append(last, np.array(low, dtype=values.dtype))
        levels.append(np.maximum(last[::2], last[1::2]))
    at, want, top = start[open_], bound[open_], limit[open_]
    found: list[list[np.ndarray]] = []
    for k, tree in enumerate(levels):
        node = at >> k
        look = (node & 1 == 1) | (k == len(levels) - 1)
        hit = np.zeros(len(at), dtype=bool)
        hit[look] = tree[node[look]] > want[look]
        found.append([open_[hit], node[hit], want[hit]])
        at = np.where(look, (node + 1) << k, at)
        stay = ~hit & (at < top) & (at >> k < len(tree))
        open_, at, want, top = open_[stay], at[stay], want[stay], top[stay]
    who, node, want = found[-1]
    for k in range(len(levels) - 2, -1, -1):
        node = node << 1
        node = node + (levels[k][node] <= want)
        who, node, want = (np.concatenate(x) for x in zip((who, node, want), found[k]))
    out[who] = np.minimum(node, limit[who])
    return out


def split_sums(values: np.ndarray, weights: np.ndarray, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Sum of weights over i in [lo, hi) with values[i] < bound, bit by bit on the value ranks."""
    if not len(values):
        return np.zeros(len(lo), dtype="int64")
    levels, ranks = np.unique(values, return_inverse=True)
    want = np.searchsorted(levels, bound, side="left")
    bits = max(1, int(len(levels)).bit_length())
    lo, hi = lo.copy(), hi.copy()
    out = np.zeros(len(lo), dtype="int64")
    for b in range(bits - 1, -1, -1):
        zero = (ranks >> b) & 1 == 0
        zeros = np.concatenate(([0], np.cumsum(zero)))
        sums = np.concatenate(([0], np.cumsum(np.where(zero, weights, 0))))
        one = (want >> b) & 1 == 1
        out += np.where(one, sums[hi] - sums[lo], 0)
        total = zeros[-1]
        lo = np.where(one, total + lo - zeros[lo], zeros[lo])
        hi = np.where(one, total + hi - zeros[hi], zeros[hi])
        order = np.concatenate((np.flatnonzero(zero), np.flatnonzero(~zero)))
        ranks, weights = ranks[order], weights[order]
    return out


def _to_blocks(df: DataFrame, lo: Column, hi: Column, blocks: Blocks) -> DataFrame:
    if blocks.single:
        return df.withColumn(BLOCK, F.lit(0))
    d = blocks.assign(blocks.assign(df, lo, "_b0"), hi, "_b1")
    return d.withColumn(BLOCK, F.explode(F.sequence("_b0", "_b1"))).drop("_b0", "_b1")


def first_beyond(
    queries: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    qid: Sequence[str],
    after: str,
    until: Column,
    bound: Column,
    sign: Column,
    ts: str,
    value: str,
    out: str,
    blocks: Blocks = ONE_BLOCK,
    ord_: str | None = None,
    closed: bool = False,
) -> DataFrame:
    """Queries with the earliest series row in (after, until) whose value lies beyond ``bound``.

    ``sign`` +1 looks for value > bound, -1 for value < bound; ``closed`` includes ``until``.
    Adds ``out`` (stamp, NULL when none) and, with ``ord_``, ``out_ord`` (first ordinal of ties).
    """
    blocks = blocks.for_python
    names = {c: f"_q{i}" for i, c in enumerate(qid)}
    types = dict(queries.dtypes)
    q = queries.select(
        *keys,
        *[F.col(c).alias(n) for c, n in names.items()],
        F.col(after).alias("_after"),
        (until + (1 if closed else 0)).alias("_until"),
        (bound * sign).cast("bigint").alias("_bound"),
        sign.cast("int").alias("_sign"),
    ).where("_bound IS NOT NULL AND _until > _after")
    q = _to_blocks(q, F.col("_after"), F.col("_until"), blocks)
    order = F.col(ord_) if ord_ else F.lit(0)
    s = series.where(F.col(value).isNotNull()).select(
        *keys, F.col(ts).alias("_ts"), F.col(value).cast("bigint").alias("_v"), order.cast("bigint").alias("_ord")
    )
    s = blocks.assign(s, "_ts")
    ids = list(names.values())

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["_ts", "_ord"])
        stamps, ords, raw = (right[c].to_numpy() for c in ("_ts", "_ord", "_v"))
        found = [left[ids].iloc[:0].assign(_ts=np.array([], dtype="int64"), _ord=np.array([], dtype="int64"))]
        if len(raw):
            for sgn, part in left.groupby("_sign"):
                lo = np.searchsorted(stamps, part["_after"].to_numpy(), side="right")
                hi = np.maximum(lo, np.searchsorted(stamps, part["_until"].to_numpy(), side="left"))
                at = first_index_beyond(raw * sgn, lo, hi, part["_bound"].to_numpy())
                hit = at < hi
                found.append(part[ids][hit].assign(_ts=stamps[at[hit]], _ord=ords[at[hit]]))
        return pd.concat(found, ignore_index=True)

    schema = ", ".join([*[f"{n} {types[c]}" for c, n in names.items()], "_ts bigint", "_ord bigint"])
    hits = q.groupBy(*keys, BLOCK).cogroup(s.groupBy(*keys, BLOCK)).applyInPandas(find, schema)
    stamp = F.struct("_ts", "_ord")
    # On one block every query was asked once, so its answer needs no merging.
    best = hits.select(*ids, stamp.alias("_h")) if blocks.single else hits.groupBy(*ids).agg(F.min(stamp).alias("_h"))
    on = [queries[c].eqNullSafe(best[n]) for c, n in names.items()]
    d = queries.join(best, on, "left")
    cols = [F.col("_h._ts").alias(out)] + ([F.col("_h._ord").alias(f"{out}_ord")] if ord_ else [])
    return d.select(*[queries[c] for c in queries.columns], *cols)


def window_volume(
    queries: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    qid: Sequence[str],
    after: str,
    until: Column,
    bound: Column,
    ts: str,
    value: str,
    weight: str,
    blocks: Blocks = ONE_BLOCK,
) -> DataFrame:
    """Weight of the series rows in (after, until] below, at and above each query's ``bound``."""
    blocks = blocks.for_python
    q = queries.select(
        *keys, F.to_json(F.struct(*qid)).alias("_id"), F.col(after).alias("_after"), until.alias("_until"), bound.cast("bigint").alias("_bound")
    )
    q = _to_blocks(q, F.col("_after"), F.col("_until"), blocks)
    s = series.select(*keys, F.col(ts).alias("_ts"), F.col(value).cast("bigint").alias("_v"), F.col(weight).cast("bigint").alias("_w"))
    s = blocks.assign(s, "_ts")

    def total(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("_ts")
        stamps, v, w = (right[c].to_numpy() for c in ("_ts", "_v", "_w"))
        if not len(v):
            v = w = np.array([], dtype="int64")
            stamps = v
        lo = np.searchsorted(stamps, left["_after"].to_numpy(), side="right")
        hi = np.searchsorted(stamps, left["_until"].to_numpy(), side="right")
        bound_ = left["_bound"].to_numpy()
        run = np.concatenate(([0], np.cumsum(w)))
        below = split_sums(v, w, lo, hi, bound_)
        upto = split_sums(v, w, lo, hi, bound_ + 1)
        ids = left["_id"].to_numpy(dtype=object)
        return pd.DataFrame({"_id": ids, "below": below, "at": upto - below, "above": run[hi] - run[lo] - upto})

    parts = (
        q.groupBy(*keys, BLOCK)
        .cogroup(s.groupBy(*keys, BLOCK))
        .applyInPandas(total, "_id string, below bigint, at bigint, above bigint")
    )
    sums = parts.groupBy("_id").agg(*[F.sum(c).alias(c) for c in ("below", "at", "above")])
    d = queries.withColumn("_id", F.to_json(F.struct(*qid))).join(sums, "_id", "left").drop("_id")
    return d.na.fill(0, ["below", "at", "above"])


def interval_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], start: str, end: str, ts: str, width: int
) -> DataFrame:
    """Pairs with start < ts < end, for windows of at most ``width``: an equi-join on time cells.

    For per-pair work that cannot be summarised; window and key keep the fan-out small, and AQE
    splits a skewed cell.
    """
    cell = F.expr(f"{start} div {width}")
    l = left.withColumn("_cell", F.explode(F.sequence(cell, F.expr(f"{end} div {width}"))))
    r = right.withColumn("_cell", F.expr(f"{ts} div {width}"))
    return l.join(r, [*keys, "_cell"]).where((F.col(ts) > F.col(start)) & (F.col(ts) < F.col(end))).drop("_cell")

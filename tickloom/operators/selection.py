"""Ranking, tails, greedy non-overlap, deterministic samples and set operations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ordered import BLOCK, ONE_BLOCK, Blocks, exact_quantiles, row_numbers
from tickloom.operators.stats import attach

def _starts(stamps: np.ndarray, hold: int) -> np.ndarray:
    """Index of the next stamp that may be kept after each kept one."""
    return np.searchsorted(stamps, stamps + hold, side="left")


def _ends(step: np.ndarray) -> np.ndarray:
    """Last index of the chain from each index; every round doubles how far the chains have gone."""
    n = len(step)
    last = np.where(step < n, step, np.arange(n))
    while True:
        further = last[last]
        if (further == last).all():
            return last
        last = further


def _free_map(pdf: pd.DataFrame, ts: str, hold: int) -> tuple[list[int], list[int]]:
    """A block as a map: entered free from ``upto[i]`` at the latest, it is left free from ``free[i]``.

    Whoever is free after the last stamp passes through. An earlier block's last kept stamp lies before this block's
    first, so only the first ``hold`` of a block can be entered, and entries with one exit are one step of the map.
    """
    stamps = np.sort(pdf[ts].to_numpy())
    enter = stamps[: np.searchsorted(stamps, stamps[0] + hold, side="left") + 1]
    out = stamps[_ends(_starts(stamps, hold))][: len(enter)] + hold
    step = np.append(out[1:] != out[:-1], True)
    return enter[step].tolist(), out[step].tolist()


def _free_from(maps: pd.DataFrame) -> pd.DataFrame:
    """The time from which each block of a key is free: its blocks' maps applied in turn."""
    maps = maps.sort_values(BLOCK)
    free, entered = None, []
    for upto, out in zip(maps["_upto"], maps["_out"]):
        entered.append(free)
        i = 0 if free is None else np.searchsorted(upto, free, side="left")
        free = out[i] if i < len(upto) else free
    return maps.drop(columns=["_upto", "_out"]).assign(_free=pd.array(entered, dtype="Int64"))


def _keep(pdf: pd.DataFrame, ts: str, hold: int, free: int | None) -> pd.DataFrame:
    pdf = pdf.sort_values(ts)
    stamps = pdf[ts].to_numpy()
    step = _starts(stamps, hold).tolist()
    at = 0 if free is None else int(np.searchsorted(stamps, free, side="left"))
    kept = []
    while at < len(step):
        kept.append(at)
        at = step[at]
    return pdf.iloc[kept]


def spaced(df: DataFrame, keys: Sequence[str], ts: str, hold: int, blocks: Blocks = ONE_BLOCK, ties: Sequence[str] = ()) -> DataFrame:
    """Greedy non-overlap: keep a row when it is at least ``hold`` after the last kept one.

    A (key, block) answers for every time from which it may be entered free, and what it answers is a short map of
    steps. The maps of a key are applied in the order of its blocks, one small row each; then every block knows
    where it starts and is walked once. Two passes over the stamps with one exchange, no job while the query is
    built, and one plan however long a run without gaps is. Of rows with the same stamp only the first by ``ties``
    can stay; without ties all of them do.
    """
    stamps = blocks.assign(df.where(F.col(ts).isNotNull()).select(*keys, ts).distinct(), ts)
    by = [*keys, BLOCK]
    types = dict(stamps.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in by)
    if blocks.single:
        kept = stamps.groupBy(*by).applyInPandas(lambda pdf: _keep(pdf, ts, hold, None), stamps.schema)
    else:

        def enter(pdf: pd.DataFrame) -> pd.DataFrame:
            upto, out = _free_map(pdf, ts, hold)
            return pdf[by].head(1).assign(_upto=[upto], _out=[out])

        def walk(pdf: pd.DataFrame, free: pd.DataFrame) -> pd.DataFrame:
            known = free["_free"].dropna()
            return _keep(pdf, ts, hold, int(known.iloc[0]) if len(known) else None)

        maps = stamps.groupBy(*by).applyInPandas(enter, f"{head}, _upto array<bigint>, _out array<bigint>")
        free = maps.groupBy(*keys).applyInPandas(_free_from, f"{head}, _free bigint")
        kept = stamps.groupBy(*by).cogroup(free.groupBy(*by)).applyInPandas(walk, stamps.schema)
    kept = kept.drop(BLOCK)
    if not ties:
        return df.join(kept, [*keys, ts], "left_semi")
    first = df.groupBy(*keys, ts).agg(F.min(F.struct(*ties)).alias("_first"))
    first = first.join(kept, [*keys, ts], "left_semi").select(*keys, ts, "_first.*")
    return df.join(first, [*keys, ts, *ties], "left_semi")


def tail_select(
    df: DataFrame, keys: Sequence[str], score: str, tail: float, blocks: Blocks = ONE_BLOCK
) -> DataFrame:
    """Rows at or above the (1 - tail) quantile of their own fold."""
    if blocks.single:
        d = df.withColumn("_cut", F.percentile(F.col(score), F.lit(1 - tail)).over(Window.partitionBy(*keys)))
    else:
        cut = exact_quantiles(df.where(F.col(score).isNotNull()), keys, score, {"_cut": 1 - tail}, blocks)
        d = attach(df, cut, keys)
    return d.where(F.col(score) >= F.col("_cut")).drop("_cut")


def stratified_first(df: DataFrame, strata: Sequence[str], key: Column, n: int) -> DataFrame:
    """Deterministic n rows per stratum by hash order; Spark prunes each stratum before the shuffle."""
    w = Window.partitionBy(*strata).orderBy(key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def evenly_spaced(
    df: DataFrame, keys: Sequence[str], order: str, cap: int, blocks: Blocks = ONE_BLOCK, ties: Sequence[str] = ()
) -> DataFrame:
    """Rows at floor(i * (n - 1) / (cap - 1)), i = 0..cap-1: a sample spread over the whole key."""
    d = row_numbers(df, keys, order, "_r", blocks, ties)
    d = attach(d, df.groupBy(*keys).agg((F.count("*") - 1).alias("_last")), keys)
    at = F.col("_r") - 1
    i = F.ceil(at * (cap - 1) / F.greatest("_last", F.lit(1)))
    chosen = (i <= cap - 1) & (F.floor(i * F.col("_last") / float(cap - 1)) == at)
    return d.where(chosen).drop("_r", "_last")


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key; a map-side-combined minimum, so a hot key does not gather."""
    rest = [c for c in df.columns if c not in keys]
    lead = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    row = F.min_by(F.struct(*rest), lead)
    return df.groupBy(*keys).agg(row.alias("_r")).select(*keys, "_r.*")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Rank small report tables by several mixed-direction keys."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


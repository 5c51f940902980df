"""Ordered operators that stay distributed when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here the ordering axis is
cut into equi-depth blocks (``Blocks``), work is partitioned by ``(key, block)``, and what has to
cross a block edge travels as a small per-block summary (``running``) or as a halo of copied rows
(``halo_rows``, ``halo_range``). With one block, which is what a small table gets after a size
check, every function below is a single built-in window; both forms give the same rows, NULL keys and
NULL order values included.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.sources.typed import scratch_dir

BLOCK = "_blk"
ROWS_CONF = "spark.tickloom.rowsPerBlock"
DEFAULT_ROWS = 4_000_000
SPLIT_SAMPLE = 100_000
#: Rows between two splits for steps in Python, which take some 1 kB a row, on every core of an executor at once.
PYTHON_ROWS = 250_000


def rows_per_block(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_CONF, str(DEFAULT_ROWS)))


@dataclass(frozen=True)
class Blocks:
    """Split points of a numeric ordering axis; a block covers ``[split_i, split_i+1)``.

    With ``tie``, a numeric column that orders equal values, one value may fill several blocks: ``fine`` splits the
    combined axis of (value, tie). It counts the split values up to a row's value and, where the value is one of
    them, adds the tie's place among all ties; both grow with the order of rows, so blocks stay contiguous.
    """

    splits: tuple[float, ...] = ()
    rows: int = DEFAULT_ROWS
    tie: str | None = None
    tie_span: tuple[float, float] = (0.0, 1.0)
    fine: tuple[float, ...] = ()
    python: tuple[float, ...] = ()

    @property
    def single(self) -> bool:
        return not self.splits

    @property
    def last(self) -> int:
        """The number of the last block that ``assign`` may give (that of NaN)."""
        return max(len(self.splits), len(self.fine)) + 1

    @property
    def for_python(self) -> Blocks:
        """Blocks of at most about ``PYTHON_ROWS`` rows, where the axis was fitted for that, else these ones."""
        return Blocks(self.python, min(self.rows, PYTHON_ROWS)) if self.python else self

    @classmethod
    def fit(cls, df: DataFrame, col: str, bound: int | None = None, tie: str | None = None, python: bool = False) -> Blocks:
        """Quantile split points with at most about ``rows_per_block`` rows between two of them.

        ``bound`` is a proven upper bound of the row count; when it already fits one block no job runs. ``tie``
        names the column by which equal values are ordered, and split when there are too many of them. With
        ``python`` the axis gets splits ``for_python`` too.
        """
        rows = rows_per_block(df.sparkSession)
        small = min(rows, PYTHON_ROWS) if python else rows
        if bound is not None and bound <= small:
            return cls(rows=rows)
        second = F.lit(0.0) if tie is None else F.col(tie).cast("double")
        axis = df.select(F.col(col).cast("double").alias("_axis"), second.alias("_tie")).where("_axis IS NOT NULL AND NOT isnan(_axis)")
        count = axis.count()
        n = math.ceil(count / rows)
        if count <= small:
            return cls(rows=rows)
        # A sample of fixed size places the cuts, so the driver's share doesn't grow with the table.
        sample = axis.sample(min(1.0, SPLIT_SAMPLE / count), seed=7).collect()
        pairs = sorted((r["_axis"], -math.inf if r["_tie"] is None else r["_tie"]) for r in sample)

        def cut(n: int) -> list[tuple[float, float]]:
            return sorted({pairs[i * len(pairs) // n] for i in range(1, n)}) if pairs else []

        cuts = cut(n)
        splits = sorted({v for v, _ in cuts})
        if tie is None:
            narrow = sorted({v for v, _ in cut(math.ceil(count / small))}) if python else []
            return cls(tuple(splits), rows, python=tuple(narrow))
        ties = [t for _, t in pairs if math.isfinite(t)] or [0.0]
        low, width = min(ties), max(max(ties) - min(ties), 1e-300)
        place = {v: i + 1 for i, v in enumerate(splits)}
        fine = [place[v] + cls._tie_place(t, low, width) for v, t in cuts]
        return cls(tuple(splits), rows, tie, (low, width), tuple(sorted(set(fine))))

    @staticmethod
    def _tie_place(tie: float, low: float, width: float) -> float:
        return 0.5 * min(max((tie - low) / width, 0.0), 0.999)

    def at_least(self, width: float) -> Blocks:
        """Fewer splits, each at least ``width`` after the one before."""
        kept: list[float] = []
        for x in self.splits:
            if not kept or x - kept[-1] >= width:
                kept.append(x)
        return Blocks(tuple(kept), self.rows)

    def assign(self, df: DataFrame, at: str | Column, out: str = BLOCK, ties: Sequence[str] = ()) -> DataFrame:
        """``df`` with the block of ``at``; rows ordered by ``ties`` too can be split inside one value."""
        if self.single:
            return df.withColumn(out, F.lit(0))
        at = F.col(at) if isinstance(at, str) else at
        d = self._bucketed(df.withColumn("_axis", at.cast("double")), self.splits)
        if self.fine and ties and ties[0] == self.tie:
            low, width = self.tie_span
            place = F.least(F.greatest((F.col(self.tie).cast("double") - low) / width, F.lit(0.0)), F.lit(0.999))
            split = F.get(F.array(*[F.lit(x) for x in self.splits]), F.col("_cut").cast("int") - 1)
            inside = F.when(F.col("_axis") == split, F.coalesce(place, F.lit(0.0)) * 0.5).otherwise(0.5)
            fine = F.when(F.isnan("_axis"), float("nan")).when(F.col("_axis").isNotNull(), F.col("_cut") + inside)
            d = self._bucketed(d.withColumn("_axis", fine).drop("_cut"), self.fine)
        # NULLs sort first in every window here, so their block is the first one.
        block = F.when(F.col("_axis").isNull(), -1).otherwise(F.col("_cut").cast("int"))
        return d.withColumn(out, block).drop("_axis", "_cut")

    @staticmethod
    def _bucketed(df: DataFrame, splits: Sequence[float]) -> DataFrame:
        points = [-math.inf, *splits, math.inf]
        return Bucketizer(splits=points, inputCol="_axis", outputCol="_cut", handleInvalid="keep").transform(df)


ONE_BLOCK = Blocks()


def settled(df: DataFrame, name: str, blocks: Blocks) -> DataFrame:
    """``df`` itself on one block; on many, ``df`` written to the shared folder and read again.

    A step in blocks reads its input twice (totals and rows), so a chain of k steps would have 2^k readers of its
    first table in its plan. Each step writes its rows once instead.
    """
    return df if blocks.single else written(df, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join that finds NULL keys too, as a window over the keys does; the keys come from ``left``."""
    other = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(other[f"_k_{k}"]) for k in keys]
    return left.join(other, on, how).drop(*[f"_k_{k}" for k in keys])


def order_by(order: str, ties: Sequence[str] = (), reverse: bool = False) -> list[Column]:
    cols = [F.col(c) for c in (order, *ties)]
    return [c.desc() for c in cols] if reverse else [c.asc() for c in cols]


def _windowed(how: str, value: Column, window: WindowSpec) -> Column:
    if how == "last":
        return F.last(value, ignorenulls=True).over(window)
    if how == "first":
        return F.first(value, ignorenulls=True).over(window)
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[how](value).over(window)


def _block_total(how: str, value: Column, key: Column, reverse: bool) -> Column:
    if how in ("last", "first"):
        seen = F.when(value.isNotNull(), key)
        late = (how == "last") != reverse
        return (F.max_by if late else F.min_by)(value, seen)
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[how](value)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    outs: dict[str, tuple[str, Column]],
    blocks: Blocks = ONE_BLOCK,
    ties: Sequence[str] = (),
    exclusive: bool = False,
    reverse: bool = False,
    peers: bool = False,
    settle: bool = True,
    source: DataFrame | None = None,
) -> DataFrame:
    """Running aggregates from the start of the key (from its end with ``reverse``) to each row.

    ``outs`` maps an output name to ``(how, expression)``; how is sum, count, min, max, first or
    last, the latter two over non-NULL values. With ``peers`` rows of equal order (and ties) are taken
    together, as SQL's default frame does. Blocked form: one map-side-combined total per (key, block),
    a window over those totals, and a window inside each block that what earlier blocks left enters as its first
    row, so rows are shuffled once and meet no join; the result is ``settled`` unless the caller does that to what it
    makes of it. ``source`` names the rows of ``df`` that have values at all: then ``df`` is read once, and what a
    block left goes to all blocks up to the key's next one in ``source`` (at most keys x blocks rows).
    """
    edge = -1 if exclusive else 0
    sort = order_by(order, ties, reverse)

    def upto(part: Sequence[str], first: Sequence[Column] = ()) -> WindowSpec:
        w = Window.partitionBy(*part).orderBy(*first, *sort)
        return (w.rangeBetween if peers else w.rowsBetween)(Window.unboundedPreceding, edge)

    if blocks.single:
        w = upto(keys)
        return df.withColumns({o: _windowed(how, v, w) for o, (how, v) in outs.items()})
    df = blocks.assign(df, order, ties=ties)
    stamp = F.struct(order, *ties)
    totals = (df if source is None else blocks.assign(source, order, ties=ties)).groupBy(*keys, BLOCK).agg(
        *[_block_total(how, v, stamp, reverse).alias(f"_t_{o}") for o, (how, v) in outs.items()]
    )
    block_order = F.col(BLOCK).desc() if reverse else F.col(BLOCK).asc()
    sequel = Window.partitionBy(*keys).orderBy(block_order)
    over = sequel.rowsBetween(Window.unboundedPreceding, -1 if source is None else 0)
    target = F.col(BLOCK)
    if source is not None:
        step = -1 if reverse else 1
        begin, end = F.col(BLOCK) + step, F.coalesce(F.lead(BLOCK).over(sequel), F.lit(-1 if reverse else blocks.last))
        target = F.when((end - begin) * step >= 0, F.sequence(begin, end, F.lit(step)))
    merged = {"count": "sum"}
    before = totals.select(
        *keys,
        target.alias(BLOCK),
        *[
            _windowed(merged.get(how, how), F.col(f"_t_{o}"), over).alias(f"_p_{o}")
            for o, (how, _) in outs.items()
        ],
    )
    before = before if source is None else before.withColumn(BLOCK, F.explode(BLOCK))
    types = dict(before.dtypes)
    own = {o: F.when(v.isNotNull(), 1) if how == "count" else v for o, (how, v) in outs.items()}
    rows = df.withColumns({f"_p_{o}": v.cast(types[f"_p_{o}"]) for o, v in own.items()}).withColumn("_carry", F.lit(False))
    some = reduce(or_, [F.col(f"_p_{o}").isNotNull() for o in outs])
    both = rows.unionByName(before.where(some).withColumn("_carry", F.lit(True)), allowMissingColumns=True)
    w = upto([*keys, BLOCK], [F.col("_carry").desc()])

    def upto_row(o: str, how: str) -> Column:
        got = _windowed(merged.get(how, how), F.col(f"_p_{o}"), w).cast(types[f"_p_{o}"])
        return F.coalesce(got, F.lit(0)) if how == "count" else got

    done = both.withColumns({o: upto_row(o, how) for o, (how, _) in outs.items()}).where("NOT _carry")
    done = done.drop(BLOCK, "_carry", *[f"_p_{o}" for o in outs])
    return settled(done, "running", blocks) if settle else done


@dataclass(frozen=True)
class Frame:
    """Rows plus a window in which every frame inside the halo is exact for the rows kept by close()."""

    df: DataFrame
    window: WindowSpec
    close: Callable[[DataFrame], DataFrame]


def _open(df: DataFrame, keys: Sequence[str], lo: Column, hi: Column, own: Column) -> DataFrame:
    return df.withColumn("_own_blk", own).withColumn(BLOCK, F.explode(F.sequence(lo, hi)))


def _close(df: DataFrame) -> DataFrame:
    return df.where(F.col(BLOCK) == F.col("_own_blk")).drop(
        "_own_blk", BLOCK, "_pos", "_lo_blk", "_hi_blk"
    )


def halo_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    blocks: Blocks = ONE_BLOCK,
    ties: Sequence[str] = (),
    back: int = 0,
    fwd: int = 0,
) -> Frame:
    """Frame for lag, lead and ROWS windows reaching ``back`` rows before and ``fwd`` after."""
    if blocks.single:
        w = Window.partitionBy(*keys).orderBy(*order_by(order, ties))
        return Frame(df, w, lambda d: d)
    df = running(df, keys, order, {"_pos": ("count", F.lit(1))}, blocks, ties, settle=False)
    size = max(blocks.rows, 4 * (back + fwd))
    at = F.col("_pos") - 1

    def part(c: Column) -> Column:
        return F.floor(F.greatest(c, F.lit(0)) / size).cast("int")

    df = _open(df, keys, part(at - fwd), part(at + back), part(at))
    return Frame(df, Window.partitionBy(*keys, BLOCK).orderBy("_pos"), _close)


def halo_range(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    blocks: Blocks = ONE_BLOCK,
    back: int = 0,
    fwd: int = 0,
) -> Frame:
    """Frame for RANGE windows reaching ``back`` units before and ``fwd`` units after a row."""
    if blocks.single:
        return Frame(df, Window.partitionBy(*keys).orderBy(order), lambda d: d)
    df = blocks.assign(df, order, "_mid_blk")
    df = blocks.assign(df, F.col(order) - fwd, "_lo_blk")
    df = blocks.assign(df, F.col(order) + back, "_hi_blk")
    df = _open(df, keys, F.col("_lo_blk"), F.col("_hi_blk"), F.col("_mid_blk")).drop("_mid_blk")
    return Frame(df, Window.partitionBy(*keys, BLOCK).orderBy(order), _close)


def shifted(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    outs: dict[str, tuple[Column, int]],
    blocks: Blocks = ONE_BLOCK,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Values of another row of the same key: ``n`` rows earlier for n > 0, later for n < 0."""
    back = max([0, *[n for _, n in outs.values()]])
    fwd = max([0, *[-n for _, n in outs.values()]])
    f = halo_rows(df, keys, order, blocks, ties, back, fwd)
    moved = {
        o: (F.lag(v, n) if n > 0 else F.lead(v, -n)).over(f.window) for o, (v, n) in outs.items()
    }
    return settled(f.close(f.df.withColumns(moved)), "shifted", blocks)


def island_ids(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    starts: Callable[[Callable[[str], Column]], Column],
    prev: Sequence[str],
    out: str,
    blocks: Blocks = ONE_BLOCK,
    ties: Sequence[str] = (),
    peers: bool = False,
) -> DataFrame:
    """Number runs of consecutive rows, from 1 inside each key.

    ``starts`` receives a function giving the previous row's value of a column listed in ``prev``
    and returns the "a new run starts here" condition; a key's first row always starts one. ``ties``
    order rows of equal order; with ``peers`` these still have one number, that of the last run to start among them.
    """
    df = shifted(
        df,
        keys,
        order,
        {"_has": (F.lit(1), 1), **{f"_prev_{c}": (F.col(c), 1) for c in prev}},
        blocks,
        ties,
    )
    new_run = F.col("_has").isNull() | F.coalesce(starts(lambda c: F.col(f"_prev_{c}")), F.lit(False))
    df = df.withColumn("_new", new_run.cast("bigint"))
    df = running(df, keys, order, {out: ("sum", F.col("_new"))}, blocks, () if peers else ties, peers=peers)
    return df.drop("_new", "_has", *[f"_prev_{c}" for c in prev])


def value_counts_running(
    df: DataFrame, keys: Sequence[str], value: str, blocks: Blocks
) -> DataFrame:
    """One row per (key, value) with its count ``_n`` and the count ``_below`` of smaller values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    out = running(
        counts, keys, value, {"_below": ("sum", F.col("_n"))}, blocks, exclusive=True
    )
    return out.withColumn("_below", F.coalesce("_below", F.lit(0)))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    blocks: Blocks = ONE_BLOCK,
) -> DataFrame:
    """Linear-interpolated exact quantiles per key, as columns named by ``probs``."""
    if blocks.single:
        both = F.percentile(F.col(value), F.array(*[F.lit(p) for p in probs.values()]))
        got = df.groupBy(*keys).agg(both.alias("_q"))
        return got.select(*keys, *[F.col("_q")[i].alias(o) for i, o in enumerate(probs)])
    vc = value_counts_running(df, keys, value, blocks)
    if keys:
        total = vc.groupBy(*keys).agg(F.sum("_n").alias("_total"))
        vc = join_keys(vc, total, keys, "inner")
    else:
        vc = vc.crossJoin(F.broadcast(vc.agg(F.sum("_n").alias("_total"))))

    def at(position: Column) -> Column:
        inside = (F.col("_below") <= position) & (position < F.col("_below") + F.col("_n"))
        return F.max(F.when(inside, F.col(value).cast("double")))

    picks = []
    for o, p in probs.items():
        place = (F.col("_total") - 1) * F.lit(p)
        picks += [
            at(F.floor(place)).alias(f"_lo_{o}"),
            at(F.ceil(place)).alias(f"_hi_{o}"),
            F.max(place - F.floor(place)).alias(f"_w_{o}"),
        ]
    got = vc.groupBy(*keys).agg(*picks)
    return got.select(
        *keys,
        *[
            (F.col(f"_lo_{o}") + F.col(f"_w_{o}") * (F.col(f"_hi_{o}") - F.col(f"_lo_{o}"))).alias(o)
            for o in probs
        ],
    )


def average_ranks(
    df: DataFrame, keys: Sequence[str], value: str, out: str, blocks: Blocks = ONE_BLOCK
) -> DataFrame:
    """Rank from 1 with ties sharing their mean rank; NULL values get a NULL rank."""
    if blocks.single:
        w = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
        peers = F.count(F.lit(1)).over(w.rangeBetween(0, 0))
        rank = F.rank().over(w) + (peers - 1) / 2.0
        return df.withColumn(out, F.when(F.col(value).isNotNull(), rank))
    vc = value_counts_running(df, keys, value, blocks)
    vc = vc.select(*keys, value, (F.col("_below") + (F.col("_n") + 1) / 2.0).alias(out))
    return join_keys(df, vc, [*keys, value])


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    out: str,
    blocks: Blocks = ONE_BLOCK,
    ties: Sequence[str] = (),
    reverse: bool = False,
) -> DataFrame:
    return running(df, keys, order, {out: ("count", F.lit(1))}, blocks, ties, reverse=reverse)


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_on: str,
    right_on: str,
    values: dict[str, str],
    blocks: Blocks = ONE_BLOCK,
    right_ties: Sequence[str] = (),
    forward: bool = False,
    strict: bool = False,
    chained: bool = False,
) -> DataFrame:
    """Left rows with the nearest right row's ``values`` (right column -> output name).

    Backward: latest right row with stamp <= (``strict``: <) the left stamp. Forward: earliest with
    stamp >= (``strict``: >). Equal right stamps are ordered by ``right_ties``. NULL when none.
    Left columns pass through as one struct, so left and right share a single sort. In blocks the result is
    ``settled``. A ``chained`` lookup reads its left rows once (totals come from the right ones) and isn't written: for
    lookups in a row whose result has one reader, by keys with many rows each.
    """
    ties = [f"_tie{i}" for i in range(len(right_ties))]
    packed = F.struct(*[F.col(c).alias(o) for c, o in values.items()])
    l_cols = left.columns
    left_first = strict != forward
    l = left.select(
        *keys,
        F.col(left_on).alias("_at"),
        F.lit(0 if left_first else 1).alias("_tag"),
        *[F.lit(None).cast(dict(right.dtypes)[c]).alias(t) for c, t in zip(right_ties, ties)],
        F.struct(*l_cols).alias("_left"),
    )
    r = right.select(
        *keys,
        F.col(right_on).alias("_at"),
        F.lit(1 if left_first else 0).alias("_tag"),
        *[F.col(c).alias(t) for c, t in zip(right_ties, ties)],
        packed.alias("_right"),
    )
    both = l.unionByName(r, allowMissingColumns=True)
    # NULL ties of left rows never decide: the tag already separates the two sides.
    both = running(
        both,
        keys,
        "_at",
        {"_hit": ("last", F.col("_right"))},
        blocks,
        ["_tag", *ties],
        reverse=forward,
        settle=False,
        source=r if chained else None,
    )
    kept = both.where(F.col("_left").isNotNull())
    kept = kept.select("_left.*", *[F.col(f"_hit.{o}").alias(o) for o in values.values()])
    return kept if chained else settled(kept, "asof", blocks)

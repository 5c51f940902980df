"""Token-budget batches inside length buckets whose boundaries minimise padding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm.shared import empty_if_null, free_name, save

BUCKETS = 8
BUDGET = 65_536
PRECISION = 6
#: File parts times buckets whose first ranks are broadcast (40 bytes each); more are joined by a shuffle.
BROADCAST_PARTS = 200_000


def byte_tokens(text: Column) -> Column:
    """Length under a byte vocabulary: the UTF-8 bytes and one end mark (null counts as empty)."""
    return F.octet_length(empty_if_null(text)).cast("long") + 1


def granule(length: Column) -> Column:
    """``length`` rounded up to ``PRECISION`` + 1 significant bits, so that a histogram of any corpus is small.

    Below 128 it is exact; above, it is at most 1/64 larger. A length of 2**40 gives 2,300 granules in all.
    """
    shift = F.greatest(F.length(F.bin(length)) - (PRECISION + 1), F.lit(0))
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return F.call_function("shiftleft", F.call_function("shiftright", length + unit - 1, shift), shift)


def boundaries(size: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds (some of ``size``) of at most ``buckets`` buckets with the least padding.

    ``size`` ascends; ``count`` documents with ``total`` tokens lie in each granule. Exact dynamic
    programming over (buckets used, last granule); of equal paddings the fewest buckets, then the
    smallest split points from the right win.
    """
    m = len(size)
    if not m:
        return []
    n = np.concatenate([[0], np.cumsum(count)]).astype(object if total.sum() * float(m) > 2**52 else np.int64)
    t = np.concatenate([[0], np.cumsum(total)]).astype(n.dtype)
    best = size * n[1:] - t[1:]
    froms = [np.zeros(m, np.int64)]
    costs = [best]
    for _ in range(1, min(buckets, m)):
        nxt, come = best.copy(), np.zeros(m, np.int64)
        for j in range(1, m):
            # Granules i..j form the last bucket, for every i from 1 to j.
            cost = best[:j] + size[j] * (n[j + 1] - n[1 : j + 1]) - (t[j + 1] - t[1 : j + 1])
            i = int(np.argmin(cost))
            nxt[j], come[j] = cost[i], i + 1
        nxt[0], come[0] = best[0], 0
        best = nxt
        froms.append(come)
        costs.append(best)
    used = min(range(len(costs)), key=lambda k: (costs[k][-1], k))
    cuts, j = [], m - 1
    for k in range(used, -1, -1):
        cuts.append(int(size[j]))
        j = int(froms[k][j]) - 1
        if j < 0:
            break
    return cuts[::-1]


def histogram(lengths: DataFrame, length_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(granule, documents, tokens) over all rows; its size is bounded by ``granule``, not by the rows."""
    rows = (
        lengths.groupBy(granule(F.col(length_col)).alias("size"))
        .agg(F.count("*").alias("n"), F.sum(length_col).alias("total"))
        .orderBy("size")
        .collect()
    )
    return tuple(np.array([r[k] for r in rows], np.int64) for k in ("size", "n", "total"))


def pack(
    docs: DataFrame,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    length: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` in batch order with ``tokens, bucket, bound, batch, slot`` added.

    Every document goes whole into the bucket with the smallest bound it fits in and is padded to that
    bound. A bucket is dealt out in order of (tokens, id), ``max(1, budget // bound)`` documents a batch:
    a batch exceeds the budget only if one document alone does. ``batch`` and ``slot`` count from 0,
    batches within their bucket. Null texts have one token, null ids come first, ties in (tokens, id)
    fall either way, repeated rows are packed as often as they occur, clashing names get underscores.

    Ranks need no window over a bucket: rows are range-partitioned by (tokens, id) into a table in the
    shared folder, and a small table of rows by (file part, bucket) gives each part its first rank.
    """
    spark = docs.sparkSession
    names = ("tokens", "bucket", "bound", "batch", "slot", "part", "row", "take", "shift", "at_part", "at_bucket")
    tokens, bucket, bound, batch, slot, part, row, take, shift, at_part, at_bucket = (free_name(docs, c) for c in names)
    sized = docs.withColumn(tokens, byte_tokens(F.col(text_col)) if length is None else length.cast("long"))
    cuts = boundaries(*histogram(sized, tokens), buckets)
    number = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        number = F.when(F.col(tokens) <= cut, i).otherwise(number)
    laid = save(
        sized.repartitionByRange(F.col(tokens), F.col(id_col), F.xxhash64(text_col))
        .sortWithinPartitions(tokens, id_col)
        .withColumn(bucket, number.cast("int"))
        .withColumn(part, F.spark_partition_id())
        .withColumn(row, F.monotonically_increasing_id()),
        "packed",
    )
    parts = laid.groupBy(F.col(part).alias(at_part), F.col(bucket).alias(at_bucket)).agg(
        F.count("*").alias("n"), F.min(row).alias("first")
    )
    before = Window.partitionBy(at_bucket).orderBy(at_part).rowsBetween(Window.unboundedPreceding, -1)
    take_of, bound_of = F.lit(0), F.lit(0).cast("long")
    for i, cut in enumerate(cuts):
        take_of = F.when(F.col(at_bucket) == i, max(1, budget // cut)).otherwise(take_of)
        bound_of = F.when(F.col(at_bucket) == i, F.lit(cut).cast("long")).otherwise(bound_of)
    starts = parts.select(
        at_part,
        at_bucket,
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias(shift),
        take_of.alias(take),
        bound_of.alias(bound),
    )
    if parts.count() <= BROADCAST_PARTS:
        starts = F.broadcast(starts)
    rank = F.col(row) + F.col(shift)
    at = rank % F.col(take)
    return laid.join(starts, (F.col(part) == F.col(at_part)) & (F.col(bucket) == F.col(at_bucket))).select(
        *docs.columns, tokens, bucket, bound, ((rank - at) / F.col(take)).cast("long").alias(batch), at.alias(slot)
    )

"""Hard negatives by a vertical scan: dimensions in each anchor's order, candidates leave as the bounds close."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm.shared import save

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: Bounds of a negative's score in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Rows packed together as one record, rows and anchors of a cell, and dimensions between two looks at the bounds.
SLAB = 1024
CELL_ROWS = 16_384
CELL_ANCHORS = 8_192
STRIDE = 8

SLABS = "slab long, dim int, ids binary, labels array<string>, anchor binary, columns binary, top long"
ANCHORS = "row long, id long, dim int, label string, vector binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task as slabs whose components lie dimension by dimension."""
    number = TaskContext.get().partitionId() << 24
    for batch in batches:
        size = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(size):
            own = np.flatnonzero(size == dim)
            for a in range(0, len(own), SLAB):
                part = batch.take(pa.array(own[a : a + SLAB]))
                whole = np.floor(part.column(2).flatten().to_numpy(zero_copy_only=False) * SCALE).reshape(len(part), dim)
                top = np.abs(whole).max(initial=0)
                if top >= 2**31 or float(dim) * top * top >= 2**63:
                    raise ValueError(f"a component of {top / SCALE:g} in {dim} dimensions: its scores don't fit a long")
                record = {
                    "slab": number,
                    "dim": int(dim),
                    "ids": part.column(0).to_numpy().tobytes(),
                    "labels": part.column(1).to_pylist(),
                    "anchor": part.column(3).to_numpy(zero_copy_only=False).tobytes(),
                    "columns": np.ascontiguousarray(whole.T).astype(np.int32).tobytes(),
                    "top": int(top),
                }
                number += 1
                yield pa.RecordBatch.from_pylist([record], schema=SLAB_TYPE)


SLAB_TYPE = pa.schema(
    [("slab", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.list_(pa.string())), ("anchor", pa.binary()), ("columns", pa.binary()), ("top", pa.int64())]
)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of slabs, one a row."""
    for batch in batches:
        for s in batch.to_pylist():
            at = np.flatnonzero(np.frombuffer(s["anchor"], bool))
            ids, columns = np.frombuffer(s["ids"], np.int64), np.frombuffer(s["columns"], np.int32).reshape(s["dim"], len(s["labels"]))
            found = [
                pa.array((s["slab"] << 10) + at),
                pa.array(ids[at]),
                pa.array(np.full(len(at), s["dim"], np.int32)),
                pa.array([s["labels"][i] for i in at], pa.string()),
                pa.array([columns[:, i].tobytes() for i in at], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(found, names=["row", "id", "dim", "label", "vector"])


class Columns:
    """The rows of one cell as columns, sorted by label, with the least and largest value of each column and label part."""

    def __init__(self, slabs: pd.DataFrame, dim: int):
        labels = np.array([label for s in slabs["labels"] for label in s], object)
        self.names, code = np.unique(labels, return_inverse=True)
        order = np.argsort(code, kind="stable")
        count = [len(s) for s in slabs["labels"]]
        self.row = np.concatenate([(s << 10) + np.arange(n) for s, n in zip(slabs["slab"], count)])[order]
        self.id = np.concatenate([np.frombuffer(b, np.int64) for b in slabs["ids"]])[order]
        values = np.concatenate([np.frombuffer(b, np.int32).reshape(dim, n) for b, n in zip(slabs["columns"], count)], axis=1)[:, order]
        # Products and sums of doubles are exact below 2^53; beyond that integers are.
        self.type = np.float64 if dim * float(slabs["top"].max()) ** 2 < 2**52 else np.int64
        self.values = values.astype(self.type)
        self.edge = np.searchsorted(code[order], np.arange(len(self.names) + 1))

    def part(self, label: str) -> tuple[int, int]:
        i = np.searchsorted(self.names, label)
        return (self.edge[i], self.edge[i + 1]) if i < len(self.names) and self.names[i] == label else (0, 0)


class Scan:
    """Scores of one anchor over columns ``a`` to ``b`` of a cell: dimension groups by descending magnitude, and after
    each what the rest can still add at least and at most."""

    def __init__(self, columns: Columns, least: np.ndarray, most: np.ndarray, anchor: np.ndarray):
        self.values, self.anchor = columns.values, anchor.astype(columns.type)
        self.order = np.argsort(-np.abs(self.anchor), kind="stable")
        x, y = (self.anchor * least)[self.order], (self.anchor * most)[self.order]
        tail = lambda v: np.append(np.cumsum(v[::-1])[::-1], 0)
        self.rest_min, self.rest_max = tail(np.minimum(x, y)), tail(np.maximum(x, y))

    def run(self, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Places and whole scores of the candidates that ``keep(partial scores, rest_min, rest_max)`` leaves."""
        score = np.zeros(len(alive), self.values.dtype)
        for a in range(0, len(self.order), STRIDE):
            if not len(alive):
                break
            dims = self.order[a : a + STRIDE]
            score = score + self.anchor[dims] @ self.values[dims[:, None], alive]
            b = min(a + STRIDE, len(self.order))
            stay = keep(score, self.rest_min[b], self.rest_max[b])
            if not stay.all():
                alive, score = alive[stay], score[stay]
        return alive, score.astype(np.int64)


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties by smaller id."""
    return np.lexsort((ids, -score))[:k]


def _keep_top(k: int):
    def keep(score, rest_min, rest_max):
        if len(score) <= k:
            return np.ones(len(score), bool)
        sure = np.partition(score, len(score) - k)[len(score) - k] + rest_min
        return score + rest_max >= sure

    return keep


def _keep_windows(low: np.ndarray, high: np.ndarray, k: int):
    def keep(score, rest_min, rest_max):
        stay = np.zeros(len(score), bool)
        for lo, hi in zip(low, high):
            if rest_max - rest_min <= hi - lo:
                # Rows that end inside the window whatever the rest adds; the k-th of them bounds all others.
                sure = score[(score + rest_min >= lo) & (score + rest_max <= hi)]
                if len(sure) >= k:
                    lo = max(lo, np.partition(sure, len(sure) - k)[len(sure) - k] + rest_min)
            stay |= (score + rest_max >= lo) & (score + rest_min <= hi)
        return stay

    return keep


def _ranges(columns: Columns, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    part = columns.values[:, a:b]
    return part.min(axis=1), part.max(axis=1)


def _positives(key: tuple, anchors: pd.DataFrame, slabs: pd.DataFrame) -> pd.DataFrame:
    """The best rows of each anchor's own label in a cell."""
    found = {"row": [], "id": [], "other": [], "score": []}
    if len(anchors) and len(slabs):
        columns = Columns(slabs, key[0])
        ranges = {}
        for n in anchors.itertuples():
            a, b = columns.part(n.label)
            if a == b:
                continue
            if n.label not in ranges:
                ranges[n.label] = _ranges(columns, a, b)
            alive = np.arange(a, b)
            alive = alive[columns.row[alive] != n.row]
            scan = Scan(columns, *ranges[n.label], np.frombuffer(n.vector, np.int32))
            at, score = scan.run(alive, _keep_top(POSITIVES))
            top = best_of(score, columns.id[at], POSITIVES)
            found["row"] += [n.row] * len(top)
            found["id"] += [n.id] * len(top)
            found["other"] += columns.id[at[top]].tolist()
            found["score"] += score[top].tolist()
    return pd.DataFrame(found)


def _negatives(key: tuple, anchors: pd.DataFrame, slabs: pd.DataFrame) -> pd.DataFrame:
    """The best rows of other labels in each window of each anchor in a cell."""
    found = {"row": [], "positive_score": [], "other": [], "score": []}
    if len(anchors) and len(slabs):
        columns = Columns(slabs, key[0])
        ranges = _ranges(columns, 0, len(columns.row))
        for n in anchors.itertuples():
            a, b = columns.part(n.label)
            alive = np.concatenate([np.arange(a), np.arange(b, len(columns.row))])
            # Scores are whole, so the bounds of the windows can be.
            low, high = [-(-LOW * p // 100) for p in n.scores], [HIGH * p // 100 for p in n.scores]
            scan = Scan(columns, *ranges, np.frombuffer(n.vector, np.int32))
            at, score = scan.run(alive, _keep_windows(low, high, NEGATIVES))
            for p, lo, hi in zip(n.scores, low, high):
                inside = np.flatnonzero((score >= lo) & (score <= hi))
                top = inside[best_of(score[inside], columns.id[at[inside]], NEGATIVES)]
                found["row"] += [n.row] * len(top)
                found["positive_score"] += [p] * len(top)
                found["other"] += columns.id[at[top]].tolist()
                found["score"] += score[top].tolist()
    return pd.DataFrame(found)


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components become ``floor(256 x)`` and scores are whole inner products, the higher first, ties by smaller id. The
    positives of an anchor are its first ``POSITIVES`` other rows of its label; for each, the first ``NEGATIVES`` rows
    of other labels whose score is ``LOW`` to ``HIGH`` hundredths of the positive's come out (none for a positive below
    zero).

    Anchors (a stated set of queries) meet all rows in cells of at most ``CELL_ANCHORS`` x about ``CELL_ROWS``, dealt
    by hashes, so no label, id or group of copies makes a larger one. In a cell each anchor reads the columns in the
    order of its own magnitudes; partial scores with the least and largest that the unread columns can add shrink the
    candidates, first to the positives, in a second pass to the windows that these set. Each cell gives a few rows an
    anchor, merged over cells.

    Rows with a null id, label or vector, or any null or non-finite component take no part; vectors of different
    lengths never meet. Each row with an id that others have too is a row of its own. Other columns aren't read. A
    component so large that a score may not fit a long is an error.
    """
    numbers = F.col(vector_col).cast("array<double>")
    bad = F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad)
    rows = good.select(F.col(id_col).cast("long"), F.col(label_col).cast("string"), numbers, F.coalesce(anchor, F.lit(False)).cast("tinyint"))
    slabs = save(rows.mapInArrow(_pack, SLABS), "slabs")
    anchors = save(slabs.mapInArrow(_anchors, ANCHORS), "anchors")
    total = slabs.agg(F.coalesce(F.sum(F.size("labels")), F.lit(0))).first()[0]
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    row_groups = max(-(-total // CELL_ROWS), min(3 * cores, -(-total // (2 * SLAB))), 1)
    anchor_groups = max(-(-anchors.count() // CELL_ANCHORS), 1)
    cells = 2 * row_groups * anchor_groups
    deal = lambda name, groups: F.pmod(F.xxhash64(name), F.lit(groups)).cast("int")
    every = lambda groups: F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    right = slabs.withColumn("r", deal("slab", row_groups)).withColumn("a", every(anchor_groups)).repartition(cells, "dim", "a", "r").groupBy("dim", "a", "r")

    def meet(some: DataFrame, work, schema: str) -> DataFrame:
        left = some.withColumn("a", deal("row", anchor_groups)).withColumn("r", every(row_groups)).repartition(cells, "dim", "a", "r").groupBy("dim", "a", "r")
        return left.cogroup(right).applyInPandas(work, schema)

    by_row = Window.partitionBy("row").orderBy(F.desc("score"), "other")
    near = meet(anchors, _positives, "row long, id long, other long, score long")
    positives = save(near.withColumn("place", F.row_number().over(by_row)).where(F.col("place") <= POSITIVES), "positives")
    asked = positives.groupBy("row").agg(F.sort_array(F.collect_set("score")).alias("scores"))
    by_window = Window.partitionBy("row", "positive_score").orderBy(F.desc("score"), "other")
    inside = meet(anchors.join(asked, "row"), _negatives, "row long, positive_score long, other long, score long")
    ranked = inside.withColumn("rank", F.row_number().over(by_window)).where(F.col("rank") <= NEGATIVES)
    negatives = ranked.select("row", "positive_score", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.select("row", F.col("id").alias("anchor_id"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(negatives, ["row", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

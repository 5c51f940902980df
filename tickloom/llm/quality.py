"""Quality probability of whole texts from a byte-level convolutional network in numpy."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 512
OVERLAP = 32
WIDTH = 8
STRIDE = 4
EMBED = 8
FILTERS = 32
BATCH = 256
THRESHOLD = 0.3
#: Bounds of the training sample: documents, and chunks of one document (spread evenly over all of it).
TRAIN_DOCS = 3_000
TRAIN_CHUNKS = 24
EPOCHS = 8


def chunks(text: str | None) -> np.ndarray:
    """Overlapping chunks of ``CHUNK`` bytes that cover all of the text's UTF-8 bytes; zeros pad the last one."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    n = max(1, -(-(len(data) - OVERLAP) // (CHUNK - OVERLAP)))
    padded = np.zeros(n * (CHUNK - OVERLAP) + OVERLAP, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[:: CHUNK - OVERLAP]


class ByteConvolution:
    """Byte embedding, filters over overlapping windows, a maximum over each chunk, a rectified layer, and a
    logistic unit over the mean and the maximum of the document's chunks."""

    SHAPES = (("embed", (256, EMBED)), ("kernel", (WIDTH * EMBED, FILTERS)), ("bias", (FILTERS,)), ("hidden", (FILTERS, FILTERS)), ("hidden_bias", (FILTERS,)), ("out", (2 * FILTERS,)), ("out_bias", (1,)))

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p = {}
        for name, shape in self.SHAPES:
            scale = {"embed": 0.5, "kernel": (2 / (WIDTH * EMBED)) ** 0.5, "hidden": (2 / FILTERS) ** 0.5, "out": 0.1}.get(name, 0.0)
            self.p[name] = (rng.standard_normal(shape) * scale).astype(np.float32)

    def pooled(self, chunk: np.ndarray, places: bool = False):
        """Largest response of each filter in each chunk (and where it was)."""
        e = self.p["embed"][chunk].reshape(len(chunk), -1)
        best, at = None, None
        # Windows that start at one of the two phases don't overlap, so each phase is a plain matrix product.
        for phase in range(0, WIDTH, STRIDE):
            n = (CHUNK - phase) // WIDTH
            view = np.ascontiguousarray(e[:, phase * EMBED : (phase + n * WIDTH) * EMBED]).reshape(-1, WIDTH * EMBED)
            answer = (view @ self.p["kernel"]).reshape(len(chunk), n, FILTERS)
            top = answer.max(axis=1)
            if places:
                where = answer.argmax(axis=1) * WIDTH + phase
                at = where if best is None else np.where(top > best, where, at)
            best = top if best is None else np.maximum(best, top)
        return (best + self.p["bias"], at, e) if places else best + self.p["bias"]

    def features(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(pooled, 0) @ self.p["hidden"] + self.p["hidden_bias"], 0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each text; chunks of all texts run through the network ``BATCH`` at a time."""
        out = np.zeros(len(texts))
        total, most, count = np.zeros((len(texts), FILTERS)), np.zeros((len(texts), FILTERS), np.float32), np.zeros(len(texts))
        held, owner = [], []

        def flush() -> None:
            f = self.features(self.pooled(np.concatenate(held)))
            own = np.repeat([o for o, _ in owner], [n for _, n in owner])
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            who = own[starts]
            total[who] += np.add.reduceat(f, starts, axis=0)
            most[who] = np.maximum(most[who], np.maximum.reduceat(f, starts, axis=0))
            held.clear()
            owner.clear()

        filled = 0
        for i, text in enumerate(texts):
            part = chunks(text)
            count[i] = len(part)
            for a in range(0, len(part), BATCH):
                piece = part[a : a + BATCH]
                if filled + len(piece) > BATCH:
                    flush()
                    filled = 0
                held.append(piece)
                owner.append((i, len(piece)))
                filled += len(piece)
        if held:
            flush()
        z = np.concatenate([total / np.maximum(count, 1)[:, None], most], axis=1) @ self.p["out"] + self.p["out_bias"]
        out[:] = 1 / (1 + np.exp(-z))
        return out

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, step: float = 0.003, seed: int = 1, per_batch: int = 32) -> ByteConvolution:
        """Adam on the logistic loss; ``docs`` holds the chunks of each training document."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        rounds = 0
        for epoch in range(epochs):
            order = rng.permutation(len(docs))
            rate = step * (1 - epoch / epochs) + step / 50
            for a in range(0, len(order), per_batch):
                g = self._gradient([docs[i] for i in order[a : a + per_batch]], labels[order[a : a + per_batch]])
                rounds += 1
                for k, v in g.items():
                    m[k] += 0.1 * (v - m[k])
                    s[k] += 0.001 * (v * v - s[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**rounds)) / (np.sqrt(s[k] / (1 - 0.999**rounds)) + 1e-7)).astype(np.float32)
        return self

    def _gradient(self, docs: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        p, size = self.p, np.array([len(d) for d in docs])
        chunk, start = np.concatenate(docs), np.cumsum(size) - size
        own = np.repeat(np.arange(len(docs)), size)
        pooled, at, e = self.pooled(chunk, places=True)
        act = np.maximum(pooled, 0)
        f = self.features(pooled)
        mean = np.add.reduceat(f, start, axis=0) / size[:, None]
        top = np.maximum.reduceat(f, start, axis=0)
        both = np.concatenate([mean, top], axis=1)
        z = both @ p["out"] + p["out_bias"]
        dz = (1 / (1 + np.exp(-z)) - labels) / len(docs)
        dboth = dz[:, None] * p["out"]
        df = (dboth[:, :FILTERS] / size[:, None])[own] + np.where(f == top[own], dboth[:, FILTERS:][own], 0)
        df *= f > 0
        dact = (df @ p["hidden"].T) * (pooled > 0)
        rows = np.arange(len(chunk))[:, None, None]
        cols = (at * EMBED)[:, :, None] + np.arange(WIDTH * EMBED)
        window = e[rows, cols]
        dkernel = np.einsum("cf,cfk->kf", dact, window, optimize=True)
        dwindow = dact[:, :, None] * p["kernel"].T
        seen = chunk[rows, at[:, :, None] + np.arange(WIDTH)]
        dembed = np.zeros_like(p["embed"])
        flat, push = seen.reshape(-1), dwindow.reshape(-1, EMBED)
        for d in range(EMBED):
            dembed[:, d] = np.bincount(flat, push[:, d], 256)
        return {
            "embed": dembed,
            "kernel": dkernel,
            "bias": dact.sum(axis=0),
            "hidden": act.T @ df,
            "hidden_bias": df.sum(axis=0),
            "out": both.T @ dz,
            "out_bias": dz.sum(keepdims=True),
        }


def held_out(id_col: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by 5 (or the id is null)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> ByteConvolution | None:
    """A network fitted to the labelled texts that aren't held out; None if there are none.

    The sample is the ``TRAIN_DOCS`` labelled ids with the smallest hashes, and of a long text
    ``TRAIN_CHUNKS`` chunks spread evenly over it: at most 37 MB reach the driver at any input size. Null
    labels and ids are passed over; of repeated ids one label (the smaller) and one text are taken.
    """
    known = (
        labels.where(F.col(label).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(TRAIN_DOCS)
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = []
            for text in batch.column(1):
                part = chunks(text.as_py())
                at = np.unique(np.linspace(0, len(part) - 1, min(len(part), TRAIN_CHUNKS)).astype(int))
                picked.append(part[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(picked, pa.binary()), batch.column(2)], names=["id", "chunks", "label"])

    id_type = rows.schema["id"].dataType.simpleString()
    sample = rows.mapInArrow(run, f"id {id_type}, chunks binary, label double").groupBy("id").agg(F.min("chunks").alias("chunks"), F.min("label").alias("label"))
    got = sorted(sample.collect(), key=lambda r: zlib.crc32(str(r["id"]).encode()))
    if not got:
        return None
    return ByteConvolution().fit([np.frombuffer(r["chunks"], np.uint8).reshape(-1, CHUNK) for r in got], np.array([r["label"] for r in got]))


def score(text: Column, model: ByteConvolution | None) -> Column:
    """Probability that a whole text is good; a model without training rows gives 0.5. Null counts as empty."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.full(len(texts), 0.5) if model is None else model.score(list(texts)))

    return run(text)


def keep_good(docs: DataFrame, model: ByteConvolution | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows whose score reaches ``threshold``, with all their columns."""
    return docs.where(score(F.col(text_col), model) >= threshold)

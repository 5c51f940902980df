"""Benchmark passages in documents, found through CGK embeddings and verified by word edit distance.

A word sequence is embedded by a random walk (Chakraborty, Goldenberg, Koucky 2016): at each of 3n steps
the word under the pointer is written out and a random bit of (step, word) moves the pointer on. Sequences
at a small edit distance give strings at a small Hamming distance, so tables of a few sampled steps bring
them together. Windows have the length of the item they are compared with.
"""

from __future__ import annotations

import random
import string
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Edits per word of an item up to which a passage counts as copied.
EDITS = 0.2
RECALL = 0.99
SAMPLED = 2
TABLES = 16
SLICE_BYTES = 32 << 20
WINDOWS = 1 << 11
BLANKED = bytes(32 if chr(i) in string.punctuation else i for i in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation and blanks part them."""
    return (text or "").lower().encode().translate(BLANKED).split()


def mix(values: np.ndarray, with_: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of two numbers."""
    out = (values ^ (np.asarray(with_).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def walk(rows: np.ndarray, walks: int, steps: int) -> np.ndarray:
    """Pointers ``[walk, row, step]`` of the random walks over rows of word ids; the bits follow from (walk, step, word)."""
    count, n = rows.shape
    rng = np.random.default_rng(17)
    odd, add = (rng.integers(0, 1 << 63, (1 << 12, walks, 1), dtype=np.uint64) for _ in range(2))
    out, at, row = np.zeros((walks, count, steps), np.int32), np.zeros((walks, count), np.int64), np.arange(count)
    padded = np.concatenate([rows, np.full((count, 1), 0, rows.dtype)], axis=1)
    for step in range(steps):
        out[:, :, step] = at
        lap = mix(padded[row, at].astype(np.uint64), step >> 12)
        at = np.minimum(at + ((lap * (odd[step % 4096] | np.uint64(1)) + add[step % 4096]) >> np.uint64(63)).astype(np.int64), n)
    return out


def keys(rows: np.ndarray, pointers: np.ndarray, n: int) -> np.ndarray:
    """``TABLES`` keys ``[walk, row, table]`` of the first ``n`` words of each row.

    A key is the words under the pointer at ``SAMPLED`` of the first 2n steps; the walk leaves n words
    after 2n steps on average, so later ones carry little.
    """
    sampled = np.random.default_rng([23, n]).integers(0, 2 * n, (TABLES, SAMPLED))
    out = mix(np.arange(TABLES, dtype=np.uint64), np.arange(len(pointers))[:, None, None])
    out = np.broadcast_to(out, (len(pointers), len(rows), TABLES))
    for i in range(SAMPLED):
        at = pointers[:, :, sampled[:, i]]
        word = rows[np.arange(len(rows))[:, None], np.minimum(at, n - 1)]
        out = mix(out, np.where(at < n, word + 1, 0))
    return out


def edit_distance(item: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Least Levenshtein distance of ``item`` (one row each) to a beginning of each row; id 0 equals nothing."""
    width = np.arange(rows.shape[1] + 1)
    last = np.broadcast_to(width, (len(rows), len(width)))
    for i in range(item.shape[1]):
        differ = (rows != item[:, i : i + 1]) | (rows == 0)
        now = np.empty(last.shape, last.dtype)
        now[:, 0] = i + 1
        now[:, 1:] = np.minimum(last[:, :-1] + differ, last[:, 1:] + 1)
        last = np.minimum.accumulate(now - width, axis=1) + width
    return last.min(axis=1)


class Items:
    """One bounded slice of a benchmark, ready to be compared."""

    def __init__(self, rows: list[tuple], edits: float = EDITS, recall: float = RECALL):
        self.edits = edits
        self.vocabulary: dict[bytes, int] = {}
        by: dict[int, list] = {}
        for item_id, text in rows:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if ids:
                by.setdefault(len(ids), []).append((item_id, ids))
        self.ids = {n: [i for i, _ in own] for n, own in by.items()}
        self.rows = {n: np.array([ids for _, ids in own], np.int64) for n, own in by.items()}
        self.width = max(self.rows, default=1)
        # Word n-grams of the items and the item length they come from (0: several); see _starts.
        self.grams = {q: self._grams(q) for q in (1, 2, 3)}
        self.walks = self._walks_for(recall)
        self.tables = {n: self._table(n) for n in self.rows}

    def allowed(self, n: int) -> int:
        return int(self.edits * n)

    def _walks_for(self, recall: float, trials: int = 12, most: int = 32) -> int:
        """The fewest walks that reach ``recall`` at the largest allowed distance, measured on edited items."""
        rng, rows, other = random.Random(3), [], []
        for n, own in sorted(self.rows.items()):
            for row in own[:4].tolist():
                for _ in range(trials if self.allowed(n) else 0):
                    edited = list(row)
                    for _ in range(self.allowed(n)):
                        at, kind = rng.randrange(len(edited)) if edited else 0, rng.randrange(3)
                        if kind < 2 and edited:
                            del edited[at]
                        if kind > 0:
                            edited.insert(at, 0)
                    rows.append((n, row + [0] * (self.width - n)))
                    other.append((edited + [0] * self.width)[:n] + [0] * (self.width - n))
        if not rows:
            return 2
        size, pair = np.array([n for n, _ in rows]), [np.array([r for _, r in rows]), np.array(other)]
        places = [walk(r, most, 2 * self.width) for r in pair]
        hit = np.zeros((most, len(rows)), bool)
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            one, two = (keys(r[at], p[:, at], n) for r, p in zip(pair, places, strict=True))
            hit[:, at] = (one == two).any(axis=2)
        reached = np.maximum.accumulate(hit, axis=0).mean(axis=1) >= recall
        return int(np.argmax(reached)) + 1 if reached.any() else most

    def _table(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys of all items of ``n`` words, sorted, and the items they belong to."""
        rows = self.rows[n]
        found = keys(rows, walk(rows, self.walks, 2 * n), n)
        item = np.broadcast_to(np.arange(len(rows))[:, None], found.shape).reshape(-1)
        order = np.argsort(found.reshape(-1), kind="stable")
        return found.reshape(-1)[order], item[order]

    def _grams(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        codes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for n, rows in self.rows.items():
            if n >= q:
                code = np.zeros((len(rows), n - q + 1), np.uint64)
                for i in range(q):
                    code = mix(code, rows[:, i : i + n - q + 1])
                codes.append(np.unique(code))
                sizes.append(np.full(len(codes[-1]), n))
        known, first, count = np.unique(np.concatenate(codes), return_index=True, return_counts=True)
        return known, np.where(count > 1, 0, np.concatenate(sizes)[first])

    def _hits(self, ids: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where ``q`` words of the text are an n-gram of the benchmark (or its hash is), and its item length."""
        known = ids > 0
        for i in range(1, q):
            known = known[:-1] & (ids[i:] > 0)
        at = np.flatnonzero(known)
        code = np.zeros(len(at), np.uint64)
        for i in range(q):
            code = mix(code, ids[at + i])
        grams, sizes = self.grams[q]
        if not len(grams):
            return at[:0], sizes
        place = np.searchsorted(grams, code)
        place[place == len(grams)] = 0
        hit = grams[place] == code
        return at[hit], sizes[place[hit]]

    def _starts(self, hits: dict[int, tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """Window starts that can lie within the allowed distance of an item of ``n`` words.

        k edits leave n - q + 1 - qk of an item's word q-grams (the q-gram lemma), so a window must hold
        as many q-grams of items of ``n`` words; every other window is at a larger distance.
        """
        k = self.allowed(n)
        q = next(q for q in (3, 2, 1) if q == 1 or n - q + 1 - q * k >= 1)
        need, reach, (at, sizes) = n - q + 1 - q * k, n - q + k, hits[q]
        hits = at[(sizes == n) | (sizes == 0)]
        if len(hits) < need:
            return np.zeros(0, np.int64)
        first, last = hits[: len(hits) - need + 1], hits[need - 1 :]
        fits = last - first <= reach
        low, high = np.maximum(last[fits] - reach, 0), first[fits]
        # Ranges ascend; each goes on where the one before it ended.
        low[1:] = np.maximum(low[1:], np.maximum.accumulate(high)[:-1] + 1)
        width = np.maximum(high - low + 1, 0)
        return np.repeat(low - np.cumsum(width) + width, width) + np.arange(width.sum())

    def find(self, texts: list[str | None]) -> pd.DataFrame:
        """``(text, item, distance, start)``: the least distance of each item in each text and its first word."""
        get = self.vocabulary.get
        coded, sizes = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = [get(w, 0) for w in words(text)]
            own.append(0)
            sizes[i] = len(own)
            coded.append(np.array(own, np.int64))
        ids = np.concatenate([*coded, np.zeros(1, np.int64)])
        begin = np.cumsum(sizes) - sizes
        # Single words matter for items of one word only.
        hits = {q: self._hits(ids, q) for q in self.grams if q > 1 or 1 in self.rows}
        starts = {n: at for n in self.rows if len(at := self._starts(hits, n))}
        every = np.unique(np.concatenate(list(starts.values()))) if starts else np.zeros(0, np.int64)
        found = []
        for a in range(0, len(every), WINDOWS):
            at = every[a : a + WINDOWS]
            text = np.searchsorted(begin, at, side="right") - 1
            places = at[:, None] + np.arange(self.width + self.allowed(self.width))
            inside = places < (begin + sizes - 1)[text][:, None]
            rows = np.where(inside, ids[np.minimum(places, len(ids) - 1)], 0)
            pointers = walk(rows, self.walks, 2 * self.width)
            for n, own in starts.items():
                pick = np.flatnonzero(np.isin(at, own, assume_unique=True))
                if len(pick):
                    window, item, far = self._compare(rows[pick], pointers[:, pick], n)
                    ids_of = self.ids[n]
                    found += [
                        (int(text[w]), ids_of[i], int(d), int(at[w] - begin[text[w]])) for w, i, d in zip(pick[window], item, far, strict=True)
                    ]
        out = pd.DataFrame(found, columns=["text", "item", "distance", "start"])
        return out.sort_values(["text", "item", "distance", "start"]).drop_duplicates(["text", "item"])

    def _compare(self, rows: np.ndarray, pointers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, distance) of the rows and items of ``n`` words that share a key and are close enough."""
        known, item = self.tables[n]
        asked = keys(rows, pointers, n)
        row = np.broadcast_to(np.arange(len(rows))[:, None], asked.shape).reshape(-1)
        low = np.searchsorted(known, asked.reshape(-1))
        width = np.searchsorted(known, asked.reshape(-1), side="right") - low
        to = np.repeat(low - np.cumsum(width) + width, width) + np.arange(width.sum())
        pairs = np.unique(np.repeat(row, width) * len(self.rows[n]) + item[to])
        out = []
        for a in range(0, len(pairs), WINDOWS):
            w, i = np.divmod(pairs[a : a + WINDOWS], len(self.rows[n]))
            far = edit_distance(self.rows[n][i], rows[w, : n + self.allowed(n)])
            close = far <= self.allowed(n)
            out.append((w[close], i[close], far[close]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def slices(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", edits: float = EDITS, recall: float = RECALL) -> list:
    """Broadcast ``Items``. One holds about ``SLICE_BYTES`` of text at most; a larger benchmark gives several."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.trim("text") != "")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // SLICE_BYTES)
    sc = benchmark.sparkSession.sparkContext
    part = F.pmod(F.xxhash64("id", "text"), F.lit(max(n, 1)))
    return [sc.broadcast(Items([(r["id"], r["text"]) for r in rows.where(part == i).collect()], edits, recall)) for i in range(n)]


def leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``(id, item_id, distance, start)`` of each row of ``docs`` and each item that it holds.

    A text holds an item if some window of it is within ``edits`` word edits per word of the item;
    ``distance`` is the least, ``start`` the word at which its first such window begins. Null, empty and
    wordless texts or items hold nothing and are held nowhere; repeated rows are reported as often as they
    occur, ties in the distance by the first start. Other columns of both tables are not read.
    """
    item_type = benchmark.schema[item_col].dataType.simpleString()
    id_type = docs.schema[id_col].dataType.simpleString()
    empty = docs.sparkSession.createDataFrame([], f"`{id_col}` {id_type}, `{item_col}` {item_type}, distance int, start long")
    names, item_arrow, out = empty.columns, to_arrow_type(benchmark.schema[item_col].dataType), None
    for items in slices(benchmark, item_col, edits=edits):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = items.value.find(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(got["text"], pa.int64())),
                        pa.array(got["item"].tolist(), item_arrow),
                        pa.array(got["distance"], pa.int32()),
                        pa.array(got["start"], pa.int64()),
                    ],
                    names=names,
                )

        found = docs.select(id_col, text_col).mapInArrow(run, empty.schema)
        out = found if out is None else out.unionByName(found)
    return empty if out is None else out


def _holds(text: Column, items) -> Column:
    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), bool)
        out[items.value.find(list(texts))["text"].to_numpy(np.int64)] = True
        return pd.Series(out)

    return run(text)


def clean(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` whose text holds no item of the benchmark (see ``leaks``), with all their columns."""
    for items in slices(benchmark, item_col, edits=edits):
        docs = docs.where(~_holds(F.col(text_col), items))
    return docs

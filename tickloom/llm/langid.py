"""Languages of whole texts: shares of a mixture fitted by expectation-maximisation to trigram likelihoods."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Trigrams fall into so many buckets; with ``MOST_LANGUAGES`` the model has 64 MB.
BUCKETS = 1 << 16
MOST_LANGUAGES = 256
#: Added to each count, so that no trigram is impossible.
SMOOTH = 0.5
#: Characters that are looked at together; a longer text goes through in pieces that share their edge characters.
PIECE = 1 << 18
#: Languages below this share after the first fit leave the set at once; the others one by one.
MINOR = 0.01
#: Cost in log-likelihood of one more language, times the logarithm of the text's letters. Each character is in
#: three trigrams, so their joint log-likelihood counts everything three times: 1/2 as in the BIC, tripled.
PENALTY = 1.5
ROUNDS = 40
STILL = 1e-3
UNKNOWN = "und"


def fold_table() -> np.ndarray:
    """For each code point its lower-case code point if it is a letter, else 0."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def buckets_of(codes: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the letters, and the bucket of each letter with the characters beside it (all but letters alike)."""
    x = fold[codes]
    at = np.flatnonzero(x)
    padded = np.zeros(len(x) + 2, np.uint32)
    padded[1:-1] = x
    h = padded[at] * np.uint32(0x9E3779B1) ^ padded[at + 1] * np.uint32(0x85EBCA77) ^ padded[at + 2] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return at, (h >> np.uint32(16)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def counted(texts: list[str | None], fold: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(text, bucket, count)`` arrays of consecutive texts, sorted by text and bucket, a group of texts at a time."""
    held, first, size = [], 0, 0
    for i, text in enumerate([*texts, None]):
        text = text or ""
        if held and (size + len(text) > PIECE or i == len(texts)):
            yield _counted_group(held, first, fold)
            held, size = [], 0
        if i == len(texts):
            return
        if len(text) > PIECE:
            total = np.zeros(BUCKETS, np.int64)
            for a in range(0, len(text), PIECE):
                before = min(a, 1)
                at, bucket = buckets_of(_codes(text[a - before : a + PIECE + 1]), fold)
                total += np.bincount(bucket[(at >= before) & (at < before + PIECE)], minlength=BUCKETS)
            found = np.flatnonzero(total)
            yield np.full(len(found), i), found, total[found]
            continue
        if not held:
            first = i
        held.append(text)
        size += len(text)


def _counted_group(texts: list[str], first: int, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    at, bucket = buckets_of(_codes("\n".join(texts) + "\n"), fold)
    key, count = np.unique(own[at] * BUCKETS + bucket, return_counts=True)
    return first + key // BUCKETS, key % BUCKETS, count


class Mixture:
    """Trigram likelihoods of each language, and the fit of language shares to texts."""

    def __init__(self, languages: list[str], counts: np.ndarray, fold: np.ndarray):
        self.languages = languages
        self.fold = fold
        smooth = counts + SMOOTH
        self.table = (smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)

    def settle(self, like: np.ndarray, who: np.ndarray, start: np.ndarray, count: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expectation-maximisation from ``share`` (languages x texts): the shares at rest and the log-likelihoods."""
        total = np.add.reduceat(count, start)
        for _ in range(ROUNDS):
            mix = share[:, who] * like
            mix *= count / mix.sum(axis=0)
            after = np.add.reduceat(mix, start, axis=1) / total
            moved = np.abs(after - share).max()
            share = after
            if moved < STILL:
                break
        return share, np.add.reduceat(count * np.log((share[:, who] * like).sum(axis=0)), start)

    def shares(self, who: np.ndarray, bucket: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Languages x texts: the shares of the set with the best penalised likelihood, 0 outside it.

        ``who`` numbers the texts from 0 without gaps. Sets shrink from all languages: as long as the penalised
        likelihood doesn't fall, the language with the smallest share goes and the others are fitted again.
        """
        count = count.astype(np.float32)
        start = np.flatnonzero(np.diff(who, prepend=-1))
        letters = np.log(np.add.reduceat(count, start))
        like = self.table[:, bucket]
        share, _ = self.settle(like, who, start, count, np.full((len(self.languages), len(start)), 1 / len(self.languages), np.float32))
        share[(share < MINOR) & (share < share.max(axis=0))] = 0
        share, fit = self.settle(like, who, start, count, share / share.sum(axis=0))
        value = fit - PENALTY * (share > 0).sum(axis=0) * letters
        open_ = np.flatnonzero((share > 0).sum(axis=0) > 1)
        while len(open_):
            place = np.full(len(start), -1)
            place[open_] = np.arange(len(open_))
            entry = np.flatnonzero(place[who] >= 0)
            fewer = share[:, open_]
            fewer[np.where(fewer > 0, fewer, 2).argmin(axis=0), np.arange(len(open_))] = 0
            own = place[who[entry]]
            fewer, fit = self.settle(like[:, entry], own, np.flatnonzero(np.diff(own, prepend=-1)), count[entry], fewer / fewer.sum(axis=0))
            worth = fit - PENALTY * (fewer > 0).sum(axis=0) * letters[open_]
            good = worth >= value[open_]
            share[:, open_[good]], value[open_[good]] = fewer[:, good], worth[good]
            open_ = open_[good & ((fewer > 0).sum(axis=0) > 1)]
        return share

    def detect(self, texts: list[str | None]) -> tuple[list[list[str]], list[list[float]]]:
        """Languages of each text and their shares, the largest first (ties in the order of names)."""
        names, parts = [[] for _ in texts], [[] for _ in texts]
        for who, bucket, count in counted(texts, self.fold):
            if not len(who):
                continue
            seen, own = np.unique(who, return_inverse=True)
            share = self.shares(own, bucket, count)
            order = np.argsort(-share, axis=0, kind="stable")
            for i, text in enumerate(seen):
                top = order[: int((share[:, i] > 0).sum()), i]
                names[text] = [self.languages[j] for j in top]
                parts[text] = [float(share[j, i]) for j in top]
        return names, parts


def held_out(id_col: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4 (or the id is null)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Mixture | None:
    """Trigram counts of every text that isn't held out and has a language; None if there is no such row.

    Each task sums its rows, so a language that most rows share costs no more than others, and at most
    ``BUCKETS`` rows a language come to the driver whatever the number of documents. More than
    ``MOST_LANGUAGES`` languages are an error: the column holds something else then.
    """
    known = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    languages = sorted(r["lang"] for r in known.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if not languages:
        return None
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values")
    fold = fold_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {lang: i for i, lang in enumerate(languages)}
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            lang = np.array([place[v] for v in batch.column(0).to_pylist()])
            for who, bucket, count in counted(batch.column(1).to_pylist(), fold):
                np.add.at(total, (lang[who], bucket), count)
        at, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[at, bucket])], names=["lang", "bucket", "n"])

    summed = known.mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), BUCKETS))
    counts[summed["lang"], summed["bucket"]] = summed["n"]
    return Mixture(languages, counts, fold)


def detect(text: Column, model: Mixture | None) -> Column:
    """``(langs, shares)`` of a whole text: the chosen languages and their shares, the largest first.

    Both are empty for null texts, texts without a letter, and a model that learned nothing.
    """

    @F.pandas_udf("langs array<string>, shares array<double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        names, parts = model.detect(list(texts)) if model is not None else ([[] for _ in texts], [[] for _ in texts])
        return pd.DataFrame({"langs": names, "shares": parts})

    return run(text)


def predict(docs: DataFrame, model: Mixture | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score, langs, shares)`` of each row: the language with the largest share, and that share.

    Where nothing is detected the language is ``und`` and the score 0. Empty and null texts count as without a
    letter; repeated rows give equal rows; no other column is read, so none can clash.
    """
    found = docs.select(F.col(id_col).alias("id"), detect(F.col(text_col), model).alias("found"))
    return found.select(
        F.col("id").alias(id_col),
        F.coalesce(F.get("found.langs", F.lit(0)), F.lit(UNKNOWN)).alias("lang_pred"),
        F.coalesce(F.get("found.shares", F.lit(0)), F.lit(0.0)).alias("score"),
        "found.langs",
        "found.shares",
    )

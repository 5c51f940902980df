import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.llm import langid

SF = "/root/testdata/sf0.01"
FOLD = langid.fold_table()
WORDS = {"aa": "taka mola reka suti nola kape", "bb": "strunz grolf prents kwild brosk", "cc": "oui eau aieu iou uaie éao"}


def plain_buckets(text):
    """Bucket of each letter with its neighbours, one letter at a time."""
    low = lambda c: (ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 0
    x, out = [0, *map(low, text or ""), 0], {}
    for i in range(1, len(x) - 1):
        if x[i]:
            h = (x[i - 1] * 0x9E3779B1 ^ x[i] * 0x85EBCA77 ^ x[i + 1] * 0xC2B2AE3D) & 0xFFFFFFFF
            h = ((h ^ h >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
            out[h >> 16] = out.get(h >> 16, 0) + 1
    return out


def plain_shares(model, grams, names):
    """Mixture of the named languages by plain expectation-maximisation, and its log-likelihood."""
    pi = {k: 1 / len(names) for k in names}
    p = {k: model.table[model.languages.index(k)].astype(float) for k in names}
    for _ in range(400):
        new = dict.fromkeys(names, 0.0)
        for g, n in grams.items():
            whole = sum(pi[k] * p[k][g] for k in names)
            for k in names:
                new[k] += n * pi[k] * p[k][g] / whole
        pi = {k: v / sum(grams.values()) for k, v in new.items()}
    return pi, sum(n * math.log(sum(pi[k] * p[k][g] for k in names)) for g, n in grams.items())


def passage(rng, lang, n):
    return " ".join(rng.choices(WORDS[lang].split(), k=n))


def model():
    rng, langs = random.Random(1), sorted(WORDS)
    counts = np.zeros((len(langs), langid.BUCKETS))
    for i, lang in enumerate(langs):
        for g, n in plain_buckets(passage(rng, lang, 3000)).items():
            counts[i, g] += n
    return langid.Mixture(langs, counts, FOLD)


def test_counts_equal_plain_code(monkeypatch):
    rng = random.Random(2)
    texts = [None, "", "1 2", "É", "İstanbul ß 中文", "😀a😀", "x" * 500, "a1b" * 300] + ["".join(rng.choices("abÉ 1\n", k=rng.randint(0, 200))) for _ in range(60)]
    for piece in (7, 64, 1 << 18):
        monkeypatch.setattr(langid, "PIECE", piece)
        got = [{} for _ in texts]
        for who, bucket, count in langid.counted(texts, FOLD):
            for w, b, n in zip(who, bucket, count):
                assert b not in got[w]
                got[w][b] = n
        assert got == [plain_buckets(t) for t in texts]


def test_shares_equal_plain_mixture():
    rng, m = random.Random(3), model()
    texts = [passage(rng, "aa", 60) + " " + passage(rng, "bb", n) for n in (20, 60, 120)]
    names, shares = m.detect(texts)
    for text, ns, ps in zip(texts, names, shares):
        assert sorted(ns) == ["aa", "bb"]
        pi, _ = plain_shares(m, plain_buckets(text), ns)
        assert all(abs(pi[k] - p) < 0.01 for k, p in zip(ns, ps)) and ps == sorted(ps, reverse=True)


def test_set_has_the_best_penalised_likelihood():
    rng, m = random.Random(4), model()
    for text in [passage(rng, "cc", 5), passage(rng, "aa", 200), passage(rng, "aa", 40) + " " + passage(rng, "cc", 40), " ".join(passage(rng, k, 50) for k in WORDS)]:
        grams = plain_buckets(text)
        value = {}
        for bits in range(1, 8):
            names = [k for i, k in enumerate(sorted(WORDS)) if bits >> i & 1]
            value[tuple(names)] = plain_shares(m, grams, names)[1] - langid.PENALTY * len(names) * math.log(sum(grams.values()))
        assert sorted(m.detect([text])[0][0]) == list(max(value, key=value.get))


def test_texts_do_not_sway_each_other():
    rng, m = random.Random(5), model()
    texts = [passage(rng, rng.choice(list(WORDS)), rng.randint(1, 40)) for _ in range(50)] + ["", None, passage(rng, "bb", 60_000)]
    names, shares = m.detect(texts)
    for i, t in enumerate(texts):
        n, p = m.detect([t])
        assert n[0] == names[i] and np.allclose(p[0], shares[i], atol=0.01)


def test_edge_rows(spark):
    rng = random.Random(6)
    learn = [(i, passage(rng, k, 30), k) for i, k in enumerate(list(WORDS) * 40)]
    odd = [(1000, None, "aa"), (1001, "", None), (1002, "12 $ 😀", "bb"), (None, "taka mola reka", "bb"), (1003, "taka mola reka suti " * 50_000, None), (5, "grolf strunz", "zz"), (5, "grolf strunz", None)]
    docs = spark.createDataFrame(learn + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("id", F.lit(3)).withColumn("found", F.lit(3))
    m = langid.train(docs)
    assert m.languages == ["aa", "bb", "cc"] + (["zz"] if zlib.crc32(b"5") % 4 != 2 else [])
    got = langid.predict(docs, m).toPandas()
    assert list(got.columns) == ["doc_id", "lang_pred", "score", "langs", "shares"] and len(got) == len(learn) + len(odd)
    by = {None if pd.isna(i) else int(i): (lang, score) for i, lang, score in zip(got["doc_id"], got["lang_pred"], got["score"])}
    assert by[1000] == by[1001] == by[1002] == ("und", 0.0)
    assert by[None][0] == by[1003][0] == "aa" and got["score"].between(0, 1).all()
    empty = docs.limit(0)
    assert langid.train(empty) is None and langid.predict(empty, None).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}


def test_too_many_languages_is_an_error(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError, match="more than 256"):
        langid.train(docs)


def test_training_takes_every_row_but_held_out_ones(spark):
    docs = spark.createDataFrame([(i, "ab", "aa" if i % 2 else "bb") for i in range(400)], "doc_id long, text string, lang string")
    m = langid.train(docs)
    for j, lang in enumerate(m.languages):
        n = sum(1 for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2 and ("aa" if i % 2 else "bb") == lang)
        seen = sorted(plain_buckets("ab"))
        ratio = m.table[j, seen[0]] / m.table[j, (seen[0] + 7) % langid.BUCKETS]
        assert ratio == pytest.approx((n + langid.SMOOTH) / langid.SMOOTH, rel=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.predict(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id")))
    assert got.where("lang_pred = lang").count() >= 0.98 * got.count()

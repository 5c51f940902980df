import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import quality


def plain_pooled(net, chunk):
    e = net.p["embed"][chunk]
    starts = [i for phase in range(0, quality.WIDTH, quality.STRIDE) for i in range(phase, quality.CHUNK - quality.WIDTH + 1, quality.WIDTH)]
    return np.max([e[i : i + quality.WIDTH].reshape(-1) @ net.p["kernel"] for i in starts], axis=0) + net.p["bias"]


def plain_score(net, text):
    data = (text or "").encode()
    step, parts, at = quality.CHUNK - quality.OVERLAP, [], 0
    while at == 0 or at + quality.OVERLAP < len(data):
        parts.append(np.frombuffer(data[at : at + quality.CHUNK].ljust(quality.CHUNK, b"\0"), np.uint8))
        at += step
    f = np.array([np.maximum(np.maximum(plain_pooled(net, c), 0) @ net.p["hidden"] + net.p["hidden_bias"], 0) for c in parts])
    z = np.concatenate([f.mean(axis=0), f.max(axis=0)]) @ net.p["out"] + net.p["out_bias"][0]
    return 1 / (1 + np.exp(-z))


def texts():
    rng = random.Random(3)
    out = [None, "", "a", "é" * 256, "b" * 512, "b" * 513, "c" * 992, "c" * 993, "long " * 60_000]
    return out + ["".join(rng.choices("abc d.\nÉ", k=rng.randint(1, 3000))) for _ in range(30)]


def test_chunks_cover_every_byte():
    for t in texts():
        data, part = (t or "").encode(), quality.chunks(t)
        joined = b"".join(c.tobytes()[: quality.CHUNK - quality.OVERLAP] for c in part) + part[-1].tobytes()[quality.CHUNK - quality.OVERLAP :]
        assert joined.rstrip(b"\0") == data


def test_score_equals_plain_form():
    net = quality.ByteConvolution(7)
    got = net.score(texts())
    assert np.allclose(got, [plain_score(net, t) for t in texts()], atol=1e-5)


def test_gradient_is_the_slope():
    net = quality.ByteConvolution(3)
    net.p = {k: v.astype(np.float64) + 0.01 for k, v in net.p.items()}
    docs, labels = [quality.chunks(t) for t in texts()[9:15]], np.array([0, 1, 1, 0, 1, 0.0])

    def loss():
        z = []
        for d in docs:
            f = net.features(net.pooled(d))
            z.append(np.concatenate([f.mean(axis=0), f.max(axis=0)]) @ net.p["out"] + net.p["out_bias"][0])
        z = np.array(z)
        return np.mean(np.log1p(np.exp(-z)) + (1 - labels) * z)

    slopes, rng = net._gradient(docs, labels), np.random.default_rng(0)
    for name, slope in slopes.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in slope.shape)
            if name == "embed":
                at = (ord("abcd"[rng.integers(0, 4)]), at[1])
            keep = net.p[name][at]
            net.p[name][at] = keep + 1e-6
            up = loss()
            net.p[name][at] = keep - 1e-6
            down = loss()
            net.p[name][at] = keep
            assert slope[at] == pytest.approx((up - down) / 2e-6, rel=1e-2, abs=1e-6), name


def test_learns_and_holds_out(spark, monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 6)
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) + ("" if good else rng.choice(["###", "%%"])) for _ in range(80)]
        rows.append((i, " ".join(words), "x"))
        # Held-out labels are inverted: learning from them would spoil the model.
        labels.append((i, int(good) if zlib.crc32(str(i).encode()) % 5 else int(not good)))
    rows += [(None, "some words", "x"), (1000, None, "x"), (1001, "", "x"), (3, rows[3][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    model = quality.train(docs, spark.createDataFrame([*labels, (5, None), (None, 1), (3, 1)], "doc_id long, quality int"))
    got = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("h"), quality.score(F.col("text"), model).alias("s")).collect()
    right = [(r.s >= 0.5) == (r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 400]
    assert np.mean(right) > 0.95 and all(0 <= r.s <= 1 for r in got) and len(got) == len(rows)
    assert all(r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.s >= 0.3 for r in got)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert quality.train(docs, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert quality.keep_good(docs, None).count() == 1
    assert quality.keep_good(docs.limit(0), None).count() == 0

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import packing


def plain_granule(n):
    shift = max(0, n.bit_length() - 7)
    return ((n + (1 << shift) - 1) >> shift) << shift


def least_padding(lengths, buckets):
    sizes = sorted({plain_granule(n) for n in lengths})
    best = None
    for k in range(1, min(buckets, len(sizes)) + 1):
        for inner in combinations(sizes[:-1], k - 1):
            cuts = [*inner, sizes[-1]]
            pad = sum(next(c for c in cuts if c >= n) - n for n in lengths)
            best = pad if best is None else min(best, pad)
    return best


def test_boundaries_are_optimal():
    rng = random.Random(5)
    for buckets in (1, 2, 3, 4):
        for _ in range(20):
            lengths = [rng.choice([rng.randint(1, 9), rng.randint(50, 3000)]) for _ in range(rng.randint(1, 14))]
            by = {}
            for n in lengths:
                c, t = by.get(plain_granule(n), (0, 0))
                by[plain_granule(n)] = (c + 1, t + n)
            size = np.array(sorted(by))
            cuts = packing.boundaries(size, np.array([by[s][0] for s in size]), np.array([by[s][1] for s in size]), buckets)
            assert len(cuts) <= buckets and cuts == sorted(cuts)
            assert sum(next(c for c in cuts if c >= n) - n for n in lengths) == least_padding(lengths, buckets)


def test_granules(spark):
    ns = [1, 2, 127, 128, 129, 255, 256, 257, 2**20 + 1, 2**40 + 5]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select(packing.granule(F.col("n"))).collect()
    assert [r[0] for r in got] == [plain_granule(n) for n in ns]


def check(spark, rows, buckets, budget):
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string, row int, p int")
    packed = packing.pack(docs, buckets, budget)
    assert packed.columns == docs.columns + ["_tokens", "bucket", "bound", "batch", "slot"]
    got = packed.collect()
    assert sorted((r.doc_id, r.text or "", r.p) for r in got if r.doc_id is not None) == sorted((a, b or "", e) for a, b, c, d, e in rows if a is not None)
    assert len(got) == len(rows)
    batches = {}
    for r in got:
        assert r._tokens == len((r.text or "").encode()) + 1 <= r.bound
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), members in batches.items():
        take = max(1, budget // members[0].bound)
        assert sorted(m.slot for m in members) == list(range(len(members))) and len(members) <= take
        if (bucket, batch + 1) in batches:
            assert len(members) == take
            assert max((m._tokens, m.doc_id or -1) for m in members) <= min((m._tokens, m.doc_id or -1) for m in batches[bucket, batch + 1])


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, "é" * rng.choice([1, 5, 40, 700]), "x", 1, i % 3) for i in range(300)]
    rows += [(5, None, "x", 1, 1), (None, "", "x", 1, 1), (6, "y" * 100_000, "x", 1, 1), (7, "same", "x", 1, 1), (7, "same", "x", 1, 1)]
    check(spark, rows, 4, 2_000)
    check(spark, [], 4, 2_000)


def test_first_ranks_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_PARTS", 0)
    check(spark, [(i, "a" * (i % 50), "x", 1, 2) for i in range(400)], 3, 300)

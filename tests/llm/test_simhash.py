import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import xxhash

from tickloom.llm import simhash


def plain_fingerprint(text, width):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, radius):
    """Smallest id reachable, by trying all pairs."""
    head = list(range(len(fps)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in combinations(range(len(fps)), 2):
        if (fps[a][1] ^ fps[b][1]).bit_count() <= radius:
            x, y = find(a), find(b)
            head[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in range(len(fps)):
        groups[find(i)].append(fps[i][0])
    return [min((v for v in groups[find(i)] if v is not None), default=None) for i in range(len(fps))]


def corpus(n=160):
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdeéñ", k=rng.randint(1, 6))) for _ in range(300)]
    texts = [None, "", " \t\n", "one", "ONE", "a b c d", "A\tb\x0bc  d", "É x y z", "long " * 30_000]
    for _ in range(n):
        texts.append(" ".join(rng.choices(vocab, k=rng.randint(3, 200))))
    for t in texts[9:60]:
        words = t.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts += [t, " ".join(words)]
    return texts


def test_fingerprint_equals_plain_form():
    for text in corpus():
        for width in (4, 5):
            assert simhash.fingerprint(text, width) & (2**64 - 1) == plain_fingerprint(text, width)


def test_components_equal_all_pairs(spark):
    texts = corpus()
    rows = [(i * 7 % 1000, t, 1, 2) for i, t in enumerate(texts)] + [(0, None, 1, 2), (None, texts[20], 1, 2), (None, None, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id int")
    got = simhash.near_duplicates(docs).collect()
    fps = [(r[0], plain_fingerprint(r[1], 4)) for r in rows]
    expect = sorted(zip([f[0] for f in fps], [f[1] for f in fps], plain_components(fps, 4), strict=True), key=repr)
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=repr) == expect


def test_hot_shards_are_cut_into_pieces(spark):
    rng = random.Random(1)
    base = rng.getrandbits(63)
    values = list({base ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 6))) for _ in range(400)})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    from tickloom.llm.components import components

    for rows in (16, 100, 2048):
        roots = {r.node: r.root for r in components(simhash.links(fps, 4, 6, rows)).collect()}
        got = [roots.get(v, v) for v in values]
        assert got == plain_components([(v, v) for v in values], 4)


def test_keep_one_keeps_columns_and_one_row_a_group(spark):
    texts = corpus(40)
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(3, "one", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, _fp string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    fps = [(i, plain_fingerprint(t, 5)) for i, t in enumerate(texts)]
    heads = plain_components(fps, 9)
    assert sorted(r.doc_id for r in got) == sorted(set(heads))
    assert all(r.row == "x" and r._fp == "y" for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.keep_one(docs).collect() == []


def plain_similar(texts, width=5):
    """Index of the first text of each group, by trying all pairs."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    head = list(range(len(texts)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            head[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_keep_one_similar_decides_by_jaccard(spark, monkeypatch):
    rng = random.Random(12)
    vocab = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    texts = corpus(40)
    for i in range(60):
        words = rng.choices(vocab, k=rng.randint(150, 500))
        texts.append(" ".join(words))
        # One to three copies with words changed, each up to five shingles: similarities of 0.6 to 1.
        for _ in range(rng.randint(1, 3)):
            words = list(words)
            for at in rng.sample(range(len(words)), max(1, int(len(words) * rng.uniform(0.005, 0.04)))):
                words[at] = "changed" + str(rng.random())
            texts.append(" ".join(words))
    expect = plain_similar(texts)
    nine = plain_components([(i, plain_fingerprint(t, 5)) for i, t in enumerate(texts)], 9)
    assert len(set(nine) - set(expect)) > 5  # the fingerprint alone leaves these copies
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, row string, sign string")
    for rows in (128, 2):
        monkeypatch.setattr(simhash, "BUCKET_ROWS", rows)
        kept = simhash.keep_one_similar(docs)
        assert kept.columns == docs.columns
        got = kept.collect()
        assert sorted(r.doc_id for r in got) == sorted(set(expect))
        assert all((r.row, r.sign) == ("x", "y") for r in got)


def test_keep_one_similar_searches_fingerprints(spark, monkeypatch):
    """Fingerprints of the sets find the pairs: without reach only texts with equal ones meet, whatever bands they share."""
    rng = random.Random(5)
    texts = []
    for _ in range(30):
        words = [f"w{rng.random()}" for _ in range(rng.randint(100, 300))]
        texts += [" ".join(words), " ".join([*words[:-1], "other"])]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    fps = [simhash.majority(x) for x in sets]

    def bits(a, b):
        return ((a ^ b) & (1 << 64) - 1).bit_count()

    expect = sorted((max(i, j), min(i, j)) for i, j in combinations(range(60), 2) if bits(fps[i], fps[j]) <= simhash.REACH)
    assert sorted(simhash._within_reach(np.array(fps), simhash.REACH)) == expect
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.keep_one_similar(docs).count() == 30
    for rows in (128, 2):
        monkeypatch.setattr(simhash, "BUCKET_ROWS", rows)
        monkeypatch.setattr(simhash, "REACH", 0)
        assert simhash.keep_one_similar(docs).count() == len(set(fps)) > 30


def test_keep_one_similar_of_nothing(spark):
    assert simhash.keep_one_similar(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def lost_pairs():
    """Texts of five and four shingles, four of them common: similarity 0.8, but no common band or 28 different bits."""
    texts = []
    for seed in (274, 1379, 1928, 6463, 27434):
        words = [f"w{seed}x{i}" for i in range(9)]
        texts += [" ".join(words), " ".join(words[:-1])]
    return texts


def test_pipeline_links_pairs_without_band_or_reach(spark):
    import corpus_pipeline

    texts = lost_pairs()
    sets = [simhash.shingle_set(t, 5) for t in texts]
    far = [(simhash.majority(a) ^ simhash.majority(b)) & (1 << 64) - 1 for a, b in zip(sets[::2], sets[1::2])]
    meet = [set(simhash.bands_of(a)) & set(simhash.bands_of(b)) for a, b in zip(sets[::2], sets[1::2])]
    assert all(x.bit_count() > simhash.REACH or not m for x, m in zip(far, meet)) and max(x.bit_count() for x in far) > simhash.REACH
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.keep_one_similar(docs).count() == 10
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()) == [0, 2, 4, 6, 8]


def test_keep_one_similar_complete_equals_all_pairs(spark, monkeypatch):
    """Copies of many degrees around shingles that most texts share, with few and many of them moved to the end."""
    rng = random.Random(9)
    shared = [" ".join(f"s{j}x{i}" for i in range(8)) for j in range(6)]
    texts = [*lost_pairs(), None, "", " ", "a b", "A  b"]
    for i in range(60):
        parts = [f"w{rng.random()}" for _ in range(rng.randint(1, 40))] + rng.sample(shared, rng.randint(1, 3))
        rng.shuffle(parts)
        texts.append(" ".join(parts))
        for _ in range(rng.randint(0, 2)):
            words = texts[-1].split()
            words[rng.randrange(len(words))] = "changed" + str(rng.random())
            texts.append(" ".join(words[: rng.randint(len(words) - 2, len(words))]))
    expect = sorted(set(plain_similar(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one_similar(docs).collect()) != expect
    monkeypatch.setattr(simhash, "REACH", 0)
    for rows, often, kept, at_once, few in ((128, 8, 65_536, 1 << 20, 131_072), (2, 2, 5, 50, 0)):
        for name, value in (("BUCKET_ROWS", rows), ("OFTEN", often), ("OFTEN_KEPT", kept), ("SHINGLES_AT_ONCE", at_once), ("FEW_NODES", few)):
            monkeypatch.setattr(simhash, name, value)
        assert sorted(r.doc_id for r in simhash.keep_one_similar(docs, complete=True).collect()) == expect


def test_keep_one_similar_complete_of_nothing(spark):
    assert simhash.keep_one_similar(spark.createDataFrame([], "doc_id long, text string"), complete=True).collect() == []

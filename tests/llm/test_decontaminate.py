import random

import numpy as np

from tickloom.llm import decontaminate


def distance_to_beginning(item, words):
    last = list(range(len(words) + 1))
    for i, a in enumerate(item):
        now = [i + 1]
        for j, b in enumerate(words):
            now.append(min(last[j] + (a != b), last[j + 1] + 1, now[j] + 1))
        last = now
    return min(last)


def plain(rows, items, own_only=False):
    """Every window of every text against every item; ``edit_distance`` itself is tested against plain code below."""
    out = {}
    for place, (_, text) in enumerate(rows):
        words = decontaminate.words(text)
        names = {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}
        ids = np.array([names[w] for w in words], int)
        for item_id, item_text in items:
            item = decontaminate.words(item_text)
            if not item or not words or (own_only and item_id != place):
                continue
            k = int(decontaminate.EDITS * len(item))
            coded = np.array([[names.get(w, -i - 1) for i, w in enumerate(item)]])
            windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([ids, np.zeros(len(item) + k, int)]), len(item) + k)[: len(words)]
            far = int(decontaminate.edit_distance(np.repeat(coded, len(windows), 0), windows).min())
            if far <= k:
                out[place, item_id] = far
    return out


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind < 2:
            del words[at]
        if kind > 0:
            words.insert(at, f"new{rng.randrange(99)}")
    return words


def corpus():
    rng = random.Random(12)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(400)]
    prose = lambda n: rng.choices(vocab, k=n)
    items = [(i, " ".join(prose(rng.choice([1, 2, 3, 5, 8, 12, 15, 30])) if i < 16 else prose(rng.randint(15, 40)))) for i in range(40)]
    items += [(90, None), (91, "..."), (92, items[30][1])]
    rows = []
    for i in range(90):
        body = prose(rng.randint(0, 90))
        if i % 2:
            item = decontaminate.words(rng.choice(items[3:40])[1])
            at = rng.randint(0, len(body))
            body[at:at] = [(w if isinstance(w, str) else w.decode()).upper() + "," for w in edited(rng, item, rng.randint(0, max(0, int(0.2 * len(item)))))] if i % 4 == 1 else [w.decode() for w in item]
        rows.append((i, " ".join(body)))
    rows += [(7, rows[1][1]), (None, rows[3][1]), (200, None), (201, ""), (202, "?!"), (203, items[30][1]), (204, "z " * 100_000 + items[31][1])]
    return rows, items


def test_against_all_windows(spark):
    rows, items = corpus()
    found = decontaminate.Items(items).find([t for _, t in rows])
    got = {(t, i): d for t, i, d in zip(found.text, found.item, found.distance, strict=True)}
    short = [(k, v) for k, v in plain([(i, t if len(t or "") < 5_000 else t[-3_000:]) for i, t in rows], items).items()]
    expect = dict(short)
    assert set(got) <= set(expect)
    assert all(got[p] >= expect[p] for p in got)
    assert {p for p, d in expect.items() if d == 0} == {p for p, d in got.items() if d == 0}
    assert len(set(expect) - set(got)) <= 0.03 * len(expect)

    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, item_id string, distance int")
    benchmark = spark.createDataFrame([(*r, 1) for r in items], "item_id int, text string, doc_id int")
    spread = decontaminate.leaks(docs, benchmark).collect()
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in spread), key=repr) == sorted(((rows[t][0], i, d) for (t, i), d in got.items()), key=repr)
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns
    dirty = {t for t, _ in got}
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None) == sorted((i, t) for n, (i, t) in enumerate(rows) if n not in dirty and i is not None)


def test_slices_of_a_large_benchmark(spark, monkeypatch):
    rows, items = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    whole = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 1_500)
    assert len(decontaminate.slices(benchmark)) > 2
    cut = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert len(whole ^ cut) <= 0.05 * len(whole)


def test_recall_at_the_largest_distance():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3_000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(15, 60)))) for i in range(150)]
    texts = []
    for _, t in items:
        words = t.split()
        texts.append(" ".join(rng.choices(vocab, k=20) + edited(rng, words, int(0.2 * len(words))) + rng.choices(vocab, k=20)))
    found = decontaminate.Items(items).find(texts)
    reach = {place for place, _ in plain(list(enumerate(texts)), items, own_only=True)}
    assert len(set(found.text[found.text == found.item]) & reach) >= 0.97 * len(reach) > 100


def test_edit_distance_rows():
    rng = random.Random(1)
    item = np.array([[rng.randint(1, 4) for _ in range(9)] for _ in range(50)])
    rows = np.array([[rng.randint(1, 4) for _ in range(11)] for _ in range(50)])
    got = decontaminate.edit_distance(item, rows)
    assert got.tolist() == [distance_to_beginning(a, b) for a, b in zip(item.tolist(), rows.tolist(), strict=True)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.leaks(docs, benchmark).collect() == decontaminate.leaks(docs, some).collect() == []
    assert decontaminate.leaks(some.withColumnRenamed("item_id", "doc_id"), benchmark).columns == ["doc_id", "item_id", "distance", "start"]
    assert decontaminate.clean(some, benchmark).count() == 1

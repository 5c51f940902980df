"""The pipeline's stages, one after another, against plain code on a small corpus."""

import random
import zlib

import corpus_pipeline
import test_decontaminate as leaks
import test_linededup as lines
import test_packing as packing
import test_simhash as near

from tickloom.llm import decontaminate, quality


def tables(spark, root):
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdeghé", k=rng.randint(2, 8))) for _ in range(500)]
    sentence = lambda: " ".join(rng.choices(vocab, k=rng.randint(4, 11))) + rng.choice([". ", "! ", ".\n"])
    items = [(i, " ".join(rng.choices(vocab, k=20 + i))) for i in range(8)]
    passage = "".join(sentence() for _ in range(9))
    texts = []
    for i in range(150):
        parts = [sentence() for _ in range(rng.randint(1, 25))]
        if i % 6 == 0:
            parts.insert(len(parts) // 2, passage)
        if i % 10 == 1:
            parts.insert(rng.randrange(len(parts)), rng.choice(items)[1] + ". ")
        text = "".join(parts)
        texts.append(" ".join(w + rng.choice(["###", "%%%"]) for w in text.split()) if i % 4 == 3 else text)
    texts += [texts[i] for i in (0, 2, 5, 8)] + [texts[4].replace(" ", "  ", 1) + "end", None, ""]
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(i % 4 != 3), 0) for i in range(150)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return docs, labels, items


def test_run_equals_plain_stages(spark, tmp_path):
    root = str(tmp_path)
    docs, labels, items = tables(spark, root)
    got = corpus_pipeline.run(spark, root).collect()

    known = {i: y for i, y, _ in labels if zlib.crc32(str(i).encode()) % 5}
    chosen = sorted(known, key=lambda i: zlib.crc32(str(i).encode()))
    text_of = {d[0]: d[1] for d in docs}
    parts = [quality.chunks(text_of[i]) for i in chosen]
    model = quality.ByteConvolution().fit(parts, lines_array([known[i] for i in chosen]))
    kept = [(i, t) for (i, t, *_), s in zip(docs, model.score([d[1] for d in docs]), strict=True) if s >= quality.THRESHOLD]
    assert 100 < len(kept) < len(docs)

    cleaned = [(i, t) for i, t, _ in lines.plain(kept)]
    assert sum((t or "") != (text_of[i] or "") for i, t in cleaned) > 10
    fps = [(i, near.plain_fingerprint(t, 5)) for i, t in cleaned]
    heads = set(near.plain_components(fps, 9))
    single = [(i, t) for i, t in cleaned if i in heads]
    held = {single[place][0] for place, _ in leaks.plain(single, items)}
    assert held
    expect = {i: t for i, t in single if i not in held}
    assert {r.doc_id: r.text for r in got} == expect
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) and r.tokens == len((r.text or "").encode()) + 1 <= r.bound for r in got)
    bounds = sorted({r.bound for r in got})
    lengths = [r.tokens for r in got]
    assert all(packing.plain_granule(n) for n in lengths) and len(bounds) <= 8
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(got)
    assert len(decontaminate.Items(items).rows) == len(items)


def lines_array(values):
    import numpy as np

    return np.array(values, dtype=float)


def test_stages_name_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]

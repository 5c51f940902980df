import random
import re

from tickloom.llm import licenses


def plain(rows, dice=licenses.DICE):
    grams = {n: set(licenses.bigrams(licenses.normal_words(t))) for n, t in licenses.TEMPLATES.items()}
    out = []
    for doc_id, text in rows:
        units = [("line", i, x) for i, x in enumerate((text or "").split("\n"))]
        units += [("paragraph", i, x) for i, x in enumerate(re.split("\n[ \t\r]*\n", text or "")) if "\n" in x]
        for kind, i, x in units:
            a = set(licenses.bigrams(licenses.normal_words(x)))
            for name, b in grams.items():
                score = 2 * len(a & b) / (len(a) + len(b))
                if score >= dice:
                    out.append((doc_id, kind, i, name, round(score, 9)))
    return sorted(out, key=repr)


def test_against_all_templates(spark):
    rng = random.Random(3)
    texts = list(licenses.TEMPLATES.values())
    vocab = sorted({w for t in texts for w in t.split()})
    rows = []
    for i in range(150):
        words = rng.choice(texts).split()
        for _ in range(rng.randint(0, max(1, len(words) // 6))):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = rng.choices(vocab, k=rng.randint(0, 2))
            words = words or ["x"]
        for at in range(9, len(words), 10):
            words[at] += rng.choice(["\n", " \n", " "])
        rows.append((i, rng.choice(["", "Intro é.\n\n", "x\n"]) + re.sub("\n ", "\n", " ".join(words)) + rng.choice(["", "\n \t\nmore text", "\n" + texts[0].upper()])))
    rows += [(1, texts[6]), (1, texts[6]), (None, texts[0]), (300, None), (301, ""), (302, "license"), (303, "a b. " * 60_000 + "\n" + texts[7])]
    docs = spark.createDataFrame([(*r, "k", 5) for r in rows], "doc_id long, text string, kind string, unit int")
    got = sorted([(r.doc_id, r.kind, r.unit, r.license, round(r.score, 9)) for r in licenses.scan(docs).collect()], key=repr)
    assert got == plain(rows)
    assert len({g[3] for g in got}) == len(texts) and any(g[1] == "paragraph" for g in got)


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []

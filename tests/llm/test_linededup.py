import random
import re
import struct
from collections import defaultdict

import xxhash

from tickloom.llm import linededup


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def of_text(t):
    return signed(xxhash.xxh64_intdigest(t.encode(), 42))


def chain(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def place_of(doc_id, text):
    seed = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    return signed(xxhash.xxh64_intdigest(text.encode(), seed))


def lines_of(text):
    out = []
    for line in re.split("(?<=[.!?] )|(?<=\n)", text):
        out += re.split("(?<=[,;:dosy] )|(?<=[。、])", line) if len(line) > linededup.LONG_LINE else [line]
    return out


def words_of(line):
    return max(line.count(" ") + (not line.endswith(" ")), len(line) // 12)


def units_of(text):
    lines = lines_of(text)
    n, h, words = len(lines), [of_text(x) for x in lines], [words_of(x) for x in lines]
    r = [chain([h[i - 1] if i else 0, h[i]]) for i in range(n)]
    cuts = [0]
    for i in range(n):
        a, c = (r[i - 1] if i else 0), (r[i + 1] if i + 1 < n else 0)
        joins = a < r[i] >= c and max(words[i : i + 2]) < linededup.OWN_WORDS
        if not joins or i + 1 == n:
            cuts.append(i + 1)
    units = []
    for k, begin in enumerate(cuts):
        for m in (1, 2, 4, 8, 16):
            if k + m < len(cuts) and sum(words[begin : cuts[k + m]]) >= linededup.UNIT_WORDS:
                units.append((begin, cuts[k + m]))
                break
    return lines, units


def plain(rows, min_words=linededup.MIN_WORDS):
    places, cut = defaultdict(set), {}
    for doc_id, text in rows:
        text = text or ""
        lines, units = units_of(text)
        cut[doc_id, text] = lines
        for b, e in units:
            places[tuple(lines[b:e])].add((doc_id is None, doc_id or 0, place_of(doc_id, text), b, e, doc_id, text))
    gone = defaultdict(set)
    for found in places.values():
        first, *others = sorted(found, key=lambda f: f[:5])
        source, from_, to = cut[first[5:]], first[3], first[4]
        for *_, b, e, doc_id, text in others:
            lines = cut[doc_id, text]
            x = next(i for i in range(linededup.AROUND + 1) if i == linededup.AROUND or i in (b, from_) or lines[b - 1 - i] != source[from_ - 1 - i])
            y = next(i for i in range(linededup.AROUND + 1) if i == linededup.AROUND or i in (len(lines) - e, len(source) - to) or lines[e + i] != source[to + i])
            gone[doc_id, text].update(range(b - x, e + y))
    out = []
    for doc_id, text in rows:
        lines, g = cut[doc_id, text or ""], gone[doc_id, text or ""]
        runs, stay, n = [], [], 0
        for i, line in enumerate(lines):
            if i in g:
                runs.append(line)
            else:
                if sum(map(words_of, runs)) < min_words:
                    stay += runs
                else:
                    n += len(runs)
                stay.append(line)
                runs = []
        if sum(map(words_of, runs)) < min_words:
            stay += runs
        else:
            n += len(runs)
        out.append((doc_id, "".join(stay) if g else text, n))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgé", k=rng.randint(1, 8)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 14))) + rng.choice(". ! ?".split())
    passages = [" ".join(sentence() for _ in range(12)) for _ in range(5)] + [" ".join(word() for _ in range(60))]
    rows = []
    for i in range(120):
        parts = [sentence() + rng.choice([" ", "\n", "\n\n"]) for _ in range(rng.randint(0, 30))]
        if i % 4 == 0:
            passage = rng.choice(passages)
            parts.insert(rng.randint(0, len(parts)), passage + (rng.choice([" ", "\n"]) if passage[-1] in ".!?" else "\n"))
        rows.append((i, "".join(parts)))
    rows += [(200 + i, rows[i * 5][1]) for i in range(8)] + [(3, rows[3][1]), (None, rows[9][1]), (None, None), (None, "x"), (300, None), (301, "")]
    rows += [(302, rows[7][1] + "\x01. \x01 end"), (303, ("one line. " * 4_000)), (304, "w " * 30_000), (305, "w " * 30_000), (5, rows[6][1])]
    return rows, passages


def test_equals_brute_force(spark):
    rows, passages = corpus()
    docs = spark.createDataFrame([(i, t, "a", "b", 7, "p") for i, t in rows], "doc_id long, text string, spans string, content string, removed int, place string")
    out = linededup.remove(docs)
    assert out.columns == [*docs.columns, "_removed"]
    got = out.collect()
    assert sorted(((r.doc_id, r.text, r._removed) for r in got), key=repr) == plain(rows)
    assert all((r.spans, r.content, r.removed, r.place) == ("a", "b", 7, "p") for r in got)
    for p in passages:
        assert sum(p in (r.text or "") for r in got) <= 1 < sum(p in (t or "") for _, t in rows)


def shared_passages(rng):
    """Passages of over 50 words of many shapes, as (text, stands between sentences of a paragraph)."""
    word = lambda: "".join(rng.choices("abcdefghilmnorstu", k=rng.randint(2, 9)))
    run = lambda n: " ".join(word() for _ in range(n))
    for sentences in (1, 2, 3, 4, 5, 6):
        for total in (51, 54, 60, 70):
            sizes = [total // sentences + (i < total % sentences) for i in range(sentences)]
            yield "".join(run(n) + ". " for n in sizes)
    for n, each in ((12, 5), (15, 4), (100, 5), (20, 3), (52, 1)):
        yield "".join(run(each) + "\n" for _ in range(n))


def test_whole_passages_go(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghilmnorstu", k=rng.randint(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(3, 14)))
    passages, rows = list(shared_passages(rng)), []
    for k, p in enumerate(passages):
        end = "\n" if p.endswith("\n") else ". "
        for copy in range(3):
            front, back = ("".join(sentence() + end for _ in range(rng.randint(1, 6))) for _ in range(2))
            rows.append((10 * k + copy, front, p, back))
    docs = spark.createDataFrame([(i, a + p + b) for i, a, p, b in rows], "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.remove(docs).collect()}
    assert got == {i: a + (p if i % 10 == 0 else "") + b for i, a, p, b in rows}


def test_passage_inside_a_sentence_goes_but_for_its_edges(spark):
    rng = random.Random(22)
    word = lambda: "".join(rng.choices("aeinorstl", k=rng.randint(2, 9)))
    run = lambda n: " ".join(word() for _ in range(n))
    rows, passages = [], [run(60) for _ in range(40)]
    for k, p in enumerate(passages):
        rows += [(10 * k + c, f"{run(7)} {p} {run(9)}.") for c in range(2)]
    got = {r.doc_id: r.text for r in linededup.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = [len(got[10 * k + 1].split()) - 16 for k in range(40)]
    assert all(got[i] == t for i, t in rows if i % 10 == 0)
    assert max(left) <= 36 and sum(left) / 40 < 14


def test_clean_documents_stay(spark):
    rng = random.Random(9)
    rows = [(i, "All rights reserved.\n" + "".join("".join(rng.choices("abcdef", k=9)) + rng.choice([" ", ". "]) for _ in range(80))) for i in range(60)]
    got = linededup.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == rows and not any(r.removed for r in got)


def test_empty_table(spark):
    assert linededup.remove(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_short_lines_at_the_end_of_a_run_equal_brute_force(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghilmnorstu", k=rng.randint(2, 9)))
    line = lambda: " ".join(word() for _ in range(rng.choice((1, 1, 1, 2, 2, 3)))) + "\n"
    lines = lambda n: "".join(line() for _ in range(n))
    rows = []
    for k in range(400):
        passage = lines(rng.randint(16, 34))
        rows += [(10 * k + copy, lines(rng.randint(1, 9)) + passage + lines(rng.randint(1, 9))) for copy in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.text, r.removed) for r in linededup.remove(docs).collect()), key=repr) == plain(rows)

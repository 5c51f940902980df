import hashlib
import random
import re

from tickloom.llm import pii
from tickloom.llm.queries import op2_pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, text):
    digits = [int(c) for c in text if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    text = text or ""
    found = [(m.start(), n, kind, m.end()) for n, (kind, r) in enumerate(PLAIN.items()) for m in re.finditer(r, text) if good(kind, m[0])]
    return sorted(found)


def corpus():
    rng = random.Random(1)
    parts = ["a.b@c.de", "x@y", "q@w.e.r@t.y", "%@-.-", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.002.003.0255", "4111 1111-1111 1111", "4111111111111112", "4111111111111111", "12", "+1 (555) 123-4567", "+12 ", "+1234567890123456", "+1 2 . 3", "é", "word", "ñ@é.com", "7", "-", "++4 44 44 44 44 4", "0" * 14]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n", ".", "  "]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    return [*texts, None, "", "no data", "a@b.c " * 5_000, "1" * 50_000, "a" * 50_000 + "@", "1-" * 20_000, "é 4111111111111111"]


def test_base_spans_equal_plain_patterns(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(corpus())]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (None, None)]
    spark.createDataFrame([(*r, "s", 3) for r in rows], "doc_id long, text string, spans string, content int").write.parquet(str(tmp_path / "documents.parquet"))
    got = op2_pii(spark, str(tmp_path)).collect()
    expect = []
    for doc_id, text in rows:
        found = plain(text)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
        expect.append((doc_id, *[sum(f[2] == k for f in found) for k in PLAIN], hashlib.sha256(joined.encode()).hexdigest(), joined))
    base_only = lambda s: ",".join(x for x in s.split(",") if not x.startswith("id:"))
    assert sorted([(*r[:6], base_only(r.spans)) for r in got], key=repr) == sorted(expect, key=repr)


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(2)
    rows = [(i, f"Words {rng.randint(0, 9)} then write to mailbox user{i}@mail{i}.org soon. Version 2.0.{i} of it") for i in range(20)]
    rows += [(100 + i, f"Please write to mailbox user{i}(at)host{i} soon, see version 3.1.{i}") for i in range(5)]
    rows += [(200, "Chapter 12345 has page 98765")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [s.value for s in r.spans if s.kind == "id"] for r in pii.find(docs).collect()}
    assert all(got[100 + i] == [f"user{i}(at)host{i}"] for i in range(5))
    assert got[200] == [] and all(got[i] == [] for i in range(20))


def test_empty_table(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tickloom.llm import fim


def plain_example(doc_id, text):
    """The contract in plain code: list slices instead of a pattern."""
    text = text or ""
    units = re.findall(fim.LINE, text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return (doc_id, n, "plain", None, None, text, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text)
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text)


def texts():
    rng = random.Random(5)
    odd = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "a\r\nb c\x85d", "$1 \\ $2\n{a}\n", "<P", "x<P>y", "<S>", "a\n<M>\nb", "<\nP>\n<\n", "😀\n😀é\n", "\\E\\Q\n"]
    odd += ["line\n" * 200_000, "x" * 1_000_000, "ab\n" * 3 + "y" * 500_000, "\n" * 300_000]
    return odd + ["".join(rng.choices("ab \n<PSM>$\\😀", k=rng.randint(1, 60))) for _ in range(400)]


def test_examples_equal_plain_code(spark):
    rows = list(enumerate(texts())) + [(None, "p\nq\nr"), (7, "same\nid\n"), (3, "\n\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("form", F.lit(0)).withColumn("h", F.lit(1))
    got = fim.examples(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((plain_example(*r) for r in rows), key=key)


def test_forms_and_places_vary(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(2000)], "doc_id long, text string")
    got = fim.examples(docs).groupBy("form").count().collect()
    assert {r["form"] for r in got} == {"psm", "spm"} and min(r["count"] for r in got) > 900
    assert fim.examples(docs).select("prefix_chars", "middle_chars").distinct().count() == 10


def test_rates_units_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "one two  three ") for i in range(500)], "doc_id long, text string")
    words = fim.examples(docs, unit=r"\S+\s*|\s+", cut=50, suffix_first=100)
    assert {r["form"] for r in words.select("form").distinct().collect()} == {"plain", "spm"}
    assert {r["n"] for r in words.select("n").distinct().collect()} == {3}
    back = words.where(fim.restored(F.col("output"), F.col("form")) != "one two  three ")
    assert back.count() == 0
    assert fim.examples(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bad", ["Exchange", "ArrowEvalPython", "MapInArrow", "BatchEvalPython"])
def test_plan_is_one_pass(spark, bad):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert bad not in fim.examples(docs)._jdf.queryExecution().executedPlan().toString()

"""Line dedup: texts are laid out once; neither join with them shuffles them again."""

import pytest
from pyspark.sql import DataFrameWriter, functions as F

from tickloom.llm import linededup


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_laid_out_texts_are_not_shuffled(spark, no_broadcast, monkeypatch):
    passage = " ".join(f"word{i} and some more of them here." for i in range(30))
    rows = [(i, f"Text number {i} begins so. {passage if i % 3 == 0 else ''} It ends here {i}.") for i in range(60)]
    rows += [(None, f"None begins. {passage}"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans = []
    write = DataFrameWriter.parquet
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (plans.append(plan(self._df)), write(self, path, *a, **k))[1])
    out = linededup.remove(docs)
    plans.append(plan(out))
    with_texts = [p for p in plans if "laid_" in p and "Join" in p]
    assert len(with_texts) == 2
    assert all("Bucketed: true" in p and "Bucketed: false" not in p for p in with_texts)
    got = {r.doc_id: r.text for r in out.where("doc_id IS NOT NULL").collect()}
    assert passage in got[0] and all("word5" not in got[i] for i in range(3, 60, 3)) and got[1] == rows[1][1]
    none = [r.text for r in out.where("doc_id IS NULL").collect()]
    assert len(none) == 2 and None in none and all(t is None or t.startswith("None begins. ") and "word5 " not in t for t in none)


def test_a_shared_passage_is_written_once(spark, no_broadcast, monkeypatch):
    passage = "".join(f"Sentence {i} of the passage has some more words here. " for i in range(60))
    rows = [(i, f"Text number {i} begins so with words of its own. {passage}It ends here {i}, again with its own.") for i in range(100)]
    chars = {}
    save = linededup.save

    def counted(df, name):
        out = save(df, name)
        if "string" in df.schema.simpleString():
            chars[name] = out.select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
        return out

    monkeypatch.setattr(linededup, "save", counted)
    got = {r.doc_id: r.text for r in linededup.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and all(got[i] == rows[i][1].replace(passage, "") for i in range(1, 100))
    assert 0 < sum(chars.values()) < 3 * len(passage)

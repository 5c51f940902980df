import gzip
import hashlib

import pytest

from tickloom.llm import warc


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 50)
    long = "ü<p>\r\n\r\n" * 50_000
    rows = [(1, "http://a/1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://a/\r\né", None), (4, "u", ""), (5, "u", long), (0, "u", long)]
    rows += [(1, "http://a/1", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, "m", "alone"), (9, "t", "\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "w", 1) for r in rows], "page_id long, url string, html string, digest string, first int")
    archives = warc.write(pages, archive_bytes=2_000)
    listed = archives.collect()
    assert sum(r.records for r in listed) == len(rows) and len(listed) > 1
    got = warc.read(archives).collect()
    firsts = {"<p>x</p>": 1, "": 3, long: 0, "\r\n\r\n": 9}
    expect = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        first = firsts.get(html or "", None)
        is_revisit = first is not None and page_id != first
        expect.append((page_id, "revisit" if is_revisit else "response", first if is_revisit else None, None if is_revisit else data, len(data), hashlib.sha1(data).digest()))
    import base64

    seen = [(r.page_id, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload), r.payload_bytes, base64.b32decode(r.payload_digest)) for r in got]
    assert sorted(seen, key=repr) == sorted(expect, key=repr)
    assert all(r.verified for r in got)
    assert next(r.url for r in got if r.page_id == 3) == "http://a/%0D%0A%C3%A9"
    for r in listed:
        store, path = warc.open_store(r.path)
        with store.open_input_stream(path, compression=None) as f:
            data = f.read()
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == r.records == len(list(warc.members(warc.pyarrow.BufferReader(data).read)))


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (4, "u", "long enough")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.read(warc.write(pages, min_bytes=3)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_damage_is_found():
    good = warc.record(1, "u", b"payload", None, False)
    assert warc.unpack(good)[-1] is True
    assert warc.unpack(good.replace(b"payload", b"pAyload"))[-1] is False
    with pytest.raises(ValueError):
        warc.unpack(good[:-1])
    data = gzip.compress(good)
    with pytest.raises(ValueError):
        list(warc.members(warc.pyarrow.BufferReader(data[:-9]).read))


def test_damaged_records_are_errors_unless_asked_for(spark, tmp_path):
    good = warc.record(1, "u", b"payload", None, False)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(gzip.compress(good) + gzip.compress(good.replace(b"payload", b"pAyload")))
    archives = spark.createDataFrame([(f"file://{path}",)], "path string")
    with pytest.raises(Exception, match="fails its digests"):
        warc.read(archives).collect()
    assert sorted(r.verified for r in warc.read(archives, strict=False).collect()) == [False, True]


def test_every_archive_has_a_task(spark):
    pages = spark.createDataFrame([(i, "u", f"{i} " + "x" * (i % 50) * 40) for i in range(600)], "page_id long, url string, html string")
    archives = warc.write(pages, archive_bytes=6_000)
    parts = [len(p) for p in warc.read(archives).select("page_id").rdd.glom().collect()]
    n = archives.count()
    assert n > 8 and sum(parts) == 600 and sum(p > 0 for p in parts) == n


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(pages)).collect() == []

"""WARC archives: one gzip member per record, written by tasks and read back sequentially."""

from __future__ import annotations

import base64
import hashlib
import sys
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from tickloom.llm.shared import empty_if_null, save, scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 16
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:page:"


def open_store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, first_id, is_revisit: bool) -> bytes:
    """One uncompressed record; a revisit holds the HTTP head only and names the response's record."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if is_revisit else head + payload
    fields = {
        "WARC-Type": "revisit" if is_revisit else "response",
        "WARC-Record-ID": f"<{RECORD}{'' if page_id is None else page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._|")
    if is_revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{RECORD}{first_id}>"}
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + END


def write(
    pages: DataFrame,
    min_bytes: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    archive_bytes: int = ARCHIVE_BYTES,
    level: int = 6,
) -> DataFrame:
    """Write every row of ``pages`` as a record; the result lists the archives ``(path, records)``.

    Of equal payloads of at least ``min_bytes`` bytes the smallest id's is a response and the others are
    revisits of it; smaller ones are responses. A null payload is empty, a null id is never the smallest
    unless all are null (then all are responses), rows that repeat the smallest id are responses too, a
    null url leaves the target field out; other columns are not read.

    Archives go to the shared folder under names of their own for each task attempt. Only archives of
    committed attempts get into the list (a table), so retries and speculation leave no double records.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), empty_if_null(F.col(html_col)).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    firsts = rows.groupBy("digest").agg(F.min("id").alias("first"))
    revisit = (F.octet_length("html") >= min_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    typed = rows.join(firsts, "digest").select("id", "url", "html", F.col("first").cast("string"), revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(folder)
        out, path, size, count = None, "", 0, 0

        def entry() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "records": pa.array([count], pa.int64())})

        for batch in batches:
            for page_id, url, html, first, is_revisit in zip(*batch.columns, strict=True):
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = member.compress(record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), first.as_py(), is_revisit.as_py()))
                data += member.flush()
                if out is not None and size + len(data) > archive_bytes:
                    yield entry()
                    out = None
                if out is None:
                    store.create_dir(top, recursive=True)
                    path, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{top}/{path}", compression=None)  # else the suffix would gzip it twice
                out.write(data)
                size, count = size + len(data), count + 1
        if out is not None:
            yield entry()

    return save(typed.mapInArrow(run, "path string, records long"), "warc-list")


def members(read) -> Iterator[bytes]:
    """The gzip members of a stream; ``read(n)`` gives at most ``READ_BYTES`` compressed bytes at a time."""
    data = read(READ_BYTES)
    while data:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not data:
                raise ValueError("the archive ends inside a gzip member")
            parts.append(inflate.decompress(data))
            data = inflate.unused_data if inflate.eof else read(READ_BYTES)
        yield b"".join(parts)
        data = data or read(READ_BYTES)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and the block of the record that a member holds, framed by its length."""
    head, _, rest = member.partition(END)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["content-length"])
    if rest[n:] != END:
        raise ValueError(f"a record of {n} bytes isn't framed by its length")
    return fields, rest[:n]


def unpack(member: bytes) -> tuple:
    """(record id, url, type, referred id, payload or None, payload bytes, payload digest, verified)."""
    fields, block = parse(member)
    head, _, payload = block.partition(END)
    http = dict(x.lower().split(": ", 1) for x in head.decode().split("\r\n")[1:])
    bare = lambda name: fields[name].strip("<>").removeprefix(RECORD) or None if name in fields else None
    claimed = fields["warc-payload-digest"].removeprefix("sha1:")
    good = fields["warc-block-digest"] == f"sha1:{digest(block)}"
    is_revisit = fields["warc-type"] == "revisit"
    if not is_revisit:
        good = good and claimed == digest(payload) and int(http["content-length"]) == len(payload)
    return (
        bare("warc-record-id"),
        fields.get("warc-target-uri"),
        fields["warc-type"],
        bare("warc-refers-to"),
        None if is_revisit else payload,
        int(http["content-length"]),
        claimed,
        good,
    )


def read(archives: DataFrame, id_type: T.DataType | None = None, strict: bool = True) -> DataFrame:
    """The records of the archives in ``archives.path``, one row each.

    Each archive is read front to back in small blocks by one task, as many tasks as there are archives;
    one record is held at a time. ``verified`` says whether the digests of block and payload agree with
    the bytes; a record that they don't verify is an error unless ``strict`` is false, as broken framing or
    compression always is. A revisit's payload is null; its size and digest are the full payload's.
    """
    kind = (id_type or T.LongType()).simpleString()
    names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "verified"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = open_store(path)
                held, size = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for member in members(stream.read):
                        record_ = unpack(member)
                        if strict and not record_[-1]:
                            raise ValueError(f"record {record_[0]} of {path} fails its digests")
                        held.append(record_)
                        size += len(member)
                        if size > 8 << 20 or len(held) >= 1_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], schema=schema)

    # A count of its own keeps adaptive planning from putting the short list of paths into one task.
    rows = archives.select("path").repartitionByRange(max(archives.count(), 1), "path").mapInArrow(
        run,
        "page_id string, url string, record_type string, refers_to string, payload binary, payload_bytes long, payload_digest string, verified boolean",
    )
    return rows.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})

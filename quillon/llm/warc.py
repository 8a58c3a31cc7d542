"""WARC archives with a Zstandard dictionary of their own (operator 5).

An archive file starts with a skippable frame that holds the dictionary trained on its records; every record is then a
frame of its own, so one record can be read without the others.  Records whose payload stands in another record are
``revisit`` records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, schema, scratch, settle, slices, table
from quillon.plans.skew import hot_keys, salted_join

#: Bytes of records in an archive before compression; a writer holds no more than this and one record.
ARCHIVE_BYTES = 16 << 20
#: Dictionary size, and about how many bytes of records, taken evenly over the whole archive, it is trained on (at most
#: twice as many).
DICTIONARY_BYTES, TRAINING_BYTES = 64 << 10, 2 << 20
LEVEL = 3
# The magic number of the skippable frame for dictionaries, and the profile of equal payloads.
MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAME = "urn:page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, payload_digest: str) -> str:
    """Names a record by page, address and payload, so that rows which repeat an id, or have none, are told apart.

    Only rows equal in all three share a name: they are one record, written as often as it stands there.
    """
    return f"{_NAME}{'' if page_id is None else page_id}:{hashlib.sha1((url or '').encode()).hexdigest()[:16]}:{payload_digest}"


def record(page_id: int | None, url: str | None, size: int, payload_digest: str, refers_to: tuple[int, str | None] | None, payload: bytes | None) -> bytes:
    """A WARC/1.1 record; with ``payload`` None a revisit of ``refers_to`` (page_id, url), whose block is the response's head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = lambda u: quote(u or "about:blank", safe=":/?#[]@!$&()*+,;=%~")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id, url, payload_digest)}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {target(url)}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
    ]
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(*refers_to, payload_digest)}>", f"WARC-Refers-To-Target-URI: {target(refers_to[1])}"]
    block = head + (payload or b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive: the dictionary's skippable frame, then a frame for each record."""
    import zstandard

    every = max(1, -(-sum(map(len, records)) // TRAINING_BYTES))
    sample, held = [], 0
    for r in records[::every] if len(records) > 7 * every else records:
        if held + len(r) <= 2 * TRAINING_BYTES:
            sample.append(r)
            held += len(r)
    data = b""
    if len(sample) >= 7:
        try:
            data = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, held // 8)), sample, k=256, d=8, steps=1, threads=0).as_bytes()
        except zstandard.ZstdError:
            data = b""  # too little in common: an empty dictionary frame
    coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data) if data else None, write_content_size=True)
    return b"".join([struct.pack("<II", MAGIC, len(data)), data, *(coder.compress(r) for r in records)])


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, each decompressed alone with the dictionary of the leading frame."""
    import zstandard

    magic, size = struct.unpack_from("<II", archive)
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    data = archive[8 : 8 + size]
    coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
    view, at = memoryview(archive), 8 + size
    while at < len(archive):
        one, out = coder.decompressobj(), []
        while not one.eof:
            part = view[at : at + (64 << 10)]
            if not part:
                raise ValueError("an archive ends inside a record")
            out.append(one.decompress(part))
            at += len(part) - len(one.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> dict:
    """Fields of a record, its payload, and what its headers say of it."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"fields": fields, "payload": payload, "length": int(re.search(rb"Content-Length: (\d+)", http)[1])}


def put_file(at: str, data: bytes) -> None:
    """Writes a file of a shared folder whole or not at all; a second attempt replaces it by the same bytes."""
    url = urlparse(at)
    if url.scheme in ("", "file"):
        os.makedirs(os.path.dirname(url.path), exist_ok=True)
        with open(part := f"{url.path}.{uuid.uuid4().hex}", "wb") as f:
            f.write(data)
        os.replace(part, url.path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(at)
        store.create_dir(os.path.dirname(path), recursive=True)
        with store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as f:
            f.write(data)
        store.move(part, path)


def with_referrals(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and what the row refers to: id and url of the largest page_id with that payload, if another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            yield pa.record_batch([*b.columns, pa.array([digest((x or "").encode()) for x in b.column(2).to_pylist()])], names=["page_id", "url", "html", "digest"])

    rows = bounded_batches(pages).select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, schema("page_id bigint, url string, html string, digest string"))
    ids = settle(rows.select("page_id", "url", "digest"))
    # Counts and maxima are combined map-side; a payload shared by a third of the pages is dealt over tasks.
    last = ids.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("m"), F.count("*").alias("n")).where("n > 1")
    last = settle(last.select("digest", F.col("m.page_id").alias("to_id"), F.col("m.url").alias("to_url"), "n"))
    out = salted_join(rows, last.select("digest", "to_id", "to_url"), ["digest"], "page_id", hot_keys(last, ["digest"], "n", ids.count()), "left")
    other = F.col("to_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("to_id"))
    return out.select("page_id", "url", "html", "digest", F.when(other, F.col("to_id")).alias("to_id"), F.when(other, F.col("to_url")).alias("to_url"))


def write_archives(pages: DataFrame, out: str) -> DataFrame:
    """Writes the pages (page_id, url, html) as archives under ``out``; returns archive, records, bytes of each file.

    A null html is an empty payload, a null url ``about:blank``; a row with a null page_id revisits the largest page_id of
    its payload, if there is one; rows that repeat an id are records of their own, told apart by url and payload; further columns are
    ignored; an empty table writes no file.  File names follow partitions and rows are sorted inside them, so a repeated task writes the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, names = TaskContext.get().partitionId(), [], 0, []

        def close() -> pa.RecordBatch:
            data = pack(held)
            names.append(f"{part:06d}-{len(names):05d}.warc.zst")
            put_file(f"{out}/{names[-1]}", data)
            return pa.record_batch([pa.array([names[-1]]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64())], names=["archive", "records", "bytes"])

        for b in slices(batches, "html"):
            for page_id, url, html, d, to_id, to_url in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                payload = (html or "").encode()
                one = record(page_id, url, len(payload), d, (to_id, to_url), payload if to_id is None else None)
                if held and size + len(one) > ARCHIVE_BYTES:
                    yield close()
                    held, size = [], 0
                held.append(one)
                size += len(one)
        if held:
            yield close()

    rows = with_referrals(pages).sortWithinPartitions("page_id", F.xxhash64("url", "html"))
    return settle(rows.mapInArrow(run, schema("archive string, records bigint, bytes bigint")))


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of every record under ``out``.

    Payload, size and digest of a response are those of its bytes; a revisit has a null payload and takes the others
    from its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if (x := x.strip("<>").removeprefix(_NAME).split(":")[0]) else None
        for b in batches:
            for archive in b.column(0):
                rows, size = [], 0
                for data in unpack(archive.as_py()):
                    r = parse(data)
                    f, again = r["fields"], r["fields"]["WARC-Type"] == "revisit"
                    rows.append((number(f["WARC-Record-ID"]), f["WARC-Target-URI"], None if again else r["payload"], r["length"] if again else len(r["payload"]), f["WARC-Payload-Digest"].removeprefix("sha1:") if again else digest(r["payload"]), f["WARC-Type"], number(f["WARC-Refers-To"]) if again else None))
                    size += len(data)
                    if size > 4 << 20:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    ddl = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").schema("path string, modificationTime timestamp, length bigint, content binary").load(out).select("content")
    return files.mapInArrow(run, schema(ddl))


def op5_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "warc")
    written = write_archives(table(spark, sf_dir, "pages"), out)
    if not written.count():
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    return read_archives(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

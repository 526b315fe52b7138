"""Operator 4: WARC archives: one gzip member per record, written and read back sequentially."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnesis.llm.common import Scratch

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_id(page_id: int | None) -> bytes:
    return b"<urn:page:%d>" % page_id if page_id is not None else b"<urn:page:none>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 6) -> bytes:
    """One record as a gzip member of its own. refers_to: the page whose payload a revisit repeats; its block holds no payload then."""
    block = HTTP % len(payload) + (payload if refers_to is None else b"")
    head = [VERSION, b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + record_id(page_id), b"WARC-Date: " + DATE]
    if url is not None:
        head.append(b"WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=~").encode())
    if refers_to is not None:
        head += [b"WARC-Refers-To: " + record_id(refers_to), b"WARC-Profile: " + PROFILE]
    head += [b"WARC-Payload-Digest: sha256:" + digest.encode(), b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode()]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(archive: memoryview | bytes, piece: int = 64 << 10) -> Iterator[bytes]:
    """The contents of an archive's gzip members, inflated piece by piece."""
    view, at = memoryview(archive), 0
    while at < len(view):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(view):
                raise ValueError("an archive ends inside a record")
            chunk = view[at : at + piece]
            out.append(inflate.decompress(chunk))
            at += len(chunk) - len(inflate.unused_data)
        if content := b"".join(out):
            yield content


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one record, framed by its content length; its digests are verified."""
    head, found, rest = content.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not re.fullmatch(rb"WARC/\d+\.\d+", lines[0]):
        raise ValueError("no WARC record")
    fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')}: its length is not {size}")
    if fields["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError(f"record {fields.get('warc-record-id')}: wrong block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    if not re.fullmatch(r"sha256:[0-9a-f]{64}", fields["warc-payload-digest"]):
        raise ValueError(f"record {fields.get('warc-record-id')}: no payload digest")
    fields["payload-length"] = re.search(rb"\r\nContent-Length: (\d+)", http)[1].decode()
    whole = fields["warc-type"] == "response"
    if whole and (len(payload) != int(fields["payload-length"]) or fields["warc-payload-digest"] != "sha256:" + hashlib.sha256(payload).hexdigest()):
        raise ValueError(f"record {fields.get('warc-record-id')}: wrong payload digest")
    return fields, payload


def write_archives(pages: DataFrame, path: str, least: int = 100, archive: int = 64 << 20, chunk: int = 1 << 20) -> None:
    """Write pages (page_id, url, html) as .warc.gz files below path, a record for each row.

    Of equal payloads of at least `least` bytes, the one of the smallest page_id is a response and the others are revisits that refer to it; of rows with
    that same page_id all are responses, and a null page_id counts as the largest. A null html is empty; a null url is left out.

    Payloads are shuffled once, by their digest, and make the files of the partitions that they fall in; a digest that many pages share can be split. A file is rolled
    over at about `archive` bytes, counted in chunks of `chunk` bytes or one record, so that no task ever holds or reads more at a time. The bytes are written by Spark's text writer, whose line end is the zero byte that every member ends with: thus any store that Spark writes can hold archives.
    """
    page = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    page = page.withColumns({"digest": F.sha2("payload", 256), "large": F.octet_length("payload") >= least})
    first = page.where("large").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("same"), "first")
    # joined by an expression over the digest, so that both sides are dealt for the join and a digest with very many pages can be split
    page = page.join(first.withColumn("k", F.xxhash64("same")), (F.xxhash64("digest") == F.col("k")) & (F.col("digest") == F.col("same")), "left")
    page = page.withColumn("refers_to", F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        put = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], names=["value"])
        out, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                member = record(*(x.as_py() for x in row))
                if member[-1]:  # the last byte is that of 2**24 in the length: over 16 MB, an empty member follows
                    member += zlib.compress(b"", wbits=31)
                out.append(member)
                size += len(member)
                if size >= chunk:
                    yield put()
                    out, size = [], 0
        if out:
            yield put()

    # a line of the writer's is a chunk of records, and a file holds so many lines
    records = page.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "value binary")
    records.select(F.col("value").cast("string")).write.mode("overwrite").option("lineSep", "\0").option("maxRecordsPerFile", max(1, archive // chunk)).text(path)
    spark = pages.sparkSession
    files = spark._jvm.org.apache.hadoop.fs
    store = files.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.listStatus(files.Path(path)):
        name = status.getPath().getName()
        if name.startswith("part-"):
            store.rename(status.getPath(), files.Path(path, name.removesuffix(".txt") + ".warc.gz"))


def read_archives(spark, path: str) -> DataFrame:
    """The records of the archives below path: archive, page_id, url, record_type, refers_to, payload (null: revisit), payload_bytes and payload_digest.

    Each archive is read by one task from its start to its end, record by record; one that is cut short or fails a digest is an error.
    """
    schema = "archive string, page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"

    def number(x: str | None) -> int | None:
        return int(m[1]) if x and (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, size = [], 0
                for x in members(memoryview(content.as_buffer())):
                    h, payload = parse(x)
                    own = payload if h["warc-type"] == "response" else None
                    rows.append((path.as_py(), number(h["warc-record-id"]), unquote(h["warc-target-uri"]) if "warc-target-uri" in h else None, h["warc-type"], number(h.get("warc-refers-to")), own, int(h["payload-length"]), h["warc-payload-digest"].removeprefix("sha256:")))
                    size += len(x)
                    if size > 4 << 20:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    empty = spark.createDataFrame([], schema)
    files = spark._jvm.org.apache.hadoop.fs
    store = files.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.globStatus(files.Path(path, "*.warc.gz")):
        return empty
    return spark.read.format("binaryFile").load(f"{path}/*.warc.gz").select("path", "content").mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """The records of all pages, written to archives in the shared folder and read back: read_archives() without the payloads. Other columns are ignored."""
    scratch = Scratch(pages.sparkSession, "warc")
    write_archives(pages, scratch.path("archives"), least)
    return read_archives(pages.sparkSession, scratch.path("archives")).drop("payload")

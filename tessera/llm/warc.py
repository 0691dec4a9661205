"""WARC archives: one gzip member a record, read sequentially.

Writing: payload digests decide which record is the response of a group of equal payloads (the
largest page_id) and which ones revisit it. Each task writes archives of about ROLL compressed bytes
into the folder that the cluster shares, under names no other attempt uses, and returns their names;
the table of names is committed by Spark, so archives of failed attempts are never read.

Reading: each archive is one row of work. Bytes go through an incremental zlib decompressor, block by
block; a record's header ends at the empty line, its content-length frames the block, and the
digests of block and payload are verified. A wrong digest or a torn record raises ValueError.

Defined results: null html is an empty payload. A null page_id or url leaves its header out and comes
back null. Repeated rows with one page_id and equal payload are all responses or all revisits.
Control characters in a url are percent-encoded. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import shared_dir, small_batches, written
from tessera.session import table

#: Payloads from this size on may become revisits.
REVISIT_BYTES = 1000
#: Compressed bytes after which a task begins a new archive; reading is parallel over archives.
ROLL = 64 << 20
#: Groups of equal payloads that may be broadcast, by a count made before; beyond it the join is a shuffle.
SMALL = 200_000
READ = 1 << 16
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_shared(path: str, mode: str):
    """A binary stream on a path of any scheme that pyarrow knows; plain and file: paths are opened directly."""
    if path.startswith("file:") or "://" not in path:
        return open("/" + path.removeprefix("file:").lstrip("/"), mode)
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_output_stream(name) if "w" in mode else store.open_input_stream(name)


def _sha1(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record, not compressed."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    lines.append(f"WARC-Payload-Digest: {_sha1(hashlib.sha1(payload).digest())}")
    lines.append(f"WARC-Block-Digest: {_sha1(hashlib.sha1(block).digest())}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem = f"{folder}/{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex[:12]}"
        names, counts, out, size = [], [], None, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None or size >= ROLL:
                    if out is not None:
                        out.close()
                    names.append(f"{stem}-{len(names):04d}.warc.gz")
                    counts.append(0)
                    out, size = open_shared(names[-1], "wb"), 0
                z = zlib.compressobj(4, zlib.DEFLATED, 31)
                raw = z.compress(record(page_id, url, html.encode(), refers_to)) + z.flush()
                out.write(raw)
                size += len(raw)
                counts[-1] += 1
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["archive", "records"])

    return run


def write_archives(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages (page_id, url, html) as archives; returns the written table (archive, records)."""
    small_batches(spark)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.xxhash64(html).alias("xx"), F.octet_length(html).alias("n"))
    key = ["sha1", "xx", "n"]
    groups = rows.where(F.col("n") >= REVISIT_BYTES).groupBy(*key).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    groups = written(spark, groups, "warc-groups")
    rows = rows.join(F.broadcast(groups) if groups.count() <= SMALL else groups, key, "left")
    rows = rows.select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("first") != F.col("page_id")), F.col("first")).alias("refers_to"))
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if folder.startswith("file:") or "://" not in folder:
        import os

        os.makedirs("/" + folder.removeprefix("file:").lstrip("/"))
    return written(spark, rows.mapInArrow(_write(folder), "archive string, records bigint"), "warc-names")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of an open archive, by incremental decompression of one member after the other."""
    raw = stream.read(READ)
    while raw:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not raw:
                raise ValueError("the archive ends within a record")
            parts.append(z.decompress(raw))
            raw = z.unused_data if z.eof else stream.read(READ)
        member = b"".join(parts)
        end = member.find(b"\r\n\r\n")
        if end < 0 or not member.startswith(b"WARC/"):
            raise ValueError("no record header")
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in member[:end].decode().split("\r\n")[1:])}
        n = int(header["content-length"])
        if len(member) != end + 4 + n + 4 or member[-4:] != b"\r\n\r\n":
            raise ValueError("content-length does not frame the record")
        yield header, member[end + 4 : end + 4 + n]
        raw = raw or stream.read(READ)


def parsed(header: dict[str, str], block: bytes) -> tuple[int | None, str | None, int, str, str, int | None]:
    """RECORD's values, after verifying both digests."""
    if _sha1(hashlib.sha1(block).digest()) != header["warc-block-digest"]:
        raise ValueError("wrong block digest")
    head, _, payload = block.partition(b"\r\n\r\n")
    n = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = header["warc-payload-digest"]
    if header["warc-type"] == "response" and (_sha1(hashlib.sha1(payload).digest()) != digest or len(payload) != n):
        raise ValueError("wrong payload digest")
    number = lambda x: int(x[10:-1]) if x.startswith("<urn:page:") else None
    return number(header["warc-record-id"]), header.get("warc-target-uri"), n, base64.b32decode(digest[5:]).hex(), header["warc-type"], number(header.get("warc-refers-to", ""))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    for batch in batches:
        for archive in batch.column(0).to_pylist():
            rows = []
            with open_shared(archive, "rb") as stream:
                for header, block in read_records(stream):
                    rows.append(parsed(header, block))
                    if len(rows) == 5000:
                        yield pack(rows)
                        rows = []
            if rows:
                yield pack(rows)


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """Records (RECORD) of the archives named in column archive; one task reads an archive from its start to its end."""
    n = max(1, min(archives.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return archives.select("archive").repartition(n).mapInArrow(_read, RECORD)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(spark, table(spark, sf_dir, "pages"))
    return read_archives(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to
FROM g
"""

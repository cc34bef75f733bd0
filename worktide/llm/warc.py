"""WARC archives with an index that comes first.

Each task writes one archive under a name of its own, a gzip member per record, and returns one
index row per record: file, offset, length, page, URL and digest. The index is written as a table;
a file of a lost task is in no index row, so it is never read. A read starts from index rows: they
are sorted by file and offset, neighbouring byte ranges are joined into one read, and each record
is checked against its digest.

Of records with equal payloads the one with the largest page id is a response, and the others are
revisits that refer to it; their payload is not stored again.

Defined results: a null page has an empty payload; rows that repeat a page id with an equal payload
are all responses if it is the largest; a null id is the smallest; an empty table gives an empty
index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.operators.staging import stage
from worktide.session import shared_dir

DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Ranges closer than the gap are read at once, up to the size.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
# Payloads shorter than this are always responses.
REVISIT_BYTES = 0

INDEX_DDL = (
    "path string, `offset` bigint, length bigint, page_id bigint, url string, digest string"
)
RECORD_DDL = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, "
    "payload_bytes bigint, payload binary"
)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           revisit: bool) -> bytes:
    """Bytes of one record."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    name = "" if page is None else str(page)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        # A header is one line.
        head.append("WARC-Target-URI: " + re.sub("[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record; fails where the payload does not match its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")

    def page(name: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))
        return int(found[1]) if found else None

    return {
        "page_id": page("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "refers_to": page("WARC-Refers-To"),
        "payload_digest": digest,
        "payload_bytes": size,
        "payload": payload if kind == "response" else None,
    }


def _writer(folder: str) -> Callable:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        stream, at = None, 0
        for part in parts:
            if stream is None:
                stream = system.open_output_stream(f"{root}/{name}", compression=None)
            rows = []
            for row in part.to_pylist():
                payload = (row["html"] or "").encode()
                digest = base32(hashlib.sha1(payload).digest())
                data = gzip.compress(
                    record(row["page_id"], row["url"], payload, digest, row["refers_to"], row["revisit"]),
                    compresslevel=4, mtime=0,
                )
                stream.write(data)
                rows.append((name, at, len(data), row["page_id"], row["url"], digest))
                at += len(data)
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["path", "offset", "length", "page_id", "url", "digest"],
                )
        if stream is not None:
            stream.close()

    return run


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url",
          html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Write archives into ``folder`` and return the written index."""
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"),
    )
    digest: Column = F.sha1(F.col("html").cast("binary"))
    groups = (
        rows.where(F.octet_length("html") >= least)
        .groupBy(digest.alias("digest"))
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
        .where("n > 1")
    )
    # Written, so that its size decides how Spark joins it.
    groups = stage(groups.select("digest", "last"))
    typed = (
        rows.withColumn("digest", digest)
        .join(groups, "digest", "left")
        .withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("last")) & F.col("last").isNotNull(), F.lit(False)))
        .select(
            "page_id", "url", "html", "revisit",
            F.when(F.col("revisit"), F.col("last")).alias("refers_to"),
        )
    )
    return stage(typed.mapInArrow(_writer(folder), INDEX_DDL))


def _reader(folder: str, gap: int, size: int) -> Callable:
    kind = pa.schema(
        [
            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
            ("refers_to", pa.int64()), ("payload_digest", pa.string()),
            ("payload_bytes", pa.int64()), ("payload", pa.binary()),
        ]
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        path, file = None, None
        for part in parts:
            rows = list(
                zip(*(part.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True)
            )
            for own, first, end, members in coalesced(rows, gap, size):
                if own != path:
                    path, file = own, system.open_input_file(f"{root}/{own}")
                data = memoryview(file.read_at(end - first, first))
                found = [
                    parse(zlib.decompress(data[a - first : a - first + n], wbits=31)) for a, n in members
                ]
                yield pa.RecordBatch.from_pylist(found, kind)

    return run


def coalesced(rows: list[tuple[str, int, int]], gap: int, size: int) -> Iterator[tuple]:
    """(file, first byte, end, records) of each joined read; ``rows`` are sorted."""
    path, first, end, members = None, 0, 0, []
    for own, offset, length in rows:
        near = own == path and offset - end <= gap and offset + length - first <= size
        if members and not near:
            yield path, first, end, members
            members = []
        if not members:
            path, first, end = own, offset, offset
        members.append((offset, length))
        end = max(end, offset + length)
    if members:
        yield path, first, end, members


def read(index: DataFrame, folder: str, gap: int = GAP_BYTES, size: int = READ_BYTES) -> DataFrame:
    """Records of the selected index rows."""
    spark = index.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = index.select("path", "offset", "length").repartitionByRange(tasks, "path", "offset")
    return places.sortWithinPartitions("path", "offset").mapInArrow(_reader(folder, gap, size), RECORD_DDL)


def new_folder(spark) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"

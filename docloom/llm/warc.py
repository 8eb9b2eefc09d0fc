"""WARC archives with an index that is written first and read by coalesced byte ranges.

Writing: every task appends its records to archive files in the shared folder, each record a gzip
member of its own, and returns one index row per record (file, offset, length, URL, digest). The
index is a Parquet table that Spark commits, and archive files carry a random name, so the index
of a lost or doubled attempt names no record twice; files that no index row names are ignored.

Reading: the selected index rows are sorted by file and offset, neighbours are joined to one read
of at most ``READ_BYTES``, and the records are cut out of it and parsed.

Revisits: of the pages with equal payloads of at least ``min_bytes``, the one with the smallest id
is a response record, and the others are revisit records that name it, with the full payload's
length in their HTTP head and its digest in their WARC head.

Edge cases: null html is an empty payload; a null URL has no WARC-Target-URI; a null page id has no
id header, comes after all ids, and if all equal pages have null ids they are all responses; rows
that repeat the smallest id are responses too; control characters in URLs are percent-encoded;
an empty table gives an index without rows. Other columns are left out.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import file_system, work_folder

MIN_REVISIT_BYTES = 100
FILE_BYTES = 1 << 30
READ_BYTES = 8 << 20
READ_GAP = 64 << 10

INDEX_SCHEMA = (
    "file string, offset long, length long, url string, digest string, page_id long, record_type string"
)
RECORD_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of pages (page_id, url, html)."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    digested = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # Only payloads that occur again are looked up; the join carries no row for the others.
    firsts = (
        digested.filter(F.octet_length("payload") >= min_bytes)
        .groupBy(F.col("digest").alias("_digest"))
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1 AND _first IS NOT NULL")
    )
    again = F.col("page_id").isNull() | (F.col("page_id") > F.col("_first"))
    return digested.join(firsts, F.col("digest") == F.col("_digest"), "left").select(
        "page_id", "url", "payload", "digest", F.when(again, F.col("_first")).alias("refers_to")
    )


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _escaped(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One uncompressed WARC/1.1 record."""
    kind = "response" if refers_to is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_escaped(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {_record_id(refers_to, digest)}")
        lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple:
    """A row of RECORD_SCHEMA from one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(fields[name]) if name in fields else None
    if fields["WARC-Type"] == "response":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    else:
        size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
        digest, payload = fields["WARC-Payload-Digest"].removeprefix("sha256:"), None
    return number("X-Page-ID"), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], number("X-Refers-To-Page-ID"), payload


def write_archives(pages: DataFrame, root: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = MIN_REVISIT_BYTES, level: int = 3) -> DataFrame:
    """Write the pages as archives below ``root`` and return their stored index."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(f"{root}/archives")
        store.create_dir(folder)
        out, name, offset = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                data = gzip.compress(record(page_id, url, payload, digest, refers_to, date), level, mtime=0)
                out.write(data)
                kind = "response" if refers_to is None else "revisit"
                rows.append((name, offset, len(data), url, digest, page_id, kind))
                offset += len(data)
                if offset >= FILE_BYTES:
                    out.close()
                    out = None
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))],
                    names=["file", "offset", "length", "url", "digest", "page_id", "record_type"],
                )
        if out is not None:
            out.close()

    index = with_revisits(pages, min_bytes).mapInArrow(write, INDEX_SCHEMA)
    index.write.parquet(f"{root}/index")
    return pages.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{root}/index")


def coalesced(ranges: list[tuple[int, int]], most: int = READ_BYTES, gap: int = READ_GAP) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of sorted (offset, length) ranges that one read of at most ``most`` bytes covers,
    with at most ``gap`` unused bytes between neighbours; a longer record is a run of its own."""
    start = 0
    for i in range(1, len(ranges) + 1):
        if i < len(ranges):
            end = ranges[i - 1][0] + ranges[i - 1][1]
            if ranges[i][0] - end <= gap and ranges[i][0] + ranges[i][1] - ranges[start][0] <= most:
                continue
        yield start, i
        start = i


def read_records(selected: DataFrame, root: str) -> DataFrame:
    """The records of the selected index rows, as RECORD_SCHEMA.

    A task gets a stretch of archive of at most 64 MiB (the file and the place in it are the key),
    so neighbours stay together and no file is one task's work.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(f"{root}/archives")
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        opened, source = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            i = 0
            while i < len(files):
                j = i
                while j < len(files) and files[j] == files[i]:
                    j += 1
                if files[i] != opened:
                    if source is not None:
                        source.close()
                    opened, source = files[i], store.open_input_file(f"{folder}/{files[i]}")
                ranges = list(zip(offsets[i:j], lengths[i:j]))
                for a, b in coalesced(ranges):
                    first, last = ranges[a][0], ranges[b - 1][0] + ranges[b - 1][1]
                    data = source.read_at(last - first, first)
                    rows = [parsed(zlib.decompress(data[o - first : o - first + n], 31)) for o, n in ranges[a:b]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                i = j

    return (
        selected.select("file", "offset", "length")
        .repartition("file", F.floor(F.col("offset") / (64 << 20)))
        .sortWithinPartitions("file", "offset")
        .mapInArrow(read, RECORD_SCHEMA)
    )


def archived(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Write the pages, select every index row and read the records back."""
    root = root or work_folder(pages.sparkSession, "warc")
    return read_records(write_archives(pages, root), root)

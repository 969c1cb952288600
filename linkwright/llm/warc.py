"""WARC archives with a two-level capture index.

Writing: records are range-partitioned by reversed-host key, so a task writes one
archive in key order and its index part beside it: index lines in compressed
blocks, then a sparse directory of the blocks (first key, offset, length), then
a fixed-size trailer. The list of parts (first and last key) is the top level; it
is the only thing written as a table, and commits a task's files: files of lost
attempts are never listed. Every record is a gzip member of its own, so a range
read gets one record. Records with equal payloads of at least ``least`` bytes are
stored once; the others are revisits that keep the HTTP header only.

Looking up: the table of parts, whose key ranges follow each other, gives the parts
that can hold the key; then binary search in a part's directory, then in one block,
then a range read of the record. Reading all back goes through the
same index, block by block; neighbouring records of a block are fetched by one
read, since archive and index share their order.

Files go to the shared folder through pyarrow's file systems (local, HDFS, S3,
GCS). A hot host or URL spreads over range partitions, because the key ends in
the page id.

Edge cases: null html is an empty payload; null or odd URLs get the key of the
empty host and are stored percent-encoded where a header needs it; pages with
equal page_id and equal payload are all responses if theirs is the smallest id;
null page_id sorts last among equal payloads and, where all are null, all are
responses; an empty table writes no archive; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from bisect import bisect_right
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import join_small, materialise, new_path
from .common import bound_batches, utf8

#: Bytes from which equal payloads are stored once; records and payload bytes of an archive; index lines of a block; bytes between records that one read may skip.
LEAST, RECORDS, ARCHIVE_BYTES, BLOCK_LINES, GAP = 100, 8_192, 64 << 20, 512, 1 << 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_TRAILER = "<QQ"
PARTS = "first_key string, last_key string, archive string, index string, records long"


def reversed_host_key(url: Column) -> Column:
    """com,example,www)/path?query of an http URL, without scheme, user, port and fragment."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(")"), rest)


def filesystem(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def record(kind: str, page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record; ``payload`` is stored for responses only, its length and digest always."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if kind == "revisit":
        head.insert(4, f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>\r\nWARC-Profile: {PROFILE}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's headers, its stored HTTP headers and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if headers["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{headers['WARC-Record-ID']}: payload does not match its digest")
    page = lambda name: int(headers[name][10:-1]) if headers.get(name, "")[10:-1] else None
    return {
        "page_id": page("WARC-Record-ID"),
        "url": headers.get("WARC-Target-URI"),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": headers["WARC-Type"],
        "refers_to": page("WARC-Refers-To"),
        "payload": payload,
    }


def _write(batches, folder):
    import uuid

    system, root = filesystem(folder)
    system.create_dir(root, recursive=True)
    name = f"{folder}/{uuid.uuid4().hex}"
    out, lines, offset = None, [], 0
    for batch in batches:
        get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        payloads = utf8(get.pop("html"))
        for row, payload in zip(pa.RecordBatch.from_arrays(list(get.values()), names=list(get)).to_pylist(), payloads):
            if out is None:
                out = system.open_output_stream(filesystem(name + ".warc.gz")[1], compression=None)
            packer = zlib.compressobj(4, zlib.DEFLATED, 31)
            data = packer.compress(record(row["kind"], row["page_id"], row["url"], row["digest"], payload, row["first"])) + packer.flush()
            out.write(data)
            lines.append((row["key"], offset, len(data)))
            offset += len(data)
    if out is None:
        return
    out.close()
    index = pack_index(lines)
    with system.open_output_stream(filesystem(name + ".idx")[1]) as f:
        f.write(index)
    yield pa.RecordBatch.from_pydict({"first_key": [lines[0][0]], "last_key": [lines[-1][0]], "archive": [name + ".warc.gz"], "index": [name + ".idx"], "records": [len(lines)]})


def pack_index(lines: list[tuple[str, int, int]], block_lines: int = BLOCK_LINES) -> bytes:
    """Sorted (key, offset, length) lines as compressed blocks, their directory and the trailer."""
    out, directory, at = [], [], 0
    for i in range(0, len(lines), block_lines):
        part = lines[i : i + block_lines]
        data = zlib.compress(json.dumps(part, ensure_ascii=False, separators=(",", ":")).encode(), 6)
        directory.append((part[0][0], at, len(data)))
        out.append(data)
        at += len(data)
    footer = zlib.compress(json.dumps(directory, ensure_ascii=False, separators=(",", ":")).encode(), 6)
    return b"".join([*out, footer, struct.pack(_TRAILER, at, len(footer))])


class Part:
    """One archive and its index: directory in memory, blocks and records by range reads."""

    def __init__(self, archive: str, index: str):
        system, path = filesystem(index)
        self.index = system.open_input_file(path)
        size = self.index.size()
        at, length = struct.unpack(_TRAILER, self.index.read_at(struct.calcsize(_TRAILER), size - struct.calcsize(_TRAILER)))
        self.directory = [tuple(x) for x in json.loads(zlib.decompress(self.index.read_at(length, at)))]
        self.archive = system.open_input_file(filesystem(archive)[1])

    def block(self, i: int) -> list[tuple[str, int, int]]:
        _, at, length = self.directory[i]
        return [tuple(x) for x in json.loads(zlib.decompress(self.index.read_at(length, at)))]

    def records(self, lines: list[tuple[str, int, int]], gap: int = GAP):
        """The lines' records, by one read for those that lie together."""
        lines = sorted(lines, key=lambda x: x[1])
        i = 0
        while i < len(lines):
            k, end = i + 1, lines[i][1] + lines[i][2]
            while k < len(lines) and lines[k][1] - end <= gap and end - lines[i][1] < 1 << 23:
                end = lines[k][1] + lines[k][2]
                k += 1
            data = self.archive.read_at(end - lines[i][1], lines[i][1])
            for _, at, length in lines[i:k]:
                yield parse(zlib.decompress(data[at - lines[i][1] : at - lines[i][1] + length], 31))
            i = k

    def find(self, key: str) -> list[dict]:
        """All captures of a key; equal keys may run over several blocks."""
        starts = [d[0] for d in self.directory]
        i = max(0, bisect_right(starts, key) - 1)
        while i > 0 and starts[i] == key:
            i -= 1
        found: list[tuple[str, int, int]] = []
        while i < len(starts) and starts[i] <= key:
            block = self.block(i)
            keys = [x[0] for x in block]
            low, high = np.searchsorted(np.array(keys, object), key, "left"), bisect_right(keys, key)
            found += block[low:high]
            i += 1
        return list(self.records(found))

    def close(self) -> None:
        self.index.close()
        self.archive.close()


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST, records: int = RECORDS) -> DataFrame:
    """Write the archives; the table of parts: first_key, last_key, archive, index, records."""
    spark = pages.sparkSession
    bound_batches(spark)
    folder = folder or new_path(spark, "warc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce("html", F.lit("")).alias("html"),
    )
    digest, size = F.sha2(F.col("html").cast("binary"), 256), F.octet_length("html")
    firsts = rows.filter(size >= least).groupBy(digest.alias("same")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = materialise(firsts.filter("n > 1").select("same", "first"), "warc-firsts")
    keyed = rows.withColumns({"digest": digest, "key": reversed_host_key(F.col("url"))})
    joined = join_small(keyed, firsts, (F.col("digest") == F.col("same")) & (F.octet_length("html") >= least))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    dealt = joined.select("page_id", "url", "html", "digest", "key", "first", F.when(revisit, "revisit").otherwise("response").alias("kind"))
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    parts = max(1, -(-n // records), -(-total // ARCHIVE_BYTES))
    ordered = dealt.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    return materialise(ordered.mapInArrow(lambda it: _write(it, folder), PARTS), "warc-parts")


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            part = Part(row["archive"], row["index"])
            for i in range(len(part.directory)):
                got = list(part.records(part.block(i)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["page_id"] for r in got], pa.int64()),
                        pa.array([r["url"] for r in got], pa.string()),
                        pa.array([r["payload_bytes"] for r in got], pa.int64()),
                        pa.array([r["payload_digest"] for r in got], pa.string()),
                        pa.array([r["record_type"] for r in got], pa.string()),
                        pa.array([r["refers_to"] for r in got], pa.int64()),
                        pa.array([r["payload"] if r["record_type"] == "response" else None for r in got], pa.binary()),
                    ],
                    names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
                )
            part.close()


def read(parts: DataFrame) -> DataFrame:
    """Every record, through the index: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    spark = parts.sparkSession
    n = parts.count()
    dealt = parts.repartition(max(1, n), "archive") if n > 1 else parts
    bound_batches(spark)
    return dealt.mapInArrow(
        _read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )


def lookup(parts: DataFrame, url: str) -> list[dict]:
    """The captures of one URL: only the parts whose key range holds it are opened."""
    spark: SparkSession = parts.sparkSession
    key = spark.range(1).select(reversed_host_key(F.lit(url))).first()[0]
    found = []
    for row in parts.filter((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("first_key").collect():
        part = Part(row.archive, row["index"])
        found += part.find(key)
        part.close()
    return found

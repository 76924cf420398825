"""WARC archives through a chunked record table: no record is ever whole in memory.

Payloads are streamed as rows (record, chunk number, chunk). A writer task takes the rows of its partition in order,
holds one chunk at a time, and appends a gzip member for each record to its archive; a reader walks the archives in
blocks and gives the same kind of rows back, each with the SHA-1 of the payload so far, so that the last chunk of a
record carries the digest of the whole, which is held against the one in the record's header. Records that repeat a
payload are revisits: headers only.

Archives are written under a name of the task's attempt and then renamed, so tasks can be repeated or lose their
executor. Their folder is the shared one; any file system that pyarrow opens by URI will do.

Cases: a null payload counts as empty; payloads under ``least`` bytes are always responses. Of rows that share payload
and id, one is the response and the others revisit it. A null id is kept. An empty table gives no archives and an
empty result; other columns are not read. A digest that does not match what was read raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import attach_group, fresh_path, map_arrow, materialize

#: Bytes of a chunk, of an archive (about), and the least payload that a revisit can stand for.
CHUNK, ARCHIVE, LEAST = 1 << 20, 256 << 20, 0
#: Tasks that read archives, at most; beyond, a task reads several.
READ_TASKS = 100_000
RECORD_SPACE = uuid.UUID("7d3a2c52-4c1e-5a58-9a3e-2f6b8c7d1e00")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hexadecimal digits make four digits of base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_types(pages: DataFrame, payload: Column, id_col: str, least: int = LEAST) -> DataFrame:
    """(page_id, digest, payload_bytes, record_type, refers_to) for each page; only digests are shuffled."""
    rows = materialize(pages.select(F.col(id_col).alias("page_id"), base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes")), "warc-digests")
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first")).where("n > 1")
    met = attach_group(rows, groups, "digest", "n", "page_id", rows.count())
    revisit = (F.col("payload_bytes") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return met.select("page_id", "digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def chunk_rows(pages: DataFrame, payload: Column, id_col: str, chunk: int = CHUNK, least: int = LEAST, url_col: str | None = "url") -> DataFrame:
    """The chunked record table: (page_id, copy, chunk_no, last, data and the record's headers), all rows of an id and payload in one partition, in order.

    Payloads are shuffled once, by id and digest, the keys of the join in which they meet their type; a task then cuts them into chunks and sorts those.
    """
    types = record_types(pages, payload, id_col, least)
    kinds = types.groupBy("page_id", "digest").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("record_type").alias("record_type"), F.first("refers_to").alias("refers_to"))
    key = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    url = F.col(url_col) if url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(key(F.col(id_col)).alias("_key"), url.alias("url"), payload.alias("payload"), base32_sha1(payload).alias("digest")).repartition("_key", "digest")
    rows = rows.join(kinds.withColumn("_key", key(F.col("page_id"))), ["_key", "digest"]).drop("_key")
    rows = rows.withColumn("copy", F.monotonically_increasing_id())
    n = F.when(F.col("record_type") == "revisit", F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk)).cast("int"))
    rows = rows.withColumn("n", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    data = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    rows = rows.select("page_id", "copy", "chunk_no", (F.col("chunk_no") == F.col("n") - 1).alias("last"), data.alias("data"), "url", "digest", "payload_bytes", "record_type", "refers_to")
    return rows.sortWithinPartitions("page_id", "digest", "copy", "chunk_no")


def record_id(page_id: int | None) -> str:
    """A record's URI: a UUID made of the page's id; the name space's own for a null id."""
    return f"<urn:uuid:{RECORD_SPACE if page_id is None else uuid.UUID(int=(1 << 127) + (page_id & ((1 << 64) - 1)))}>"


def page_of(record: str) -> int | None:
    u = uuid.UUID(record.strip("<>").rpartition(":")[2])
    if u == RECORD_SPACE:
        return None
    n = u.int & ((1 << 64) - 1)
    return n - (1 << 64) if n >> 63 else n


def head(row: dict) -> bytes:
    """The WARC header of a record, and of a response the HTTP header of its block; all lengths are known before the first chunk."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    length = len(http) + (row["payload_bytes"] if row["record_type"] == "response" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(row['page_id'])}", "WARC-Date: 2024-01-01T00:00:00Z"]
    url = "".join(c for c in row["url"] or "" if c > " ")
    lines += [f"WARC-Target-URI: {url}"] if url else []
    lines += [f"WARC-Payload-Digest: sha1:{row['digest']}", f"X-Payload-Length: {row['payload_bytes']}"]
    if row["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(row['refers_to'])}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


class ArchiveWriter:
    """Appends records to archives of about ``size`` bytes each; gives (path, bytes, records) of those that are finished."""

    def __init__(self, folder: str, name: str, attempt: str, size: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.base, self.name, self.attempt, self.size, self.number, self.out, self.made = folder, name, attempt, size, 0, None, []

    def begin(self, header: bytes) -> None:
        if self.out is None:
            self.path = f"{self.name}-{self.number:05d}.warc.gz"
            self.out = self.fs.open_output_stream(f"{self.folder}/.{self.path}.{self.attempt}", compression=None)
            self.bytes = self.records = 0
        self.zip = zlib.compressobj(6, zlib.DEFLATED, 31)
        self._put(self.zip.compress(header))

    def chunk(self, data: bytes) -> None:
        self._put(self.zip.compress(data))

    def end(self) -> None:
        self._put(self.zip.compress(b"\r\n\r\n") + self.zip.flush())
        self.records += 1
        if self.bytes >= self.size:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(f"{self.folder}/.{self.path}.{self.attempt}", f"{self.folder}/{self.path}")
            self.made.append((f"{self.base}/{self.path}", self.bytes, self.records))
            self.out, self.number = None, self.number + 1


def write_archives(chunks: DataFrame, folder: str, archive: int = ARCHIVE, least: int = LEAST) -> DataFrame:
    """Writes the chunked record table as archives in folder; gives the manifest (path, bytes, records), itself a table there."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer, before = None, None
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                r = {k: v.as_py() for k, v in zip(batch.schema.names, row, strict=True)}
                writer = writer or ArchiveWriter(folder, f"part-{task.partitionId():05d}", str(task.taskAttemptId()), archive)
                if r["chunk_no"] == 0:
                    key = r["page_id"], r["digest"], r["payload_bytes"]
                    again = key == before and r["record_type"] == "response" and r["payload_bytes"] >= least
                    before = key
                    skip = again
                    writer.begin(head(r | {"record_type": "revisit", "refers_to": r["page_id"]} if again else r))
                if not skip:
                    writer.chunk(r["data"])
                if r["last"]:
                    writer.end()
        if writer:
            writer.close()
            path, size, records = zip(*writer.made)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(size, pa.int64()), pa.array(records, pa.int64())], ["path", "bytes", "records"])

    manifest = map_arrow(chunks, write, "path string, bytes long, records long", 64)
    return materialize(manifest, "warc-manifest")


def read_stream(stream, block: int = CHUNK) -> Iterator[tuple[dict, int, bytes, bool]]:
    """(headers, chunk number, payload chunk, last) for the records of an archive of gzip members, a block at a time."""
    zip_, buffer = zlib.decompressobj(31), bytearray()

    def more() -> bool:
        nonlocal zip_
        if zip_.eof:
            rest = zip_.unused_data or stream.read(block)
            if not rest:
                return False
            zip_ = zlib.decompressobj(31)
            buffer.extend(zip_.decompress(rest, block))
            return True
        data = zip_.unconsumed_tail or stream.read(block)
        if not data:
            return False
        buffer.extend(zip_.decompress(data, block))
        return True

    def until(mark: bytes) -> bytes:
        while (at := buffer.find(mark)) < 0:
            if not more():
                raise ValueError("the archive ends within a record")
        got = bytes(buffer[:at])
        del buffer[: at + len(mark)]
        return got

    while True:
        while not buffer:
            if not more():
                return
        lines = until(b"\r\n\r\n").decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        left = int(headers["Content-Length"])
        left -= len(until(b"\r\n\r\n")) + 4
        number = 0
        while True:
            while len(buffer) < min(left, block):
                if not more():
                    raise ValueError("the archive ends within a record")
            data = bytes(buffer[: min(left, block)])
            del buffer[: len(data)]
            left -= len(data)
            yield headers, number, data, not left
            number += 1
            if not left:
                break
        if until(b"\r\n\r\n"):
            raise ValueError("a record is longer than it says")


def read_archives(manifest: DataFrame, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunked record table of archives: (page_id, chunk_no, data, bytes_so_far, sha1_so_far, last, record_type, refers_to, digest, payload_bytes)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "chunk_no", "data", "bytes_so_far", "sha1_so_far", "last", "record_type", "refers_to", "digest", "payload_bytes"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        held: list[tuple] = []
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_stream(path, compression=None) as stream:
                    for headers, number, got, last in read_stream(stream, chunk):
                        if number == 0:
                            sha, so_far = hashlib.sha1(), 0
                        sha.update(got)
                        so_far += len(got)
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = headers["WARC-Type"] == "revisit"
                        now = base64.b32encode(sha.digest()).decode()
                        if last and not revisit and (now != digest or so_far != int(headers["X-Payload-Length"])):
                            raise ValueError(f"{uri}: the payload of {headers['WARC-Record-ID']} does not match its digest")
                        held.append((page_of(headers["WARC-Record-ID"]), number, got if data else None, so_far, now, last, headers["WARC-Type"], page_of(headers["WARC-Refers-To"]) if revisit else None, digest, int(headers["X-Payload-Length"])))
                        if len(held) >= (16 if data else 1000):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                            held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    files = manifest.repartition(max(1, min(manifest.count(), READ_TASKS)))  # by turns, a task for each archive: a number of its own, so that adaptive execution does not fold them
    return map_arrow(files, read, "page_id long, chunk_no long, data binary, bytes_so_far long, sha1_so_far string, last boolean, record_type string, refers_to long, digest string, payload_bytes long")


def round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", text_col: str = "html", chunk: int = CHUNK, least: int = LEAST, archive: int = ARCHIVE) -> DataFrame:
    """Writes pages as archives in the shared folder, reads them back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    payload = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    manifest = write_archives(chunk_rows(pages, payload, id_col, chunk, least), fresh_path(spark, "warc"), archive, least)
    last = read_archives(manifest, chunk, data=False).where("last")
    digest = F.when(F.col("record_type") == "revisit", F.col("digest")).otherwise(F.col("sha1_so_far"))
    size = F.when(F.col("record_type") == "revisit", F.col("payload_bytes")).otherwise(F.col("bytes_so_far"))
    return last.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
         row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC) AS k,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages)
SELECT page_id, payload_bytes,
       translate(string_agg(upper(to_base(CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT), 32, 4)), '' ORDER BY i),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN first_id END AS refers_to
FROM p, range(8) AS r(i)
GROUP BY page_id, payload_bytes, h, k, first_id
"""

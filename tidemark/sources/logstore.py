"""The log as files, and other places where messages come from and go to.

A log is Parquet under ``topic=.../partition=...``, sorted by offset within files: partition pruning finds a topic's
partition, row-group statistics an offset or time.
"""

from __future__ import annotations

import gzip
import os
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reads import PART, append

LOG_SCHEMA = "topic string, partition int, offset long, ts timestamp_ntz, key string, value string, priority int, flags int"


def write_log(log: DataFrame, path: str, mode: str = "append", files_per_partition: int = 1) -> None:
    """Deals each topic's partition to a bounded number of files by ranges of offsets, so that one large partition is no single task."""
    spread = F.pmod(F.floor(F.col("offset") / 1_000_000), F.lit(files_per_partition))
    log.repartition(*PART, spread).sortWithinPartitions(*PART, "offset").write.mode(mode).partitionBy(*PART).parquet(path)


def read_log(spark: SparkSession, path: str, topics: list[str] | None = None) -> DataFrame:
    rows = spark.read.schema(LOG_SCHEMA).parquet(path)
    return rows.where(F.col("topic").isin(*topics)) if topics else rows


def stream_log(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """The log as a stream; ts as a timestamp with zone, which watermarks need."""
    rows = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def publish(batch: DataFrame, log: DataFrame, path: str, order: list, columns: list[str] | None = None) -> None:
    """Appends batch behind the ends of its partitions; with ``columns``, only those and the offsets are written."""
    rows = append(log, batch, order)
    write_log(rows.select("offset", *columns) if columns else rows, path)


def dead_letter_sink(path: str):
    """A function for foreachBatch: writes dead letters once an epoch, however often the epoch is tried."""

    def write(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").json(f"{path}/epoch={epoch}")

    return write


def export_spans(spans: DataFrame, path: str, endpoints: tuple[str, ...] = ("file",)) -> None:
    """Writes spans to each endpoint's folder as JSON lines, by one read for each endpoint."""
    for name in endpoints:
        spans.write.mode("overwrite").json(f"{path}/{name}")


def webhook_events(events: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(endpoint, event columns) for each endpoint that wants an event's type: those it lists, or all if it lists none.

    Endpoints' lists are exploded to an equi-join; those without a list take all, one copy of the events each.
    """
    listed = endpoints.where(F.size("events") > 0).select("endpoint", F.explode("events").alias("event_type"))
    every = endpoints.where(F.size("events") == 0).select("endpoint")
    return events.join(F.broadcast(listed), "event_type").unionByName(events.join(F.broadcast(every)))


_CRC32C: list[int] = []


def crc32c(data: bytes) -> int:
    """CRC-32C (Castagnoli), by a table made from its polynomial."""
    if not _CRC32C:
        for i in range(256):
            for _ in range(8):
                i = (i >> 1) ^ (0x82F63B78 if i & 1 else 0)
            _CRC32C.append(i)
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC32C[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


#: Fixed values of the record format. The frame: two bytes of magic, version, flags, CRC of all that follows it, offset, time,
#: priority, a reserved zero, lengths of key, value and headers; 34 bytes, big-endian. Behind it key, value, headers.
MAGIC, VERSION = b"\x47\x51", 1
FRAME = struct.Struct(">2sBBIqqBBHIH")
CHECKED_FROM = 8
HAS_HEADERS = 1 << 1


def encode_headers(headers: dict[str, str]) -> bytes:
    """A count, then each key and value with its length in two bytes, in order of keys; nothing for no headers."""
    parts = [x.encode() for pair in sorted(headers.items()) for x in pair]
    return struct.pack(">H", len(headers)) + b"".join(struct.pack(">H", len(x)) + x for x in parts) if headers else b""


def decode_headers(data: bytes) -> dict[str, str]:
    parts, at = [], 2
    for _ in range(2 * struct.unpack_from(">H", data)[0] if data else 0):
        (n,) = struct.unpack_from(">H", data, at)
        parts.append(bytes(data[at + 2 : at + 2 + n]).decode())
        at += 2 + n
    return dict(zip(parts[::2], parts[1::2]))


def encode_record(offset: int, ts_ns: int, key: bytes | None, value: bytes, priority: int, flags: int, headers: dict[str, str]) -> bytes:
    key, tail = key or b"", encode_headers(headers)
    frame = FRAME.pack(MAGIC, VERSION, flags | (HAS_HEADERS if tail else 0), 0, offset, ts_ns, priority, 0, len(key), len(value), len(tail))
    body = frame[CHECKED_FROM:] + key + value + tail
    return frame[:4] + struct.pack(">I", crc32c(body)) + body


def decode_record(data: bytes) -> dict:
    """The record at the beginning of data; ValueError if it is cut or damaged."""
    if len(data) < FRAME.size:
        raise ValueError("cut")
    magic, version, flags, crc, offset, ts_ns, priority, _, nk, nv, nh = FRAME.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a record")
    key_end = FRAME.size + nk
    value_end = key_end + nv
    end = value_end + nh
    if len(data) < end:
        raise ValueError("cut")
    if crc32c(data[CHECKED_FROM:end]) != crc:
        raise ValueError("damaged")
    return {"offset": offset, "ts_ns": ts_ns, "key": bytes(data[FRAME.size : key_end]) or None, "value": bytes(data[key_end:value_end]), "priority": priority, "flags": flags, "headers": decode_headers(data[value_end:end]), "size": end}


def decode_stream(data: bytes) -> Iterator[dict]:
    """The records of a segment up to the first that is cut or damaged."""
    at, data = 0, memoryview(data)
    while at < len(data):
        try:
            r = decode_record(data[at:])
        except ValueError:
            return
        yield r
        at += r["size"]


def records(log: DataFrame) -> DataFrame:
    """(event_id, record): each message of (event_id, offset, ts, key, value, priority, flags) in its stored form, without headers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[1:]))
            made = [encode_record(o, ts, None if k is None else k.encode(), (v or "").encode(), p, f, {}) for o, ts, k, v, p, f in rows]
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), pa.array(made, pa.binary())], ["event_id", "record"])

    rows = log.select("event_id", "offset", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"), "key", "value", "priority", "flags")
    return rows.mapInArrow(encode, "event_id long, record binary")


def compressed(value: Column, codec: str = "gzip", least: int = 64) -> Column:
    """(flags bit, data): compressed if at least ``least`` bytes and if that is smaller; in Arrow batches."""

    def pack(v: bytes | None) -> tuple[int, bytes | None]:
        if v is None or len(v) < least or codec == "none":
            return 0, v
        out = gzip.compress(v, mtime=0) if codec == "gzip" else zlib.compressobj(wbits=-15)
        if codec == "flate":
            out = out.compress(v) + out.flush()
        return (1, out) if len(out) < len(v) else (0, v)

    @F.pandas_udf("compressed int, data binary")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pack(v) for v in values], columns=["compressed", "data"])

    return run(value)


def decompressed(packed: Column, codec: str = "gzip") -> Column:
    @F.pandas_udf("binary")
    def run(flags: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([d if not f else zlib.decompress(d, 31 if codec == "gzip" else -15) for f, d in zip(flags, data)])

    return run(packed["compressed"], packed["data"])


def encrypted(value: Column, key: bytes, iv: Column | None = None) -> Column:
    """AES-GCM of the value alone; pass an iv only where results must repeat, as in tests."""
    args = (value, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"))
    return F.aes_encrypt(*args) if iv is None else F.aes_encrypt(*args, iv)


def decrypted(value: Column, key: bytes) -> Column:
    return F.aes_decrypt(value, F.lit(key), F.lit("GCM"))


def disk_ok(used: Column, total: Column, threshold: float = 0.9) -> Column:
    """Whether a publish may go on: usage under the threshold."""
    return used / total < threshold


def restore_topics(documents: DataFrame) -> DataFrame:
    """(topic, partition, earliest, next) from the documents of a backup."""
    d = F.from_json("document", "topic string, partitions array<struct<partition:int,earliest:long,next:long>>")
    return documents.select(d.alias("d")).select("d.topic", F.explode("d.partitions").alias("p")).select("topic", "p.*")


def segment_path(base: str, topic: str, partition: int, offset: int) -> str:
    return os.path.join(base, f"topic={topic}", f"partition={partition}", f"{offset:020d}.log")

"""Traces from spans (trace_id, seq, event_type, ts_us, topic, partition, offset, consumer_group)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The status that a trace's latest decisive event gives it.
DECISIVE = {
    "consume.acked": "completed", "consume.rejected": "failed", "dlq.routed": "failed", "consume.nacked": "retrying",
    "delay.scheduled": "delayed", "visibility.expired": "expired",
}


def assemble(spans: DataFrame, by: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """(by, started, ended, duration_us, spans, status); by message rather than trace id it is the life of a message."""
    status = F.lit(None).cast("string")
    for event, name in DECISIVE.items():
        status = F.when(F.col("event_type") == event, name).otherwise(status)
    last = F.max(F.when(status.isNotNull(), F.struct("ts_us", "seq", status.alias("status"))))
    got = spans.groupBy(*by).agg(F.min("ts_us").alias("started"), F.max("ts_us").alias("ended"), F.count(F.lit(1)).alias("spans"), last.alias("_l"))
    return got.select(*by, "started", "ended", (F.col("ended") - F.col("started")).alias("duration_us"), "spans", F.coalesce("_l.status", F.lit("in_progress")).alias("status"))


def search(spans: DataFrame, where: Column | None = None, status: str | None = None, start_us: int | None = None, end_us: int | None = None, limit: int = 100) -> DataFrame:
    """Traces with a span that matches (both ends of the time range count, if both are given), newest first."""
    keep = F.lit(True) if where is None else where
    if start_us is not None and end_us is not None:
        keep = keep & F.col("ts_us").between(start_us, end_us)
    ids = spans.where(keep).select("trace_id").distinct()
    found = assemble(spans.join(ids, "trace_id", "left_semi"))
    found = found if status is None else found.where(F.col("status") == status)
    return found.orderBy(F.desc("started"), "trace_id").limit(limit)


def timeline(spans: DataFrame) -> DataFrame:
    """Each trace's events in order, as text."""
    events = F.array_sort(F.collect_list(F.struct("ts_us", "seq", "event_type")))
    return spans.groupBy("trace_id").agg(F.concat_ws(">", F.transform(events, lambda e: e["event_type"])).alias("events"))


def newest(spans: DataFrame, n: int) -> DataFrame:
    """What a ring buffer of n spans holds."""
    return spans.orderBy(F.desc("ts_us"), F.desc("trace_id"), F.desc("seq")).limit(n)


def unexpired(spans: DataFrame, as_of_us: int, ttl_us: int = 3_600_000_000) -> DataFrame:
    """Spans of traces whose last span is not older than the time to live."""
    live = spans.groupBy("trace_id").agg(F.max("ts_us").alias("_t")).where(F.col("_t") >= as_of_us - ttl_us).select("trace_id")
    return spans.join(live, "trace_id", "left_semi")


def span_stats(spans: DataFrame) -> DataFrame:
    """Spans and traces; traces are made distinct by a group-by, so the count is spread."""
    return spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("spans"), F.count(F.lit(1)).alias("traces"))


def sampled(spans: DataFrame, rate: Column) -> DataFrame:
    """Traces whose id's hash byte is within the rate: whole traces, the same ones each time."""
    return spans.where(F.conv(F.substring(F.md5("trace_id"), 1, 2), 16, 10).cast("int") / 255.0 <= rate)

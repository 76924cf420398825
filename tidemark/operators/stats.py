"""Counts over the log and its side tables. Single passes with map-side combining; totals by rollup or grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reads import PART


def topic_stats(log: DataFrame, size: Column) -> DataFrame:
    """(topic, partitions, messages, bytes) by topic, and for all under a null topic. Partitions are few, so they are made
    first and counted then: no distinct over messages."""
    parts = log.groupBy(*PART).agg((F.max("offset") + 1 - F.min("offset")).alias("m"), F.sum(size).alias("b"))
    return parts.rollup("topic").agg(F.count(F.lit(1)).alias("partitions"), F.sum("m").alias("messages"), F.sum("b").alias("bytes"))


def priority_stats(log: DataFrame, consumed: DataFrame, size: Column) -> DataFrame:
    """total, bytes, pending, consumed and the oldest pending offset by topic, partition and priority, with roll-ups."""
    gone = consumed.select("topic", "partition", "offset", F.lit(1).alias("_gone"))
    rows = log.join(gone, ["topic", "partition", "offset"], "left")
    pending = F.col("_gone").isNull()
    base = rows.groupBy(*PART, "priority").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"), F.count_if(pending).alias("p"), F.min(F.when(pending, F.col("offset"))).alias("o"))
    return base.rollup(*PART, "priority").agg(F.sum("n").alias("total"), F.sum("b").alias("bytes"), F.sum("p").alias("pending"), (F.sum("n") - F.sum("p")).alias("consumed"), F.min("o").alias("oldest_pending"))


def lane_counts(log: DataFrame) -> DataFrame:
    """A column for each lane."""
    return log.groupBy(*PART).agg(*[F.count_if(F.col("priority") == p).alias(f"lane{p}") for p in range(5)])


def dirty_ratio(log: DataFrame) -> DataFrame:
    """(total - keys) / total for each partition; a null key counts as empty. Keys are made distinct by a group-by first, so no key set is held in one place."""
    keys = log.groupBy(*PART, F.coalesce("key", F.lit("")).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    return keys.groupBy(*PART).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("keys")).withColumn("dirty", (F.col("total") - F.col("keys")) / F.col("total"))


def should_compact(log: DataFrame, threshold: float = 0.5) -> DataFrame:
    return dirty_ratio(log).where(F.col("dirty") >= threshold)


def consumer_lag(log: DataFrame, committed: DataFrame, in_flight: DataFrame) -> DataFrame:
    """For each group and partition: committed, end (the last offset), total lag, in flight, and their sums by roll-up."""
    ends = log.groupBy(*PART).agg(F.max("offset").alias("log_end"))
    flights = in_flight.groupBy("group_id", *PART).agg(F.count(F.lit(1)).alias("in_flight"))
    met = committed.join(ends, PART).join(flights, ["group_id", *PART], "left")
    lag = F.greatest(F.col("log_end") - F.col("committed"), F.lit(0))
    return met.select("group_id", *PART, "committed", "log_end", F.coalesce("in_flight", F.lit(0)).alias("in_flight"), lag.alias("lag"))


def lag_totals(lag: DataFrame) -> DataFrame:
    return lag.rollup("group_id", "topic").agg(F.sum("lag").alias("lag"), F.count(F.lit(1)).alias("partitions"))


def counted(rows: DataFrame, *sets: tuple[str, ...]) -> DataFrame:
    """Row counts for each of several groupings in one pass."""
    cols = sorted({c for s in sets for c in s})
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.count(F.lit(1)).alias("n"))


def event_counts(acks: DataFrame, keys: list[str], kinds: tuple[str, ...], col: str = "event") -> DataFrame:
    """A column for each kind of event."""
    return acks.groupBy(*keys).agg(*[F.count_if(F.col(col) == k).alias(k) for k in kinds])


def delay_stats(delays: DataFrame) -> DataFrame:
    return delays.rollup("topic").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("pending", "delivered", "canceled")])


def tenant_usage(log: DataFrame, tenant: Column, size: Column, quotas: DataFrame) -> DataFrame:
    """Messages, bytes, topics of each tenant and the share of its quota in percent; 0 where the quota is 0, unlimited."""
    by_topic = log.withColumn("tenant", tenant).groupBy("tenant", "topic").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"))
    use = by_topic.groupBy("tenant").agg(F.sum("n").alias("messages"), F.sum("b").alias("bytes"), F.count(F.lit(1)).alias("topics"))
    percent = lambda used, quota: F.when(F.col(quota) > 0, F.round(F.col(used) * 100.0 / F.col(quota), 6)).otherwise(F.lit(0.0))
    return use.join(quotas, "tenant").select("tenant", "messages", "bytes", "topics", percent("messages", "max_messages").alias("messages_percent"), percent("bytes", "max_bytes").alias("bytes_percent"))


def schema_stats(schemas: DataFrame) -> DataFrame:
    return schemas.groupBy("subject").agg(F.count(F.lit(1)).alias("versions"), F.max("version").alias("latest"))


def backup_summary(log: DataFrame, committed: DataFrame, schemas: DataFrame) -> DataFrame:
    """What a metadata backup holds, as counts."""
    parts = log.groupBy(*PART).agg(F.count(F.lit(1)).alias("n"))
    a = parts.agg(F.count_distinct("topic").alias("topics"), F.count(F.lit(1)).alias("partitions"))
    b = committed.agg(F.count_distinct("group_id").alias("groups"), F.count(F.lit(1)).alias("offsets"))
    c = schemas.agg(F.count_distinct("subject").alias("subjects"), F.count(F.lit(1)).alias("schemas"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))


def backup_document(log: DataFrame) -> DataFrame:
    """One JSON document a topic: its partitions with their bounds, ready to restore."""
    parts = log.groupBy(*PART).agg(F.min("offset").alias("earliest"), (F.max("offset") + 1).alias("next"))
    return parts.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("partition", "earliest", "next"))).alias("partitions")).select("topic", F.to_json(F.struct("topic", "partitions")).alias("document"))

"""Acknowledgement, retries, dead letters, idempotent producers and transactions, over tables of what happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import backoff_ms, dlq_topic
from .folds import numbered
from .reads import ID, PART

DLQ_SCHEMA = "original_topic string, original_partition int, original_offset long, key string, value string, reason string, deliveries int"


def committed_prefix(acks: DataFrame, start: int = 0) -> DataFrame:
    """For each partition the last offset of the run of acknowledged ones that begins at ``start``; start - 1 if there is none.

    Acknowledged offsets are numbered; the run ends where number and offset part. Duplicates count once.
    """
    done = acks.where((F.col("event") == "ack") & (F.col("offset") >= start)).select(*PART, "offset").distinct()
    n = F.row_number().over(W.partitionBy(*PART).orderBy("offset")) - 1
    run = done.withColumn("_n", n).groupBy(*PART).agg(F.max(F.when(F.col("offset") - F.col("_n") == start, F.col("offset"))).alias("m"))
    seen = acks.select(*PART).distinct()
    return seen.join(run, PART, "left").select(*PART, F.coalesce("m", F.lit(start - 1)).alias("committed"))


def outcomes(acks: DataFrame, attempts: Column, retries: int = 3) -> DataFrame:
    """What becomes of each delivery: done, retry after a back-off, or dead letter with the reason."""
    last = attempts > retries
    fate = F.when(F.col("event") == "ack", "done").when(F.col("event") == "reject", "dlq").when(last, "dlq").otherwise("retry")
    reason = F.when(F.col("event") == "reject", "REJECTED").when((F.col("event") != "ack") & last, "MAX_RETRIES_EXCEEDED")
    return acks.select(*ID, "event", fate.alias("outcome"), reason.alias("reason"), F.when(fate == "retry", backoff_ms(attempts)).alias("backoff_ms"))


def dead_letters(log: DataFrame, fates: DataFrame, deliveries: Column) -> DataFrame:
    """Records for the dead-letter topics: same partition and key, the message and why in a JSON envelope."""
    rows = log.join(fates.where("outcome = 'dlq'").select(*ID, "reason"), ID)
    envelope = F.struct(F.col("topic").alias("original_topic"), F.col("partition").alias("original_partition"), F.col("offset").alias("original_offset"), "key", "value", "reason", deliveries.cast("int").alias("deliveries"))
    return rows.select(dlq_topic(F.col("topic")).alias("topic"), "partition", "key", F.to_json(envelope).alias("value"), "ts", F.col("offset").alias("source_offset"))


def parse_dead_letters(dlq: DataFrame) -> DataFrame:
    """The envelopes' fields; ``parsed`` is false where a value is no envelope."""
    e = F.from_json("value", DLQ_SCHEMA)
    return dlq.select(F.col("topic").alias("dlq_topic"), e.alias("e")).select("dlq_topic", "e.*", F.col("e.original_topic").isNotNull().alias("parsed"))


def reprocess(dlq: DataFrame, wanted: Column, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Messages to publish again, and counts of those processed, skipped and not parsed."""
    rows = parse_dead_letters(dlq).withColumn("_fate", F.when(~F.col("parsed"), "errors").when(wanted, "processed").otherwise("skipped"))
    out = rows.where("_fate = 'processed'").select((F.lit(target) if target else F.col("original_topic")).alias("topic"), F.col("original_partition").alias("partition"), "key", "value")
    return out, rows.agg(*[F.count_if(F.col("_fate") == f).alias(f) for f in ("processed", "skipped", "errors")])


def due(flights: DataFrame, as_of: Column, retries: int = 3) -> DataFrame:
    """In-flight messages past their deadline, oldest first, and whether they are redelivered or given up."""
    return flights.where(F.col("deadline") <= as_of).withColumn("action", F.when(F.col("deliveries") + 1 > retries, "dlq").otherwise("redeliver")).orderBy("deadline", *ID)


def accepted_sequences(sent: DataFrame) -> DataFrame:
    """How an idempotent producer's messages fare: ok, duplicate or gap, for each producer and partition in order of arrival.

    A message is accepted if its number is the one expected, which is one more than was accepted last. Rows stream through
    sorted batches; a key is one number of state.
    """

    def judge(batches):
        key, expected = None, 0
        for pdf in batches:
            verdicts = []
            for producer, partition, n in zip(pdf["producer_id"], pdf["partition"], pdf["sequence"]):
                if (producer, partition) != key:
                    key, expected = (producer, partition), 0
                verdicts.append("ok" if n == expected else "duplicate" if n < expected else "gap")
                expected += n == expected
            yield pdf.assign(verdict=verdicts)

    rows = sent.select("producer_id", "partition", "arrival", "sequence")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition("producer_id", "partition").sortWithinPartitions("producer_id", "partition", "arrival").mapInPandas(judge, f"{fields}, verdict string")


def gap_free_sequences(sent: DataFrame) -> DataFrame:
    """The same where no number was skipped: the first arrival of each number is ok, the others are duplicates."""
    first = F.min("arrival").over(W.partitionBy("producer_id", "partition", "sequence"))
    return sent.select("producer_id", "partition", "arrival", "sequence", F.when(F.col("arrival") == first, "ok").otherwise("duplicate").alias("verdict"))


def unfenced(sent: DataFrame) -> DataFrame:
    """Messages of each producer's latest epoch."""
    latest = sent.groupBy("producer_id").agg(F.max("epoch").alias("epoch"))
    return sent.join(latest, ["producer_id", "epoch"], "left_semi")


def transaction_states(events: DataFrame, as_of: Column, timeout_s: int = 60) -> DataFrame:
    """(txn_id, status) from begin, commit and abort events: the last marker, or abort for those open too long."""
    kinds = F.max(F.when(F.col("kind") != "begin", F.struct("ts", "kind")))
    got = events.groupBy("txn_id").agg(F.min("ts").alias("began"), kinds.alias("m"), F.count_if(F.col("kind") == "begin").alias("n"))
    open_ = F.when(F.col("began") < as_of - F.expr(f"interval {timeout_s} seconds"), "aborted").otherwise("open")
    return got.select("txn_id", F.when(F.col("m.kind") == "commit", "committed").when(F.col("m.kind") == "abort", "aborted").otherwise(open_).alias("status"))


def next_markers(records: DataFrame, markers: DataFrame) -> DataFrame:
    """Each transactional record with the first marker of its producer, epoch and partition behind it: a union and one window instead of a range join."""
    keys = ["producer_id", "epoch", "topic", "partition"]
    a = records.select(*keys, "offset", F.lit(None).cast("long").alias("marker"), F.lit(None).cast("string").alias("kind"))
    b = markers.select(*keys, "offset", F.col("offset").alias("marker"), "kind")
    w = W.partitionBy(*keys).orderBy("offset").rowsBetween(1, W.unboundedFollowing)
    ahead = F.first(F.when(F.col("marker").isNotNull(), F.struct("marker", "kind")), ignorenulls=True).over(w)
    return a.unionByName(b).withColumn("_m", ahead).where("marker is null").select(*keys, "offset", F.col("_m.marker").alias("marker_offset"), F.coalesce("_m.kind", F.lit("open")).alias("status"))


def producer_batches(log: DataFrame, size: Column, count: int, most_bytes: int, linger_s: float) -> DataFrame:
    """The batches of each partition. A batch is sent once it has ``count`` messages or ``most_bytes`` bytes of keys and values, or once its first message is ``linger_s`` seconds old; the next message begins another, and counts begin anew. Without linger each message is a batch."""

    def flush():
        n, total, made = 0, 0, 0.0

        def begins(size: int, at: float) -> bool:
            nonlocal n, total, made
            new = n >= count or total >= most_bytes or at - made >= linger_s
            if new or not n:
                n, total, made = 0, 0, at
            n, total = n + 1, total + size
            return new

        return begins

    rows = log.select(*PART, "offset", size.cast("long").alias("size"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).withColumn("at", F.col("at") / 1e6)
    rows = numbered(rows, flush, ["size", "at"], "batch")
    return rows.groupBy(*PART, "batch").agg(F.count(F.lit(1)).alias("messages"), F.sum("size").alias("bytes"), F.min("offset").alias("first_offset")).drop("batch")

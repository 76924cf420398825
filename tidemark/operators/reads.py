"""Reads of the log: by offset, by time, by priority, and the rules of which messages a reader may see.

``log`` has (topic, partition, offset, ts, priority, flags, ...). All reads are filters and small aggregates, so that
predicates reach the scan; a limit within partitions is a row number, which Spark turns into a group limit before
the shuffle. Clocks are arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import numbered

ID = ["topic", "partition", "offset"]
PART = ["topic", "partition"]
CONTROL, COMMIT = 8, 16
#: Priorities from the first served to the last.
PRIORITIES = ("critical", "high", "normal", "low", "background")


def first_per(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def point_read(log: DataFrame, topic: str, partition: int, offset: int) -> DataFrame:
    return log.where((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") == offset))


def range_scan(log: DataFrame, start: int, most: int = 0) -> DataFrame:
    """For each partition the messages from offset start on, at most so many; 0 is all."""
    rows = log.where(F.col("offset") >= start)
    return first_per(rows, PART, ["offset"], most) if most else rows


def not_control(log: DataFrame) -> DataFrame:
    return log.where(F.col("flags").bitwiseAND(CONTROL) == 0)


def control_kind(flags: Column) -> Column:
    return F.when(flags.bitwiseAND(CONTROL) == 0, "message").when(flags.bitwiseAND(COMMIT) != 0, "commit").otherwise("abort")


def hidden_by_delay(delays: DataFrame, as_of: Column) -> DataFrame:
    return delays.where((F.col("state") == "pending") & (F.col("deliver_at") > as_of)).select(*ID)


def hidden_by_transaction(transactions: DataFrame, statuses: tuple[str, ...] = ("open", "aborted")) -> DataFrame:
    return transactions.where(F.col("status").isin(*statuses)).select(*ID)


def visible(log: DataFrame, delays: DataFrame | None = None, transactions: DataFrame | None = None, as_of: Column | None = None, consumed: DataFrame | None = None) -> DataFrame:
    """Messages that a reader may see: no control records, none that are still delayed, none of open or aborted
    transactions, none consumed. One anti-join for all that hides; it needs no more than the ids, and Spark
    broadcasts those where they are few."""
    hidden = [hidden_by_delay(delays, as_of)] if delays is not None else []
    hidden += [hidden_by_transaction(transactions)] if transactions is not None else []
    hidden += [consumed.select(*ID)] if consumed is not None else []
    rows = not_control(log)
    if not hidden:
        return rows
    ids = hidden[0]
    for h in hidden[1:]:
        ids = ids.unionByName(h)
    return rows.join(ids, ID, "left_anti")


def priority_cursor(log: DataFrame, start: int = 0) -> DataFrame:
    """What one pass of the shared cursor serves: a message that no later, more urgent one makes it jump over.

    Needs no sort: a message is served if it lies behind the last message of each more urgent lane, and those are five
    numbers a partition, joined back.
    """
    rows = log.where(F.col("offset") >= start)
    last = rows.groupBy(*PART).agg(*[F.max(F.when(F.col("priority") == p, F.col("offset"))).alias(f"_last{p}") for p in range(len(PRIORITIES) - 1)])
    met = rows.join(last, PART)
    over = F.lit(True)
    for p in range(len(PRIORITIES) - 1):
        over = over & ((F.col("priority") <= p) | F.col(f"_last{p}").isNull() | (F.col("offset") > F.col(f"_last{p}")))
    return met.where(over).drop(*[f"_last{p}" for p in range(len(PRIORITIES) - 1)])


def priority_strict(log: DataFrame, most: int) -> DataFrame:
    """The first messages of each partition by priority, then offset."""
    return first_per(log, PART, ["priority", "offset"], most)


def round_robin(log: DataFrame, most: int = 0) -> DataFrame:
    """Fair queuing as one drain: a message of each waiting lane in turn, in order within a lane; ``turn`` numbers the service."""
    lane = F.row_number().over(W.partitionBy(*PART, "priority").orderBy("offset"))
    rows = log.withColumn("_lane", lane)
    rows = rows.where(F.col("_lane") <= most) if most else rows
    rows = rows.withColumn("turn", F.row_number().over(W.partitionBy(*PART).orderBy("_lane", "priority")).cast("long"))
    return (rows.where(F.col("turn") <= most) if most else rows).drop("_lane")


def next_in_lanes(log: DataFrame, start: int) -> DataFrame:
    """For each partition and lane the next offset from start on."""
    return log.where(F.col("offset") >= start).groupBy(*PART, "priority").agg(F.min("offset").alias("next_offset"))


def next_across(log: DataFrame, start: int) -> DataFrame:
    """For each partition the next offset from start on of the most urgent lane that has one."""
    return log.where(F.col("offset") >= start).groupBy(*PART).agg(F.min(F.struct("priority", "offset")).alias("_m")).select(*PART, "_m.priority", F.col("_m.offset").alias("next_offset"))


def time_range(log: DataFrame, start: Column, end: Column | None = None, most: int = 0) -> DataFrame:
    """start <= ts < end, then the limit for each partition."""
    rows = log.where(F.col("ts") >= start)
    rows = rows if end is None else rows.where(F.col("ts") < end)
    return first_per(rows, PART, ["offset"], most) if most else rows


def offset_by_time(log: DataFrame, when: Column) -> DataFrame:
    """For each partition the first offset with ts >= when; the next offset to come if there is none."""
    return log.groupBy(*PART).agg(F.coalesce(F.min(F.when(F.col("ts") >= when, F.col("offset"))), F.max("offset") + 1).alias("offset"))


def time_index_floor(log: DataFrame, when: Column) -> DataFrame:
    """For each partition the last offset with ts <= when; the first offset if there is none."""
    return log.groupBy(*PART).agg(F.coalesce(F.max(F.when(F.col("ts") <= when, F.struct("ts", "offset")))["offset"], F.min("offset")).alias("offset"))


def bounds(log: DataFrame) -> DataFrame:
    return log.groupBy(*PART).agg(F.min("offset").alias("earliest"), F.max("offset").alias("latest"), (F.max("offset") + 1).alias("next_offset"))


def start_positions(log: DataFrame, offset: int, when: Column) -> DataFrame:
    """Where a consumer begins, for each partition, by each kind of start."""
    return log.groupBy(*PART).agg(
        F.lit(0).cast("long").alias("earliest"), (F.max("offset") + 1).alias("latest"), F.lit(offset).cast("long").alias("at_offset"),
        F.coalesce(F.min(F.when(F.col("ts") >= when, F.col("offset"))), F.max("offset") + 1).alias("at_time"),
    )


def page(rows: DataFrame, order: list, skip: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(skip).limit(limit)


def partition_read(log: DataFrame, topic: str, partition: int, start: int, limit: int = 100, cap: int = 1000) -> DataFrame:
    """One partition's messages by the shared cursor, with the offset to go on from."""
    rows = log.where((F.col("topic") == topic) & (F.col("partition") == partition))
    rows = first_per(not_control(priority_cursor(rows, start)), PART, ["offset"], min(limit, cap))
    return rows.withColumn("next_offset", F.max("offset").over(W.partitionBy(*PART)) + 1)


def group_poll(log: DataFrame, assignment: DataFrame, committed: DataFrame, most: int) -> DataFrame:
    """For each group and partition that it is assigned, the next messages from its committed offset (0 if none)."""
    starts = assignment.join(committed, ["group_id", *PART], "left").withColumn("_from", F.coalesce("committed", F.lit(0)))
    rows = log.join(starts, PART).where("offset >= _from")
    return first_per(rows, ["group_id", *PART], ["offset"], most).drop("_from", "committed")


def append(log: DataFrame, batch: DataFrame, order: list) -> DataFrame:
    """batch with offsets that go on from each partition's end, in the order given."""
    ends = log.groupBy(*PART).agg((F.max("offset") + 1).alias("_base"))
    n = F.row_number().over(W.partitionBy(*PART).orderBy(*order)) - 1
    return batch.withColumn("_n", n).join(F.broadcast(ends), PART, "left").withColumn("offset", F.coalesce("_base", F.lit(0)) + F.col("_n")).drop("_n", "_base")


def replica_append(log: DataFrame, batch: DataFrame) -> DataFrame:
    """batch has offsets already; those that the log has are left out, so that a repeated fetch changes nothing."""
    return batch.join(log.select(*ID), ID, "left_anti")


def segments(log: DataFrame, size: Column, most: int) -> DataFrame:
    """The segment of each message and the offset it begins at: a message that would take its segment beyond ``most`` bytes begins another, whose bytes count from 0. A larger message has one of its own."""

    def rollover():
        position = 0

        def begins(n: int) -> bool:
            nonlocal position
            full = position + n > most
            position = n if full else position + n
            return full

        return begins

    return numbered(log.withColumn("_size", size.cast("long")), rollover, ["_size"], "segment", "base_offset").drop("_size")


def truncate_after(log: DataFrame, offset: int) -> DataFrame:
    return log.where(F.col("offset") <= offset)


def delete_before(segmented: DataFrame, offset: int) -> DataFrame:
    """segmented without whole segments that end before offset; the last segment of a partition stays."""
    w = W.partitionBy(*PART, "segment")
    ends = segmented.withColumn("_end", F.max("offset").over(w)).withColumn("_active", F.max("segment").over(W.partitionBy(*PART)))
    return ends.where((F.col("_end") >= offset) | (F.col("segment") == F.col("_active"))).drop("_end", "_active")


def write_buffer(log: DataFrame, size: Column, most_bytes: int, most_messages: int, linger_ms: int = 0) -> DataFrame:
    """The flush that each message goes out with: what would take the buffer beyond its bytes, or finds it full of messages, flushes it first; a timer flushes each ``linger_ms`` (0: no timer)."""
    tick = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (linger_ms * 1000)) if linger_ms else F.lit(0)

    def buffer():
        held = messages = 0
        last = None

        def begins(n: int, now: int) -> bool:
            nonlocal held, messages, last
            flush = held + n > most_bytes or messages >= most_messages or now != last
            held, messages, last = (n, 1, now) if flush else (held + n, messages + 1, now)
            return flush

        return begins

    return numbered(log.withColumns({"_size": size.cast("long"), "_tick": tick.cast("long")}), buffer, ["_size", "_tick"], "flush").drop("_size", "_tick")


def flow_window(batch: int) -> int:
    """Messages that are sent before a pause: five batches, 100 at least and 5,000 at most."""
    return min(max(5 * batch, 100), 5_000)


def flow_pauses(batches: DataFrame, count: Column, window: int) -> DataFrame:
    """batches (topic, partition, offset, ...) with ``pauses``, how many pauses came before each: one after each batch that exhausts the window. Empty batches count for nothing."""

    def controller():
        sent = 0

        def begins(n: int) -> bool:
            nonlocal sent
            paused = sent >= window
            sent = (0 if paused else sent) + max(n, 0)
            return paused

        return begins

    return numbered(batches.withColumn("_count", F.coalesce(count, F.lit(0)).cast("long")), controller, ["_count"], "pauses").drop("_count")


def next_n_in_lane(log: DataFrame, priority: int, start: int, n: int) -> DataFrame:
    return first_per(log.where((F.col("priority") == priority) & (F.col("offset") >= start)), PART, ["offset"], n)


def peek_lanes(log: DataFrame) -> DataFrame:
    """The head of each lane, which stays there."""
    return log.groupBy(*PART, "priority").agg(F.min("offset").alias("head"))


def time_index_range(log: DataFrame, start: Column, end: Column) -> DataFrame:
    """Offsets to read a span of time between: that of the last message at or before its start (else the first), and of the first at or after its end (-1: read to the end)."""
    first = F.coalesce(F.max(F.when(F.col("ts") <= start, F.col("offset"))), F.min("offset"))
    return log.groupBy(*PART).agg(first.alias("start_offset"), F.coalesce(F.min(F.when(F.col("ts") >= end, F.col("offset"))), F.lit(-1)).alias("end_offset"))

"""Streaming forms of the stateful operators. Sources give ``ts`` as a timestamp with zone; each takes its watermark as an argument."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.storage import shared_path


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there now and gives its result as a table in the shared folder.

    Each epoch writes its own part, so that an epoch tried twice is there once; in complete mode the last epoch's is the result.
    """
    spark = stream.sparkSession
    path, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    last = []

    def write(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        last[:] = [epoch]

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    at = f"{path}/epoch={last[0]}" if mode == "complete" else path
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(at)


def rates(stream: DataFrame, keys: list[str], window: str, slide: str, late: str) -> DataFrame:
    got = stream.withWatermark("ts", late).groupBy(*keys, F.window("ts", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return got.select(*keys, F.unix_seconds("w.start").alias("window_s"), "n")


def sessions(stream: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """Membership as sessions of heartbeats: a member is gone when it is silent for the gap."""
    got = stream.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("heartbeats"))
    return got.select(key, F.unix_seconds("w.start").alias("joined_s"), F.unix_seconds("w.end").alias("expires_s"), "heartbeats")


def accepted_sequences(stream: DataFrame) -> DataFrame:
    """The verdict on each message (producer_id, partition, arrival, sequence) of idempotent producers; the state is one number a key."""

    def check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("arrival")
        verdicts = []
        for n in rows["sequence"]:
            verdicts.append("ok" if n == expected else "duplicate" if n < expected else "gap")
            expected += n == expected
        state.update((int(expected),))
        yield pd.DataFrame({"producer_id": key[0], "partition": key[1], "arrival": rows["arrival"], "sequence": rows["sequence"], "verdict": verdicts})

    out = "producer_id long, partition int, arrival long, sequence long, verdict string"
    return stream.groupBy("producer_id", "partition").applyInPandasWithState(check, out, "expected long", "append", GroupStateTimeout.NoTimeout)


def delayed(stream: DataFrame, late: str) -> DataFrame:
    """Messages (topic, partition, offset, ts, deliver_at) when their time has come: at once, or when the watermark passes it; those without a time never.

    Held back by topic, partition and quarter day of delivery, so that state is spread and a call handles many messages. A key's timer is
    its earliest second of delivery; what is due later stays.
    """
    rows = stream.withWatermark("ts", late).withColumn("due_s", F.ceil(F.unix_micros("deliver_at") / 1e6).cast("long"))
    rows = rows.select("topic", "partition", F.floor(F.col("due_s") / 21_600).alias("block"), "offset", "due_s", "ts")

    def hold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if pd.isna(key[2]):  # not a filter, which would go below the watermark and hold it back
            return
        held, new = state.get if state.exists else ((), ()), [] if state.hasTimedOut else list(batches)
        offset, due = (np.concatenate([np.array(h, "int64"), *(pdf[c].astype("int64") for pdf in new)]) for h, c in zip(held, ("offset", "due_s")))
        ready = due * 1000 < state.getCurrentWatermarkMs()
        if not ready.all():
            state.update((offset[~ready].tolist(), due[~ready].tolist()))
            state.setTimeoutTimestamp(max(int(due[~ready].min()) * 1000, 1))
        elif state.exists:
            state.remove()
        if ready.any():
            yield pd.DataFrame({"topic": key[0], "partition": key[1], "offset": offset[ready], "due_s": due[ready]})

    return rows.groupBy("topic", "partition", "block").applyInPandasWithState(hold, "topic string, partition int, offset long, due_s long", "offsets array<long>, due array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def deliveries(events: DataFrame, late: str, visible_ms: int = 30_000, retries: int = 3) -> DataFrame:
    """What becomes of each message of (group_id, topic, partition, offset, event, ts), event one of deliver, ack, nack, reject, extend.

    ack: done. reject: dead letter. nack: retried, or a dead letter beyond the retries. A delivery that nothing follows
    before its deadline expires when the watermark passes it, and is redelivered or given up. State is four numbers a message in flight,
    kept in blocks of offsets, so that a call handles many messages; a key's timer is the earliest of its messages' own.
    """
    rows = events.withWatermark("ts", late).withColumns({"ts_ms": F.unix_millis("ts"), "block": F.floor(F.col("offset") / 65_536)})
    rows = rows.select("group_id", "topic", "partition", "block", "offset", "event", "ts_ms", "ts")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, flight, todo, ended = state.getCurrentWatermarkMs(), {}, defaultdict(list), []
        if state.exists:
            flight = {o: rest for o, *rest in zip(*state.get)}
        for pdf in () if state.hasTimedOut else batches:
            offsets = [None] * len(pdf) if pd.isna(key[3]) else pdf["offset"].astype("int64").tolist()
            for o, t, e in zip(offsets, pdf["ts_ms"].astype("int64").tolist(), pdf["event"].tolist()):
                todo[o].append((t, e))
        for o in [o for o, (_, _, timer) in flight.items() if timer < now and o not in todo]:
            ended.append((o, "expired:dlq" if flight.pop(o)[0] > retries else "expired:redeliver"))
        for o, happened in todo.items():
            open_ = o in flight
            count, deadline, _ = flight.pop(o, (0, 0, 0))
            for t, e in sorted(happened):
                if e == "deliver":
                    count, deadline, open_ = count + 1, t + visible_ms, True
                elif not open_:
                    ended.append((o, "unknown"))
                elif e == "extend":
                    deadline = t + visible_ms if t < deadline else deadline
                elif e == "ack":
                    ended.append((o, "done"))
                    open_ = False
                else:
                    ended.append((o, "dlq" if e == "reject" or count > retries else "retry"))
                    open_ = False
            if open_:
                flight[o] = (count, deadline, max(deadline, now + 1))
        if flight:
            state.update(tuple(map(list, zip(*((o, *rest) for o, rest in flight.items())))))
            state.setTimeoutTimestamp(min(timer for _, _, timer in flight.values()))
        elif state.exists:
            state.remove()
        if ended:
            offsets, outcomes = zip(*ended)
            yield pd.DataFrame({"group_id": key[0], "topic": key[1], "partition": key[2], "offset": pd.array(offsets, "Int64"), "outcome": outcomes})

    schema = "group_id string, topic string, partition int, offset long, outcome string"
    held = "offsets array<long>, deliveries array<int>, deadlines array<long>, timers array<long>"
    return rows.groupBy("group_id", "topic", "partition", "block").applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.EventTimeTimeout)


def subscribe(stream: DataFrame, assignment: DataFrame, committed: DataFrame) -> DataFrame:
    """What a group's members get of a stream of the log: (group_id, member_id) and each message at or beyond the group's commit in the partitions assigned (from 0 without a commit).

    Both tables are read anew in each micro-batch, so that a rebalance or a reset holds from the next one on.
    """
    keys = ["group_id", "topic", "partition"]
    starts = assignment.select(*keys, "member_id").join(committed.select(*keys, "committed"), keys, "left")
    return stream.join(starts, ["topic", "partition"]).where(F.col("offset") >= F.coalesce("committed", F.lit(0))).drop("committed")


def positions(delivered: DataFrame) -> DataFrame:
    """The offsets to commit after what was delivered."""
    return delivered.groupBy("group_id", "topic", "partition").agg((F.max("offset") + 1).alias("offset"))

"""Held messages of the stateful streams: few keys for many messages, each given out in the micro-batch in which its time has passed."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F
from tidemark.streaming import operators as streams


def at(clock):
    """A time of the day on which all happens."""
    return dt.datetime.fromisoformat(f"2024-01-01T{clock}")


def replayed(spark, folder, batches, schema, operator):
    """What the operator gives in each micro-batch, where each batch of rows is one; and the most keys that it held."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        for name in os.listdir(f"{folder}/in"):
            if name.startswith("part-"):
                os.rename(f"{folder}/in/{name}", f"{folder}/in/batch-{i}.parquet")
                os.utime(f"{folder}/in/batch-{i}.parquet", (1_700_000_000 + i * 60,) * 2)
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "batch-*").parquet(f"{folder}/in")
    got = {}
    out = operator(stream.withColumn("ts", F.col("ts").cast("timestamp"))).writeStream.outputMode("append").trigger(availableNow=True)
    query = out.option("checkpointLocation", f"{folder}/state").foreachBatch(lambda df, epoch: got.update({epoch: df.collect()})).start()
    query.awaitTermination()
    return [got[k] for k in sorted(got)], max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)


def test_delayed_holds_blocks_and_gives_each_second_in_time(spark, tmp_path):
    schema = "topic string, partition int, offset long, ts timestamp, deliver_at timestamp"
    first = [("t", 0, i, at("10:00:00"), at("10:00:00") + dt.timedelta(seconds=i)) for i in range(1, 201)]
    batches = [first, [("t", 0, 300, at("11:03:20"), None)], [("t", 0, 301, at("11:03:21"), at("23:00:00"))]]
    got, keys = replayed(spark, tmp_path, batches, schema, lambda s: streams.delayed(s, "1 hour"))
    assert [sorted(r["offset"] for r in rows) for rows in got] == [[], [], list(range(1, 200)), [200]]
    assert all(r["due_s"] == at("10:00:00").replace(tzinfo=dt.timezone.utc).timestamp() + r["offset"] for rows in got for r in rows)
    assert keys == 2


def fates(batches, visible, retries):
    """Each message by itself: what ends in each micro-batch, the last of which has no rows. The lateness is an hour."""
    flight, now, before, found = {}, 0, 0, []
    for rows in [*batches, []]:
        ended, todo = [], {}
        for o, event, ts in rows:
            if ts > before:
                todo.setdefault(o, []).append((ts, event))
        for o in [o for o in flight if o not in todo and flight[o][2] < now]:
            ended.append((o, "expired:dlq" if flight.pop(o)[0] > retries else "expired:redeliver"))
        for o, happened in todo.items():
            count, deadline, _ = flight.get(o, (0, 0, 0))
            for ts, event in sorted(happened):
                if event == "deliver":
                    count, deadline = count + 1, ts + visible
                    flight[o] = (count, deadline, 0)
                elif o not in flight:
                    ended.append((o, "unknown"))
                elif event == "extend":
                    deadline = ts + visible if ts < deadline else deadline
                else:
                    ended.append((o, "done" if event == "ack" else "dlq" if event == "reject" or count > retries else "retry"))
                    del flight[o]
            if o in flight:
                flight[o] = (count, deadline, max(deadline, now + 1))
        found.append(sorted(ended, key=str))
        before, now = now, max([now, *(ts - 3_600_000 for _, _, ts in rows)])
    return found


def test_deliveries_hold_blocks_and_end_each_message_in_time(spark, tmp_path):
    rng, start, minute = random.Random(3), 1_704_103_200_000, 60_000
    kinds = ["deliver"] * 5 + ["ack", "nack", "reject", "extend", "extend"]
    batches = [[(rng.choice([None, *range(80)]), rng.choice(kinds), start + i * 25 * minute - rng.randrange(90 * minute)) for _ in range(60)] for i in range(6)]
    want = fates(batches, 30 * minute, 1)
    assert {x for ended in want for _, x in ended} == {"done", "dlq", "retry", "unknown", "expired:dlq", "expired:redeliver"}
    rows = [[("g", "t", 0, o, e, dt.datetime.fromtimestamp(ts / 1000)) for o, e, ts in b] for b in batches]
    got, keys = replayed(spark, tmp_path, rows, "group_id string, topic string, partition int, offset long, event string, ts timestamp", lambda s: streams.deliveries(s, "1 hour", 30 * minute, 1))
    assert [sorted(((r["offset"], r["outcome"]) for r in ended), key=str) for ended in got] == want
    assert keys <= 2

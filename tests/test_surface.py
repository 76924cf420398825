"""Worked examples of recovery, rebalancing, flow control, the stored log and its client."""

import random

import pytest
from pyspark.sql import functions as F
from tidemark.hooks import Hooks
from tidemark.operators import reads, rebalance, recovery
from tidemark.plans import surface
from tidemark.session import Log
from tidemark.sources import logstore
from tidemark.streaming import operators as streams

SF = "/root/testdata/sf0.001"
ROW = "topic string, partition int, ts timestamp_ntz, key string, value string, priority int, flags int, n int"


def wheel(delay):
    """A timer wheel turned until the timer is on its finest level: the (level, time) of each cascade."""
    spans, moves, now = ((3, 10_485_760), (2, 163_840), (1, 2_560)), [], 0
    while True:
        level = next(((n, s) for n, s in spans if delay - now >= s), None)
        if level is None:
            return moves
        now += (delay - now) // level[1] * level[1]
        moves.append((level[0], now))


def test_wheel_moves(spark):
    rng = random.Random(5)
    delays = [0, 9, 10, 2_559, 2_560, 163_839, 163_840, 163_841, 10_485_760, 10_485_761, 10_488_320, 671_088_639] + [rng.randrange(671_088_640) for _ in range(200)]
    rows = spark.createDataFrame([(d,) for d in delays], "d long").select("d", recovery.wheel_moves(F.col("d")).alias("m")).collect()
    assert {r["d"]: [tuple(m) for m in r["m"]] for r in rows} == {d: wheel(d) for d in delays}


def test_retry_pipeline_is_a_running_maximum(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(10_000)) for i in range(500)]
    got = {r["i"]: r["done"] for r in recovery.retry_pipeline(spark.createDataFrame(rows, "i long, ready long"), "i", "ready", 37).collect()}
    most = 0
    for i, ready in rows:
        most = max(most, ready)
        assert got[i] == most


@pytest.mark.parametrize("batch, window", [(0, 100), (20, 100), (21, 105), (999, 4_995), (1_001, 5_000)])
def test_flow_window(batch, window):
    assert reads.flow_window(batch) == window


def test_replica_lists(spark):
    rows = spark.createDataFrame([([1, 2, 3], [3, 4, 4, 1]), ([], [1]), ([2, 2, 1], [])], "old array<int>, new array<int>")
    got = [tuple(map(list, (r["joint"], r["adding"], r["removing"]))) for r in rebalance.reassignment(rows).collect()]
    assert got == [([1, 2, 3, 4], [4, 4], [2]), ([1], [1], []), ([2, 1], [], [2, 2, 1])]


def test_rebalance_without_losers_assigns_at_once(spark):
    diff = spark.createDataFrame([("g", "t", 0, None, "b", "assigned"), ("g", "t", 1, "a", "a", "unchanged"), ("h", "t", 0, "a", None, "revoked")], "group_id string, topic string, partition int, from_member string, to_member string, change string")
    acks = spark.createDataFrame([], "group_id string, member_id string, at_ms long")
    got = {r["group_id"]: (r["revoked_ms"], r["forced"], r["assigned_ms"]) for r in rebalance.cooperative(diff, acks, 5, 10).collect()}
    assert got == {"g": (None, False, 5), "h": (15, True, None)}


def test_metrics_lines_escape_labels(spark):
    rows = spark.createDataFrame([('a"b\\c\nd', 1), (None, 2)], "t string, n long")
    got = [r["line"] for r in recovery.metrics_lines(rows, "m", "gauge", "About.", ["t"], "n").collect()]
    assert got == ["# HELP m About.", "# TYPE m gauge", 'm{t="a\\"b\\\\c\\nd"} 1', 'm{t=""} 2']


def test_stored_log_is_pruned(spark):
    rows = logstore.read_log(spark, surface.stored(spark, SF)).where("topic = 'click' AND partition = 1 AND offset = 3")
    plan = rows._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(topic" in plan and "EqualTo(offset,3)" in plan
    scan = next(x for x in plan.split("\n") if "FileScan" in x)
    assert "(topic#" in scan and "= click)" in scan and "(partition#" in scan


def test_client_commits_resets_and_empty_log(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log")
    assert log.rows().count() == log.topics().count() == log.committed().count() == 0
    batch = spark.createDataFrame([("t", 0, None, str(i), "v", 2, 0, i) for i in range(5)], ROW)
    log.publish(batch, ["n"])
    log.publish(batch.where("n < 2"), ["n"])
    assert [(r["offset"], r["key"]) for r in log.rows().orderBy("offset").collect()] == [(0, "0"), (1, "1"), (2, "2"), (3, "3"), (4, "4"), (5, "0"), (6, "1")]
    where = spark.createDataFrame([("t", 0, 3), ("t", 1, -1)], "topic string, partition int, offset long")
    log.commit("g", where)
    mine = where.select(F.lit("g").alias("group_id"), "topic", "partition")
    poll = lambda: [r["offset"] for r in log.poll("g", mine, 2).orderBy("offset").collect()]
    assert poll() == [3, 4]
    log.reset("g", "t", "latest")
    assert poll() == []
    log.reset("g", "t", 6)
    assert poll() == [6]
    log.reset("g", "t", "earliest")
    assert poll() == [0, 1]
    assert [tuple(r) for r in log.describe(spark.createDataFrame([("g", "m")], "group_id string, member_id string")).collect()] == [("g", 1, 1, 7)]
    assert [r["offset"] for r in log.consume("t", [0], 2, 3).orderBy("offset").collect()] == [2, 3, 4]


def test_a_null_verdict_refuses(spark):
    batch = spark.createDataFrame([("t", 0, None, k, "v", 2, 0, 0) for k in ("a", None)], ROW)
    assert Hooks(validator=lambda b: F.col("key") == "a").admit(batch).count() == 1


def test_stream_gives_what_a_later_batch_adds(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log")
    batch = spark.createDataFrame([("t", 0, None, str(i), "v", 2, 0, i) for i in range(3)], ROW)
    log.publish(batch, ["n"])
    mine = spark.createDataFrame([("g", "t", 0, "m")], "group_id string, topic string, partition int, member_id string")
    log.commit("g", spark.createDataFrame([("t", 0, 1)], "topic string, partition int, offset long"))
    for want in ([1, 2], [3, 4, 5]):
        got = streams.run_available(streams.subscribe(logstore.stream_log(spark, f"{tmp_path}/log/log"), mine, log.committed()).select("group_id", "topic", "partition", "offset"), "s")
        assert sorted(r["offset"] for r in got.collect()) == want
        log.commit("g", streams.positions(got))
        log.publish(batch, ["n"])

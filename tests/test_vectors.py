"""Rules against worked examples."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import groups, reads, registry, reliability, tenancy
from tidemark.plans.queries import PAIRS
from tidemark.sources import logstore

LOG = "topic string, partition int, offset long, priority int, n long, ts timestamp_ntz"


def log(spark, rows):
    """rows of (offset, priority, size, seconds)."""
    made = [("t", 0, o, p, n, s) for o, p, n, s in rows]
    return spark.createDataFrame(made, "topic string, partition int, offset long, priority int, n long, s long").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))


@pytest.mark.parametrize(("sizes", "want"), [([60, 60, 60], [0, 1, 2]), ([50, 50, 1], [0, 0, 1]), ([200, 10, 95], [0, 1, 2]), ([100, 1], [0, 1]), ([], [])])
def test_segments_begin_anew(spark, sizes, want):
    got = reads.segments(log(spark, [(i, 0, n, 0) for i, n in enumerate(sizes)]), F.col("n"), 100).orderBy("offset").collect()
    assert [r.segment for r in got] == want
    assert [r.base_offset for r in got] == [want.index(s) for s in want]


def test_batches_begin_anew(spark):
    rows = [(0, 0, 10, 0), (1, 0, 10, 1), (2, 0, 10, 2), (3, 0, 100, 3), (4, 0, 10, 4), (5, 0, 10, 13), (6, 0, 10, 14), (7, 0, 10, 15)]
    got = reliability.producer_batches(log(spark, rows), F.col("n"), 3, 100, 10).orderBy("first_offset").collect()
    assert [(r.first_offset, r.messages, r.bytes) for r in got] == [(0, 3, 30), (3, 1, 100), (4, 2, 20), (6, 2, 20)]  # by count, by bytes, by age
    each = reliability.producer_batches(log(spark, rows), F.col("n"), 3, 100, 0)
    assert each.count() == len(rows)


def test_lanes_take_turns_whatever_their_weights(spark):
    rows = [(0, 0, 1, 0), (1, 0, 1, 0), (2, 0, 1, 0), (3, 3, 1, 0), (4, 3, 1, 0)]
    got = tenancy.drain(log(spark, rows)).orderBy("turn").collect()
    assert [r.priority for r in got] == [0, 3, 0, 3, 0]
    with pytest.raises(ValueError):
        tenancy.drain(log(spark, rows), weights=(1, 0))


def test_starving_lanes_are_first(spark):
    rows = [(0, 0, 1, 100), (1, 0, 1, 100), (2, 3, 1, 100), (3, 4, 1, 40), (4, 4, 1, 100)]
    now = F.timestamp_seconds(F.lit(110)).cast("timestamp_ntz")
    got = tenancy.starving_drain(log(spark, rows), now, starving_ms=60_000, step_ms=1).orderBy("turn").collect()
    assert [r.offset for r in got] == [3, 0, 2, 4, 1]


def assignment(spark, members, n, current):
    people = spark.createDataFrame([("g", m) for m in members], "group_id string, member_id string")
    topics = spark.createDataFrame([("t", n)], "topic string, n int")
    held = spark.createDataFrame([("g", "t", p, m) for m, ps in current.items() for p in ps], "group_id string, topic string, partition int, member_id string")
    got = {m: [] for m in members}
    for r in groups.sticky_assign(people, topics, held).collect():
        got[r.member_id].append(r.partition)
    return {m: sorted(ps) for m, ps in got.items()}


def test_sticky_moves_only_beyond_the_allowed(spark):
    assert assignment(spark, ["a", "b", "c"], 6, {"a": [0, 1, 2], "b": [3, 4, 5]}) == {"a": [0, 1, 2], "b": [3, 4, 5], "c": []}
    assert assignment(spark, ["a", "b"], 5, {"a": [0, 1, 2, 3, 4]}) == {"a": [0, 1, 2, 3], "b": [4]}  # ceil(5 / 2) + 1 stay
    assert assignment(spark, ["a", "b"], 4, {"a": [0, 1], "gone": [2, 3]}) == {"a": [0, 1], "b": [2, 3]}


@pytest.mark.parametrize("pair", PAIRS)
def test_compatibility_on_the_driver(pair):
    import json

    old, new, backward, forward = pair
    for mode, want in (("NONE", True), ("BACKWARD", backward), ("FORWARD", forward), ("FULL", backward and forward)):
        assert registry.compatible_documents(json.loads(old), json.loads(new), mode) == want


def test_records():
    plain = logstore.encode_record(5, 7, b"k", b"value", 2, 0, {})
    assert len(plain) == 34 + 1 + 5 and plain[:4] == b"\x47\x51\x01\x00" and plain[34:] == b"kvalue"
    rich = logstore.encode_record(6, 8, None, b"", 0, 8, {"b": "2", "a": "\u00e9"})
    assert rich[34:] == b"\x00\x02\x00\x01a\x00\x02\xc3\xa9\x00\x01b\x00\x012"
    got = list(logstore.decode_stream(plain + rich + plain[:-1]))
    assert [(r["offset"], r["key"], r["value"], r["headers"], r["flags"]) for r in got] == [(5, b"k", b"value", {}, 0), (6, None, b"", {"a": "\u00e9", "b": "2"}, 10)]
    for at in range(len(plain)):
        bad = bytearray(plain)
        bad[at] ^= 1
        if at == 3:
            continue  # the flags are before what the CRC covers
        with pytest.raises(ValueError):
            logstore.decode_record(bytes(bad))
    assert logstore.crc32c(b"123456789") == 0xE3069283


def test_murmur3(spark):
    from tidemark.functions.scalars import murmur3_32

    want = {"": 0, "a": 1009084850, "ab": 2613040991, "abc": 3017643002, "hello": 613153351, "hello world": 1586663183}
    rows = spark.createDataFrame([(k,) for k in want], "k string").select("k", murmur3_32(F.col("k").cast("binary")).alias("h")).collect()
    assert {r["k"]: r["h"] for r in rows} == want

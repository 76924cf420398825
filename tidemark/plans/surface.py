"""More registered queries: recovery, rebalancing, the stored log and its client, quotas, and streams of deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..hooks import Hooks
from ..operators import groups as G
from ..operators import reads as R
from ..operators import rebalance as B
from ..operators import recovery as V
from ..operators import reliability as L
from ..operators import stats as A
from ..operators import tenancy as Q
from ..session import Log
from ..sources import logstore as Z
from ..streaming import operators as O
from . import fixtures as D
from .queries import BYTES, COMMITS, FATES, MID, ORACLES, PID, QUERIES, RR, commits, fates, on_log, plain, query, size
from .storage import shared_path

ID = D.ID
__all__ = ["ORACLES", "QUERIES"]

# Reads


@on_log(f"SELECT {PID}, start_offset, end_offset FROM (SELECT {PID}, coalesce(max(\"offset\") FILTER (ts <= TIMESTAMP '2024-01-10 00:00:00'), min(\"offset\")) AS start_offset, coalesce(min(\"offset\") FILTER (ts >= TIMESTAMP '2024-01-29 20:00:00'), -1) AS end_offset FROM logs GROUP BY 1, 2)")
def time_index_range(log):
    return R.time_index_range(log, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-29 20:00:00").cast("timestamp_ntz"))


@on_log(f"SELECT {MID} FROM (SELECT *, row_number() OVER (PARTITION BY {PID} ORDER BY \"offset\") AS k FROM logs WHERE priority = 3 AND \"offset\" >= 20) WHERE k <= 7")
def next_n_in_lane(log):
    return R.next_n_in_lane(log, 3, 20, 7).select(*ID)


@on_log(f"SELECT {PID}, priority, min(\"offset\") AS head FROM logs GROUP BY 1, 2, 3")
def peek_lanes(log):
    return R.peek_lanes(log)


@on_log(f"SELECT {PID}, " + ", ".join(f"count(*) FILTER (priority = {p}) AS lane{p}" for p in range(5)) + " FROM logs l ANTI JOIN consumed USING (topic, \"partition\", \"offset\") GROUP BY 1, 2")
def lane_counts_unconsumed(log):
    return A.lane_counts(log.join(D.consumed(log), ID, "left_anti"))


@on_log(f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY {PID} ORDER BY "offset") AS rn, {BYTES} AS b, epoch_us(ts) // 43200000000 AS tick FROM logs),
 f AS (SELECT {PID}, rn, 1 AS n, b AS held, tick, CAST(0 AS BIGINT) AS flush FROM r WHERE rn = 1 UNION ALL
  SELECT topic, "partition", rn, CASE WHEN again THEN 1 ELSE n + 1 END, CASE WHEN again THEN b ELSE held + b END, now, CASE WHEN again THEN flush + 1 ELSE flush END
  FROM (SELECT r.topic, r."partition", r.rn, r.b, r.tick AS now, f.n, f.held, f.flush, f.held + r.b > 400 OR f.n >= 9 OR r.tick <> f.tick AS again FROM f JOIN r ON r.topic = f.topic AND r."partition" = f."partition" AND r.rn = f.rn + 1))
 SELECT r.topic, r."partition", r."offset", f.flush FROM f JOIN r ON r.topic = f.topic AND r."partition" = f."partition" AND r.rn = f.rn""")
def write_buffer(log):
    return R.write_buffer(log, size(), 400, 9, 43_200_000).select(*ID, "flush")


@on_log(f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY {PID} ORDER BY "offset") AS rn, event_id % 40 AS c FROM logs),
 f AS (SELECT {PID}, rn, c AS sent, CAST(0 AS BIGINT) AS pauses FROM r WHERE rn = 1 UNION ALL
  SELECT r.topic, r."partition", r.rn, CASE WHEN f.sent >= 195 THEN r.c ELSE f.sent + r.c END, CASE WHEN f.sent >= 195 THEN f.pauses + 1 ELSE f.pauses END FROM f JOIN r ON r.topic = f.topic AND r."partition" = f."partition" AND r.rn = f.rn + 1)
 SELECT r.topic, r."partition", r."offset", f.pauses FROM f JOIN r ON r.topic = f.topic AND r."partition" = f."partition" AND r.rn = f.rn""")
def flow_pauses(log):
    return R.flow_pauses(log, F.col("event_id") % 40, R.flow_window(39)).select(*ID, "pauses")


# Recovery


@on_log("SELECT topic, \"partition\", \"offset\", CASE WHEN deliver_at < $as_of THEN 'deliver' ELSE 'schedule' END AS action FROM delays WHERE state = 'pending'")
def delay_recovery(log):
    return V.recover_delays(D.delays(log), D.as_of()).select(*ID, "action")


@on_log("""SELECT event_id, concat_ws(',', CASE WHEN d >= 10485760 THEN '3@' || d // 10485760 * 10485760 END, CASE WHEN d % 10485760 >= 163840 THEN '2@' || d // 163840 * 163840 END,
 CASE WHEN d % 163840 >= 2560 THEN '1@' || d // 2560 * 2560 END) AS moves FROM (SELECT event_id, event_id * event_id AS d FROM logs)""")
def timer_cascade(log):
    moves = V.wheel_moves(F.col("event_id") * F.col("event_id"))
    return log.select("event_id", F.concat_ws(",", F.transform(moves, lambda m: F.concat_ws("@", m["level"].cast("string"), m["at_ms"].cast("string")))).alias("moves"))


@on_log("SELECT event_id, max(ready_ms) OVER (ORDER BY event_id) AS done_ms FROM (SELECT event_id, epoch_us(ts) // 1000 + CAST(least(60000.0, 1000.0 * pow(2.0, greatest(event_id % 10, 1) - 1)) AS BIGINT) AS ready_ms FROM logs WHERE event_id % 17 = 0)")
def retry_pipeline(log):
    ready = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000) + S.backoff_ms(F.col("event_id") % 10)
    return V.retry_pipeline(log.where("event_id % 17 = 0").select("event_id", ready.cast("long").alias("ready")), "event_id", "ready", 500).select("event_id", F.col("done").alias("done_ms"))


def wal(log) -> DataFrame:
    """Lines of a transaction log: one a message, and one or two at a transaction's end; some lines are cut short."""
    t = D.transactions(log).join(log.select(*ID, "event_id"), ID)
    line = lambda seq, kind: F.to_json(F.struct(seq.alias("seq"), kind.alias("type"), F.col("txn_id")))
    body = t.select(F.when(F.col("event_id") % 31 == 0, '{"seq": 1, "ty').otherwise(line(F.col("event_id") * 4, F.lit("txn_publish"))).alias("line"))
    ends = t.groupBy("txn_id").agg(F.max("event_id").alias("e"))
    kinds = F.when(F.col("txn_id") % 5 == 0, F.array(F.lit("prepare_abort"), F.lit("complete_abort"))).when(F.col("txn_id") % 5 == 2, F.array(F.lit("prepare_commit"))).when(F.col("txn_id") % 5 > 2, F.array(F.lit("prepare_commit"), F.lit("complete_commit")))
    tail = ends.select("txn_id", "e", F.posexplode(kinds).alias("i", "kind")).select(line(F.col("e") * 4 + 1 + F.col("i"), F.col("kind")).alias("line"))
    return body.unionByName(tail)


@on_log("""SELECT txn_id, CASE WHEN txn_id % 5 = 1 THEN max(event_id) FILTER (event_id % 31 <> 0) * 4 WHEN txn_id % 5 = 2 THEN max(event_id) * 4 + 1 ELSE max(event_id) * 4 + 2 END AS seq,
 CASE txn_id % 5 WHEN 0 THEN 'aborted' WHEN 1 THEN 'open' WHEN 2 THEN 'prepare_commit' ELSE 'committed' END AS state
 FROM (SELECT event_id, event_id // 8 AS txn_id FROM logs WHERE topic = 'purchase') GROUP BY txn_id HAVING txn_id % 5 <> 1 OR count(*) FILTER (event_id % 31 <> 0) > 0""")
def transaction_log_replay(log):
    lines, at = wal(log), 15_000
    before = V.wal_states(lines).where(F.col("seq") <= at).groupBy("txn_id").agg(F.max(F.struct("seq", "state")).alias("m")).select("txn_id", "m.*")
    return V.replay_wal(before, lines, at)


@on_log(f"SELECT group_id, topic, \"partition\", \"offset\" AS value FROM (SELECT *, row_number() OVER (PARTITION BY group_id, topic, \"partition\" ORDER BY committed_at DESC) AS k FROM {COMMITS}) WHERE k = 1 AND \"offset\" >= 0")
def coordinator_snapshot(log):
    rows, keys = commits(log).withColumn("value", F.when(F.col("offset") >= 0, F.col("offset"))), ["group_id", "topic", "partition"]
    return V.replay_from(V.snapshot_at(rows, keys, "committed_at", "value", 6_000), rows, keys, "committed_at", "value", 6_000)


@on_log("""SELECT '# HELP log_messages_total Messages of each partition.' AS line UNION ALL SELECT '# TYPE log_messages_total counter'
 UNION ALL SELECT 'log_messages_total{topic="' || topic || '",partition="' || "partition" || '"} ' || count(*) FROM logs GROUP BY topic, "partition" """)
def metrics_scrape(log):
    return V.metrics_lines(log.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("n")), "log_messages_total", "counter", "Messages of each partition.", ["topic", "partition"], "n")


# Groups and replicas


@query(f"""WITH d AS (SELECT group_id, topic, "partition", member_id AS from_member, CASE WHEN "partition" % 2 = 0 THEN member_id ELSE 'ASIA' END AS to_member FROM {RR}),
 c AS (SELECT * FROM d WHERE from_member <> to_member),
 l AS (SELECT *, CASE from_member WHEN 'AFRICA' THEN 4000 WHEN 'AMERICA' THEN 1500 WHEN 'EUROPE' THEN 99000 END AS said FROM c)
 SELECT group_id, topic, "partition", from_member, to_member, 'moved' AS change, CAST(CASE WHEN said <= 31000 THEN said ELSE 31000 END AS BIGINT) AS revoked_ms, coalesce(said > 31000, true) AS forced,
 CAST((SELECT max(CASE WHEN said <= 31000 THEN said ELSE 31000 END) FROM l) AS BIGINT) AS assigned_ms FROM l""")
def cooperative_rebalance(spark, sf_dir):
    now = plain(G.round_robin_assign(D.members(spark, sf_dir), D.topic_partitions(D.log(spark, sf_dir))))
    new = now.withColumn("member_id", F.when(F.col("partition") % 2 == 0, F.col("member_id")).otherwise("ASIA"))
    acks = spark.createDataFrame([("g", "AFRICA", 4000), ("g", "AFRICA", 9000), ("g", "AMERICA", 1500), ("g", "EUROPE", 99000)], "group_id string, member_id string, at_ms long")
    return B.cooperative(G.assignment_diff(now, new), acks, 1_000, 30_000)


@on_log("""SELECT event_id, CASE k WHEN 0 THEN '0,1,2' WHEN 1 THEN '0,1,2,3' WHEN 2 THEN '0,1,2,3,4' ELSE '0,1,2,3,4,5' END AS joint, CASE k WHEN 0 THEN '' WHEN 1 THEN '3' WHEN 2 THEN '3,4' ELSE '3,4,5' END AS adding,
 CASE k WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '0,1' ELSE '0,1,2' END AS removing FROM (SELECT event_id, event_id % 4 AS k FROM logs)""")
def replica_reassignment(log):
    k = (F.col("event_id") % 4).cast("int")
    rows = log.select("event_id", F.array(*[F.lit(i) for i in range(3)]).alias("old"), F.array(*[k + i for i in range(3)]).alias("new"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return B.reassignment(rows).select("event_id", text("joint"), text("adding"), text("removing"))


@on_log("""SELECT topic, "partition", follower, s AND (was OR matched >= leo - 1) AS is_member FROM (SELECT topic, "partition", r AS follower, leo, matched, r % 2 = 0 AS was, leo - matched - 1 <= 1000 AS s
 FROM (SELECT topic, "partition", max("offset") + 1 AS leo, r, max("offset") - r // 2 * 400 - r % 2 * (max("offset") % 2) AS matched FROM logs, range(5) AS g(r) GROUP BY topic, "partition", r))""")
def isr_expand(log):
    ends = log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("leo")).withColumn("follower", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    r, last = F.col("follower"), F.col("leo") - 1
    rows = ends.withColumns({"matched": last - F.floor(r / 2) * 400 - r % 2 * (last % 2), "was": r % 2 == 0, "last_fetch_ms": F.lit(0).cast("long")})
    return G.expanded(G.in_sync_replicas(rows, 10_000)).select("topic", "partition", "follower", "is_member")


# Deliveries


@on_log("""SELECT producer_id, "partition", arrival, sequence, CASE WHEN sequence > g THEN 'gap' WHEN arrival = min(arrival) OVER (PARTITION BY producer_id, "partition", sequence) THEN 'ok' ELSE 'duplicate' END AS verdict
 FROM (SELECT q.*, coalesce(x.g, 1000000000) AS g FROM sequences q LEFT JOIN (SELECT producer_id, "partition", min(sequence) AS g FROM sent WHERE event_id % 23 = 0 GROUP BY 1, 2) x USING (producer_id, "partition")) WHERE (arrival // 2) % 23 <> 0""")
def sequence_gaps(log):
    return L.accepted_sequences(D.sequences(log).where("arrival div 2 % 23 <> 0"))


DEADS = f"(SELECT f.topic, f.reason FROM {FATES} f WHERE f.outcome = 'dlq')"


@on_log(f"SELECT topic, reason, count(*) AS n FROM {DEADS} GROUP BY GROUPING SETS ((topic), (reason), ())")
def dlq_by_reason(log):
    return A.counted(fates(log).where("outcome = 'dlq'"), ("topic",), ("reason",), ()).select("topic", "reason", "n")


@on_log(f"""SELECT f.topic, count(*) FILTER (event = 'ack') AS acks, count(*) FILTER (event = 'nack') AS nacks, count(*) FILTER (event = 'reject') AS rejects,
 count(*) FILTER (outcome = 'dlq') AS dlq, count(*) FILTER (outcome = 'retry') AS retries FROM {FATES} f GROUP BY 1""")
def ack_counters(log):
    f = fates(log)
    return f.groupBy("topic").agg(*[F.count_if(F.col("event") == e).alias(f"{e}s") for e in ("ack", "nack", "reject")], F.count_if(F.col("outcome") == "dlq").alias("dlq"), F.count_if(F.col("outcome") == "retry").alias("retries"))


# Quotas


def tenants(log) -> DataFrame:
    """What each tenant uses, in a column for each kind of quota, and its limits: multiples of 7 by kind, no limit for some."""
    use = log.groupBy(F.concat(F.lit("t"), (F.col("user_id") % 8).cast("string")).alias("tenant")).agg(F.max("user_id").alias("m"))
    cols = {f"use_{q}": (F.col("m") * (i + 1)) % 50 for i, q in enumerate(Q.QUOTAS)} | {f"most_{q}": F.lit(i * 7 % 36) for i, q in enumerate(Q.QUOTAS)}
    return use.withColumns(cols)


KINDS = "(SELECT tenant, q AS quota, CAST(m * (i + 1) % 50 AS DOUBLE) AS used, CAST(i * 7 % 36 AS DOUBLE) AS most FROM (SELECT 't' || (user_id % 8) AS tenant, max(user_id) AS m FROM logs GROUP BY 1), (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(Q.QUOTAS)) + ") AS k(i, q))"


@on_log(f"SELECT *, most = 0 OR used <= most AS ok FROM {KINDS}")
def quota_kinds(log):
    return Q.quota_checks(tenants(log), {q: (f"use_{q}", f"most_{q}") for q in Q.QUOTAS})


@on_log(f"""SELECT tenant, arg_min(quota, CASE quota WHEN 'topics' THEN 1 WHEN 'consumers_per_group' THEN 2 ELSE 3 END) FILTER (most <> 0 AND used > most) AS failed
 FROM {KINDS} WHERE quota IN ('topics', 'consumers_per_group', 'partitions') GROUP BY 1""")
def quota_composite(log):
    checks = Q.quota_checks(tenants(log), {q: (f"use_{q}", f"most_{q}") for q in Q.QUOTAS})
    return Q.first_failure(checks, ("topics", "consumers_per_group", "partitions"))


#: Two buckets and what each check leaves, request by request; the bounds are those that the query gives.
GATE = """WITH RECURSIVE r AS (SELECT user_id % 8 AS tenant, event_id AS seq, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS at_s, CAST(event_id * 37 % 120 AS BIGINT) AS b, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS rn FROM logs),
 s AS (SELECT *, coalesce(at_s - lag(at_s) OVER (PARTITION BY tenant ORDER BY rn), 0) AS gap FROM r),
 f AS (SELECT tenant, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS refused, 3.0::DOUBLE AS tokens, 200.0::DOUBLE AS space FROM s WHERE rn = 1 UNION ALL
  SELECT tenant, rn, CASE WHEN b > 110 THEN 'message_size' WHEN t < 1 THEN 'publish_rate' WHEN w < b THEN 'publish_bytes_rate' END, CASE WHEN b > 110 OR t < 1 THEN t ELSE t - 1 END, CASE WHEN b > 110 OR t < 1 OR w < b THEN w ELSE w - b END
  FROM (SELECT s.tenant, s.rn, s.b, least(3.0::DOUBLE, f.tokens + s.gap * 0.00048828125::DOUBLE) AS t, least(200.0::DOUBLE, f.space + s.gap * 0.015625::DOUBLE) AS w FROM f JOIN s ON s.tenant = f.tenant AND s.rn = f.rn + 1))
 SELECT s.tenant, s.seq, f.refused FROM f JOIN s ON s.tenant = f.tenant AND s.rn = f.rn"""


@on_log(GATE)
def publish_gate(log):
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("double")
    rows = log.select((F.col("user_id") % 8).alias("tenant"), F.col("event_id").alias("seq"), at.alias("at_s"), (F.col("event_id") * 37 % 120).alias("bytes"))
    return Q.publish_gate(rows, 110, 1 / 2048, 3.0, 1 / 64, 200.0).select("tenant", "seq", "refused")


# The stored log

_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> str:
    """The canonical log as files, written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = shared_path(spark, "log")
        Z.write_log(D.log(spark, sf_dir).select("topic", "partition", "offset", "ts", "key", "value", "priority", "flags"), path)
        _STORED[key] = path
    return _STORED[key]


@query(f"SELECT {MID}, key FROM logs WHERE topic = 'click' AND \"partition\" = 1 AND \"offset\" BETWEEN 17 AND 40")
def stored_range(spark, sf_dir):
    """Prunes to one directory, and within it by the offsets of row groups."""
    return R.range_scan(Z.read_log(spark, stored(spark, sf_dir)).where("topic = 'click' AND partition = 1"), 17, 24).select(*ID, "key")


def client(spark: SparkSession, sf_dir: str, hooks: Hooks | None = None) -> Log:
    """A new log, to which the messages are published in two batches."""
    out = Log(spark, shared_path(spark, "client"), hooks)
    rows = D.log(spark, sf_dir).drop("offset")
    half = rows.agg((F.max("event_id") / 2).alias("h")).first()["h"]
    out.publish(rows.where(F.col("event_id") <= half), ["ts", "event_id"])
    out.publish(rows.where(F.col("event_id") > half), ["ts", "event_id"])
    return out


@query(f"SELECT {MID}, key, value, ts, priority, flags FROM logs")
def client_publish(spark, sf_dir):
    return client(spark, sf_dir).rows()


@query(f"""SELECT 'group-1' AS group_id, topic, "partition", "offset", key FROM (SELECT l.*, row_number() OVER (PARTITION BY l.topic, l."partition" ORDER BY l."offset") AS k FROM logs l JOIN committed c ON c.group_id = 'group-1' AND c.topic = l.topic AND c."partition" = l."partition"
 WHERE l."offset" >= CASE l.topic WHEN 'view' THEN 0 WHEN 'click' THEN 12 WHEN 'purchase' THEN coalesce((SELECT min(x."offset") FROM logs x WHERE x.topic = l.topic AND x."partition" = l."partition" AND x.ts >= $as_of), 1000000000) ELSE c.committed END) WHERE k <= 20""")
def client_poll(spark, sf_dir):
    """Commits, three kinds of reset, and a poll."""
    log = client(spark, sf_dir)
    known = D.committed_offsets(log.rows()).where("group_id = 'group-1'")
    log.commit("group-1", known.select("topic", "partition", F.col("committed").alias("offset")))
    log.reset("group-1", "view", "earliest")
    log.reset("group-1", "click", 12)
    log.reset("group-1", "purchase", D.as_of())
    assignment = log.topics().select(F.lit("group-1").alias("group_id"), "topic", "partition")
    return log.poll("group-1", assignment, 20).select("group_id", *ID, "key")


@query("SELECT c.group_id, CAST(CASE c.group_id WHEN 'group-0' THEN 2 ELSE 0 END AS BIGINT) AS members, count(*) AS partitions, CAST(sum(e.n - c.committed) AS BIGINT) AS lag FROM committed c JOIN (SELECT topic, \"partition\", max(\"offset\") + 1 AS n FROM logs GROUP BY 1, 2) e USING (topic, \"partition\") GROUP BY 1, 2")
def group_describe(spark, sf_dir):
    log = Z.read_log(spark, stored(spark, sf_dir))
    ends = log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next"))
    members = spark.createDataFrame([("group-0", "a"), ("group-0", "b")], "group_id string, member_id string")
    return V.group_describe(D.committed_offsets(log), ends, members)


@query("SELECT event_type AS topic, CAST(user_id % 3 AS INTEGER) AS \"partition\", count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS size FROM events WHERE event_id % 10 <> 0 AND user_id <> 7 GROUP BY 1, 2")
def client_hooks(spark, sf_dir):
    """A partitioner, a validator, a quota and a codec of the program's own."""
    hooks = Hooks(partitioner=lambda b: F.col("key").cast("int") % 3, validator=lambda b: F.col("event_id") % 10 != 0, quota=lambda b: F.col("key") != "7", encode=(F.base64, F.reverse), decode=(F.reverse, lambda c: F.unbase64(c).cast("string")))
    log = Log(spark, shared_path(spark, "hooks"), hooks)
    log.publish(D.log(spark, sf_dir).drop("offset"), ["ts", "event_id"])
    return hooks.deliver(log.rows()).groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("size"))


# Streams


@query(f"SELECT c.group_id, l.topic, l.\"partition\", l.\"offset\" FROM logs l JOIN committed c USING (topic, \"partition\") WHERE l.\"offset\" >= c.committed AND c.group_id <> 'group-2'")
def stream_subscribe(spark, sf_dir):
    path = stored(spark, sf_dir)
    committed = D.committed_offsets(Z.read_log(spark, path))
    assignment = committed.where("group_id <> 'group-2'").select("group_id", "topic", "partition", F.lit("m").alias("member_id"))
    return O.run_available(O.subscribe(Z.stream_log(spark, path), assignment, committed).select("group_id", *ID), "subscribe")


@query(f"SELECT group_id, topic, \"partition\", max(\"offset\") + 1 AS \"offset\" FROM logs JOIN committed USING (topic, \"partition\") WHERE \"offset\" >= committed GROUP BY 1, 2, 3")
def stream_positions(spark, sf_dir):
    """Where a group stands after all that it was sent."""
    path = stored(spark, sf_dir)
    committed = D.committed_offsets(Z.read_log(spark, path))
    assignment = committed.select("group_id", "topic", "partition", F.lit("m").alias("member_id"))
    got = O.subscribe(Z.stream_log(spark, path), assignment, committed).select("group_id", *ID)
    return O.positions(O.run_available(got, "subscribe"))


@query("""SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition", event_id AS "offset", due_s FROM (SELECT *, CAST(ceil((epoch_us(ts) + (event_id % 5) * 3600000000) / 1000000.0) AS BIGINT) AS due_s FROM events)
 WHERE due_s * 1000 < (SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events)""")
def stream_delayed(spark, sf_dir):
    rows = O.table_stream(spark, sf_dir, "events")
    rows = rows.select(F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"), "ts", F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 5) * 3_600_000_000).alias("deliver_at"))
    return O.run_available(O.delayed(rows, "1 hour"), "delayed")


@query("""SELECT 'g' AS group_id, event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition", event_id AS "offset", CASE event_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'retry' ELSE 'expired:redeliver' END AS outcome
 FROM events WHERE event_id % 3 <> 2 OR epoch_us(ts) // 1000 + 30000 < (SELECT max(epoch_us(ts) + CASE WHEN event_id % 3 = 2 THEN 0 ELSE 10000000 END) // 1000 - 3600000 FROM events)""")
def stream_deliveries(spark, sf_dir):
    rows = O.table_stream(spark, sf_dir, "events")
    k = F.col("event_id") % 3
    steps = F.array_compact(F.array(F.struct(F.lit("deliver").alias("event"), F.lit(0).alias("s")), F.when(k < 2, F.struct(F.when(k == 0, "ack").otherwise("nack").alias("event"), F.lit(10).alias("s")))))
    rows = rows.select(F.lit("g").alias("group_id"), F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"), "ts", F.explode(steps).alias("x"))
    rows = rows.select("group_id", *ID, F.col("x.event").alias("event"), F.timestamp_micros(F.unix_micros("ts") + F.col("x.s").cast("long") * 1_000_000).alias("ts"))
    return O.run_available(O.deliveries(rows, "1 hour"), "deliveries")

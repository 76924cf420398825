"""A message log and its side tables, derived from the test tables by integer arithmetic, for Spark and for SQL alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

AS_OF = "2024-01-16 00:00:00"
ID = ["topic", "partition", "offset"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical log. Offsets are dense in each partition; a real log carries them, here a window makes them."""
    e = table(spark, sf_dir, "events")
    part = (F.col("user_id") % 4).cast("int")
    offset = F.row_number().over(W.partitionBy("event_type", part).orderBy("ts", "event_id")).cast("long") - 1
    flags = F.when(F.col("event_id") % 41 == 0, 8 + 16 * (F.col("event_id") % 2)).otherwise(F.lit(0)).cast("int")
    return e.select(
        "event_id", F.col("event_type").alias("topic"), part.alias("partition"), offset.alias("offset"), "ts", F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"),
        ((F.col("event_id") * 7) % 5).cast("int").alias("priority"), flags.alias("flags"), "user_id", F.col("value").alias("amount"),
    )


def delays(logs: DataFrame) -> DataFrame:
    state = F.when(F.col("event_id") % 33 == 0, "canceled").otherwise("pending")
    return logs.where("event_id % 11 = 0").select(*ID, (F.col("ts") + F.expr("interval 6 hours")).alias("deliver_at"), state.alias("state"))


def transactions(logs: DataFrame) -> DataFrame:
    """(topic, partition, offset, txn_id, status) of transactional records."""
    txn = F.expr("event_id div 8")
    status = F.when(txn % 5 == 0, "aborted").when(txn % 5 == 1, "open").otherwise("committed")
    return logs.where("topic = 'purchase'").select(*ID, txn.alias("txn_id"), status.alias("status"))


def consumed(logs: DataFrame) -> DataFrame:
    return logs.where("event_id % 13 = 0").select(*ID)


def committed_offsets(logs: DataFrame) -> DataFrame:
    groups = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("g")
    ends = logs.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next"))
    return ends.select("topic", "partition", "next", groups).select(F.concat(F.lit("group-"), F.col("g").cast("string")).alias("group_id"), "topic", "partition", F.expr("next * (g + 1) div 4").alias("committed"))


def ack_events(logs: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_id") % 29 == 0, "reject").when(F.col("event_id") % 17 == 0, "nack").otherwise("ack")
    return logs.select("event_id", *ID, "ts", kind.alias("event"))


def spans(logs: DataFrame) -> DataFrame:
    outcome = F.when(F.col("event_id") % 29 == 0, "consume.rejected").when(F.col("event_id") % 17 == 0, "consume.nacked").when(F.col("event_id") % 7 == 0, "delay.scheduled").otherwise("consume.acked")
    steps = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(ms).alias("ms"), kind.alias("event_type")) for i, (ms, kind) in enumerate([(0, F.lit("publish.received")), (1, F.lit("publish.persisted")), (5, F.lit("consume.fetched")), (20, outcome)])])
    rows = logs.select("event_id", *ID, "ts", F.explode(steps).alias("s"))
    trace = F.lpad(F.lower(F.hex("event_id")), 32, "0")
    return rows.select(trace.alias("trace_id"), "s.seq", "s.event_type", (F.unix_micros(F.col("ts").cast("timestamp")) + F.col("s.ms") * 1000).alias("ts_us"), *ID, F.concat(F.lit("group-"), (F.col("event_id") % 3).cast("string")).alias("consumer_group"))


def sequences(logs: DataFrame) -> DataFrame:
    """(producer_id, epoch, partition, arrival, sequence): sequence numbers as sent, with resent ones and gaps."""
    n = F.row_number().over(W.partitionBy("user_id", "partition").orderBy("ts", "event_id")).cast("long") - 1
    sent = logs.select(F.col("user_id").alias("producer_id"), (F.col("user_id") % 3).cast("int").alias("epoch"), "partition", "event_id", n.alias("sequence"))
    again = sent.where("event_id % 19 = 0").select("producer_id", "epoch", "partition", (F.col("event_id") * 2 + 1).alias("arrival"), "sequence")
    return sent.select("producer_id", "epoch", "partition", (F.col("event_id") * 2).alias("arrival"), "sequence").unionByName(again)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.lit("g").alias("group_id"), F.col("r_name").alias("member_id"), F.col("r_regionkey").alias("joined_at"))


def topic_partitions(logs: DataFrame) -> DataFrame:
    """(topic, n): 4 to 12 partitions for each topic, by the length of its name."""
    return logs.select("topic").distinct().select("topic", (F.length("topic") % 9 + 4).alias("n"))


def schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, subject, version, schema): three versions for each nation's name as subject."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("subject"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("version"))
    text = F.concat(F.lit('{"type":"object","properties":{"k":{"type":"integer"},"p'), F.col("version").cast("string"), F.lit('":{"type":"string"}},"required":["k"]}'))
    return n.where("version <= 1 + k % 3").select((F.col("k") * 3 + F.col("version")).cast("long").alias("id"), "subject", "version", text.alias("schema"))


def metrics(logs: DataFrame) -> DataFrame:
    """(topic, ts, total): a counter for each topic that starts again each ten days."""
    day = F.expr("(day(ts) - 1) div 10")
    w = W.partitionBy("topic", day).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return logs.select("topic", "ts", "event_id", F.count(F.lit(1)).over(w).alias("total"))


#: The same in SQL, by name; a query takes those it mentions.
SQL = {
    "logs": """SELECT event_id, event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition",
      row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) - 1 AS "offset", ts, CAST(user_id AS VARCHAR) AS key, props AS value,
      CAST((event_id * 7) % 5 AS INTEGER) AS priority, CAST(CASE WHEN event_id % 41 = 0 THEN 8 + 16 * (event_id % 2) ELSE 0 END AS INTEGER) AS flags, user_id, value AS amount FROM events""",
    "delays": """SELECT topic, "partition", "offset", ts + INTERVAL 6 HOUR AS deliver_at, CASE WHEN event_id % 33 = 0 THEN 'canceled' ELSE 'pending' END AS state FROM logs WHERE event_id % 11 = 0""",
    "txns": """SELECT topic, "partition", "offset", event_id // 8 AS txn_id, CASE (event_id // 8) % 5 WHEN 0 THEN 'aborted' WHEN 1 THEN 'open' ELSE 'committed' END AS status FROM logs WHERE topic = 'purchase'""",
    "consumed": """SELECT topic, "partition", "offset" FROM logs WHERE event_id % 13 = 0""",
    "committed": """SELECT 'group-' || g AS group_id, topic, "partition", n * (g + 1) // 4 AS committed FROM (SELECT topic, "partition", max("offset") + 1 AS n FROM logs GROUP BY 1, 2), range(3) AS r(g)""",
    "acks": """SELECT event_id, topic, "partition", "offset", ts, CASE WHEN event_id % 29 = 0 THEN 'reject' WHEN event_id % 17 = 0 THEN 'nack' ELSE 'ack' END AS event FROM logs""",
    "spans": """SELECT lpad(lower(to_hex(event_id)), 32, '0') AS trace_id, seq, CASE seq WHEN 0 THEN 'publish.received' WHEN 1 THEN 'publish.persisted' WHEN 2 THEN 'consume.fetched' ELSE
      CASE WHEN event_id % 29 = 0 THEN 'consume.rejected' WHEN event_id % 17 = 0 THEN 'consume.nacked' WHEN event_id % 7 = 0 THEN 'delay.scheduled' ELSE 'consume.acked' END END AS event_type,
      epoch_us(ts) + CASE seq WHEN 0 THEN 0 WHEN 1 THEN 1000 WHEN 2 THEN 5000 ELSE 20000 END AS ts_us, topic, "partition", "offset", 'group-' || (event_id % 3) AS consumer_group FROM logs, range(4) AS r(seq)""",
    "sent": """SELECT user_id AS producer_id, CAST(user_id % 3 AS INTEGER) AS epoch, "partition", event_id, row_number() OVER (PARTITION BY user_id, "partition" ORDER BY ts, event_id) - 1 AS sequence FROM logs""",
    "sequences": """SELECT producer_id, epoch, "partition", event_id * 2 AS arrival, sequence FROM sent UNION ALL SELECT producer_id, epoch, "partition", event_id * 2 + 1, sequence FROM sent WHERE event_id % 19 = 0""",
    "members": """SELECT 'g' AS group_id, r_name AS member_id, r_regionkey AS joined_at FROM region""",
    "topic_partitions": """SELECT topic, length(topic) % 9 + 4 AS n FROM (SELECT DISTINCT topic FROM logs)""",
    "schemas": """SELECT CAST(n_nationkey * 3 + version AS BIGINT) AS id, n_name AS subject, version, '{"type":"object","properties":{"k":{"type":"integer"},"p' || version || '":{"type":"string"}},"required":["k"]}' AS schema
      FROM nation, range(1, 4) AS r(version) WHERE version <= 1 + n_nationkey % 3""",
    "metrics": """SELECT topic, ts, event_id, count(*) OVER (PARTITION BY topic, (day(ts) - 1) // 10 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM logs""",
}


def oracle(body: str) -> str:
    """body behind the definitions that it needs, in order; $as_of is the constant clock."""
    body = body.replace("$as_of", f"TIMESTAMP '{AS_OF}'")
    need, new = set(), {body}
    while new:
        found = {n for text in new for n in SQL if re.search(rf"(\bFROM|\bJOIN|,)\s+{n}\b", text)} - need
        need |= found
        new = {SQL[n] for n in found}
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in SQL if n in need)
    if not ctes:
        return body
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"

"""What is built up again after a restart, and what waits for its time: delays, retries, timers, transaction logs, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import WHEEL
from .groups import replay
from .reads import PART

#: Records of a transaction log and the state that each leaves; fixed values of the data model.
STATES = {
    "begin_txn": "open", "add_partition": "open", "txn_publish": "open", "prepare_commit": "prepare_commit",
    "prepare_abort": "prepare_abort", "complete_commit": "committed", "complete_abort": "aborted",
}


def recover_delays(delays: DataFrame, as_of: Column) -> DataFrame:
    """Pending delays after a restart: those past their time are delivered at once, others scheduled. Delivered and canceled ones have no entry any more."""
    return delays.where("state = 'pending'").withColumn("action", F.when(F.col("deliver_at") < as_of, "deliver").otherwise("schedule"))


def wheel_moves(delay_ms: Column) -> Column:
    """Where a timer, set when all cursors are at 0, moves on to a finer level: an array of (level, at_ms).

    A timer waits in the bucket of its level until the cursor comes to it; what is left of its delay then chooses the next
    level, so that a level is left out where the delay has no whole bucket of it.
    """
    moves = []
    for level in range(len(WHEEL) - 1, 0, -1):
        tick, buckets = WHEEL[level]
        whole = F.floor(delay_ms / tick)
        digit = whole if level == len(WHEEL) - 1 else whole % buckets
        moves.append(F.when(digit > 0, F.struct(F.lit(level).alias("level"), (whole * tick).cast("long").alias("at_ms"))))
    return F.array_compact(F.array(*moves))


def retry_pipeline(retries: DataFrame, order: str, ready: str, bucket: int) -> DataFrame:
    """retries with ``done``: when a single worker that takes them in ``order`` and sleeps until each is ready has served it.

    A message waits for all before it, so done is the running maximum of ready. It is made in two steps, over buckets of the
    (whole) order column and within them, so that no task has the whole queue.
    """
    rows = retries.withColumn("_b", F.floor(F.col(order) / bucket))
    tops = rows.groupBy("_b").agg(F.max(ready).alias("_top"))
    before = tops.withColumn("_before", F.max("_top").over(W.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))).select("_b", "_before")
    within = F.max(ready).over(W.partitionBy("_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_within", within).join(before, "_b").withColumn("done", F.greatest("_within", F.coalesce("_before", "_within"))).drop("_b", "_within", "_before")


def wal_states(wal: DataFrame, after: int = -1) -> DataFrame:
    """(txn_id, seq, state) after each record of a log of JSON lines beyond ``after``; lines that are no records are skipped."""
    got = wal.select(F.from_json("line", "seq long, type string, txn_id long").alias("r")).select("r.*")
    names = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    known = got.where(F.col("seq").isNotNull() & F.col("txn_id").isNotNull() & F.col("type").isin(*STATES))
    return known.where(F.col("seq") > after).select("txn_id", "seq", names[F.col("type")].alias("state"))


def replay_wal(snapshot: DataFrame, wal: DataFrame, after: int) -> DataFrame:
    """(txn_id, seq, state): the snapshot's states, taken at record ``after``, and the log's beyond it; the last record of each transaction counts."""
    rows = snapshot.select("txn_id", "seq", "state").unionByName(wal_states(wal, after))
    return rows.groupBy("txn_id").agg(F.max(F.struct("seq", "state")).alias("m")).select("txn_id", "m.*")


def snapshot_at(records: DataFrame, keys: list[str], order: str, value: str, at: int) -> DataFrame:
    """A coordinator's state after all records up to ``at``, as records that a replay can begin with; each carries the order of the record it came from."""
    last = records.where(F.col(order) <= at).groupBy(*keys).agg(F.max(F.struct(order, value)).alias("m"))
    return last.select(*keys, f"m.{order}", f"m.{value}")


def replay_from(snapshot: DataFrame, records: DataFrame, keys: list[str], order: str, value: str, at: int) -> DataFrame:
    """The state after the snapshot and all records beyond ``at``: what a replay of the whole log gives, without its beginning."""
    cols = [*keys, order, value]
    return replay(snapshot.select(*cols).unionByName(records.where(F.col(order) > at).select(*cols)), keys, order, value)


def metrics_lines(samples: DataFrame, name: str, kind: str, about: str, labels: list[str], value: str) -> DataFrame:
    """(line) of a scrape in the text format: what the metric is, and a line for each sample. Label values are escaped."""

    def text(c: str) -> Column:
        out = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for plain, escaped in (("\\", "\\\\"), ("\n", "\\n"), ('"', '\\"')):
            out = F.replace(out, F.lit(plain), F.lit(escaped))
        return F.concat(F.lit(f'{c}="'), out, F.lit('"'))

    pairs = F.concat(F.lit("{"), F.concat_ws(",", *map(text, labels)), F.lit("}")) if labels else F.lit("")
    rows = samples.select(F.concat(F.lit(name), pairs, F.lit(" "), F.col(value).cast("string")).alias("line"))
    head = samples.sparkSession.createDataFrame([(f"# HELP {name} {about}",), (f"# TYPE {name} {kind}",)], "line string")
    return head.unionByName(rows)


def group_describe(committed: DataFrame, ends: DataFrame, members: DataFrame) -> DataFrame:
    """For each group: members, partitions with a commit, and the sum of what lies between commits and ends."""
    lag = committed.join(ends, PART, "left").groupBy("group_id").agg(F.count(F.lit(1)).alias("partitions"), F.sum(F.greatest(F.coalesce(F.col("next") - F.col("committed"), F.lit(0)), F.lit(0))).alias("lag"))
    people = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))
    return lag.join(people, "group_id", "full").select("group_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("members", "partitions", "lag")])

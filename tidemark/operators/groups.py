"""Consumer groups: assignment of partitions, differences of assignments, placement and election of replicas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(members: DataFrame) -> DataFrame:
    """(group_id, member_id, rank, m): members of each group in order, and how many."""
    w = W.partitionBy("group_id")
    return members.select("group_id", "member_id", (F.row_number().over(w.orderBy("member_id")) - 1).alias("rank"), F.count(F.lit(1)).over(w).alias("m"))


def expand(topics: DataFrame) -> DataFrame:
    """(topic, partition) from (topic, n)."""
    return topics.select("topic", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("partition"))


def range_assign(members: DataFrame, topics: DataFrame) -> DataFrame:
    """For each topic contiguous runs of partitions; the first members get one more where it does not come out even."""
    r = ranked(members)
    size = r.select("group_id", "m").distinct()
    rows = topics.join(F.broadcast(size)).withColumn("partition", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    q, left = F.expr("n div m"), F.expr("n % m")
    wide = F.expr("(n % m) * (n div m + 1)")
    rank = F.when(F.col("partition") < wide, F.expr("partition div (n div m + 1)")).otherwise(left + F.expr("(partition - (n % m) * (n div m + 1)) div greatest(n div m, 1)"))
    rows = rows.withColumn("rank", rank.cast("int")).where((q > 0) | (F.col("partition") < wide))
    return rows.join(r.select("group_id", "member_id", "rank"), ["group_id", "rank"]).select("group_id", "topic", "partition", "member_id")


def round_robin_assign(members: DataFrame, topics: DataFrame) -> DataFrame:
    """All partitions in order, dealt to the members in turn. A partition's place is its topic's first place plus its number, so only topics are sorted."""
    r = ranked(members)
    starts = topics.withColumn("_base", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("topic").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    parts = starts.select("topic", "_base", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("partition"))
    size = r.select("group_id", "m").distinct()
    rows = parts.join(F.broadcast(size)).withColumn("rank", ((F.col("_base") + F.col("partition")) % F.col("m")).cast("int"))
    return rows.join(r.select("group_id", "member_id", "rank"), ["group_id", "rank"]).select("group_id", "topic", "partition", "member_id")


def sticky_assign(members: DataFrame, topics: DataFrame, current: DataFrame, imbalance: int = 1) -> DataFrame:
    """Members keep what they have and may have, in order of topic and partition, down to the fair share rounded up plus ``imbalance``; the rest goes to the least loaded.

    Greedy, so each group is one call; a group's metadata, not its messages, goes there.
    """
    wanted = expand(topics)
    ids = members.select("group_id").distinct()
    rows = ids.join(F.broadcast(wanted)).select("group_id", "topic", "partition").join(current, ["group_id", "topic", "partition"], "left").withColumn("kind", F.lit("p"))
    people = members.select("group_id", F.lit("").alias("topic"), F.lit(-1).alias("partition"), "member_id", F.lit("m").alias("kind"))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        alive = sorted(pdf.loc[pdf.kind == "m", "member_id"])
        parts = pdf[pdf.kind == "p"].sort_values(["topic", "partition"])
        mine: dict[str, list] = {m: [] for m in alive}
        free = []
        for t, p, m in zip(parts.topic, parts.partition, parts.member_id):
            (mine[m] if m in mine else free).append((t, p))
        share = -(-len(parts) // len(alive)) if alive else 0
        for m in alive:
            while len(mine[m]) > share + imbalance:
                free.append(mine[m].pop())
        for x in sorted(free):
            if alive:
                mine[min(alive, key=lambda m: (len(mine[m]), m))].append(x)
        out = [(pdf.group_id.iloc[0], t, p, m) for m in alive for t, p in mine[m]]
        return pd.DataFrame(out, columns=["group_id", "topic", "partition", "member_id"])

    return rows.unionByName(people).groupBy("group_id").applyInPandas(assign, "group_id string, topic string, partition int, member_id string")


def assignment_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """For each partition: unchanged, assigned, revoked or moved, and from whom to whom."""
    keys = ["group_id", "topic", "partition"]
    met = old.withColumnRenamed("member_id", "from_member").join(new.withColumnRenamed("member_id", "to_member"), keys, "full")
    a, b = F.col("from_member"), F.col("to_member")
    return met.withColumn("change", F.when(a.isNull(), "assigned").when(b.isNull(), "revoked").when(a == b, "unchanged").otherwise("moved"))


def set_algebra(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left not in right, in both, and in either, each marked by ``op``; the union is distinct."""
    a, b = left.select(*keys), right.select(*keys)
    parts = [("difference", a.join(b, keys, "left_anti")), ("intersection", a.join(b, keys, "left_semi")), ("union", a.union(b).distinct())]
    out = None
    for op, rows in parts:
        rows = rows.select(F.lit(op).alias("op"), *keys)
        out = rows if out is None else out.unionByName(rows)
    return out


def group_leader(members: DataFrame) -> DataFrame:
    return members.groupBy("group_id").agg(F.min(F.struct("joined_at", "member_id")).alias("_m")).select("group_id", F.col("_m.member_id").alias("leader"))


def place_replicas(topics: DataFrame, nodes: DataFrame, replicas: int) -> DataFrame:
    """Partition p is led by node p mod N and copied to the ones that follow; (topic, partition, pos, node)."""
    w = W.partitionBy(F.lit(0))
    known = nodes.select("node", (F.row_number().over(w.orderBy("node")) - 1).alias("rank"), F.count(F.lit(1)).over(w).alias("n_nodes"))
    size = known.select("n_nodes").limit(1)
    rows = expand(topics).join(F.broadcast(size)).withColumn("pos", F.explode(F.sequence(F.lit(0), F.least(F.lit(replicas), F.col("n_nodes")) - 1)))
    return rows.withColumn("rank", ((F.col("partition") + F.col("pos")) % F.col("n_nodes")).cast("int")).join(F.broadcast(known.select("rank", "node")), "rank").select("topic", "partition", "pos", "node")


def elect_leaders(replicas: DataFrame, alive: Column, in_sync: Column, unclean: bool = False) -> DataFrame:
    """For each partition the first living replica in sync other than its first; with ``unclean`` any living one if there is none."""
    clean = F.when(alive & in_sync & (F.col("pos") > 0), F.struct("pos", "node"))
    any_ = F.when(alive & (F.col("pos") > 0), F.struct("pos", "node")) if unclean else F.lit(None).cast("struct<pos:int,node:string>")
    return replicas.groupBy("topic", "partition").agg(F.min(clean).alias("c"), F.min(any_).alias("u")).select("topic", "partition", F.coalesce("c.node", "u.node").alias("leader"))


def coordinator_partition(group_id: Column, partitions: int = 50) -> Column:
    from ..functions.scalars import murmur3_32

    return (murmur3_32(group_id.cast("binary")) % partitions).cast("int")


def node_status(silent_ms: Column, suspect_ms: int, dead_ms: int) -> Column:
    return F.when(silent_ms >= dead_ms, "dead").when(silent_ms >= suspect_ms, "suspect").otherwise("alive")


def latest_commits(commits: DataFrame) -> DataFrame:
    """Last write wins, for each group and partition; negative offsets are no commits."""
    rows = commits.where(F.col("offset") >= 0).groupBy("group_id", "topic", "partition").agg(F.max(F.struct("committed_at", "offset")).alias("m"))
    return rows.select("group_id", "topic", "partition", "m.offset", "m.committed_at")


def replay(records: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """State after a log of keyed records: the last value of each key; a null value deletes it."""
    last = records.groupBy(*keys).agg(F.max(F.struct(order, value)).alias("m"))
    return last.where(F.col(f"m.{value}").isNotNull()).select(*keys, f"m.{value}")


def in_sync_replicas(followers: DataFrame, as_of_ms: int, most_silent_ms: int = 10_000, most_behind: int = 1_000) -> DataFrame:
    """Followers (topic, partition, leo, follower, last_fetch_ms, matched) with in_sync."""
    ok = (F.lit(as_of_ms) - F.col("last_fetch_ms") <= most_silent_ms) & (F.col("leo") - F.col("matched") - 1 <= most_behind)
    return followers.withColumn("in_sync", ok)


def expanded(followers: DataFrame) -> DataFrame:
    """in_sync after a fetch: members stay as they are judged; others come in only when they have caught up to the leader's last message and are judged in sync. ``was`` tells who was a member."""
    return followers.withColumn("is_member", F.col("in_sync") & (F.col("was") | (F.col("matched") >= F.col("leo") - 1)))


def high_watermark(followers: DataFrame) -> DataFrame:
    """For each partition: the offset that all in sync have reached, how many those are, the least matched, the greatest lag."""
    ok = F.col("in_sync")
    return followers.groupBy("topic", "partition").agg(
        F.least(F.max("leo"), F.coalesce(F.min(F.when(ok, F.col("matched") + 1)), F.max("leo"))).alias("high_watermark"), F.count_if(ok).alias("in_sync"), F.min("matched").alias("least_matched"),
        F.max(F.col("leo") - F.col("matched") - 1).alias("greatest_lag"),
    )

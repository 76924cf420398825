"""Rebalancing in two phases, and the replica lists of a reassignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replica_union(a: Column, b: Column) -> Column:
    """All of a, then those of b that are not there yet, each once, in order."""
    return F.array_distinct(F.concat(a, b))


def replica_difference(a: Column, b: Column) -> Column:
    """Those of a that b does not have, in order, repeated as in a."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def reassignment(partitions: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """partitions with the replicas while copies are made (``joint``), those to be added and those to be removed at the end."""
    a, b = F.col(old), F.col(new)
    return partitions.select("*", replica_union(a, b).alias("joint"), replica_difference(b, a).alias("adding"), replica_difference(a, b).alias("removing"))


def cooperative(diff: DataFrame, acks: DataFrame, begun_ms: int, timeout_ms: int) -> DataFrame:
    """A cooperative rebalance, from an assignment's diff (group_id, topic, partition, from_member, to_member, change) and the
    members' acknowledgements (group_id, member_id, at_ms).

    First all that lose partitions give them up: a member is done when it says so, or is forced when the timeout has
    passed. When the last of a group is done, its partitions are assigned. Unchanged ones are consumed all the time.
    Members that lose nothing are not waited for; with none to wait for, the second phase begins at once. Gives for each partition
    that changes ``revoked_ms`` (null where nobody had it), ``forced`` and ``assigned_ms`` (null where nobody gets it).
    """
    changed = diff.where("change <> 'unchanged'")
    deadline = F.lit(begun_ms + timeout_ms).cast("long")
    said = acks.groupBy("group_id", "member_id").agg(F.min("at_ms").alias("at_ms")).withColumnRenamed("member_id", "from_member")
    losing = changed.where("from_member IS NOT NULL").select("group_id", "from_member").distinct().join(said, ["group_id", "from_member"], "left")
    late = F.coalesce(F.col("at_ms") > deadline, F.lit(True))
    losing = losing.select("group_id", "from_member", F.when(late, deadline).otherwise(F.greatest("at_ms", F.lit(begun_ms).cast("long"))).alias("revoked_ms"), late.alias("forced"))
    ready = losing.groupBy("group_id").agg(F.max("revoked_ms").alias("ready_ms"))
    met = changed.join(losing, ["group_id", "from_member"], "left").join(ready, "group_id", "left")
    assigned = F.when(F.col("to_member").isNotNull(), F.coalesce("ready_ms", F.lit(begun_ms).cast("long")))
    return met.select("group_id", "topic", "partition", "from_member", "to_member", "change", "revoked_ms", F.coalesce("forced", F.lit(False)).alias("forced"), assigned.alias("assigned_ms"))

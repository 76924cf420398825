"""Compaction and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .reads import CONTROL, PART


def compact(log: DataFrame, as_of: Column, tombstone_hours: int = 24) -> DataFrame:
    """The last message of each key, without control records and without keys whose last message is an expired tombstone (an empty value)."""
    rows = log.where(F.col("flags").bitwiseAND(CONTROL) == 0)
    rest = [c for c in log.columns if c not in (*PART, "offset")]
    last = rows.groupBy(*PART, F.coalesce("key", F.lit("")).alias("_k")).agg(F.max(F.struct("offset", *rest)).alias("m"))
    expired = (F.coalesce(F.col("m.value"), F.lit("")) == "") & (F.col("m.ts") < as_of - F.expr(f"interval {tombstone_hours} hours"))
    return last.where(~expired).select(*PART, "m.offset", *[F.col(f"m.{c}").alias(c) for c in rest])


def compaction_stats(log: DataFrame, as_of: Column, size: Column, tombstone_hours: int = 24) -> DataFrame:
    """For each partition: messages before and after, keys, expired tombstones seen, bytes before."""
    rows = log.where(F.col("flags").bitwiseAND(CONTROL) == 0)
    old = (F.coalesce("value", F.lit("")) == "") & (F.col("ts") < as_of - F.expr(f"interval {tombstone_hours} hours"))
    keys = rows.groupBy(*PART, F.coalesce("key", F.lit("")).alias("_k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(old).alias("t"), F.sum(size).alias("b"), F.max(F.struct("offset", old.alias("dead"))).alias("m"))
    return keys.groupBy(*PART).agg(F.sum("n").alias("before"), F.count_if(~F.col("m.dead")).alias("after"), F.count(F.lit(1)).alias("keys"), F.sum("t").alias("tombstones"), F.sum("b").alias("bytes"))


def keep_recent(log: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Messages not older than so many hours; 0 keeps all."""
    return log.where(F.col("ts") >= as_of - F.expr(f"interval {hours} hours")) if hours else log


def keep_recent_segments(segmented: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Whole segments: those that have a message not older, and each partition's last one."""
    if not hours:
        return segmented
    ends = segmented.groupBy(*PART, "segment").agg(F.max("ts").alias("_last"))
    ends = ends.withColumn("_active", F.max("segment").over(W.partitionBy(*PART)))
    live = ends.where((F.col("_last") >= as_of - F.expr(f"interval {hours} hours")) | (F.col("segment") == F.col("_active"))).select(*PART, "segment")
    return segmented.join(live, [*PART, "segment"], "left_semi")


def keep_bytes(log: DataFrame, size: Column, most: int) -> DataFrame:
    """The newest messages of each partition that fit in so many bytes."""
    after = F.sum(size).over(W.partitionBy(*PART).orderBy(F.desc("offset")).rowsBetween(W.unboundedPreceding, 0))
    return log.withColumn("_bytes", after).where(F.col("_bytes") <= most).drop("_bytes")

"""A client of a stored log: publish, consume, poll, commit, reset, describe. State is files in one shared folder."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hooks import Hooks
from .operators import groups, reads, recovery
from .sources import logstore

COMMITS = "group_id string, topic string, partition int, offset long, committed_at long"


class Log:
    """The log at ``path``; nothing need be there yet. Calls that give rows are lazy."""

    def __init__(self, spark: SparkSession, path: str, hooks: Hooks | None = None):
        self.spark, self.path, self.hooks = spark, path.rstrip("/"), hooks or Hooks()

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def rows(self, topics: list[str] | None = None) -> DataFrame:
        if not self._there("log"):
            return self.spark.createDataFrame([], logstore.LOG_SCHEMA)
        return logstore.read_log(self.spark, f"{self.path}/log", topics)

    def publish(self, batch: DataFrame, order: list[str]) -> None:
        """Appends batch (topic, partition, ts, key, value, priority, flags) behind the ends, in the order given."""
        batch = self.hooks.admit(batch)
        for f in self.hooks.on_publish:
            f(batch)
        cols = [c for c in self.rows().columns if c != "offset"]
        logstore.publish(batch.select(*dict.fromkeys([*cols, *order])), self.rows(), f"{self.path}/log", order, cols)

    def topics(self) -> DataFrame:
        """(topic, partition, earliest, next) of all partitions that have messages."""
        return self.rows().groupBy(*reads.PART).agg(F.min("offset").alias("earliest"), (F.max("offset") + 1).alias("next"))

    def consume(self, topic: str, partitions: list[int] | None = None, start: int = 0, most: int = 100) -> DataFrame:
        """The first ``most`` messages of each partition from an offset; all partitions if none are named."""
        rows = self.rows([topic]).where(F.col("offset") >= start)
        rows = rows.where(F.col("partition").isin(*partitions)) if partitions else rows
        return self.hooks.deliver(reads.first_per(rows, reads.PART, ["offset"], most))

    def committed(self, group: str | None = None) -> DataFrame:
        """(group_id, topic, partition, committed): the last commits."""
        rows = self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits") if self._there("commits") else self.spark.createDataFrame([], COMMITS)
        rows = rows.where(F.col("group_id") == group) if group else rows
        return groups.latest_commits(rows).select("group_id", *reads.PART, F.col("offset").alias("committed"))

    def commit(self, group: str, offsets: DataFrame) -> None:
        """offsets (topic, partition, offset); negative ones are skipped. A later call counts before an earlier one."""
        rows = offsets.select(F.lit(group).alias("group_id"), "topic", F.col("partition").cast("int").alias("partition"), F.col("offset").cast("long").alias("offset"), F.lit(time.time_ns()).alias("committed_at"))
        rows.where("offset >= 0").write.mode("append").parquet(f"{self.path}/commits")

    def reset(self, group: str, topic: str, to: str | int | Column) -> None:
        """To 'earliest' (0), 'latest' (the next offset), an offset, or the first message at or after a time."""
        rows = self.rows([topic])
        where = to if isinstance(to, Column) else F.lit(None).cast("timestamp_ntz")
        starts = reads.start_positions(rows, to if isinstance(to, int) else 0, where)
        chosen = "at_time" if isinstance(to, Column) else "at_offset" if isinstance(to, int) else {"earliest": "earliest", "latest": "latest"}[to]
        self.commit(group, starts.select(*reads.PART, F.col(chosen).alias("offset")))

    def poll(self, group: str, assignment: DataFrame, most: int = 100) -> DataFrame:
        """The next messages of each partition that the group is assigned, from its commits."""
        mine = assignment.where(F.col("group_id") == group).select("group_id", *reads.PART)
        return self.hooks.deliver(reads.group_poll(self.rows(), mine, self.committed(group), most))

    def describe(self, members: DataFrame) -> DataFrame:
        ends = self.rows().groupBy(*reads.PART).agg((F.max("offset") + 1).alias("next"))
        return recovery.group_describe(self.committed(), ends, members)

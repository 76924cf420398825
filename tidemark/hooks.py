"""Functions that a program may put in: each takes and gives Columns or DataFrames, so that what it does stays in the plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hooks:
    """partitioner: batch -> partition column; validator: batch -> column, false rows are refused; assignor: (members, topics)
    -> assignment; dead_letter: batch -> column, true rows are dead letters; quota: batch -> column, false rows are over the quota;
    on_publish, on_deliver: called with the rows; compress and encrypt with their inverses: column -> column, on values."""

    partitioner: Callable[[DataFrame], Column] | None = None
    validator: Callable[[DataFrame], Column] | None = None
    assignor: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    dead_letter: Callable[[DataFrame], Column] | None = None
    quota: Callable[[DataFrame], Column] | None = None
    on_publish: list[Callable[[DataFrame], None]] = field(default_factory=list)
    on_deliver: list[Callable[[DataFrame], None]] = field(default_factory=list)
    encode: tuple[Callable[[Column], Column], ...] = ()
    decode: tuple[Callable[[Column], Column], ...] = ()

    def admit(self, batch: DataFrame) -> DataFrame:
        """batch with its partitions, without what is refused. A verdict of null refuses."""
        if self.partitioner:
            batch = batch.withColumn("partition", self.partitioner(batch).cast("int"))
        for check in (self.validator, self.quota):
            if check:
                batch = batch.where(F.coalesce(check(batch), F.lit(False)))
        for f in self.encode:
            batch = batch.withColumn("value", f(F.col("value")))
        return batch

    def deliver(self, rows: DataFrame) -> DataFrame:
        for f in self.decode:
            rows = rows.withColumn("value", f(F.col("value")))
        for f in self.on_deliver:
            f(rows)
        return rows

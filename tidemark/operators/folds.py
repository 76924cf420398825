"""Folds along each partition of the log, where what begins anew depends on what came before.

Rows stream through sorted batches; a partition is one state of a few numbers, never a list of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

PART = ["topic", "partition"]


def numbered(rows: DataFrame, judge: Callable[[], Callable[..., bool]], inputs: list[str], name: str, base: str | None = None) -> DataFrame:
    """rows with the number of their run, from 0 in each partition, and with ``base`` the offset that the run begins at.

    judge() makes a judge for a partition; it takes the inputs of each row after the first, in order of offset, and tells whether a
    run begins there. The first row begins one; the judge sees it too, and its answer is not asked for.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, first, begins = None, 0, None, None
        for batch in batches:
            runs, bases = [], []
            for topic, partition, offset, *values in zip(*(batch.column(c).to_pylist() for c in [*PART, "offset", *inputs])):
                if begins is None or (topic, partition) != part:
                    part, run, first, begins = (topic, partition), 0, offset, judge()
                    begins(*values)
                elif begins(*values):
                    run, first = run + 1, offset
                runs.append(run), bases.append(first)
            batch = batch.append_column(name, pa.array(runs, pa.int64()))
            yield batch.append_column(base, pa.array(bases, pa.int64())) if base else batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(*PART).sortWithinPartitions(*PART, "offset").mapInArrow(fold, f"{fields}, {name} long" + (f", {base} long" if base else ""))

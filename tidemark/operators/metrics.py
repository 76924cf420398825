"""Time-series functions over counters and latencies: increases with resets, rates, histograms and their quantiles, burn rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Upper bounds of the latency histogram in seconds; fixed values of the data model.
BUCKETS = (0.0005, 0.001, 0.002, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0)


def deltas(samples: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """samples with ``delta``, what each adds to its predecessor; after a reset all of it, for the first nothing."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(*order))
    return samples.withColumn("delta", F.when(before.isNull(), 0).when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value)))


def increase(samples: DataFrame, keys: list[str], order: list[str], value: str, seconds: int, start: Column | None = None) -> DataFrame:
    """Increase and rate a second of each counter in windows of so many seconds; ``start`` is a sample's window where its time does not give it."""
    rows = deltas(samples, keys, order, value)
    if start is None:
        start = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds) * seconds
    got = rows.groupBy(*keys, start.alias("window_s")).agg(F.sum("delta").cast("double").alias("increase"))
    return got.withColumn("rate", F.round(F.col("increase") / seconds, 9))


def sliding_rate(rows: DataFrame, keys: list[str], seconds: int, step: int) -> DataFrame:
    """Events a second in windows of ``seconds`` that begin each ``step``."""
    got = rows.groupBy(*keys, F.window("ts", f"{seconds} seconds", f"{step} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return got.select(*keys, F.unix_seconds(F.col("w.start").cast("timestamp")).alias("window_s"), "n", F.round(F.col("n") / F.lit(float(seconds)), 9).alias("rate"))


def histogram(rows: DataFrame, keys: list[str], value: Column, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative counts (keys, le, n), one pass; the last bound is infinity, given as null."""
    cols = [F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    got = rows.groupBy(*keys).agg(*cols, F.count(F.lit(1)).alias("all"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("n")))
    return got.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.le", "c.n")


def histogram_quantile(cells: DataFrame, keys: list[str], q: float) -> DataFrame:
    """The quantile by linear interpolation in the bucket that holds it; the highest finite bound if that is the last one."""
    w = W.partitionBy(*keys).orderBy(F.asc_nulls_last("le"))
    rows = cells.withColumn("_lo", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("_below", F.coalesce(F.lag("n").over(w), F.lit(0)))
    rows = rows.withColumn("_rank", q * F.max("n").over(W.partitionBy(*keys)))
    hit = rows.where((F.col("n") >= F.col("_rank")) & (F.col("_below") < F.col("_rank")))
    inside = F.col("_lo") + (F.col("le") - F.col("_lo")) * (F.col("_rank") - F.col("_below")) / (F.col("n") - F.col("_below"))
    return hit.groupBy(*keys).agg(F.round(F.min(F.coalesce(inside, F.col("_lo"))), 9).alias("quantile"))


def burn_rate(rows: DataFrame, keys: list[str], bad: Column, slo: float, seconds: int) -> DataFrame:
    """Share of bad events over the share that the objective allows, in windows of so many seconds."""
    start = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds) * seconds
    got = rows.groupBy(*keys, start.alias("window_s")).agg(F.count_if(bad).alias("bad"), F.count(F.lit(1)).alias("n"))
    return got.withColumn("burn", F.round(F.col("bad") / F.col("n") / F.lit(1 - slo), 9))


def error_rate(rows: DataFrame, bad: Column) -> DataFrame:
    return rows.agg(F.count_if(bad).alias("failed"), F.count(F.lit(1)).alias("total")).withColumn("error_rate", F.round(F.col("failed") / F.col("total"), 9))


def rebalances(diff: DataFrame) -> DataFrame:
    """How many partitions each kind of change concerns."""
    return diff.groupBy("change").agg(F.count(F.lit(1)).alias("partitions"))

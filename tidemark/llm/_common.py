"""Plumbing shared by the text operators: shared storage, skew-safe lookups, bounded memos."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast; each row is at most a few dozen bytes.
BROADCAST_ROWS = 200_000
#: Rows that an operator handles at once: bounds a worker's memory. Bytes of a batch are bounded by Spark's arrow.maxBytesPerBatch.
ARROW_ROWS, ARROW_BYTES = 1_000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see: spark.checkpoint.dir, or in a local session a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        app = spark.sparkContext.applicationId
        base = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def discard(*dfs: DataFrame | None) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_tidemark_path", None)
        if path:
            jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm_path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than it takes to tell."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its size, checked by counting, is within the bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, rows) else df


def attach_group(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: str, total: int, how: str = "left") -> DataFrame:
    """rows LEFT (or INNER) JOIN groups on key, where a few keys may hold most of the rows.

    ``groups`` has one row for each key with the number of its rows in ``size``. Keys with more than a
    ten-thousandth of ``total`` rows number at most 10,000, so they are broadcast; the rows of all other
    keys meet their group in a shuffle in which no key is heavy. Rows of heavy keys, and those without a key,
    take part in that shuffle with a second part of the key, made from ``spread``, and so are dealt evenly. (The second
    part of other keys is a hash of the key: were it a constant, the optimizer would shuffle by the first part alone.)
    """
    heavy = max(1_000, total // 10_000)
    cols = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > heavy).select(F.col(key).alias("_hot_key"), F.struct(*cols).alias("_hot"))
    cold = groups.where(F.col(size) <= heavy).select(F.col(key).alias("_cold_key"), F.xxhash64(F.col(key)).alias("_cold_spread"), F.struct(*cols).alias("_cold"))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    apart = F.col("_hot").isNotNull() | F.col(key).isNull()
    met = met.withColumn("_spread", F.when(apart, F.xxhash64(F.col(spread), F.lit(1))).otherwise(F.xxhash64(F.col(key))))
    met = met.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_spread") == F.col("_cold_spread")), "left")
    got = F.coalesce(F.col("_hot"), F.col("_cold"))
    if how == "inner":
        met = met.where(got.isNotNull())
    return met.select(*[c for c in rows.columns], *[got[c].alias(c) for c in cols])


def release() -> None:
    """Give back to the system what a task of this Python worker has freed: workers live on, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str, rows: int = ARROW_ROWS) -> DataFrame:
    """df.mapInArrow, with batches of at most so many rows, and of about ARROW_BYTES at most, handed to f."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = max(1, min(rows, batch.num_rows * ARROW_BYTES // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, some):
                yield batch.slice(at, some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(sliced(batches))
        release()

    return df.mapInArrow(run, schema)


class Memo:
    """A cache of bounded size for pure functions: two generations, of which the older is forgotten whole."""

    def __init__(self, size: int = 300_000):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        got = self.new.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def peek(self, key):
        """The value of key, if it is known; changes nothing."""
        got = self.new.get(key)
        return self.old.get(key) if got is None else got

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value

    def clear(self) -> None:
        self.new, self.old = {}, {}

    def fill(self, keys: Iterable, compute: Callable[[list], list]) -> dict:
        """A dictionary that has the values of keys, those not known computed all at once, until the next call."""
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = set(keys).difference(new)
        if old:
            new.update([(k, old[k]) for k in missing if k in old])
            missing.difference_update(new)
        if missing:
            rest = list(missing)
            new.update(zip(rest, compute(rest), strict=True))
        return new

    def values(self, keys: list, compute: Callable[[list], list]) -> list:
        """The value of each key, those not known computed all at once."""
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        got = list(map(self.new.get, keys))
        missing = [k for k, v in zip(keys, got) if v is None]
        if missing:
            new = self.fill(missing, compute)
            got = [new[k] if v is None else v for k, v in zip(keys, got)]
        return got


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo: the fixed folds of the labelled rows. A null key counts as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "utf-8")), F.lit(modulus))

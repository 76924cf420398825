"""The corpus pipeline: quality, exact and near duplicates, personal data, packing. Each stage takes what its predecessor kept.

All stages but the last return the columns of documents; the last returns the packed pieces. Rows are told apart by numbers,
not ids: of rows with one id, or with none, each is kept or dropped for its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, near_dedup, packing, pii, quality
from tidemark.llm._common import broadcast_if_small, discard, materialize, table

#: Rows up to which what is looked up or dropped is broadcast, 16 bytes each; beyond, they meet in a shuffle.
DROPPED_ROWS = 1_000_000
#: Words that a packing worker remembers within a task, and texts that it encodes at once: less than in packing alone, as the JVM
#: still holds what the stages before made it take, and the same workers serve the stages of the next run.
REMEMBERED, TEXTS = 100_000, 250


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number of its own for each row in ``_row``, written down so that it stays the same: ids may repeat or be null."""
    return materialize(docs.withColumn("_row", F.monotonically_increasing_id()), name)


def keep_best(rows: DataFrame, groups: DataFrame, *order: Column) -> DataFrame:
    """rows (numbered) with one row of each group: the first one by ``order``, then by hash of the text. groups: (row, group), the group being one of its rows."""
    others = groups.where("row <> group")
    members = materialize(others.union(others.select(F.col("group").alias("row"), "group").distinct()), "pipeline-members")
    ranked = rows.select(F.col("_row").alias("row"), F.struct(*order, F.xxhash64("text"), F.col("_row").alias("row")).alias("rank"))
    best = ranked.join(broadcast_if_small(members, DROPPED_ROWS), "row").groupBy("group").agg(F.min("rank").alias("best")).select(F.col("best.row").alias("row"))
    dropped = materialize(members.select("row").join(best, "row", "left_anti"), "pipeline-dropped")
    discard(members)
    return rows.join(broadcast_if_small(dropped, DROPPED_ROWS), rows["_row"] == dropped["row"], "left_anti").drop("_row")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts the row that op3 prefers: the longest original, then a null id, then the smallest."""
    rows = numbered(docs, "pipeline-exact-rows")
    found = materialize(exact_dedup.exact_dedup(rows, "_row").select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group")), "pipeline-exact")
    return keep_best(rows, found, -F.length(F.coalesce("text", F.lit(""))), F.col("doc_id"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row that op4 prefers: the smallest id, a null one last. Every row is a document of its own."""
    rows = numbered(docs, "pipeline-near-rows")
    found = materialize(near_dedup.near_dedup(rows, "_row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), "pipeline-near")
    return keep_best(rows, found, F.col("doc_id").isNull(), F.col("doc_id"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs, remembered=REMEMBERED, rows=TEXTS, forget=True)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: A learned classifier, tokens and packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

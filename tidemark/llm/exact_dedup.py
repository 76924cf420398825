"""Exact deduplication in two passes: a Bloom filter of possibly repeated hashes, then a shuffle of those rows only.

Pass one sets two bits for each text's hash and keeps the bits that were set more than once: the filter of
hashes that may repeat. Pass two tests every row against it. Rows that fail the test have a text of their own
and pass straight through; only the rest are shuffled, and they are grouped by the whole SHA-256, so a false
alarm of the filter costs a little traffic and never a wrong result. The filter is a table of 4 KB blocks whose
number is bounded by a parameter; with more rows than that bound is made for, more rows are shuffled and the
result stays exact. Everything is DataFrame functions.

Cases: a null text counts as empty; empty texts are equal to each other and to texts of white space alone. Of
equal texts the longest original in code points stays, then the smallest doc_id; a null doc_id sorts first.
Rows that repeat a doc_id each count in group_size, and each of them is kept if that doc_id is. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import attach_group, discard, materialize

#: What a text is compared without.
SPACES = " \t\n\x0b\x0c\r"
#: Bits of the filter for each row, and at most: 2**28 bits are 32 MB.
BITS_PER_ROW, MAX_BITS = 16, 1 << 28
BLOCK = 32_768


def normalized(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n"), F.unhex(F.sha2(F.encode(normalized(text), "utf-8"), 256)).alias("sha"))


def _slots(bits: int) -> list[Column]:
    """The bits of a hash: two, from different parts of it."""
    return [F.pmod(F.conv(F.substring(F.hex("sha"), at, 15), 16, 10).cast("long"), F.lit(bits)) for at in (1, 17)]


def repeated_filter(rows: DataFrame, bits: int) -> DataFrame:
    """Blocks (block, bitmap) of the bits that more than one row sets."""
    slots = rows.select(F.explode(F.array(*_slots(bits))).alias("slot"))
    twice = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy(F.expr("bitmap_bucket_number(slot)").alias("block")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bitmap"))


def _set(bitmap: Column, slot: Column) -> Column:
    """Whether the block has the bit of slot; there is no block where none of its bits is set."""
    at = F.expr(f"bitmap_bit_position({slot})") if isinstance(slot, str) else slot
    octet = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(octet, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))


def possibly_repeated(rows: DataFrame, blocks: DataFrame, bits: int) -> DataFrame:
    """rows with ``maybe``: whether all bits of the hash are in the filter. blocks has at most bits / 32768 rows, so it is broadcast."""
    out = rows
    for i, slot in enumerate(_slots(bits)):
        out = out.withColumn(f"_s{i}", slot)
        b = blocks.select(F.col("block").alias(f"_b{i}"), F.col("bitmap").alias(f"_m{i}"))
        out = out.join(F.broadcast(b), F.expr(f"bitmap_bucket_number(_s{i})") == F.col(f"_b{i}"), "left")
    tests = [_set(F.col(f"_m{i}"), f"_s{i}") for i in range(2)]
    return out.select(*rows.columns, (tests[0] & tests[1]).alias("maybe"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs."""
    rows = materialize(digests(docs, id_col, text_col), "exact-digests")
    total = rows.count()
    bits = BLOCK
    while bits < min(max_bits, BITS_PER_ROW * total):
        bits *= 2
    blocks = materialize(repeated_filter(rows, bits), "exact-filter")
    tested = materialize(possibly_repeated(rows, blocks, bits), "exact-tested")
    discard(rows, blocks)
    maybe = tested.where("maybe").drop("maybe")
    groups = maybe.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id"))).alias("best"))
    groups = groups.select("sha", "group_size", F.col("best.doc_id").alias("keep_id"))
    repeats = groups.where("group_size > 1")
    met = attach_group(maybe, repeats, "sha", "group_size", "doc_id", total)
    single = F.col("group_size").isNull()
    met = met.select("doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "sha")
    alone = tested.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    return alone.unionByName(met).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

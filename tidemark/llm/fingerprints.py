"""Document fingerprints: Merkle trees over sections, paragraphs and pieces of paragraphs.

A line is a paragraph; a blank line ends a section, and so does a paragraph that its digest chooses, one in 16, so that a
long text without blank lines has sections too; parts of sentences, of a few words each, that end at words chosen by
their hash, are the leaves. Each node's digest is made of its children's, so equal roots mean equal texts, and where two
roots differ the digests show which sections, paragraphs and pieces do. A fingerprint is the tree in a string:
``root/section:paragraph,leaves.paragraph,leaves/section:...``, 8 hexadecimal digits a section or paragraph, 6 a leaf. The likeness of
two fingerprints is 1 for equal roots, else the share of leaves that both have (Dice, as multisets), found by descent:
sections, then paragraphs, that are equal on both sides are taken whole and not looked into.

The edited text of the contract needs the next document in order of id. Ids are dealt into ranges; each range's first
row is also sent to the range before it (the very first row to the last range). So each text is shuffled once, and a task
holds two rows at a time.

Cases: a null or empty text has a root of its own and no leaves; two of them have likeness 1, one and a text 0. Rows
that share an id follow each other in order of their texts; a null id comes first. A single row is followed by itself.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow

LEAF_DIGITS = 6
#: Sentences are cut at words that their hash chooses, one in so many, or after so many words or characters.
CHOSEN, MOST_WORDS, LONGEST = 4, 6, 480
#: Bytes of text in a range of ids, about: there are more ranges where the table is larger.
RANGE_BYTES = 64 << 20
#: Paragraphs that end a section by their digest: one in so many.
SECTION = 16
_SENTENCE = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+")
_WORD = re.compile(r"\S*\s*")


def leaves(paragraph: str) -> list[str]:
    """The pieces of a paragraph; together they are the paragraph."""
    out = []
    for piece in _SENTENCE.findall(paragraph):
        start = at = words = 0
        for word in _WORD.findall(piece):
            at += len(word)
            words += 1
            while at - start > LONGEST:
                out.append(piece[start : start + LONGEST])
                start += LONGEST
            if at > start and (words == MOST_WORDS or zlib.crc32(word.encode()) % CHOSEN == 0):
                out.append(piece[start:at])
                start, words = at, 0
        if start < len(piece):
            out.append(piece[start:])
    return out


class Tree:
    """root: hexadecimal digest; sections: (digest, paragraphs), each paragraph (digest, list of leaf digests)."""

    __slots__ = ("root", "sections")

    def __init__(self, text: str):
        import xxhash

        leaf, node = xxhash.xxh3_128_digest, hashlib.blake2b
        self.sections, digests = [], []
        paragraphs, whole = [], []

        def close() -> None:
            digest = node(b"".join(whole), digest_size=16)
            digests.append(digest.digest())
            self.sections.append((digest.hexdigest()[:8], list(paragraphs)))
            paragraphs.clear(), whole.clear()

        for line in text.split("\n") if text else []:
            got = [leaf(p) for p in leaves(line)]
            digest = node(b"".join(got), digest_size=16).digest()
            paragraphs.append((digest[:4].hex(), [d[:3].hex() for d in got]))
            whole.append(digest)
            if digest[-1] % SECTION == 0 or not line.strip():
                close()
        if paragraphs:
            close()
        self.root = node(b"".join(digests), digest_size=16).hexdigest()

    def __str__(self) -> str:
        return "/".join([self.root, *(f"{digest}:{'.'.join(f'{d},{"".join(p)}' for d, p in paragraphs)}" for digest, paragraphs in self.sections)])


def parse(fingerprint: str) -> Tree:
    out = Tree.__new__(Tree)
    out.root, *sections = fingerprint.split("/")
    cut = lambda p: (p[:8], [p[i : i + LEAF_DIGITS] for i in range(9, len(p), LEAF_DIGITS)])
    out.sections = [(s[:8], [cut(p) for p in s[9:].split(".")]) for s in sections]
    return out


def _apart(a: list[tuple], b: list[tuple]) -> tuple[list, list, list]:
    """Nodes that both sides have (by digest, as often as both do), and those that only a and only b have."""
    left, both, only_b = Counter(n[0] for n in a), [], []
    for n in b:
        if left[n[0]] > 0:
            left[n[0]] -= 1
            both.append(n)
        else:
            only_b.append(n)
    only_a = []
    for n in reversed(a):
        if left[n[0]] > 0:
            left[n[0]] -= 1
            only_a.append(n)
    return both, only_a[::-1], only_b


def likeness(a: Tree, b: Tree) -> float:
    if a.root == b.root:
        return 1.0
    leaves_of = lambda ps: sum(len(p[1]) for p in ps)
    total = sum(leaves_of(s[1]) for t in (a, b) for s in t.sections)
    if not total:
        return 0.0
    same, mine, yours = _apart(a.sections, b.sections)
    both = sum(leaves_of(s[1]) for s in same)
    same, mine, yours = _apart([p for s in mine for p in s[1]], [p for s in yours for p in s[1]])
    both += leaves_of(same)
    mine, yours = (Counter(x for p in side for x in p[1]) for side in (mine, yours))
    return min(1.0, 2 * (both + sum((mine & yours).values())) / total)


def differing(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """(section, paragraph) of a whose digests b does not have: where the edits are. Equal sections are not looked into."""
    if a.root == b.root:
        return []
    have = {s[0] for s in b.sections}
    paragraphs = {p[0] for s in b.sections for p in s[1]}
    return [(i, j) for i, s in enumerate(a.sections) if s[0] not in have for j, p in enumerate(s[1]) if p[0] not in paragraphs]


def edited(text: str, following: str) -> str:
    """text, its last quarter (rounded down) replaced by as much of the following one's beginning."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, ahead, doc_id, text): parts in order of ids, each followed, as ``ahead``, by the row that comes after its last one."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    bounds = sorted({int(b) for b in rows.select(key.cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    part = F.array_size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= key)) if len(bounds) <= 64 else None
    if part is None:  # many bounds: halve the search with a nested choice
        def choose(lo: int, hi: int):
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(key >= F.lit(bounds[mid]), choose(mid + 1, hi)).otherwise(choose(lo, mid))

        part = choose(0, len(bounds))
    rows = rows.withColumn("part", (part if bounds else F.lit(0)).cast("int"))
    heads = sorted((r["part"], r["k"]) for r in rows.groupBy("part").agg(F.min(key).alias("k")).collect())  # a row for each range
    before = spark.createDataFrame([(k, heads[i - 1][0]) for i, (_, k) in enumerate(heads)], "k long, prior int")
    rows = rows.withColumn("k", key).join(F.broadcast(before), "k", "left")
    here, there = F.struct("part", F.lit(0).alias("ahead")), F.struct(F.col("prior").alias("part"), F.lit(1).alias("ahead"))
    rows = rows.withColumn("to", F.explode(F.when(F.col("prior").isNotNull(), F.array(here, there)).otherwise(F.array(here))))
    rows = rows.select("to.part", "to.ahead", "k", "doc_id", "text").repartition(parts, "part")
    return rows.sortWithinPartitions("part", "ahead", "k", "text").select("part", "ahead", "doc_id", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_paragraphs), one row for each row of docs.

    edited_paragraphs: how many paragraphs of the edited text the text does not have.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # part, id, text, tree of the row that waits for the next one
        for batch in batches:
            out = []
            for part, ahead, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if ahead and before is None:
                    continue
                tree = Tree(text)
                if before is not None:
                    _, own_id, own, own_tree = before
                    new = edited(own, text)
                    new_tree = Tree(new) if new != own else own_tree
                    out.append((own_id, len(own), hashlib.sha256(new.encode()).hexdigest(), str(own_tree), str(new_tree), likeness(own_tree, new_tree), likeness(own_tree, tree), len(differing(new_tree, own_tree))))
                before = None if ahead else (part, doc_id, text, tree)
            columns = list(zip(*out)) or [[]] * 8
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_paragraphs"])

    return map_arrow(with_next(docs, id_col, text_col), made, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_paragraphs int")

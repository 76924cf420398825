"""Near-duplicates by a chosen-path set similarity join over minwise tokens.

Documents with equal sets of shingles are one vertex. A vertex carries ``POSITIONS`` minwise tokens of its set. Each
of ``trees`` independent trees starts with all vertices in its root; a node chooses one or two of the positions (4/3
on average, the inverse of the similarity sought, which keeps a pair at the threshold alive from level to level) and
sends each vertex to the child of its token there. Which positions a node chooses depends on its path alone, so
vertices find their nodes by themselves and nodes of one vertex are dropped in the first shuffle.

Small nodes, of up to ``limit`` vertices, are compared exhaustively by a task that holds the node: set sizes and
minwise tokens of all its vertices. What it gives out is linear: first each vertex's likeliest partner in another
component, then some; those are confirmed on the full sets, which joins components, and nodes whose vertices are in one component are
done. At last the vertices that still have likely partners in other components meet again with their full sets, all
likely pairs are confirmed there, and a forest of links comes out. Sets too long to travel are confirmed pair by pair.
Large nodes branch on until they are small or done; at each level their vertices are first dealt into random blocks
of about half of ``limit``, each giving its likeliest partners in the block, so that a group of many near copies becomes one
component in few turns, without a vertex that all others must meet. A vertex has partners only in its own blocks, so
no key of these joins is heavy. Nothing is capped.

Pairs whose set sizes or minwise tokens rule them out (more than four standard deviations below the threshold) are
dropped; all others are confirmed on the full sets. A pair at the threshold survives one tree of depth 4 with
probability 0.53, so 16 trees miss it with about 5 in a million; of depth 8 with 0.37 (6 in 10,000), of depth 16 with
0.23 (14 in 1,000); more similar pairs are missed more rarely. Only nodes that are still large and apart go deeper than 4.

Cases: a null or empty text, or one without words, has an empty set and is linked with nothing. With fewer words than
a shingle the whole sequence is the one shingle. Rows that share an id act as one document with all their sets; rows
with a null id form links only through copies that have one. An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import attach_group, broadcast_if_small, discard, map_arrow, materialize

WORDS, PERCENT = 5, 75
POSITIONS, TREES, DEPTH, LIMIT = 128, 16, 4, 1024
#: Partners that a vertex of a small node has confirmed in each turn (below the first level in the first turn alone), before a node that is still apart is settled on its full sets.
TURNS = (1, 8)
#: Shingles of a set that travels to its nodes as it is (32 KB), and distinct shingles that a task holds as bits at once.
WHOLE, STRETCH = 4096, 1 << 14
#: Standard deviations below the threshold up to which tokens do not rule a pair out.
DEVIATIONS = 4
#: Children of a vertex at each level, on average.
BRANCHES = 4 / 3
#: Vertices up to which their ids are broadcast to fetch their sets: 16 bytes each.
FETCH_ROWS = 1_000_000
_RNG = np.random.default_rng(5)
_ODD = (_RNG.integers(1, 1 << 63, WORDS + 2, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_A = (_RNG.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RNG.integers(1, 1 << 63, POSITIONS, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that makes them look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of the whole text as sorted 64-bit hashes."""
    import xxhash

    parts = (text or "").encode().lower().split()  # of bytes: A-Z, and white space in \x20 \x09-\x0D
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), 1)], np.uint64)
    h = xxhash.xxh64_intdigest
    w = np.fromiter(map(h, parts), np.uint64, len(parts))
    n = len(w) - words + 1
    s = np.zeros(n, np.uint64)
    for i in range(words):
        s = (s + w[i : i + n]) * _ODD[i]
    return np.unique(mix(s))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """POSITIONS tokens of 16 bits; two sets agree at each with the probability of their Jaccard similarity."""
    least = np.full(POSITIONS, np.uint64(1 << 63), np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, ((shingles[at : at + 2048, None] * _A + _B) >> np.uint64(1)).min(0))
    return (mix(least) >> np.uint64(48)).astype("<u2")


def branch(nodes: np.ndarray, rows: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of each (node, row): one, and for a third of the nodes a second at another position."""
    h = mix(nodes ^ np.uint64(0x9E3779B97F4A7C15))
    p1 = ((h & np.uint64(0xFFFF)) % np.uint64(POSITIONS)).astype(np.int64)
    p2 = (p1 + 1 + ((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64) % (POSITIONS - 1)) % POSITIONS
    two = (h >> np.uint64(40)) % np.uint64(3) == 0
    child = lambda n, r, p: mix(n * _ODD[-1] + (p.astype(np.uint64) << np.uint64(16) | tokens[r, p].astype(np.uint64)))
    return np.concatenate([child(nodes, rows, p1), child(nodes[two], rows[two], p2[two])]), np.concatenate([rows, rows[two]])


def shingle_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, key, tokens): size of the set, what equal sets share, and its minwise tokens (null for empty sets)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            tokens = [minwise(s) if len(s) else None for s in sets]
            tokens = pa.array([None if t is None else t.tobytes() for t in tokens], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), tokens], ["doc_id", "n", "key", "tokens"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return map_arrow(rows, made, "doc_id long, n long, key binary, tokens binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, POSITIONS)


def grow(vertices: DataFrame, levels: int, trees: int = 0) -> DataFrame:
    """(node, vertex): the nodes that (vertex, tokens), or (node, vertex, tokens) where trees is 0, reach after so many levels."""

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, every = _matrix(batch.column("tokens")), np.arange(batch.num_rows)
            vertex = batch.column("vertex").to_numpy()
            if trees:
                starts = [(np.full(len(every), mix(np.array([t + 1], np.uint64))[0]), every) for t in range(trees)]
            else:
                starts = [(batch.column("node").to_numpy().view(np.uint64), every)]
            for nodes, rows in starts:
                for _ in range(levels):
                    nodes, rows = branch(nodes, rows, tokens)
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(vertex[rows])], ["node", "vertex"])

    return map_arrow(vertices, grown, "node long, vertex long")


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches of rows sorted by block, dealt anew so that no block is cut in two. A block is small."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        block = table.column("block").to_numpy()
        last = int(np.searchsorted(block, block[-1]))  # sorted by the same signed number
        if last:
            yield table.slice(0, last)
        held = table.slice(last)
    if held is not None:
        yield held


def _likely(tokens: np.ndarray, label: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """For blocks (g, m) of vertices: how many minwise tokens each two share, -1 where they are in one component or sizes or tokens rule them out."""
    share = percent / 100
    need = POSITIONS * (share - DEVIATIONS * (share * (1 - share) / POSITIONS) ** 0.5)
    same = np.stack([(tokens == tokens[:, j : j + 1]).sum(2, dtype=np.int16) for j in range(tokens.shape[1])], 1)
    least, most = np.minimum(n[:, :, None], n[:, None, :]), np.maximum(n[:, :, None], n[:, None, :])
    same[(label[:, :, None] == label[:, None, :]) | (least * 100 < most * percent) | (same < need)] = -1
    return same


def nearest(few: DataFrame, best: int, percent: int = PERCENT) -> DataFrame:
    """(block, a, b, same): for each vertex of a block its likeliest partners in other components, as many as ``best``, or one where not ``every``.

    few: (block, vertex, l, n, tokens, every). All vertices of a block are compared, by set sizes and minwise tokens.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _nodes(batches):
            block, vertex, label, n, every = (table.column(c).to_numpy() for c in ("block", "vertex", "l", "n", "every"))
            tokens = _matrix(table.column("tokens"))
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(block)]]))
            for m in np.unique(sizes[sizes > 1]).tolist():
                of_size, step = starts[sizes == m], max(1, 8_000 // (m * m))
                for at in range(0, len(of_size), step):
                    rows = of_size[at : at + step, None] + np.arange(m)
                    same = _likely(tokens[rows], label[rows], n[rows], percent)
                    order = np.argsort(-same, axis=2, kind="stable")[:, :, :best]
                    got = np.take_along_axis(same, order, 2)
                    got[:, :, 1:][~every[rows]] = -1
                    g, i, j = np.nonzero(got >= 0)
                    if len(g):
                        yield pa.RecordBatch.from_arrays([pa.array(block[rows[g, i]]), pa.array(vertex[rows[g, i]]), pa.array(vertex[rows[g, order[g, i, j]]]), pa.array(got[g, i, j].astype(np.int32))], ["block", "a", "b", "same"])

    dealt = few.repartition("block").sortWithinPartitions("block", "vertex")
    return map_arrow(dealt, compared, "block long, a long, b long, same int")


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] and sets[right], in stretches of the elements, as bits."""
    lengths = np.array([len(s) for s in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), lengths)
    out = np.zeros(len(left), np.int64)
    for lo in range(0, len(values), STRETCH):
        width = min(STRETCH, len(values) - lo)
        here = (at >= lo) & (at < lo + width)
        has = np.zeros((len(sets), -(-width // 64) * 64), bool)
        has[owner[here], at[here] - lo] = True
        bits = np.packbits(has, axis=1).view(np.uint64)
        for k in range(0, len(left), 4096):
            some = slice(k, k + 4096)
            out[some] += np.bitwise_count(bits[left[some]] & bits[right[some]]).sum(1, dtype=np.int64)
    return out


def _forest(edges: list[tuple[int, int]], labels: list[int]) -> list[tuple[int, int]]:
    """The edges that join components, given by labels, or what edges before have joined."""
    parent = {l: l for l in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in edges:
        a, b = root(labels[i]), root(labels[j])
        if a != b:
            parent[a] = b
            out.append((i, j))
    return out


def settled(few: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, sure): links that join the components of each block, confirmed on the full sets.

    few: (block, vertex, l, n, tokens, shingles). Where a set is too long to travel, shingles is null; likely pairs with such a set come out not sure.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _nodes(batches):
            block, vertex, label, n = (table.column(c).to_numpy() for c in ("block", "vertex", "l", "n"))
            tokens = _matrix(table.column("tokens"))
            sets = table.column("shingles").combine_chunks()
            whole = sets.is_valid().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist()
            out = []
            for lo, hi in zip(starts, [*starts[1:], len(block)]):
                if label[lo:hi].min() == label[lo:hi].max():
                    continue
                i, j = np.nonzero(np.triu(_likely(tokens[None, lo:hi], label[None, lo:hi], n[None, lo:hi], percent)[0] >= 0))
                known = whole[lo + i] & whole[lo + j]
                out += [(vertex[lo + x], vertex[lo + y], False) for x, y in zip(i[~known], j[~known])]
                i, j = i[known], j[known]
                if not len(i):
                    continue
                used = np.unique(np.concatenate([i, j]))
                both = shared_counts([np.asarray(sets[lo + int(x)].values) for x in used], np.searchsorted(used, i), np.searchsorted(used, j))
                linked = both * 100 >= (n[lo + i] + n[lo + j] - both) * percent
                edges = list(zip(i[linked].tolist(), j[linked].tolist()))
                out += [(vertex[lo + x], vertex[lo + y], True) for x, y in _forest(edges, label[lo:hi].tolist())]
            if out:
                a, b, sure = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure, pa.bool_())], ["a", "b", "sure"])

    dealt = few.repartition("block").sortWithinPartitions("block", "vertex")
    return map_arrow(dealt, compared, "a long, b long, sure boolean").distinct()


def full_sets(docs: DataFrame, vertices: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(vertex, shingles) for some vertices, made again from their texts."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vertex"), pa.array(sets, pa.list_(pa.int64()))], ["vertex", "shingles"])

    texts = docs.select(docs[id_col].cast("long").alias("vertex"), docs[text_col].alias("text"))
    return map_arrow(texts.join(broadcast_if_small(vertices, FETCH_ROWS), "vertex", "left_semi"), made, "vertex long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The (a, b) whose full sets are similar enough."""
    left, right = (sets.select(F.col("vertex").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab")
    met = pairs.join(right, "b").join(left, "a")
    both, sizes = F.size(F.array_intersect("s_a", "s_b")), F.size("s_a") + F.size("s_b")
    return met.select("a", "b", both.alias("both"), (sizes - both).alias("either")).where(F.col("both") * 100 >= F.col("either") * percent).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, l): for each vertex of the links (a, b) the smallest vertex it can reach.

    Takes the least label of the neighbours, then that label's label, until nothing changes. Vertices of many links and
    labels of many vertices are heavy keys, and meet their rows by ``attach_group``.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    edges = both.count()
    now = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")).select("v", F.least("v", "m").alias("l"), "degree"), "labels")
    while True:
        met = attach_group(both, now.select(F.col("v").alias("b"), "l", "degree"), "b", "degree", "a", edges)
        near = met.groupBy("a").agg(F.min("l").alias("m"))
        step = now.join(near, F.col("v") == F.col("a")).select("v", F.col("l").alias("old"), F.least("l", "m").alias("l"), "degree")
        step = materialize(step, "labels-step")
        sizes = step.groupBy("l").agg(F.count(F.lit(1)).alias("size"))
        jump = sizes.join(now.select(F.col("v").alias("l"), F.col("l").alias("far")), "l")
        new = attach_group(step, jump, "l", "size", "v", edges).select("v", "old", F.least("l", F.coalesce("far", "l")).alias("l"), "degree")
        new = materialize(new, "labels")
        changed = new.where("l <> old").limit(1).count()
        discard(now, step)
        now = new.select("v", "l", "degree")
        now._tidemark_path = new._tidemark_path
        if not changed:
            discard(both)
            out = now.select("v", "l")
            out._tidemark_path = now._tidemark_path
            return out


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (v, l) after new links (a, b) between vertices; a vertex without a row is its own label."""
    if labels is None:
        return components(links)
    end = lambda x: links.join(labels.select(F.col("v").alias(x), F.col("l").alias(f"l{x}")), x, "left").select("a", "b", F.coalesce(f"l{x}", x).alias(f"l{x}"))
    lifted = end("a").join(end("b"), ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b")
    top = components(lifted)
    sizes = labels.groupBy("l").agg(F.count(F.lit(1)).alias("size"))
    far = sizes.join(top.select(F.col("v").alias("l"), F.col("l").alias("far")), "l")
    known = attach_group(labels, far, "l", "size", "v", labels.count()).select("v", F.coalesce("far", "l").alias("l"))
    fresh = top.join(labels, "v", "left_anti").select("v", "l")
    out = materialize(known.unionByName(fresh), "labels")
    discard(labels, top)
    return out


def _labelled(rows: DataFrame, labels: DataFrame | None, col: str, out: str) -> DataFrame:
    if labels is None:
        return rows.withColumn(out, F.col(col))
    found = labels.select(F.col("v").alias(col), F.col("l").alias("_l"))
    return rows.join(found, col, "left").withColumn(out, F.coalesce("_l", col)).drop("_l")


def _shared(rows: DataFrame, total: int) -> DataFrame:
    """(node, vertex, m) for nodes of several vertices, m being their number. total: rows, about."""
    nodes = rows.groupBy("node").agg(F.min("vertex").alias("_min"), F.max("vertex").alias("_max"), F.count(F.lit(1)).alias("m")).where("_min <> _max").select("node", "m")
    return materialize(attach_group(rows, nodes, "node", "m", "vertex", total, "inner"), "near-members")


def _torn(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(node, vertex, m, l) for nodes whose vertices are not all in one component."""
    known = materialize(_labelled(members.select("node", "vertex"), labels, "vertex", "l"), "near-known")
    nodes = known.groupBy("node").agg(F.min("l").alias("lo"), F.max("l").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("node", "m")
    out = materialize(attach_group(known, nodes, "node", "m", "vertex", known.count(), "inner"), "near-members")
    discard(known, members)
    return out


def links_of(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, percent: int = PERCENT, trees: int = TREES, limit: int = LIMIT, whole: int = WHOLE) -> DataFrame | None:
    """Labels (v, l) of the vertices that have links; None if there are none."""
    members = _shared(grow(reps.select("vertex", "tokens"), DEPTH, trees), int(reps.count() * trees * BRANCHES**DEPTH))
    sets = materialize(full_sets(docs, members.select("vertex").distinct(), id_col, text_col), "near-sets")
    labels, tested, level = None, None, 0

    def confirm(labels: DataFrame | None, pairs: DataFrame, sure: DataFrame | None = None) -> DataFrame | None:
        """labels after the pairs (a, b) that have not been tested yet are, and after those that are sure."""
        nonlocal tested
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "near-pairs")
        if sure is None and not pairs.limit(1).count():
            discard(pairs)
            return labels
        links = confirmed(pairs, sets, percent)
        links = materialize(links if sure is None else links.union(sure), "near-links")
        if links.limit(1).count():
            labels = merged(labels, links)
        before, tested = tested, materialize(pairs if tested is None else tested.union(pairs), "near-tested")
        discard(pairs, before, links)
        return labels

    while True:
        found = None
        for turn, best in enumerate(TURNS if not level else TURNS[:1]):
            members = _torn(members, labels)
            small = F.col("m") <= limit
            block = F.when(small, F.col("node")).otherwise(F.xxhash64("node", F.pmod(F.xxhash64("vertex", F.lit(8 * level + turn)), F.ceil(F.col("m") * 2 / limit).cast("long"))))
            few = members.select(block.alias("block"), "vertex", "l", small.alias("every")).join(reps.select("vertex", "n", "tokens"), "vertex")
            discard(found)
            found = materialize(nearest(few, best, percent), "near-found")
            pairs = found.groupBy("a", "b").agg(F.first("same").alias("same"))
            rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("same"), "b"))
            labels = confirm(labels, pairs.withColumn("rank", rank).where(F.col("rank") <= best).select("a", "b"))
        members = _torn(members, labels)
        likely = found.select(F.col("block").alias("node"), F.col("a").alias("vertex")).distinct()
        left = members.where(F.col("m") <= limit).select("node", "vertex", "l").join(likely, ["node", "vertex"], "left_semi")
        small_sets = sets.where(F.size("shingles") <= whole)
        few = left.withColumnRenamed("node", "block").join(reps.select("vertex", "n", "tokens"), "vertex").join(small_sets, "vertex", "left")
        got = materialize(settled(few, percent), "near-settled")
        labels = confirm(labels, got.where("not sure").select("a", "b"), got.where("sure").select("a", "b"))
        large = members.where(F.col("m") > limit)
        count = large.count()
        discard(found, got)
        if not count:
            discard(members, tested, sets)
            return labels
        below = grow(large.select("node", "vertex").join(reps.select("vertex", "tokens"), "vertex"), 1)
        below = _shared(below, int(count * BRANCHES))
        discard(members)
        members, level = below, level + 1


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, trees: int = TREES, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs."""
    rows = materialize(shingle_rows(docs, id_col, text_col), "near-rows")
    groups = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("vertex"), F.min_by("tokens", "doc_id").alias("tokens"), F.first("n").alias("n"), F.count(F.lit(1)).alias("size"))
    groups = materialize(groups, "near-groups")
    reps = groups.where("vertex is not null")
    labels = links_of(docs, reps, id_col, text_col, percent, trees, limit)
    found = _labelled(groups.select("key", "vertex", "size"), labels, "vertex", "component_id").select("key", "size", "component_id")
    met = attach_group(rows.select("doc_id", "n", "key"), found, "key", "size", "doc_id", rows.count())
    component = F.coalesce("component_id", "doc_id")
    return met.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 4], ' ') END AS g
  FROM w, unnest(range(1, greatest(2, len(words) - 3))) AS t(i)
  WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(u) AS component_id FROM r GROUP BY v) c ON c.v = d.doc_id
"""

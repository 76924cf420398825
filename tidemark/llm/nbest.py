"""N-best segmentation into the pieces of a SentencePiece vocabulary, and decoding.

The lattice of a text has a node for each position and an edge for each piece that stands there; characters in no
piece are edges of byte pieces. A piece's score is its log-probability: its share of all pieces when the library segments the
words of all documents, half a count added to each (the vocabulary's own scores are ranks of merges, which do not add
up). A forward Viterbi pass gives the best score from the start to each node. The N best paths are found from the
end by A*, for which those scores are the exact rest: it never expands a path that is not among the best.

No piece has a blank behind another character, so all paths pass each position before a blank that stands behind a
character that is not one, and the lattice falls apart into words there. The forward pass keeps the two best scores, so
each word's best path is known and how much its second best is worse. The N best paths of a whole text differ from its
best one only in words that are among the N - 1 with the smallest such losses; A* runs in those, and a heap joins
their alternatives. Words of a batch go through the forward pass together, position by position, in columns; words of more
than WIDE characters, or with rare characters, go alone. Words met before are remembered, within a bound.

As in the library, a text gets a blank in front and blanks are written as U+2581; that character itself in a text, like
all that have no piece, is written in bytes, so each path decodes to the text. Ties in score go to the longer last piece.

Cases: a null or empty text has one path, without pieces, of score 0. Texts with fewer than N paths give those they
have. Copies get equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Memo, map_arrow
from .token_counts import vocabulary_path

VOCABULARY, BEST = "piece_bpe_32k.model", 4
BLANK = "▁"
#: Characters of a word that goes through the forward pass in columns, by bands, and characters that have columns in its trie.
BANDS, COLUMNS = (8, 12, 16, 24, 32), 250
WIDE = BANDS[-1]
#: Words of the forward pass at a time, and rows of a batch.
TOGETHER, ROWS = 100_000, 4_000
_LOADED: dict[tuple, Pieces] = {}


def library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Pieces:
    """A vocabulary with scores by id. Pieces are kept with a blank for U+2581; byte pieces apart."""

    def __init__(self, path: str, scores: np.ndarray):
        sp = library(path)
        self.edges, self.byte_ids, self.text = {}, {}, {}
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
                piece = piece.replace(BLANK, " ")
                self.edges[piece] = float(scores[i]), i
                self.text[i] = piece.encode()
        self.scores = np.asarray(scores, np.float64)
        for c in map(chr, range(128)):  # a byte piece is an edge like another where it is a whole character
            if c not in self.edges:
                self.edges[c] = float(scores[self.byte_ids[ord(c)]]), self.byte_ids[ord(c)]
        self.longest = max(map(len, self.edges))
        if any(" " in p.lstrip(" ") for p in self.edges):
            raise ValueError("a piece spans a word's end; this vocabulary has no words to cut at")
        text = [self.text.get(i, b"") for i in range(sp.vocab_size())]
        self.pool, self.size = np.frombuffer(b"".join(text), np.uint8), np.array(list(map(len, text)))
        self.first = np.cumsum(self.size) - self.size
        self.memo, self.paths = Memo(), {}
        self._trie()

    def _trie(self) -> None:
        """next_[node, column of a character]: the node below, 0 where there is none; piece[node]: the piece that ends there, or -1. Node 1 is the root."""
        common = [c for c, _ in Counter(chain.from_iterable(self.edges)).most_common() if c in self.edges and ord(c) >= 128][: COLUMNS - 128]
        common = [*map(chr, range(128)), *common]
        self.column = {c: k + 1 for k, c in enumerate(common)}
        self.codes = np.zeros(max(map(ord, common), default=0) + 2, np.uint8)
        for c, k in self.column.items():
            self.codes[ord(c)] = k
        below, ends = [None, {}], [-1, -1]
        for piece, (_, i) in self.edges.items():
            node = 1
            for c in piece:
                k = self.column.get(c)
                if k is None:
                    break
                at = below[node].get(k)
                if at is None:
                    below[node][k] = at = len(below)
                    below.append({}), ends.append(-1)
                node = at
            else:
                ends[node] = i
        inner = [node for node, has in enumerate(below) if has]
        number = np.zeros(len(below), np.int32)  # nodes with others below come first, so that only those need a row
        number[inner] = np.arange(1, len(inner) + 1)
        number[1:][number[1:] == 0] = np.arange(len(inner) + 1, len(below))
        self.inner, self.piece = len(inner), np.full(len(below), -1)
        self.piece[number[1:]] = ends[1:]
        self.next_ = np.zeros((len(inner) + 1, len(common) + 1), np.int32)
        for node in inner:
            for k, at in below[node].items():
                self.next_[number[node], k] = number[at]

    def edge(self, piece: str) -> tuple[float, tuple[int, ...]] | None:
        """Score and ids of the edge for piece, if there is one."""
        if piece in self.edges:
            score, i = self.edges[piece]
            return score, (i,)
        if len(piece) == 1:
            ids = tuple(self.byte_ids[c] for c in piece.encode())
            return sum(float(self.scores[i]) for i in ids), ids
        return None

    def forward(self, word: str) -> tuple[list[float], float, bytes]:
        """The best score at each position, the second best at the end, and the ids of the best path as 32-bit numbers."""
        n, longest = len(word), self.longest
        best, second, back = [float("-inf")] * (n + 1), [float("-inf")] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            for end in range(start + 1, min(n, start + longest) + 1):
                got = self.edge(word[start:end])
                if got is None:
                    continue
                v, w, b = best[start] + got[0], second[start] + got[0], best[end]
                second[end] = max(min(b, v), second[end], w)
                if v > b:
                    best[end], back[end] = v, (start, got[1])
        parts, end = [], n
        while end:
            end, ids = back[end]
            parts.append(ids)
        return best, second[n], array("I", chain.from_iterable(reversed(parts))).tobytes()

    def forward_all(self, words: list[str]) -> list[tuple[float, float, bytes]]:
        """For each word its best score, the loss of its second best path, and the best one's ids."""
        out: list = [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in BANDS:
            band = np.flatnonzero((lengths > low) & (lengths <= width))
            for at in range(0, len(band), TOGETHER):
                some = band[at : at + TOGETHER]
                self._together([words[i] for i in some], lengths[some], width, some, out)
            low = width
        for i, got in enumerate(out):
            if got is None:
                best, second, ids = self.forward(words[i])
                out[i] = best[-1], best[-1] - second, ids
        return out

    def _together(self, words: list[str], lengths: np.ndarray, width: int, at: np.ndarray, out: list) -> None:
        """forward_all for words of at most width characters; those with characters that have no column are left out."""
        points = np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)
        code = self.codes[np.minimum(points, len(self.codes) - 1)]
        known = ((code > 0) | (np.arange(width) >= lengths[:, None])).all(1)
        code, lengths, at = np.ascontiguousarray(code[known].T), lengths[known], at[known]
        m = len(at)
        if not m:
            return
        best, second = np.full((width + 1, m), -np.inf), np.full((width + 1, m), -np.inf)
        back, by = np.zeros((width + 1, m), np.int64), np.zeros((width + 1, m), np.int64)
        best[0] = 0.0
        for start in range(width):
            rows = np.flatnonzero(lengths > start)
            node = np.ones(len(rows), np.int32)
            for end in range(start + 1, min(width, start + self.longest) + 1):
                node = self.next_[np.where(node <= self.inner, node, 0), code[end - 1, rows]]
                alive = node > 0
                rows, node = rows[alive], node[alive]
                if not len(rows):
                    break
                piece = self.piece[node]
                has = piece >= 0
                r, piece = rows[has], piece[has]
                score, b = self.scores[piece], best[end, r]
                v = best[start, r] + score
                second[end, r] = np.maximum(np.maximum(np.minimum(b, v), second[end, r]), second[start, r] + score)
                more = v > b
                r = r[more]
                best[end, r], back[end, r], by[end, r] = v[more], start, piece[more]
        every, end, steps = np.arange(m), lengths.copy(), []
        while end.any():
            steps.append(np.where(end > 0, by[end, every], -1))
            end = back[end, every]
        path = np.array(steps[::-1]).T
        kept = path >= 0
        ids, counts = path[kept].astype("<u4").tobytes(), (kept.sum(1) * 4).tolist()
        top, lo = best[lengths, every], 0
        for i, score, loss, n in zip(at.tolist(), top.tolist(), (top - second[lengths, every]).tolist(), counts):
            out[i] = score, loss, ids[lo : lo + n]
            lo += n

    def n_best(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths of a word: A* from the end, with the forward scores as exact rests.

        A position is expanded n times at most: what comes to it later is worse than n paths through it. Paths share
        their ends, as linked lists, so that a word takes time and memory proportional to its length.
        """
        best = self.forward(word)[0]
        heap, out, expanded, pushed = [(-best[len(word)], 0, len(word), 0.0, None)], [], [0] * (len(word) + 1), 0
        while heap and len(out) < n:
            f, _, end, done, path = heapq.heappop(heap)
            if end == 0:
                ids = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((-f, tuple(ids)))
                continue
            if expanded[end] == n:
                continue
            expanded[end] += 1
            for start in range(max(0, end - self.longest), end):
                got = self.edge(word[start:end])
                if got is not None:
                    score, pushed = done + got[0], pushed + 1
                    heapq.heappush(heap, (-(best[start] + score), pushed, start, score, (got[1], path)))
        return out

    def alternatives(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """n_best, remembered for short words, within a bound."""
        if len(word) > 40:
            return self.n_best(word, n)
        found = self.paths.get((word, n))
        if found is None:
            if len(self.paths) >= 50_000:
                self.paths.clear()
            found = self.paths[word, n] = self.n_best(word, n)
        return found

    def segment(self, words: list[str], known: list[tuple], n: int) -> list[tuple[float, np.ndarray]]:
        """The n best paths (score, ids) of a text of these words; known: of each word what forward_all gives."""
        losses = np.array([k[1] for k in known])
        ids = [k[2] for k in known]
        return self.spliced(words.__getitem__, sum(k[0] for k in known), losses, np.frombuffer(b"".join(ids), "<u4"), np.cumsum([0, *map(len, ids)]) // 4, n)

    def spliced(self, word, top: float, losses: np.ndarray, ids: np.ndarray, at: np.ndarray, n: int) -> list[tuple[float, np.ndarray]]:
        """The n best paths: the best one's ids, of which word k has at[k] to at[k + 1], with alternatives put in. word: gives word k."""
        weak = np.flatnonzero(losses < np.inf)
        weak = weak[np.argsort(losses[weak], kind="stable")[: n - 1]].tolist()
        paths: list[tuple[float, dict[int, tuple]]] = [(0.0, {})]
        for k in weak:
            options = self.alternatives(word(k), n)
            options = [(options[0][0] - score, new) for score, new in options]
            paths = heapq.nsmallest(n, ((loss + more, changed | {k: new} if more or new != options[0][1] else changed) for loss, changed in paths for more, new in options), key=lambda p: p[0])
        out = []
        for loss, changed in paths:
            parts, lo = [], 0
            for k in sorted(changed):
                parts += [ids[lo : at[k]], np.array(changed[k], "<u4")]
                lo = at[k + 1]
            out.append((top - loss, np.concatenate([*parts, ids[lo:]]) if parts else ids))
        return out

    def paths_of(self, texts: list[str], n: int) -> list[list[tuple[float, np.ndarray]]]:
        """The n best paths of each text. Words are told apart in columns, as each distinct one is looked up once."""
        easy = [i for i, t in enumerate(texts) if t and t[0] != " " and t[-1] != " " and "  " not in t]
        parts = pc.split_pattern(pa.array([texts[i] for i in easy], pa.large_string()), " ")
        starts, found = parts.offsets.to_numpy(), parts.flatten().dictionary_encode()
        word, keys = found.indices.to_numpy().astype(np.int64), [" " + w for w in found.dictionary.to_pylist()]
        known = self.memo.values(keys, self.forward_all)
        score, loss = np.array([k[0] for k in known]), np.array([k[1] for k in known])
        pool, size = np.frombuffer(b"".join([k[2] for k in known]), "<u4"), np.fromiter((len(k[2]) for k in known), np.int64, len(known)) // 4
        first = np.cumsum(size) - size
        out: list = [None] * len(texts)
        for i, lo, hi in zip(easy, starts[:-1].tolist(), starts[1:].tolist()):
            w = word[lo:hi]
            at = np.concatenate([[0], np.cumsum(size[w])])
            ids = pool[np.repeat(first[w] - at[:-1], size[w]) + np.arange(at[-1])]
            out[i] = self.spliced(lambda k, w=w: keys[w[k]], float(score[w].sum()), loss[w], ids, at, n)
        for i in set(range(len(texts))).difference(easy):
            ws = words_of(texts[i])
            out[i] = self.segment(ws, self.memo.values(ws, self.forward_all), n)
        return out

    def spelled(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, gathered from those of all pieces."""
        n = self.size[ids]
        ends = np.cumsum(n)
        return self.pool[np.repeat(self.first[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        if len(ids) and (self.size[ids] == 0).any():
            raise ValueError("an id stands for no text")
        return self.spelled(ids).decode()[1:]


def words_of(text: str) -> list[str]:
    """The words of a text, each with its blanks in front."""
    out, blanks = [], " "
    for w in text.split(" ") if text else []:
        if w:
            out.append(blanks + w)
            blanks = " "
        else:
            blanks += " "
    return out + ([blanks[1:]] if len(blanks) > 1 else [])


def pieces(path: str, scores: np.ndarray) -> Pieces:
    key = path, zlib.crc32(np.ascontiguousarray(scores).tobytes())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(path, scores)
    return _LOADED[key]


def piece_scores(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> np.ndarray:
    """Log-probabilities of the pieces by id, from all words of all texts as the library segments them. A count for each id comes to the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = library(vocabulary_path(vocabulary))
        total = np.zeros(sp.vocab_size(), np.int64)
        for batch in batches:
            got = pc.split_pattern(batch.column(0).drop_null(), " ").flatten().value_counts()
            n = got.field("counts").to_numpy()
            ids = sp.encode(got.field("values").to_pylist(), num_threads=1)
            total += np.bincount(np.fromiter(chain.from_iterable(ids), np.int64), np.repeat(n, list(map(len, ids))), len(total)).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["id", "n"])

    rows = map_arrow(docs.select(docs[text_col].alias("text")), counted, "id long, n long", ROWS).groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.full(library(vocabulary_path(vocabulary)).vocab_size(), 0.5)
    for r in rows:
        counts[r["id"]] += r["n"]
    return np.log(counts / counts.sum())


def n_best(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, n: int = BEST, scores: np.ndarray | None = None) -> DataFrame:
    """(doc_id, scores, ids, decoded): the n best paths, best first, as lists of ids; decoded: each of them gives the text back. scores: by id; from docs if None."""
    scores = piece_scores(docs, text_col, vocabulary) if scores is None else scores

    def segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(vocabulary_path(vocabulary), scores)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            got = p.paths_of(texts, n)
            wanted = [f" {t}".encode() if t else b"" for t in texts]
            same = [all(p.spelled(ids) == t for _, ids in g) for g, t in zip(got, wanted, strict=True)]
            flat = [ids.astype(np.int32) for g in got for _, ids in g]
            inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, flat)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *flat])))
            outer = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, got)]), pa.int32()), inner)
            columns = [pa.array([[round(s, 6) for s, _ in g] for g in got], pa.list_(pa.float64())), outer, pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "scores", "ids", "decoded"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return map_arrow(rows, segmented, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, scores array<double>, ids array<array<int>>, decoded boolean")


def decode(paths: DataFrame, ids_col: str = "ids", out_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """paths with a column of the texts that lists of ids stand for; null for a null list. An id outside the vocabulary raises an error."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(vocabulary_path(vocabulary), np.zeros(library(vocabulary_path(vocabulary)).vocab_size()))
        for batch in batches:
            texts = [None if ids is None else p.decode(ids) for ids in batch.column(ids_col).to_pylist()]
            yield batch.append_column(out_col, pa.array(texts, pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema)
    return map_arrow(paths, decoded, f"{schema}, `{out_col}` string")

"""Quality by attention-based multiple-instance learning: a document is a bag of passages, and only documents have labels.

Every passage of the whole text is encoded by the mean of its words' embeddings, and by a layer over numbers that describe
its signs and repetitions; gated attention gives each passage a weight, and a logistic unit scores the weighted sum. Word
embeddings (one for each of WORDS hashes of lower-case words; where two words meet, they share one), layer, attention and unit are
learned together, from document labels, by gradient descent with Adam and a fixed seed, on at most ``fit_docs`` labelled rows
(those with the smallest hashes of their ids) outside the held-out fold. Ids, language, source and labels are no inputs.
Words that training never saw have an embedding of 0, the same as no word.

Cases: a null or empty text is a bag of one passage without words and gets a score like any other. Copies get equal
scores. Labels of null, or for ids that are not there, are not used; an id with several labels counts once for each.
With no labelled rows, or of one kind only, the score is the (smoothed) share of label 1. An empty table gives an
empty result; columns besides id and text are left as they are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fold, map_arrow

#: Words of a passage; labelled documents that the model is fitted on, at most; passages of each that are kept for it.
PASSAGE, FIT_DOCS = 96, 4_000
#: The fold that is held out: crc32(id) mod FOLDS = HELD.
FOLDS, HELD = 3, 1
EMBED, GATE, EPOCHS, SEED = 12, 6, 40, 9
#: Different words of passages that are scored at once: bounds memory, whatever the texts' lengths (a document is never split).
AT_ONCE = 20_000
#: Word embeddings, and how fast they shrink: one that few documents teach stays near 0.
WORDS, SHRINK = 1 << 14, 2e-3
SIGNS = "|#%&*$<>{}=/_@"
_ODD = re.compile(r"[^\w\s.,;:!?'\"()-]")
_DIGITS = re.compile(r"[0-9]")


class Bag(NamedTuple):
    """A document: numbers of each passage, and its words as (hash, share of the passage's words), those of passage i from starts[i] on."""

    numbers: np.ndarray
    starts: np.ndarray
    words: np.ndarray
    shares: np.ndarray

    def pack(self) -> bytes:
        head = np.array([len(self.numbers), len(self.words)], "<i4")
        return b"".join(a.tobytes() for a in (head, self.numbers.astype("<f4"), self.starts.astype("<i4"), self.words.astype("<i4"), self.shares.astype("<f4")))

    @classmethod
    def unpack(cls, data: bytes) -> Bag:
        n, m = np.frombuffer(data, "<i4", 2)
        out, at = [], 8
        for kind, size in (("<f4", n * FEATURES), ("<i4", n), ("<i4", m), ("<f4", m)):
            out.append(np.frombuffer(data, kind, size, at))
            at += 4 * int(size)
        return cls(out[0].reshape(-1, FEATURES).astype(float), out[1].astype(np.int64), out[2].astype(np.int64), out[3].astype(float))


def passage_features(words: list[str], counts: Counter, lines_repeated: float, log_words: float) -> list[float]:
    n = len(words)
    if not n:
        return [0.0] * 15 + [lines_repeated, log_words, 1.0]
    text = " ".join(words)
    most = counts.most_common(1)[0][1]
    size = len(text)
    odd = len(_ODD.findall(text))
    return [
        len(counts) / n, sum(a == b for a, b in pairwise(words)) / n, most / n, size / n / 10, odd / size * 5, text.count("|") / n, len(_DIGITS.findall(text)) / size * 5,
        sum(w[0].isupper() for w in words) / n, text.count(".") / n * 4, text.count(",") / n * 4, text.isascii(), sum(not w[-1].isalnum() and w[-1] not in ".,;:!?\"')" for w in words) / n,
        sum(len(w) == 1 for w in words) / n, max(map(len, words)) / 50, sum(map(text.count, ("http", "www", ".com", "License"))) / n * 10, lines_repeated, log_words, 0.0,
    ]


FEATURES = len(passage_features([], Counter(), 0, 0))


def encode(text: str, passage: int = PASSAGE) -> Bag:
    """Every word is in one passage, and passages are of nearly equal length; one without words has a word of share 0."""
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
    parts = max(1, round(len(words) / passage))
    cuts = [len(words) * i // parts for i in range(parts + 1)]
    numbers, starts, hashes, shares = [], [], [], []
    for a, b in pairwise(cuts):
        counts = Counter(words[a:b])
        numbers.append(passage_features(words[a:b], counts, repeated, np.log1p(len(words)) / 10))
        starts.append(len(hashes))
        hashes += [zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS for w in counts] or [0]
        shares += [c / (b - a) for c in counts.values()] or [0.0]
    return Bag(np.array(numbers, np.float64), np.array(starts, np.int64), np.array(hashes, np.int32), np.array(shares, np.float32))


class Model:
    """Embedding, gated attention and the logistic unit on top."""

    def __init__(self, bags: list[Bag], labels: list[int], epochs: int = EPOCHS):
        ones = sum(labels)
        self.prior = (ones + 1) / (len(labels) + 2)
        self.p = None
        if 0 < ones < len(labels):
            x = np.concatenate([b.numbers for b in bags])
            self.mean, self.std = x.mean(0), x.std(0) + 1e-6
            self._fit(bags, np.array(labels, float), epochs)

    def _fit(self, bags: list[Bag], y: np.ndarray, epochs: int) -> None:
        rng = np.random.default_rng(SEED)
        d = bags[0].numbers.shape[1]
        shapes = {"W": (d, EMBED), "b": (EMBED,), "V": (EMBED, GATE), "U": (EMBED, GATE), "w": (GATE,), "c": (EMBED,), "o": ()}
        self.p = {k: rng.normal(0, 1 / np.sqrt(max(1, s[0] if s else 1)), s) if k not in "bo" else np.zeros(s) for k, s in shapes.items()}
        shapes["E"] = (WORDS, EMBED)
        self.p["E"] = np.zeros(shapes["E"])
        m, v, t = {k: 0.0 for k in shapes}, {k: 0.0 for k in shapes}, 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for part in np.array_split(order, max(1, len(order) // 128)):
                grads = self._gradients(self._stack([bags[i] for i in part]), y[part])
                t += 1
                for k, g in grads.items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8) - (SHRINK if k == "E" else 1e-5) * self.p[k]

    def _stack(self, bags: list[Bag]) -> tuple:
        """The passages of several documents: numbers, document of each, and words with where each passage's begin and what passage each is of."""
        sizes = [len(b.words) for b in bags]
        base = np.cumsum([0, *sizes[:-1]])
        starts = np.concatenate([b.starts + at for b, at in zip(bags, base)])
        x = np.clip((np.concatenate([b.numbers for b in bags]) - self.mean) / self.std, -6, 6)
        owner = np.repeat(np.arange(len(starts)), np.diff([*starts, sum(sizes)]))
        return x, np.repeat(np.arange(len(bags)), [len(b.numbers) for b in bags]), starts, np.concatenate([b.words for b in bags]), np.concatenate([b.shares for b in bags]), owner

    def _forward(self, stacked: tuple) -> tuple:
        p = self.p
        x, bag, starts, words, shares, _ = stacked
        h = np.tanh(x @ p["W"] + np.add.reduceat(shares[:, None] * p["E"][words], starts, axis=0) + p["b"])
        tv, su = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (tv * su) @ p["w"]
        e = np.exp(np.clip(e, -30, 30))
        a = e / np.bincount(bag, e)[bag]
        z = np.zeros((bag[-1] + 1, h.shape[1]))
        np.add.at(z, bag, a[:, None] * h)
        return h, tv, su, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["o"], -30, 30)))

    def _gradients(self, stacked: tuple, y: np.ndarray) -> dict:
        p = self.p
        x, bag, _, words, shares, owner = stacked
        h, tv, su, a, z, out = self._forward(stacked)
        g = (out - y) / len(y)
        dz = g[:, None] * p["c"]
        da = (h * dz[bag]).sum(1)
        de = a * (da - np.bincount(bag, a * da)[bag])
        gate = de[:, None] * p["w"]
        dv, du = gate * su * (1 - tv**2), gate * tv * su * (1 - su)
        dh = a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T
        dx = dh * (1 - h**2)
        de_words = np.stack([np.bincount(words, shares * dx[owner, j], WORDS) for j in range(EMBED)], 1)
        return {"E": de_words, "W": x.T @ dx, "b": dx.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (tv * su).T @ de, "c": z.T @ g, "o": g.sum()}

    def score(self, bags: Iterable[Bag]) -> np.ndarray:
        """The score of each bag; takes and scores them a few at a time."""
        out, some, words = [np.zeros(0)], [], 0

        def done() -> None:
            if some:
                out.append(np.full(len(some), self.prior) if self.p is None else self._forward(self._stack(some))[-1])
            some.clear()

        for bag in bags:
            some.append(bag)
            words += len(bag.words)
            if words >= AT_ONCE:
                done()
                words = 0
        done()
        return np.concatenate(out)

    def score_texts(self, texts: Iterable[str | None]) -> np.ndarray:
        return self.score(encode(t or "") for t in texts)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_docs: int = FIT_DOCS, folds: int = FOLDS, held: int = HELD) -> Model:
    """A model from at most ``fit_docs`` labelled rows outside the fold ``held``: their passages are encoded on the executors, their codes come to the driver."""
    known = labels.where(F.col(label_col).isNotNull() & (fold(F.col(id_col), folds) != held)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(fit_docs)
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("text")).join(F.broadcast(known), "_id").select("_id", "text", "_label")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [encode(t or "").pack() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(bags, pa.binary()), batch.column("_label")], ["bag", "label"])

    got = sorted((bytes(r["bag"]), r["label"]) for r in map_arrow(rows, coded, "bag binary, label int").collect())
    return Model([Bag.unpack(b) for b, _ in got], [min(1, max(0, y)) for _, y in got])


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_docs: int = FIT_DOCS, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs."""
    model = fit_quality(docs, labels, id_col, text_col, label_col, fit_docs, folds, held)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score_texts(x.as_py() for x in batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("int32"))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), (fold(docs[id_col], folds) == held).alias("held_out"))
    return map_arrow(rows, scored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", least: float = 0.5, **options) -> DataFrame:
    """docs without those that score under ``least``; all columns stay as they are."""
    model = fit_quality(docs, labels, text_col=text_col, **options)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score_texts(x.as_py() for x in batch.column(text_col)) >= least))

    return map_arrow(docs, kept, docs.schema)

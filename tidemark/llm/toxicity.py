"""Toxicity by class-conditional Kneser-Ney models: which of two language models finds a text likelier, per word?

Both models spell words out in bytes, between marks of their ends. At the highest order each has the counts of its own
class; below that both back off to the same continuation counts, of distinct contexts over all documents, labelled or
not. Rare spellings thus get the same probability from either model, and what counts is what one class wrote and the
other did not. For a spelling that neither class has, the shared probability cancels out and the ratio of the two
back-off weights is left, so a score needs one number for each spelling seen in a class and one for each context.

Counting, the back-off recursion and the ratios are DataFrame aggregations and joins over distinct spellings, of any
size. Scoring looks ratios up by the spelling itself. Up to KEYED_ROWS spellings of the labelled documents, checked by
counting, they are broadcast with their ratios; beyond, the documents' distinct spellings meet all ratios in a join, and words
and documents meet theirs in two more. A document's score is a logistic function, fitted on a bounded
sample of labelled rows that the counts leave out, of its log-likelihood ratio per word, of the share of words
that the ratio finds toxic, and of its most toxic word.

The held-out fold is crc32(id) mod 5 = 0; fold 4 is for the logistic function; the rest, for the counts. Cases: a null
or empty text has no words, a ratio of 0, and a score by that. Labels of null, or for ids that are not there, are not
used; an id with several labels counts once for each. With no label of one kind the score is the share of label 1.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Memo, attach_group, broadcast_if_small, discard, fold, map_arrow, materialize, small

ORDER, DISCOUNT, LIMIT = 5, 0.75, 6.0
FOLDS, HELD, TUNE = 5, 0, 4
#: Labelled rows that the logistic function is fitted on, at most; labels up to which they are broadcast.
FIT_DOCS, LABEL_ROWS = 20_000, 1_000_000
#: Spellings up to which their ratios are broadcast, 16 bytes each; they have no more contexts than that.
KEYED_ROWS = 1_000_000
#: Ratios from which a word counts as toxic, and so many features of a document.
TOXIC_WORD = (5.0, 10.0, 15.0, 20.0)
FEATURES = 2 + 2 * len(TOXIC_WORD)


def spellings(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The windows of ``order`` bytes that end at each byte of each word and at its end mark, as numbers, and the word of each."""
    coded = [b"\0" * (order - 2) + b" " + w.encode() + b" " for w in words]
    sizes = np.array([len(c) for c in coded], np.int64)
    stream = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(stream)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ends = np.where(place >= order - 1)[0]
    keys = np.zeros(len(ends), np.int64)
    for k in range(order):
        keys |= stream[ends - k] << (8 * k)
    return keys, word[ends]


def spelling_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, t, o): how often each spelling of (text, label) stands in toxic and in ordinary documents; 0 and 0 for those of unlabelled ones alone."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_class: dict = {}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                by_class.setdefault(label, Counter()).update((text or "").lower().split())
            for label, counts in by_class.items():
                if not counts:
                    continue
                keys, word = spellings(list(counts), order)
                keys, at = np.unique(keys, return_inverse=True)
                n = np.bincount(at, np.fromiter(counts.values(), float, len(counts))[word]).astype(np.int64) if label is not None else np.zeros(len(keys), np.int64)
                zero = np.zeros_like(n)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n if label == 1 else zero), pa.array(zero if label == 1 else n)], ["key", "t", "o"])

    return map_arrow(docs, counted, "key long, t long, o long").groupBy("key").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def _suffix(key: Column, order: int) -> Column:
    return key.bitwiseAND(F.lit((1 << (8 * order)) - 1))


def _context(key: Column) -> Column:
    return F.shiftright(key, 8)


def shared_probabilities(keys: DataFrame, order: int, discount: float = DISCOUNT) -> DataFrame:
    """(key, p): the Kneser-Ney probability of each spelling of ``order`` bytes, from the distinct spellings (key) of one more."""
    own = keys.groupBy(_suffix(F.col("key"), order).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    if order == 1:
        total = own.agg(F.sum("n").alias("total"))
        return own.join(F.broadcast(total)).select("key", ((F.col("n") + 1) / (F.col("total") + 256)).alias("p"))
    own = materialize(own, f"toxic-order{order}")
    contexts = own.groupBy(_context(F.col("key")).alias("h")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    lower = shared_probabilities(own.select("key"), order - 1, discount).withColumnRenamed("key", "low")
    met = own.withColumn("h", _context(F.col("key"))).join(contexts, "h").withColumn("low", _suffix(F.col("key"), order - 1)).join(lower, "low")
    return met.select("key", ((F.col("n") - discount + discount * F.col("kinds") * F.col("p")) / F.col("total")).alias("p"))


def _class_p(n: str, total: str, kinds: str, p: str, discount: float) -> Column:
    seen = (F.greatest(F.col(n) - discount, F.lit(0.0)) + discount * F.col(kinds) * F.col(p)) / F.col(total)
    return F.when(F.col(total) > 0, seen).otherwise(F.col(p))


def ratios(counts: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """(key, ratio) for the spellings of the labelled documents and (key, ratio) for their contexts: log toxic over ordinary."""
    seen = counts.where("t + o > 0").withColumn("h", _context(F.col("key")))
    contexts = seen.groupBy("h").agg(F.sum("t").alias("tt"), F.sum("o").alias("oo"), F.count_if(F.col("t") > 0).alias("tk"), F.count_if(F.col("o") > 0).alias("ok"))
    shared = shared_probabilities(counts.select("key"), order - 1, discount).withColumnRenamed("key", "low")
    met = seen.join(contexts, "h").withColumn("low", _suffix(F.col("key"), order - 1)).join(shared, "low")
    full = met.select("key", F.log(_class_p("t", "tt", "tk", "p", discount) / _class_p("o", "oo", "ok", "p", discount)).alias("ratio"))
    weight = lambda kinds, total: F.when(F.col(total) > 0, discount * F.col(kinds) / F.col(total)).otherwise(F.lit(1.0))
    return full, contexts.select(F.col("h").alias("key"), F.log(weight("tk", "tt") / weight("ok", "oo")).alias("ratio"))


def keyed(ratios: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The keys of (key, ratio) in order, and their ratios. All rows come to the driver."""
    got = ratios.select("key", "ratio").toPandas().sort_values("key")
    return got["key"].to_numpy(np.int64), got["ratio"].to_numpy(np.float64)


def look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The ratio of each key; NaN for those that the table does not have."""
    known, ratio = table
    if not len(known):
        return np.full(len(keys), np.nan)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, ratio[at], np.nan)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def described(r: np.ndarray) -> tuple[float, ...]:
    """The features of a text whose words have these ratios: ratio per word, shares of words by their ratio, ratio of the most toxic word (squashed)."""
    return r.mean(), *((r > t).mean() for t in TOXIC_WORD), *((r > t).any() for t in TOXIC_WORD), np.clip(r.max(), 0, 40) / 10


class Scorer:
    """The ratios by key, and the words met so far with their ratios."""

    def __init__(self, full: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray], order: int = ORDER):
        self.full, self.contexts, self.order, self.memo = full, contexts, order, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": None}

    def word_ratios(self, words: list[str]) -> list[float]:
        keys, word = spellings(words, self.order)
        r = look_up(self.full, keys)
        miss = np.isnan(r)
        r[miss] = np.nan_to_num(look_up(self.contexts, keys[miss] >> 8))
        return np.bincount(word, np.clip(r, -LIMIT, LIMIT), len(words)).tolist()

    def features(self, texts: list[str | None]) -> np.ndarray:
        """FEATURES numbers for each text; zeros where it has no words."""
        if self.memo is None:
            self.memo = Memo()
        words = [words_of(t) for t in texts]
        known = self.memo.fill((w for ws in words for w in ws), self.word_ratios).__getitem__
        out = np.zeros((len(texts), FEATURES))
        for i, ws in enumerate(words):
            if ws:
                out[i] = described(np.fromiter(map(known, ws), float, len(ws)))
        return out


def measured(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """rows with their features, x, instead of their text, by broadcast ratios."""
    others = [c for c in rows.columns if c != "text"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = scorer.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(list(x), pa.list_(pa.float64()))], [*others, "x"])

    return map_arrow(rows, made, "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in others) + "x array<double>")


def joined_word_ratios(words: DataFrame, full: DataFrame, contexts: DataFrame, order: int = ORDER) -> DataFrame:
    """(no, ratio) for (no, word): ratios met in joins, on distinct spellings and then on those of each word."""

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, word = spellings(batch.column("word").to_pylist(), order)
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("no").to_numpy()[word]), pa.array(keys)], ["no", "key"])

    uses = materialize(map_arrow(words.select("no", "word"), spelled, "no long, key long"), "toxic-spellings")
    keys = uses.groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    keys = keys.join(full.select("key", F.col("ratio").alias("own")), "key", "left").withColumn("h", _context(F.col("key")))
    keys = keys.join(contexts.select(F.col("key").alias("h"), F.col("ratio").alias("back")), "h", "left")
    limited = F.greatest(F.least(F.coalesce("own", "back", F.lit(0.0)), F.lit(LIMIT)), F.lit(-LIMIT))
    keys = materialize(keys.select("key", "uses", limited.alias("ratio")), "toxic-keys")
    out = attach_group(uses, keys, "key", "uses", "no", uses.count()).groupBy("no").agg(F.sum("ratio").alias("ratio"))
    out = materialize(out, "toxic-word-ratios")
    discard(uses, keys)
    return out


def measured_by_joins(rows: DataFrame, full: DataFrame, contexts: DataFrame, order: int = ORDER) -> DataFrame:
    """rows with their features, x, instead of their text, whatever the number of ratios."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("_row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts = Counter(words_of(text))
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(counts), pa.int64()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["_row", "word", "n"])

    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "toxic-rows")  # ids may repeat or be null
    held = materialize(map_arrow(rows.select("_row", "text"), counted, "_row long, word string, n long"), "toxic-bags")
    words = materialize(held.groupBy("word").agg(F.count(F.lit(1)).alias("docs")).withColumn("no", F.monotonically_increasing_id()), "toxic-words")
    ratios = joined_word_ratios(words, full, contexts, order)
    groups = materialize(words.join(ratios, "no").select("word", "docs", "ratio"), "toxic-by-word")
    met = attach_group(held, groups, "word", "docs", "_row", held.count())
    total, r = F.sum("n"), F.col("ratio")
    shares = [F.sum(F.when(r > t, F.col("n")).otherwise(0)) / total for t in TOXIC_WORD]
    ever = [F.max((r > t).cast("double")) for t in TOXIC_WORD]
    x = F.array(F.sum(r * F.col("n")) / total, *shares, *ever, F.greatest(F.least(F.max(r), F.lit(40.0)), F.lit(0.0)) / 10)
    found = materialize(met.groupBy("_row").agg(x.alias("_x")), "toxic-features")
    discard(held, words, ratios, groups)
    none = F.array(*[F.lit(0.0)] * FEATURES)
    return rows.drop("text").join(found, "_row", "left").withColumn("x", F.coalesce("_x", none)).drop("_row", "_x")


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and weights (the last one constant) of a logistic regression by Newton's method."""
    mean, std = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - mean) / std, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), z.T @ (p - y) + 0.1 * w)
    return mean, std, w


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", order: int = ORDER, fit_docs: int = FIT_DOCS, keyed_rows: int = KEYED_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    usable = labels.where(F.col(label_col).isNotNull() & (fold(F.col(id_col), FOLDS) != HELD)).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    tune = fold(F.col("doc_id"), FOLDS) == TUNE
    counts = materialize(spelling_counts(rows.join(broadcast_if_small(usable.where(~tune), LABEL_ROWS), "doc_id", "left").select("text", "label"), order), "toxic-counts")
    full, contexts = (materialize(r, "toxic-ratios") for r in ratios(counts, order))
    discard(counts)
    if small(full, keyed_rows):
        scorer = Scorer(keyed(full), keyed(contexts), order)
        measure = lambda some: measured(some, scorer)
    else:
        measure = lambda some: measured_by_joins(some, full, contexts, order)
    some = usable.where(tune).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(fit_docs)
    known = measure(rows.join(F.broadcast(some), "doc_id").select("text", "label")).select("x", "label").collect()
    known = sorted((list(r["x"]), float(r["label"] > 0)) for r in known)
    x, y = np.array([k[0] for k in known]).reshape(-1, FEATURES), np.array([k[1] for k in known])
    if 0 < y.sum() < len(y):
        mean, std, w = logistic(x, y)
    else:
        share = (y.sum() + 1) / (len(y) + 2)
        mean, std, w = np.zeros(FEATURES), np.ones(FEATURES), np.append(np.zeros(FEATURES), np.log(share / (1 - share)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = (np.array(batch.column("x").to_pylist(), float).reshape(-1, FEATURES) - mean) / std
            s = 1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype("int32"))], ["doc_id", "held_out", "score", "predicted"])

    out = measure(rows.withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD))
    return map_arrow(out, scored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")

"""Scoring by exact keys: unseen spellings back off, and joins give what broadcast ratios give."""

import random

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm import toxicity  # noqa: E402


def corpus(spark):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choices(letters, k=8))
    docs = [(i, " ".join(word("abcdefghij" if i % 2 else "klmnopqrst") for _ in range(60))) for i in range(400)]
    docs += [(1000 + i, "z" + word("0123456789")) for i in range(300)]
    docs += [(5000, None), (5000, ""), (5001, "same id"), (5001, docs[1][1]), (None, docs[3][1]), (None, "no id at all")]
    labels = [(i, i % 2) for i in range(400)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_words_of_unseen_spellings_score_alike(spark):
    docs, labels = corpus(spark)
    # no labelled document has a z or a digit: every spelling of these words backs off, by contexts that they share
    got = toxicity.toxicity(docs, labels).where("doc_id between 1000 and 1299").collect()
    assert len(got) == 300 and len({r.score for r in got}) == 1


def test_joins_give_what_broadcast_ratios_give(spark):
    docs, labels = corpus(spark)
    few, many = (sorted((r.doc_id or 0, r.held_out, round(r.score, 9), r.predicted) for r in toxicity.toxicity(docs, labels, keyed_rows=n).collect()) for n in (10**6, 0))
    assert few == many and len(few) == docs.count()


def test_ratios_by_key_against_a_dictionary(spark):
    docs, labels = corpus(spark)
    counts = toxicity.spelling_counts(docs.join(labels.withColumnRenamed("toxic", "label"), "doc_id", "left").select("text", "label"))
    full, contexts = toxicity.ratios(counts)
    own, back = ({r.key: r.ratio for r in d.collect()} for d in (full, contexts))
    words = sorted({w for r in docs.limit(500).collect() for w in toxicity.words_of(r.text)})[:3000]
    want = []
    for w in words:
        stream = b"\0\0\0 " + w.encode() + b" "
        keys = [int.from_bytes(stream[i : i + 5], "big") for i in range(len(stream) - 4)]
        want.append(sum(float(np.clip(own.get(k, back.get(k >> 8, 0.0)), -6, 6)) for k in keys))
    assert np.allclose(toxicity.Scorer(toxicity.keyed(full), toxicity.keyed(contexts)).word_ratios(words), want)
    numbered = spark.createDataFrame(list(enumerate(words)), "no long, word string")
    got = {r.no: r.ratio for r in toxicity.joined_word_ratios(numbered, full, contexts).collect()}
    assert np.allclose([got[i] for i in range(len(words))], want)

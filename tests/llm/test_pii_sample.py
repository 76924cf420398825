"""The texts that the field's potentials are fitted on: copies count once, long texts count."""

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm import pii  # noqa: E402

TEXTS = [f"write to user{i}@mail{i % 7}.org or {i}.2.3.4 , again user{i}@mail{i % 7}.org , item {i * 37}" for i in range(60)]


def fitted(spark, texts, n):
    return pii.fitted(spark.createDataFrame([(t,) for t in texts], "text string"), fit_docs=n)


def test_copies_do_not_fill_the_sample(spark):
    want = fitted(spark, TEXTS, 20)
    got = fitted(spark, TEXTS + [t for t in TEXTS for _ in range(40)], 20)
    assert all(np.allclose(a, b) for a, b in zip(got, want))


def test_long_texts_are_sampled(spark):
    long = " ".join(TEXTS * 20)
    assert len(long) > 3 * pii.PIECE
    weights = fitted(spark, [long], 20)[0]
    assert np.abs(weights).max() > 0.1
    pieces = pii.sample(spark.createDataFrame([(long,), ("7" * 45_000,), (None,)], "text string"))
    assert max(map(len, pieces)) <= pii.PIECE + 1
    assert sum(map(len, pieces)) == len(long) + 2 * 20_000 - 20_000 + 5_000  # the two equal pieces of the run count once

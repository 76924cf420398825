"""The learned encoder: gradients against differences, texts that only their words tell apart, and packed bags."""

import random

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm import quality  # noqa: E402


def texts(n: int, seed: int):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bdfgklmn" for b in ("ale", "ore", "ine", "ust", "eck")]
    good, bad = words[:6], words[6:12]
    for i in range(n):
        body = [rng.choice(words[12:]) for _ in range(rng.randrange(30, 300))]
        at = rng.randrange(len(body) - 5)
        body[at : at + 5] = [rng.choice(good if i % 2 else bad) for _ in range(5)]
        yield " ".join(body), i % 2


def test_words_alone_tell_documents_apart():
    train, test = list(texts(600, 1)), list(texts(300, 2))
    model = quality.Model([quality.encode(t) for t, _ in train], [y for _, y in train])
    scores = model.score([quality.encode(t) for t, _ in test])
    assert np.mean((scores >= 0.5) == np.array([y for _, y in test])) > 0.9


def test_gradients():
    rows = list(texts(9, 3)) + [("", 1), ("one", 0)]
    model = quality.Model([quality.encode(t) for t, _ in rows], [y for _, y in rows], epochs=3)
    stacked, y = model._stack([quality.encode(t) for t, _ in rows]), np.array([y for _, y in rows], float)

    def loss():
        p = model._forward(stacked)[-1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = model._gradients(stacked, y)
    for k, g in grads.items():
        g = np.asarray(g)
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        values = []
        for step in (1e-5, -2e-5):
            model.p[k] = np.array(model.p[k], float)
            model.p[k][at] += step
            values.append(loss())
        model.p[k][at] += 1e-5
        assert (values[0] - values[1]) / 2e-5 == pytest.approx(g[at], rel=1e-3, abs=1e-8), k


@pytest.mark.parametrize("text", ["", " \n ", "one", "a b c " * 500, "日本 語 \ud800 x"])
def test_packed_bags_and_shares(text):
    bag = quality.encode(text)
    again = quality.Bag.unpack(bag.pack())
    assert all(np.allclose(a, b) for a, b in zip(bag, again)) and len(bag.starts) == len(bag.numbers)
    assert np.add.reduceat(bag.shares, bag.starts) == pytest.approx(np.full(len(bag.starts), 1.0 if text.split() else 0.0))

"""The field: what comes again in another format is labelled, what does not is left alone; its marginals against enumeration."""

from itertools import product

import duckdb
import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm import pii  # noqa: E402


@pytest.fixture(scope="module")
def weights():
    texts = [t for (t,) in duckdb.sql("SELECT text FROM read_parquet('/root/testdata/sf0.01/documents.parquet') WHERE text IS NOT NULL ORDER BY doc_id").fetchall()]
    return pii.fit(texts)


def added(text, weights):
    ((base, every),) = pii.find_spans([text], weights)
    return [(pii.KINDS[k], text[a:b]) for a, k, b in every if (a, k, b) not in base]


@pytest.mark.parametrize("again", ["(017) 555-7713", "0175557713", "017-555-7713", "1 017 555 7713", "017 5557713."])
def test_phones_in_other_formats(weights, again):
    assert added(f"Call +1 (017) 555-7713 today. Then, much later on, ask for {again} and wait.", weights) == [("phone", again.rstrip("."))]


def test_cards_in_blocks(weights):
    assert added("Paid by 4845168114407329 once. The second time 4845-1681 1440-7329, as before.", weights) == []  # blocks are a base span of their own
    assert added("Paid by 4845168114407329 once. The second time 4845/1681/1440/7329 as before.", weights) == [("card", "4845/1681/1440/7329")]


@pytest.mark.parametrize("text", ["Call +1 (017) 555-7713 or 2024 or 9807915762804490, see 4.0. and 555.", "Numbers 0175557713 and 0175557713 alone.", "a@b.cd met 20240101 and 20240101", "", "+1 (017) 555-7713 in 2024 (018) 555-7714"])
def test_others_are_left_alone(weights, text):
    assert added(text, weights) == []


@pytest.mark.parametrize("text", ["+1 (017) 555-7713 is 0175557713 and 33", "call 0175557713 then +1 (017) 555-7713 end 12", "a@b.cd x a.b@c 77 88 ab1234"])
def test_marginals_against_enumeration_on_trees(weights, text):
    g = pii.Graph([text], [pii.base_spans(text)])
    edges = {tuple(e) for e in g.chain.tolist()} | {tuple(e) for e in g.skip.tolist()}
    assert len(g.chain) + len(g.skip) == len(edges) < len(g.x) <= 6  # without loops, where messages are exact
    w, chain, skip = weights
    unary = g.x @ w
    k = unary.shape[1]
    total = np.zeros_like(unary)
    for labels in product(range(k), repeat=len(g.x)):
        if any(h and h != y for h, y in zip(g.held, labels)):
            continue
        score = sum(unary[i, y] for i, y in enumerate(labels) if not g.held[i])
        score += sum(chain[labels[a], labels[b]] for a, b in g.chain) + sum(skip[labels[a], labels[b]] for a, b in g.skip)
        for i, y in enumerate(labels):
            total[i, y] += np.exp(score)
    assert np.allclose(pii.marginals(g, weights), total / total.sum(1, keepdims=True), atol=2e-3)

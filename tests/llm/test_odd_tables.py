"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm import exact_dedup, fingerprints, nbest, near_dedup, packing, pii, quality, token_counts, toxicity, warc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, component_id long, sequence_id long, n long"
LABELS = "doc_id long, quality int, toxic int"
LONG = "many words of one long text " * 20_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), None, None, None, None, None) for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (4, "one two"), (5, "a b c d e f g"), (6, "A B C D E F G"), (7, LONG), (8, "x" * 50_000), (None, "no id here at all today"), (9, "mail a@b.cd twice a@b.cd")]

OPERATORS = {
    "token_counts": lambda s, d, y: token_counts.token_counts(d),
    "exact_dedup": lambda s, d, y: exact_dedup.exact_dedup(d),
    "near_dedup": lambda s, d, y: near_dedup.near_dedup(d),
    "fingerprints": lambda s, d, y: fingerprints.fingerprints(d),
    "pii": lambda s, d, y: pii.pii(d),
    "nbest": lambda s, d, y: nbest.n_best(d),
    "toxicity": lambda s, d, y: toxicity.toxicity(d, y),
    "quality": lambda s, d, y: quality.quality(d, y),
    "warc": lambda s, d, y: warc.round_trip(s, d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_odd_row(spark, name):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, None, None), (77, 1, 1)], LABELS)
    got = OPERATORS[name](spark, docs(spark, ODD), labels).collect()
    assert len(got) == len(ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, docs(spark, []), spark.createDataFrame([], LABELS)).count() == 0


def test_packing_of_odd_rows(spark):
    got = packing.best_fit_packing(docs(spark, ODD)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in ODD}
    assert sum(r.piece == 0 for r in got) == len(ODD)
    assert packing.best_fit_packing(docs(spark, [])).count() == 0


def test_copies_of_every_kind(spark):
    rows = [(i, "same text  here" if i % 2 else "same\ttext here ") for i in range(300)] + [(1000, "another")]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()}
    assert sum(r.kept for r in got.values()) == 2
    assert got[7].group_size == 300 and got[7].keep_id == 0
    near = {r.doc_id: r for r in near_dedup.near_dedup(docs(spark, [(i, "w1 w2 w3 w4 w5 w6 w7 w8") for i in range(200, 400)] + [(1, None), (2, "")])).collect()}
    assert {near[i].component_id for i in range(200, 400)} == {200}
    assert near[1].kept and near[2].kept and near[1].n_shingles == 0


def test_masked():
    assert pii.masked("to a@b.cd now", pii.base_spans("to a@b.cd now")) == "to [EMAIL] now"

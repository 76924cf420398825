"""The pipeline's stages on repeated and null ids, against brute force."""

import pytest

pytest.importorskip("tidemark.llm")
import corpus_pipeline as c  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stage(spark, name, rows):
    docs = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    got = dict(c.STAGES)[name](spark, docs, "")
    assert got.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)


def words(*ids):
    return " ".join(f"word{i}" for i in ids)


EXACT = [(3, "A"), (10, "A"), (10, "B"), (None, "A"), (None, "C"), (None, "D"), (11, "D"), (12, "e f"), (12, "ef "), (12, "e f"), (13, "G"), (13, "G"), (14, None), (14, ""), (15, "H"), (None, "H ")]


@pytest.mark.parametrize("rows", [EXACT, [(7, "hot")] * 50 + [(7, f"own {i}") for i in range(50)], [(None, "hot")] * 50 + [(None, f"own {i}") for i in range(50)], []])
def test_exact_stage_decides_for_each_row(spark, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join((t or "").split()), []).append((i, t))
    got = stage(spark, "exact_dedup", rows)
    assert len(got) == len(groups)
    for i, t in got:
        best = min((-len(t or ""), i is not None, i or 0) for i, t in groups.pop("".join((t or "").split())))
        assert (-len(t or ""), i is not None, i or 0) == best


def test_near_stage_decides_for_each_row(spark):
    a, b, d = range(0, 60), range(100, 160), range(200, 260)
    near = lambda ids: words(*list(ids)[:-1], 9_999)
    rows = [(3, words(*a)), (10, near(a)), (10, words(*b)), (None, near(b)), (None, words(*d)), (None, near(d)), (None, words(7, 8, 9, 10, 11, 12)), (20, words(*a)), (None, None), (21, "")]
    want = [(3, words(*a)), (10, words(*b)), (None, words(7, 8, 9, 10, 11, 12)), (None, None), (21, "")]
    got = stage(spark, "near_dedup", rows)
    kept = [r for r in got if r in want]
    assert kept == sorted(want, key=repr)
    (last,) = [r for r in got if r not in want]
    assert last in [(None, words(*d)), (None, near(d))]

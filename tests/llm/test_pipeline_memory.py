"""The pipeline's packing keeps a worker's memory small, with the results of packing alone."""

import pyarrow as pa
import pytest

pytest.importorskip("tidemark.llm")
import corpus_pipeline as c  # noqa: E402
from tidemark.llm import packing  # noqa: E402
from tidemark.llm.token_counts import vocabulary_path  # noqa: E402

TEXTS = [" ".join(f"zqx{i}y{j}" for j in range(300)) for i in range(40)] + ["", None, "zqx  zqx\n zqx! zqx"]


def test_workers_forget_words_after_the_pipelines_packing(spark):
    def remembered(batches):
        from tidemark.llm import packing

        for batch in batches:
            n = sum("zqx" in w for _, memo in packing._LOADED.values() for w in (*memo.new, *memo.old))
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], ["n"])

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = sorted(map(tuple, dict(c.STAGES)["packing"](spark, docs, "").select(*cols).collect()))
    held = spark.range(0, 64, 1, 16).mapInArrow(remembered, "n long").agg({"n": "max"}).first()[0]
    assert held == 0
    assert got == sorted(map(tuple, packing.best_fit_packing(docs).select(*cols).collect()))


def test_few_words_remembered_change_no_ids():
    path = vocabulary_path(packing.VOCABULARY)
    texts = [t or "" for t in TEXTS]
    want = packing.encode(texts, path)
    packing._LOADED[path][1].clear()
    got = []
    for t in texts:
        got += packing.encode([t], path, 50)
        memo = packing._LOADED[path][1]
        assert len(memo.new) <= 50 + 301 and len(memo.old) <= 50 + 301
    assert [x.tolist() for x in got] == [x.tolist() for x in want]

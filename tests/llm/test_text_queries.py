"""The ten text queries and the pipeline against SQL, brute force, round trips and held-out labels."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from compare import SF, difference

pytest.importorskip("tidemark.llm")
from tidemark.llm import fingerprints, nbest, packing, pii, token_counts  # noqa: E402
from tidemark.llm.queries import ORACLES, QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def texts(sf=SMALL):
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet')").fetchall()}


def rows(spark, name, sf=SMALL):
    return QUERIES[name](spark, sf).collect()


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.vocabulary_path(name))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), ORACLES[name]) == ""


def test_token_counts_of_whole_texts(spark):
    t = tokenizer("word_bpe_49k.json")
    want = {i: (len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in texts().items()}
    got = rows(spark, "op1_token_counts")
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


@pytest.mark.parametrize("text", ["word " * 400, "x" * 3000, "a <|endoftext|> b " * 80, "日本語 テキスト　" * 120, "é " * 500, "\U0001f600" * 700, " \t\n" * 300])
def test_splices_agree_with_one_encoding(text):
    path = token_counts.vocabulary_path("word_bpe_49k.json")
    want = len(tokenizer("word_bpe_49k.json").encode(text, add_special_tokens=False).ids)
    assert token_counts.count_tokens([text], path, 64, 8) == [want]


def test_edited_texts(spark):
    docs = sorted(texts().items())
    got = {r.doc_id: r for r in rows(spark, "op5_fingerprints")}
    assert len(got) == len(docs)
    same = defaultdict(set)
    for k, (i, text) in enumerate(docs):
        n = len(text) // 4
        edited = text[: len(text) - n] + docs[(k + 1) % len(docs)][1][:n]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        same[text].add(got[i].fingerprint)
    assert all(len(s) == 1 for s in same.values())
    assert len({s for v in same.values() for s in v}) == len(same)


def test_differing_branches_find_the_edit(spark):
    parts = [f"Paragraph {i} has its own words, {i * 7}." for i in range(40)]
    other = parts.copy()
    other[17] = "Something else stands here."
    docs = spark.createDataFrame([(1, "\n\n".join(parts)), (2, "\n\n".join(other))], "doc_id long, text string")
    a, b = (fingerprints.parse(r.fingerprint) for r in fingerprints.fingerprints(docs).orderBy("doc_id").collect())
    assert fingerprints.likeness(a, a) == 1.0
    assert 0.8 < fingerprints.likeness(a, b) < 1.0
    assert fingerprints.differing(a, b) and not fingerprints.differing(a, a)


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        check = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and check % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_of_the_corpus(spark):
    want = {i: plain_spans(t) for i, t in texts(SF).items()}
    got = {r.doc_id: r for r in rows(spark, "op6_pii", SF)}
    for i, spans in want.items():
        line = pii.joined(spans)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        kinds = Counter(k for _, k, _ in spans)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [kinds[k] for k in range(4)]
        assert set(filter(None, line.split(","))) <= set(got[i].spans.split(","))


@pytest.mark.parametrize("text", ["", "@", "a@b", "a@b.c@d.e", "..@x.y.", "1.2.3.4.5.6.7.8", "999.1.1.1", "4111 1111 1111 1111", "+1 (555) 010-9999 x", "1-1" * 50, "+1+2" * 20])
def test_base_spans_of_odd_texts(text):
    assert pii.base_spans(text) == plain_spans(text)


def all_paths(p, word):
    if not word:
        return [(0.0, ())]
    out = []
    for end in range(1, len(word) + 1):
        got = p.edge(word[:end])
        if got is not None:
            out += [(got[0] + s, got[1] + ids) for s, ids in all_paths(p, word[end:])]
    return out


def vocabulary(seed=1):
    """The vocabulary with random log-probabilities."""
    path = token_counts.vocabulary_path(nbest.VOCABULARY)
    n = nbest.library(path).vocab_size()
    return nbest.Pieces(path, np.log(np.random.default_rng(seed).dirichlet(np.ones(n))))


def test_best_paths_against_all_paths():
    p = vocabulary()
    rng = np.random.default_rng(2)
    some = ["".join(rng.choice(list("theinrsao."), 9)) for _ in range(30)]
    for text in ("hello", "a bc", "the cat", "naïve", "日本", "x  y", "▁", "a\nb", " lead", "\U0010ffff a", *some):
        got = [s for s, _ in p.paths_of([text], 4)[0]]
        want = sorted((s for s, _ in all_paths(p, " " + text)), reverse=True)[:4]
        assert np.allclose(got, want), text
        assert all(p.decode(ids) == text for _, ids in p.paths_of([text], 4)[0])


def test_columns_give_what_one_word_gives():
    p = vocabulary(3)
    rng = np.random.default_rng(4)
    words = [" " + "".join(rng.choice(list("abcdeéßñ日\n.T\U0001f600▁"), n)) for n in rng.integers(1, 60, 400)]
    for word, (score, loss, ids) in zip(words, p.forward_all(words), strict=True):
        best, second, one = p.forward(word)
        assert np.isclose(score, best[-1]) and np.isclose(loss, best[-1] - second) and ids == one


def test_scores_count_all_documents(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["the cat", "the  dog\n", None, "", "the"])], "doc_id long, text string")
    scores = nbest.piece_scores(docs)
    sp = nbest.library(token_counts.vocabulary_path(nbest.VOCABULARY))
    counts = np.full(sp.vocab_size(), 0.5)
    for w in ("the", "cat", "the", "", "dog\n", "the"):
        np.add.at(counts, sp.encode(w), 1)
    assert np.allclose(scores, np.log(counts / counts.sum()))


def test_best_paths_decode(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = nbest.n_best(docs)
    got = {r.doc_id: r for r in found.collect()}
    assert all(r.decoded and list(r.scores) == sorted(r.scores, reverse=True) and len({tuple(x) for x in r.ids}) == len(r.ids) for r in got.values())
    first = found.selectExpr("doc_id", "ids[0] AS ids")
    assert {r.doc_id: r.text for r in nbest.decode(first).collect()} == texts()
    sp = nbest.library(token_counts.vocabulary_path(nbest.VOCABULARY))
    ours, theirs = ([len(x) for x in xs] for xs in ([r.ids[0] for r in got.values()], sp.encode([texts()[i] for i in got])))
    assert sum(ours) <= 1.03 * sum(theirs)  # as few pieces as the library's, about


def auc(scores, truth):
    scores, truth = np.array(scores), np.array(truth)
    return (scores[truth == 1][:, None] > scores[truth == 0][None]).mean() + 0.5 * (scores[truth == 1][:, None] == scores[truth == 0][None]).mean()


@pytest.mark.parametrize(("name", "label", "folds", "held"), [("op8_toxicity", "toxic", 5, 0), ("op9_quality", "quality", 3, 1)])
def test_held_out_labels(spark, name, label, folds, held):
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM read_parquet('/root/testdata/sf0.1/labels.parquet') WHERE {label} IS NOT NULL").fetchall())
    got = rows(spark, name, "/root/testdata/sf0.1")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    out = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    print(name, auc(*zip(*out)))
    assert auc(*zip(*out)) >= 0.85


def test_packing(spark):
    t = tokenizer("byte_bpe_50k.json")
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in texts().items()}
    got = rows(spark, "op10_packing")
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            part = ids[i][r.start : r.start + r.length]
            assert (r.piece, r.start, r.length) == (k, at, len(part))
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert k == 0 or r.length == 2048
            at += r.length
        assert at == len(ids[i])
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    bound = packing.lower_bound(np.bincount([r.length for r in got], minlength=2049), 2048)
    assert bound <= len(bins) <= 1.02 * bound + 1


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = c.table(spark, SMALL, "documents")
    columns = docs.columns
    assert [n for n, _ in c.STAGES] == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]
    before = {r.doc_id for r in docs.collect()}
    for name, stage in c.STAGES[:-1]:
        docs = c.materialize(stage(spark, docs, SMALL), f"test-{name}")
        assert docs.columns == columns
        after = {r.doc_id for r in docs.collect()}
        assert after <= before
        before = after
    out = c.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in out} == before
    assert {r.doc_id for r in c.run(spark, SMALL).collect()} == before

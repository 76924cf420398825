"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both encodings must agree.

A text longer than a chunk is encoded in chunks that overlap. Each chunk's tokens come with offsets. Two
neighbours are spliced inside their overlap at a position where
  1. both encodings have a token boundary, and
  2. white space ends there, or a special token's text cannot reach over it: this tokenizer drops white space
     before it merges, so no token, pre-token or added token spans a run of it, and what stands left of it has no
     say in what stands right of it (nor the other way round, as composition and lower-casing act on neighbours
     that are not white space), and
  3. the tokens of both encodings on either side of that position, as far as the overlap goes, are the same.
1 and 2 prove the splice; 3 is checked all the same. Where the overlap has no such position, the left chunk is
widened, twice as far each time, until it has one or reaches the end of the text.

Texts within one chunk are encoded without offsets, word by word with a memo of bounded size, by the same proof:
ASCII blanks bound tokens.

Cases: a null or empty text has no bytes and no tokens. Rows are counted one by one, repeated rows and ids too;
an empty table gives an empty result; columns besides the id and the text are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import Memo, map_arrow

VOCABULARY = "word_bpe_49k.json"
CHUNK, OVERLAP = 32_768, 512
LIMIT = 2048
#: White space on which every part of the tokenizer agrees.
BLANKS = " \t\n\r"

_LOADED: dict[str, tuple] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):
    """The tokenizer and the memo of this Python worker."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t, Memo()
    return _LOADED[path]


def encode_with_offsets(tokenizer, text: str, at: int) -> list[tuple[int, int, int]]:
    """(id, start, end) for the tokens of text, which begins at position ``at`` of its document."""
    e = tokenizer.encode(text, add_special_tokens=False)
    return [(i, a + at, b + at) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]


def stable_boundary(text: str, left: list, right: list, lo: int, hi: int) -> int | None:
    """A position in (lo, hi) where the two encodings can be spliced: behind a blank, with the same tokens around it in both."""
    a, b = [t for t in left if t[2] > lo], [t for t in right if t[1] < hi]
    spans = {x for t in a for x in range(t[1] + 1, t[2])} | {x for t in b for x in range(t[1] + 1, t[2])}
    middle = (lo + hi) // 2
    for p in sorted(range(lo + 1, hi), key=lambda p: abs(p - middle)):
        if text[p - 1] not in BLANKS or p in spans:
            continue
        start = next((q for q in range(p - 2, lo, -1) if text[q] in BLANKS), None)
        stop = next((q for q in range(p, hi) if text[q] in BLANKS), None)
        if start is None or stop is None:
            continue
        inner = [t for t in a if t[1] >= start and t[2] <= stop], [t for t in b if t[1] >= start and t[2] <= stop]
        if inner[0] == inner[1]:
            return p
    return None


def encode_spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """The tokens of text with offsets, from chunks of about ``chunk`` code points."""
    out: list[tuple[int, int, int]] = []
    begin, right = 0, None
    while True:
        stop = begin + chunk
        if stop + overlap >= len(text):
            return out + (encode_with_offsets(tokenizer, text[begin:], begin) if begin < len(text) else [])
        wide = overlap
        while True:
            end = min(len(text), stop + wide)
            left = encode_with_offsets(tokenizer, text[begin:end], begin)
            if end == len(text):
                return out + left
            right = encode_with_offsets(tokenizer, text[stop : end + wide], stop)
            cut = stable_boundary(text, left, right, stop, end)
            if cut is not None:
                break
            wide *= 2
        out += [t for t in left if t[2] <= cut]
        begin = cut


def count_tokens(texts: list[str], path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    tokenizer, memo = _tokenizer(path)
    words = [None if len(t) > chunk else t.replace("\n", " ").split(" ") for t in texts]
    known = memo.fill(chain.from_iterable(w for w in words if w), lambda missing: [len(e) for e in tokenizer.encode_batch_fast(missing, add_special_tokens=False)])
    size = known.__getitem__
    return [len(encode_spliced(tokenizer, t, chunk, overlap)) if w is None else sum(map(size, w)) for t, w in zip(texts, words, strict=True)]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of docs."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_path(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = count_tokens(texts, path, chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return map_arrow(rows, counted, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")

"""Best-fit packing of token sequences, with lower bounds that certify each partition's number of bins.

Documents become pieces of at most ``capacity`` tokens. A piece that fills a sequence is one. The others are dealt
into partitions of bounded size and packed by best-fit decreasing. For each partition dual-feasible functions give
a lower bound on the number of bins that any packing of its pieces needs; where best-fit decreasing meets it, the
packing is certified and stays. The bins of the other partitions that still have room give their pieces back;
these are dealt anew, so that partitions exchange documents, and are packed again. A new packing of the pieces
given back replaces the old one only if it has fewer bins. Rounds end when every partition is certified, the bound
over all pieces is met, or a round gains nothing. Partitions hold a bounded number of pieces at any input size, and
the driver sees a row of totals a round and a histogram of at most ``capacity`` lengths.

Cases: a null or empty text is a document of one token, the end mark. Rows are packed one by one, repeated rows and
ids too. Ties in length go by id and piece. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ARROW_ROWS, Memo, discard, map_arrow, materialize
from .token_counts import vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
CAPACITY, END_ID = 2048, 0
#: Pieces in a partition, about, and rounds of repacking at most.
PART_PIECES, ROUNDS = 20_000, 6
#: Words that a worker remembers, and again as many of the generation before; words encoded at a time.
REMEMBERED, LINES = 500_000, 256

_LOADED: dict[str, tuple] = {}
_KINDS: dict[str | None, bool] = {}
_DOUBLE = re.compile(r"\s\s")
_CUTS = re.compile(r"(?<=\S)(?= \S)")
_LETTERS = re.compile(r"( ?([^\W\d_]+))([!-/:-@\[-`{-~]*)").fullmatch
_PLAIN = re.compile(r" ?\S+").fullmatch


def _tokenizer(path: str, remembered: int = REMEMBERED):
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t, Memo(remembered)
    _LOADED[path][1].size = remembered
    return _LOADED[path]


def _byte_level(tokenizer) -> bool:
    """Whether the tokenizer is byte-level, with that pre-tokenizer alone and no normalizer."""
    path = next((p for p, (t, _) in _LOADED.items() if t is tokenizer), None)
    if path not in _KINDS:
        made = json.loads(tokenizer.to_str())
        kind = made["pre_tokenizer"] or {}
        _KINDS[path] = not made["normalizer"] and kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space")
    return _KINDS[path]


def plain(text: str) -> bool:
    """Whether the text has no white space beside a blank, nor at its ends."""
    return bool(text) and not text[0].isspace() and not text[-1].isspace() and not _DOUBLE.search(text)


def little_endian(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def byte_letters() -> dict[int, int]:
    """The letter that a byte-level vocabulary writes each byte as: itself where it is printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


def encode_words(words: list[str], tokenizer, known=lambda word: None) -> list[bytes]:
    """The ids of each word.

    Letters, with a blank in front or not, are a pre-token, and so is the punctuation behind them: the model takes
    such a word without the pre-tokenizer, and ``known`` may have its letters. Of the others those without inner white space
    are encoded many at a time, each on a line: a line's end between them is a pre-token of its own.
    """
    out: dict[str, bytes] = {}
    tails: dict[str, bytes] = {"": b""}
    model, letters = tokenizer.model, byte_letters()
    for word in words if _byte_level(tokenizer) else ():
        m = _LETTERS(word)
        if not m or not m[2].isalpha():
            continue
        ids, front = known(m[1]) if m[3] else None, m[1]
        if ids is None:
            front = front.replace(" ", "\u0120") if front.isascii() else front.encode().decode("latin-1").translate(letters)
            ids = little_endian([t.id for t in model.tokenize(front)])
        tail = tails.get(m[3])
        if tail is None:
            tail = tails[m[3]] = little_endian(tokenizer.encode(m[3], add_special_tokens=False).ids)
        out[word] = ids + tail
    mark = tokenizer.encode("\n", add_special_tokens=False).ids
    plain = [w for w in words if w not in out and _PLAIN(w)] if len(mark) == 1 else []
    chunks = [plain[i : i + LINES] for i in range(0, len(plain), LINES)]
    for chunk, e in zip(chunks, tokenizer.encode_batch_fast(["\n".join(c) for c in chunks], add_special_tokens=False), strict=True):
        ids = little_endian(e.ids)
        ends = (np.flatnonzero(np.frombuffer(ids, "<u4") == mark[0]) * 4).tolist() + [len(ids)]
        if len(ends) == len(chunk):
            out.update(zip(chunk, (ids[a:b] for a, b in zip([0, *(x + 4 for x in ends)], ends))))
    rest = [w for w in words if w not in out]
    out.update(zip(rest, (little_endian(e.ids) for e in tokenizer.encode_batch_fast(rest, add_special_tokens=False))))
    return [out[w] for w in words]


def encode(texts: list[str], path: str, remembered: int = REMEMBERED) -> list[np.ndarray]:
    """The ids of each text as unsigned 32-bit numbers, from the tokenizer at path.

    Texts are cut before each blank that has no white space beside it. This tokenizer's pre-tokens take at most one blank,
    in front, so all its pre-tokens end at such a cut. Words are told apart in columns, each distinct one is looked up or encoded once, and the ids are gathered.
    """
    tokenizer, memo = _tokenizer(path, remembered)
    easy = [i for i, t in enumerate(texts) if plain(t)]
    parts = pc.split_pattern(pa.array([texts[i] for i in easy], pa.large_string()), " ")
    at, found = parts.offsets.to_numpy(), parts.flatten().dictionary_encode()
    word = found.indices.to_numpy().astype(np.int64)
    keys = [" " + w for w in found.dictionary.to_pylist()]
    word[at[:-1]] = len(keys) + np.arange(len(easy))  # a text's first word has no blank in front
    keys += [t[: t.find(" ")] if " " in t else t for t in map(texts.__getitem__, easy)]
    other = {i: _CUTS.split(texts[i]) for i in sorted(set(range(len(texts))).difference(easy))}
    word = np.concatenate([word, np.arange(len(keys), len(keys) + sum(map(len, other.values())))])
    for ws in other.values():
        keys += ws
    ids = memo.values(keys, lambda missing: encode_words(missing, tokenizer, memo.peek))
    flat, lengths = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    starts, n = np.cumsum(lengths) - lengths, lengths[word]
    ends = np.cumsum(n)
    flat = flat[np.repeat(starts[word] - (ends - n), n) + np.arange(int(n.sum()))]
    words = np.concatenate([np.diff(at), [len(ws) for ws in other.values()]]).astype(np.int64)
    stops = np.concatenate([[0], ends])[np.cumsum(words)]
    out = dict(zip([*easy, *other], np.split(flat, stops[:-1]))) if len(words) else {}
    return [out[i] for i in range(len(texts))]


def cut_pieces(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; only the first piece may be shorter than capacity."""
    n = len(ids)
    first = n % capacity or min(n, capacity)
    stops = list(range(first, n + 1, capacity))
    return [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip([0, *stops], stops))]


def pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int, end_id: int, remembered: int = REMEMBERED, rows: int = ARROW_ROWS, forget: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32).

    remembered, rows, forget: words that a worker remembers, texts that it encodes at once, and whether it forgets the words after
    each task. They bound its memory and change no result.
    """
    end = np.array([end_id], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_path(vocabulary)
        for batch in batches:
            got = [cut_pieces(np.concatenate([ids, end]), capacity) for ids in encode([t or "" for t in batch.column("text").to_pylist()], path, remembered)]
            at = pa.array(np.repeat(np.arange(len(got)), [len(g) for g in got]))
            k, start, length, crc = (list(x) for x in zip(*(p for g in got for p in g))) if got else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])
        if forget:
            _tokenizer(path, remembered)[1].clear()

    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return map_arrow(texts, cut, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long", rows)


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """The least number of bins that dual-feasible functions prove; histogram[s] items have size s."""
    n = np.asarray(histogram, np.int64)
    s = np.arange(len(n), dtype=np.int64)
    best = -(-int((n * s).sum()) // capacity)
    # u_eps: items above capacity - eps count as whole bins, those below eps as nothing.
    above, mass = np.concatenate([n[::-1].cumsum()[::-1], [0]]), np.concatenate([[0], (n * s).cumsum()])
    for eps in range(1, capacity // 2 + 1):
        hi = capacity - eps
        best = max(best, int(above[hi + 1]) - (-int(mass[hi + 1] - mass[eps]) // capacity))
    # f_k: an item of more than a multiple of 1 / (k + 1) of a bin rounds down to that multiple of 1 / k.
    for k in range(1, 33):
        x = s * (k + 1)
        parts = np.where(x % capacity == 0, s * k, (x // capacity) * capacity)
        best = max(best, -(-int((n * parts).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sizes in falling order: each item's bin and place in it, and each bin's room left."""
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin has room r
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        fits = some >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                some &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins[i], places[i] = b, capacity - r
        room[b] = r = r - size
        by_room[r].append(b)
        some |= 1 << r
    return bins, places, np.array(room, np.int64)


def _pack(items: DataFrame, parts: int, capacity: int, salt: int) -> DataFrame:
    """Packs each of ``parts`` partitions. bin and bins number within the partition; open: the bin has room and the partition no certificate."""
    schema = items.schema

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        sizes = pdf["length"].to_numpy(np.int64)
        bins, places, room = best_fit_decreasing(sizes, capacity)
        certified = len(room) == lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        return pdf.assign(bin=bins, offset=places, open=(room[bins] > 0) & (not certified))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    dealt = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32", F.lit(salt)), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").applyInPandas(pack, f"{fields}, part int, bin long, offset long, open boolean")


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, part_pieces: int = PART_PIECES, rounds: int = ROUNDS, remembered: int = REMEMBERED, rows: int = ARROW_ROWS, forget: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece."""
    all_pieces = materialize(pieces(docs, id_col, text_col, vocabulary, capacity, end_id, remembered, rows, forget), "packing-pieces")
    cols = all_pieces.columns
    whole = all_pieces.where(F.col("length") == capacity)
    done = [whole.select(*cols, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    items, base, before = all_pieces.where(F.col("length") < capacity), 0, None
    for k in range(rounds):
        n = items.count()
        if not n:
            break
        parts = -(-n // part_pieces)
        packed = materialize(_pack(items, parts, capacity, k), f"packing-round{k}")
        packed = packed.withColumn("sequence_id", F.lit(base) + F.col("bin") * parts + F.col("part"))
        t = packed.agg(F.max("sequence_id").alias("last"), F.count_if((F.col("offset") == 0)).alias("bins"), F.count_if((F.col("offset") == 0) & F.col("open")).alias("open")).first()
        if before is not None and t["bins"] >= before[1]:
            break
        if before is not None:
            done[-1] = before[0].where("not open").select(*cols, "sequence_id", "offset")
        done.append(packed.select(*cols, "sequence_id", "offset"))
        hist = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}
        counts = np.zeros(capacity + 1, np.int64)
        counts[list(hist)] = list(hist.values())
        if not t["open"] or t["bins"] <= lower_bound(counts, capacity):
            break
        base, before = t["last"] + 1, (packed, t["open"])
        items = packed.where("open").select(*cols)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out

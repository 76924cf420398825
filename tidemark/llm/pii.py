"""Personal data: fixed patterns, and a skip-chain conditional random field that carries their labels to distant repeats.

The patterns give the base spans. The field runs over a document's active nodes: tokens with a digit or an at sign, where
all tokens of one base span are one node, and so are numbers in a row that have up to 19 digits together, such as
``(017) 555-7713``. All other tokens are held at "nothing", which cuts the chain between nodes that do not follow each
other. Its potentials: a log-linear one for each token over features of its shape and neighbours; one for each pair
of nodes in a row; and skip edges between successive occurrences of the same or similar nodes (the same
digits; digits of which one are the end of the other's, 7 at least and 3 less at most, as without a country's code; or the same
letters and digits, without punctuation or case), wherever they stand in the document.
Loopy belief propagation passes messages until they settle, base spans held fast. A node gets a span, of its
likeliest kind, when the probability that it is of any is at least ``sure`` and skip edges tie it to an occurrence that a base span holds, so that an
entity is labelled alike throughout its document, in whatever format it comes again. Documents without base spans can gain none,
so the field is not run there. Base spans always stay.

Potentials are trained on the base spans of a bounded sample (``fit_docs``, by hash of the text, copies once; a text of
more than PIECE characters is cut at blanks, and each piece is sampled as a text): the token weights by multinomial
logistic regression, chain and skip potentials piecewise from counts of label pairs.

Cases: a null or empty text has no spans. Copies get equal results; rows are handled one by one, repeated rows and
ids too. Positions are code points, ends exclusive. Very long texts and runs without blanks take linear time. An
empty table gives an empty result, and is fitted to nothing. Columns besides id and text are left as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow

KINDS = ("email", "ip", "card", "phone")
#: Distinct pieces of texts that the potentials are fitted on, at most, and characters of a piece; the probability that a span needs.
FIT_DOCS, PIECE, SURE = 3_000, 20_000, 0.5
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The contract's patterns; possessive, which changes no match here and keeps them linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]")
ACTIVE = re.compile(r"\S*?[0-9@]\S*")
NOT_DIGIT, NOT_ALNUM = re.compile(r"[^0-9]+"), re.compile(r"[\W_]+")
#: A token of a number that may come in several; and one that ends it.
NUMBER, ENDED = re.compile(r"[(+]?[0-9][0-9().+-]*[.,;:!?]*").fullmatch, re.compile(r"[.,;:!?]$").search
#: Digits of numbers in a row that are one node, and of what skip edges tie, at most and least; digits that a similar one may lack.
MOST_DIGITS, LEAST_DIGITS, TAIL, LACK = 19, 6, 7, 3
#: Pairs that agree, for one that does not, that are counted before any is seen: as many digits seldom come again as something else.
SAME = 200
FEATURES = 24


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    if not ANY.search(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0]) if m.end() - m.start() <= 40 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def features(token: str, before: str, after: str) -> np.ndarray:
    digits = sum(c.isdigit() for c in token)
    n = len(token)
    core = token.strip(".,;:!?\"'")
    parts = core.split(".")
    out = np.zeros(FEATURES)
    out[:20] = (
        1, "@" in token, token.count(".") == 3, core.isdigit(), core.isdigit() and 14 <= len(core) <= 19, digits / n, min(n, 40) / 40, min(digits, 20) / 20, token[0] == "+", "(" in token and ")" in token,
        "-" in core and core.replace("-", "").isdigit(), "=" in token, digits == n, core.isalnum() and not core.isdigit(), len(parts) == 4 and all(p.isdigit() and len(p) <= 3 for p in parts), any(c.isupper() for c in token), any(c.islower() for c in token), ANY.search(before) is not None, ANY.search(after) is not None, digits < 5,
    )
    return out


def merged_nodes(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) of the active nodes: tokens, those of a base span and numbers in a row as one; label: the base span's kind + 1, or 0."""
    out: list[tuple[int, int, int]] = []
    at, last, digits = 0, None, 0
    for m in ACTIVE.finditer(text) if ANY.search(text) else ():
        a, b = m.span()
        while at < len(base) and base[at][2] <= a:
            at += 1
        span = next((s for s in takewhile(lambda s: s[0] < b, islice(base, at, None)) if s[2] > a), None)  # noqa: B023
        n = len(NOT_DIGIT.sub("", m[0])) if span is None and NUMBER(m[0]) else MOST_DIGITS + 1
        if span is not None and span == last:
            out[-1] = out[-1][0], b, out[-1][2]
        elif span is None and last is None and out and text[out[-1][1] : a] == " " and digits + n <= MOST_DIGITS and not ENDED(text[out[-1][1] - 1]):
            out[-1], digits = (out[-1][0], b, 0), digits + n
        else:
            out.append((a, b, span[1] + 1 if span else 0))
            digits = n
        last = span
    return out


def similar(x: str, y: str) -> bool:
    """Whether one's digits are the end of the other's, a few less at most."""
    return abs(len(x) - len(y)) <= LACK and (x.endswith(y) or y.endswith(x))


class Graph:
    """The active nodes of many documents, with their edges."""

    def __init__(self, texts: list[str], bases: list[list[tuple[int, int, int]]]):
        self.doc, self.start, self.end, self.held, rows, chain, skip, tails = [], [], [], [], [], [], set(), {}
        for d, (text, base) in enumerate(zip(texts, bases, strict=True)):
            known, first = defaultdict(list), len(self.doc)
            nodes = merged_nodes(text, base)
            for j, (a, b, label) in enumerate(nodes):
                i = first + j
                self.doc.append(d), self.start.append(a), self.end.append(b), self.held.append(label)
                before = text[nodes[j - 1][0] : nodes[j - 1][1]] if j and a - nodes[j - 1][1] == 1 else ""
                after = text[nodes[j + 1][0] : nodes[j + 1][1]] if j + 1 < len(nodes) and nodes[j + 1][0] - b == 1 else ""
                token = text[a:b]
                rows.append(features(token, before, after))
                if before:
                    chain.append((i - 1, i))
                digits, plain = NOT_DIGIT.sub("", token), NOT_ALNUM.sub("", token).lower()
                for key in (("d", digits), ("a", plain)):
                    if len(key[1]) >= LEAST_DIGITS:
                        known[key].append(i)
                if TAIL <= len(digits) <= MOST_DIGITS:
                    tails[i] = digits
                    known["t", digits[-TAIL:]].append(i)
            for (kind, _), occurrences in known.items():
                pairs = zip(occurrences, occurrences[1:])
                skip |= set(pairs) if kind != "t" else {(x, y) for x, y in pairs if similar(tails[x], tails[y])}
        self.x = np.array(rows).reshape(-1, FEATURES)
        self.held = np.array(self.held, int)
        self.chain, self.skip = np.array(chain, int).reshape(-1, 2), np.array(sorted(skip), int).reshape(-1, 2)

    def tied(self) -> np.ndarray:
        """For each token, whether skip edges lead to one that a base span holds."""
        reach = self.held > 0
        while len(self.skip):
            a, b = self.skip.T
            wide = reach.copy()
            np.logical_or.at(wide, a, reach[b])
            np.logical_or.at(wide, b, reach[a])
            if (wide == reach).all():
                break
            reach = wide
        return reach


def fit(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token weights (features x labels), chain and skip potentials (labels x labels), all logarithms."""
    k = len(KINDS) + 1
    g = Graph(texts, [base_spans(t) for t in texts])
    w = np.zeros((FEATURES, k))
    if len(g.x):
        y = np.eye(k)[g.held]
        for _ in range(300):
            z = g.x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            w -= 2.0 * (g.x.T @ (p - y) / len(g.x) + 1e-4 * w)
    pair = np.full((k, k), 1.0)
    np.add.at(pair, (g.held[g.chain[:, 0]], g.held[g.chain[:, 1]]), 1)
    chain = np.clip(np.log(pair * pair.sum() / np.outer(pair.sum(1), pair.sum(0))), -3, 3)
    same = int((g.held[g.skip[:, 0]] == g.held[g.skip[:, 1]]).sum())
    agree = np.clip(np.log((same + SAME) / (len(g.skip) - same + 1)), 2, 8)
    return w, chain, agree * np.eye(k)


def marginals(g: Graph, weights: tuple[np.ndarray, np.ndarray, np.ndarray], rounds: int = 30) -> np.ndarray:
    """Loopy sum-product over all tokens at once; tokens in a base span are held at its kind."""
    w, chain, skip = weights
    unary = g.x @ w
    unary -= unary.max(1, keepdims=True)
    held = np.where(g.held > 0)[0]
    unary[held] = -50
    unary[held, g.held[held]] = 0
    ends = np.concatenate([g.chain, g.skip])
    pots = np.concatenate([np.repeat(chain[None], len(g.chain), 0), np.repeat(skip[None], len(g.skip), 0)])
    src, dst = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    pots = np.exp(np.concatenate([pots, pots.transpose(0, 2, 1)]))
    back = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
    msg = np.zeros((len(src), unary.shape[1]))
    for _ in range(rounds if len(src) else 0):
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        out = belief[src] - msg[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.log(np.maximum(np.einsum("ei,eij->ej", out, pots), 1e-30))
        new -= new.max(1, keepdims=True)
        new = 0.5 * msg + 0.5 * new
        if np.abs(new - msg).max() < 1e-4:
            msg = new
            break
        msg = new
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def find_spans(texts: list[str], weights: tuple[np.ndarray, np.ndarray, np.ndarray], sure: float = SURE) -> list[tuple[list, list]]:
    """For each text its base spans and all its spans."""
    bases = [base_spans(t) for t in texts]
    added: dict[int, list] = defaultdict(list)
    some = [i for i, b in enumerate(bases) if b]
    if some:
        g = Graph([texts[i] for i in some], [bases[i] for i in some])
        p = marginals(g, weights)
        for i in np.where((g.held == 0) & g.tied() & (1 - p[:, 0] >= sure))[0]:
            d = some[g.doc[i]]
            start, end = g.start[i], g.end[i]
            core = texts[d][start:end]
            end -= len(core) - len(core.rstrip(".,;:!?)\"'%$*&#"))
            start += len(core) - len(core.lstrip("\"'" if ")" in core else "(\"'"))
            if start < end:
                added[d].append((start, int(p[i, 1:].argmax()), end))
    return [(b, sorted(b + added[i])) for i, b in enumerate(bases)]


def sample(docs: DataFrame, text_col: str = "text", fit_docs: int = FIT_DOCS) -> list[str]:
    """The at most ``fit_docs`` distinct pieces of texts with a digit or an at sign whose hashes are least. Only hashes are sorted; only these pieces come to the driver."""
    text = F.col(text_col)
    pieces = F.when(F.length(text) <= PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}(?:\s|\z)|.{{1,{PIECE}}}"), F.lit(0)))
    rows = docs.select(F.explode(pieces).alias("t")).where(F.col("t").rlike("[0-9@]")).withColumn("h", F.xxhash64("t"))
    least = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(fit_docs).collect()]
    if not least:
        return []
    return [r["t"] for r in sorted(rows.where(F.col("h") <= least[-1]).groupBy("h").agg(F.min("t").alias("t")).collect())]


def fitted(docs: DataFrame, text_col: str = "text", fit_docs: int = FIT_DOCS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Potentials from a sample of the texts."""
    return fit(sample(docs, text_col, fit_docs))


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, sure: float = SURE) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans); the counts are of base spans, spans has all."""
    weights = fitted(docs, text_col, fit_docs)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = find_spans([t or "" for t in batch.column("text").to_pylist()], weights, sure)
            counts = [pa.array([sum(s[1] == k for s in b) for b, _ in got], pa.int64()) for k in range(len(KINDS))]
            sha = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in got], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, sha, pa.array([joined(a) for _, a in got], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return map_arrow(rows, found, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; of spans that overlap, the union by the first one's kind."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", fit_docs: int = FIT_DOCS, sure: float = SURE) -> DataFrame:
    """docs with personal data in the text masked, and the number of characters counted anew; null texts stay null."""
    weights = fitted(docs, text_col, fit_docs)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            got = find_spans([t or "" for t in texts], weights, sure)
            new = [t if t is None else masked(t, spans) for t, (_, spans) in zip(texts, got, strict=True)]
            out = batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(new, pa.string()))
            if chars_col in batch.schema.names:
                n = [old if a == b else len(b) for old, a, b in zip(batch.column(chars_col).to_pylist(), texts, new, strict=True)]
                out = out.set_column(batch.schema.get_field_index(chars_col), chars_col, pa.array(n, batch.schema.field(chars_col).type))
            yield out

    return map_arrow(docs, mask, docs.schema)

"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Four kinds have a fixed grammar (email, ip, card, phone) and are always reported. Beyond them, wide
patterns propose further spans: secrets (long mixed tokens), numbers (long digit groups) and handles
(odd forms with an at sign). Regex, gazetteer and context labelers vote on each of these or abstain.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is; its
posteriors are soft labels for a logistic classifier over span features, which decides.

What the driver sees is a table of (votes, features) patterns, whose number is bounded by the
discrete values they can take, with counts over all documents.

Defined results: null and empty texts have no spans; spans are code points, end exclusive; ties in
start are ordered by kind as in ``KINDS``; repeated rows have equal spans; an empty table gives an empty
result; without candidates nothing is added; a very long text is one task's, in time proportional to it;
further columns are kept by ``redact`` and ignored otherwise.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches
from .textblocks import buffers, slices

KINDS = ("email", "ip", "card", "phone", "secret", "number", "handle")
_RANK = {k: i for i, k in enumerate(KINDS)}
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # always matches a run of digits whole, so none is read twice
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The spans of the four fixed kinds, in order. Each pattern takes time in proportion to the text."""
    out = list(_emails(text)) if "@" in text else []
    for m in _CHAIN.finditer(text):  # four parts of a dotted chain at a time, from its left
        parts, start = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append(("ip", start, end))
            start = end + 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], _RANK[s[0]]))


_WIDE = (
    ("secret", re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*[0-9])(?=[0-9_+/=-]*[A-Za-z])[A-Za-z0-9_+/=-]{16,}")),
    ("number", re.compile(r"(?<![A-Za-z0-9.+-])\(?[0-9](?:[ .()-]{0,2}[0-9]){8,}(?![A-Za-z0-9])")),
    ("handle", re.compile(r"(?<!\S)[^\s@]+@[^\s@]+(?!\S)")),
)
_KEYWORD = re.compile(r"([^\W\d_]+)\W{0,4}$")
#: Words that announce personal data.
GAZETTEER = {
    "secret": frozenset("token key secret password passwd pwd api apikey auth bearer credential access private session".split()),
    "number": frozenset("phone tel telephone call mobile fax card visa account acct iban ssn passport number konto telefon".split()),
    "handle": frozenset("mail email contact write user account twitter handle".split()),
}
LABELERS = ("grammar", "gazetteer", "quoted", "entropy", "company", "shape")


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def candidates(text: str, base: list[Span]) -> Iterator[tuple[Span, tuple[int, ...], tuple[int, ...]]]:
    """(span, votes, features) of the wide patterns' matches that touch no fixed span. Votes: 1, -1 or 0 (abstains)."""
    starts = [s for _, s, _ in base]
    ends = list(itertools.accumulate((e for _, _, e in base), max, initial=-1000))
    # whether a fixed span reaches into [lo, hi): of those that start before hi, one ends after lo
    touched = lambda lo, hi: ends[bisect.bisect_left(starts, hi)] > lo
    for kind, pattern in _WIDE:
        if kind == "handle" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            start, end = m.span()
            if touched(start, end):
                continue
            got, before, after = m[0], text[max(0, start - 24) : start], text[end : end + 1]
            digits = sum("0" <= c <= "9" for c in got)
            said = _KEYWORD.search(before)
            named = bool(said) and said[1].lower() in GAZETTEER[kind]
            quoted = before[-1:] in "\"'" and before != "" and after == before[-1:]
            entropy = _entropy(got)
            near = touched(start - 200, end + 200)
            if kind == "secret":
                grammar = 1 if re.fullmatch(r"(?:[0-9a-f]{32,}|[0-9A-F]{32,}|[A-Z0-9]{20,}|[A-Za-z0-9+/]{32,}={0,2})", got) else 0
                shape = 1 if digits >= 4 and len(got) >= 24 else -1
            elif kind == "number":
                grammar = 1 if re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}", got) else 0
                shape = 1 if 9 <= digits <= 11 else -1  # of card length, it has failed the card's checksum
            else:
                grammar = 1 if re.fullmatch(r"[\w.+-]+@[\w-]+", got) else -1
                shape = 1 if len(got) <= 40 else -1
            votes = (grammar, 1 if named else 0, 1 if quoted else 0, 1 if entropy >= 2.8 else -1, 1 if near else 0, shape)
            features = (KINDS.index(kind), min(7, len(got) // 8), min(3, 4 * digits // len(got)), int(named), int(quoted), min(4, int(entropy)), int(near), int(got.isascii()))
            yield (kind, start, end), votes, features


@dataclass(frozen=True)
class SpanModel:
    """Log-odds of each value of each feature, and the labelers' estimated reliabilities."""

    weights: dict[tuple[int, int], float]
    bias: float
    reliability: dict[str, float]

    def score(self, features: tuple[int, ...]) -> float:
        z = self.bias + sum(self.weights.get((i, v), 0.0) for i, v in enumerate(features))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(patterns: list[tuple[tuple[int, ...], tuple[int, ...], int]], rounds: int = 50) -> SpanModel | None:
    """A model from (votes, features, count); None if there is nothing to learn from."""
    if not patterns:
        return None
    patterns = sorted(patterns)
    votes = np.array([v for v, _, _ in patterns]) + 1
    n = np.array([c for _, _, c in patterns], float)
    labelers = votes.shape[1]
    post = np.clip(0.5 + 0.2 * (votes - 1).sum(axis=1), 0.05, 0.95)
    for _ in range(rounds):  # each labeler has a distribution over its votes for true and for false spans
        prior = (post @ n + 1) / (n.sum() + 2)
        log = np.log(np.stack([np.full(len(n), 1 - prior), np.full(len(n), prior)]))
        table = np.zeros((2, labelers, 3))
        for y, w in ((0, (1 - post) * n), (1, post * n)):
            for k in range(labelers):
                # the pseudo-votes say that a labeler is right more often than not
                share = np.bincount(votes[:, k], w, 3) + (np.array([0.5, 1, 2.0]) if y else np.array([2.0, 1, 0.5]))
                table[y, k] = share / share.sum()
                log[y] += np.log(table[y, k][votes[:, k]])
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
    keys = sorted({(i, v) for _, f, _ in patterns for i, v in enumerate(f)})
    at = {k: i for i, k in enumerate(keys)}
    x = np.zeros((len(patterns), len(keys) + 1))
    x[:, -1] = 1
    for r, (_, f, _) in enumerate(patterns):
        x[r, [at[i, v] for i, v in enumerate(f)]] = 1
    w, scale = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(25):  # Newton's method, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (scale * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (scale * (post - p)) - 1e-3 * w)
    right = {name: float((table[1, k, 2] + table[0, k, 0]) / (table[:, k, 0].sum() + table[:, k, 2].sum())) for k, name in enumerate(LABELERS)}
    return SpanModel(dict(zip(keys, map(float, w[:-1]), strict=True)), float(w[-1]), right)


def _texts(part: pa.RecordBatch, column: int) -> Iterator[tuple[int, str]]:
    """(row, text) of the rows that have a digit or an at sign; no other text holds a span."""
    buf, off = buffers(part.column(column))
    hit = np.flatnonzero((buf == 64) | ((buf >= 48) & (buf <= 57)))
    for i in np.flatnonzero(np.diff(np.searchsorted(hit, off))):
        yield int(i), buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")


def fit(docs: DataFrame) -> SpanModel | None:
    """A model from the candidates of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in slices(batches, "text"):
            for _, text in _texts(part, 0):
                for _, votes, features in candidates(text, base_spans(text)):
                    seen[votes + features] += 1
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], names=["k", "n"])

    rows = map_batches(docs.select("text"), count, "k array<int>, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    cut = len(LABELERS)
    return train([(tuple(r["k"][:cut]), tuple(r["k"][cut:]), r["n"]) for r in rows])


def all_spans(text: str, model: SpanModel | None) -> tuple[list[Span], list[Span]]:
    """(fixed spans, all spans), each in order."""
    base = base_spans(text)
    more = [] if model is None else [s for s, _, f in candidates(text, base) if model.score(f) >= 0.5]
    return base, sorted(base + more, key=lambda s: (s[1], _RANK[s[0]])) if more else base


def find(docs: DataFrame, model: SpanModel | None) -> DataFrame:
    """(doc_id, spans: array of (kind, start, stop, fixed)) of every row."""
    schema = "doc_id long, spans array<struct<kind:string,start:long,stop:long,fixed:boolean>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("fixed", pa.bool_())]))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found: list[list] = [[] for _ in range(part.num_rows)]
            for i, text in _texts(part, 1):
                base, every = all_spans(text, model)
                fixed = set(base)
                found[i] = [{"kind": s[0], "start": s[1], "stop": s[2], "fixed": s in fixed} for s in every]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return map_batches(docs.select("doc_id", "text"), mark, schema)


def replace(text: str, spans: list[Span]) -> str:
    """``text`` with each span, or run of spans that overlap, replaced by the first one's kind in angle brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: SpanModel | None) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced; all other columns stay as they are."""
    names = docs.columns
    at = names.index("text")

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            new = {}
            for i, text in _texts(part, at):
                if spans := all_spans(text, model)[1]:
                    new[i] = replace(text, spans)
            if new:
                column = part.column(at)
                texts = column.to_pylist()
                for i, text in new.items():
                    texts[i] = text
                columns = list(part.columns)
                columns[at] = pa.array(texts, column.type)
                part = pa.RecordBatch.from_arrays(columns, names=names)
            yield part

    return map_batches(docs, change, docs.schema)

"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, word pairs and pairs that skip one word, hashed to
``2**bits`` coordinates. FTRL-proximal gives each coordinate its own learning rate and, through its L1
term, exact zeros: the weights that remain are a few thousand numbers at most, which go to every task.

Defined results: null and empty texts have the score of the bias alone; repeated rows have equal
scores; an empty table gives an empty result; without a label for each class the score is the share
of label 1; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import labelled_sample, map_batches
from .textblocks import NOT_WORD, buffers, runs, mix, seeds, slices, span_hashes, tokens

_U = np.uint64


def features(buf: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, coordinate) of every word, pair and skip-pair, repeats included."""
    start, end, first = tokens(buf, off, NOT_WORD)
    h, doc = span_hashes(buf, start, end), runs(first)
    one, two, skip = seeds(3, 21) | _U(1)
    parts = [(doc, mix(h * one))]
    for gap, factor in ((1, two), (2, skip)):
        near = doc[gap:] == doc[:-gap] if len(doc) > gap else np.zeros(0, bool)
        parts.append((doc[gap:][near], mix(h[:-gap][near] * factor + h[gap:][near]) if len(near) else np.zeros(0, _U)))
    return np.concatenate([d for d, _ in parts]), (np.concatenate([x for _, x in parts]) >> _U(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Ftrl:
    """The coordinates that have a weight, in order, their weights, and the bias."""

    bits: int
    at: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        doc, x = features(buf, off, self.bits)
        dense = np.zeros(1 << self.bits, bool)
        dense[self.at] = True
        hit = dense[x]
        pair = np.unique(doc[hit] << self.bits | x[hit])  # a feature counts once in a text
        z = np.full(len(off) - 1, self.bias)
        np.add.at(z, pair >> self.bits, self.weight[np.searchsorted(self.at, pair & ((1 << self.bits) - 1))])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def without_copies(rows: list[tuple[np.ndarray, int]], keys: int = 3) -> list[tuple[np.ndarray, int]]:
    """The rows without most of the near copies of earlier ones: a row goes if one of ``keys`` pairs of
    minima of its coordinates' hashes was seen. Else a text that is copied often would teach its own words."""
    salts = seeds(2 * keys, 23)
    seen: set[tuple] = set()
    kept = []
    for x, y in rows:
        low = [int(mix(x.astype(_U) ^ s).min()) if len(x) else 0 for s in salts]
        own = {(k, low[2 * k], low[2 * k + 1]) for k in range(keys)}
        if not own & seen:
            kept.append((x, y))
        seen |= own
    return kept


def train_ftrl(rows: list[tuple[np.ndarray, int]], bits: int, alpha: float = 2.0, beta: float = 1.0, l1: float | None = None, l2: float = 0.0, epochs: int = 4, seed: int = 3) -> Ftrl:
    """Weights after ``epochs`` passes over (coordinates, label), each in a seeded order.

    The L1 term grows with the number of rows unless it is given: what one text or a few copies of it
    have in common must not get a weight.
    """
    l1 = max(2.0, 0.003 * len(rows)) if l1 is None else l1
    size = 1 << bits
    z, n = np.zeros(size), np.zeros(size)
    positive = sum(y for _, y in rows)
    rate = (positive + 0.5) / (len(rows) + 1)
    bias = bias0 = math.log(rate / (1 - rate))
    if not 0 < positive < len(rows):
        return Ftrl(bits, np.zeros(0, np.int64), np.zeros(0), bias0)
    order = np.random.default_rng(seed)
    seen = 0.0
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x, y = rows[i]
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2))
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, w.sum() + bias)))) - y
            sigma = (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha
            z[x] = zx + g - sigma * w
            n[x] = nx + g * g
            seen += g * g
            bias -= 0.1 * g / (1 + math.sqrt(seen))
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    at = np.flatnonzero(w)
    return Ftrl(bits, at, w[at], float(bias))


def fit(docs: DataFrame, labels: DataFrame, rows: int = 8000, bits: int = 20, **options) -> Ftrl:
    """A model of ``labels`` (doc_id, label), from at most ``rows`` labelled documents (documented bound).

    Tasks hash the sample's texts; the driver gets a list of coordinates for each of its rows.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            doc, x = features(*buffers(part.column(1)), bits)
            pair = np.unique(doc << bits | x)
            cut = np.searchsorted(pair >> bits, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array((pair & ((1 << bits) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.int32()), lists], names=["doc_id", "label", "x"])

    sample = map_batches(labelled_sample(docs, labels, rows, 5, 0), hashed, "doc_id long, label int, x array<int>").toArrow().sort_by([("doc_id", "ascending")])
    lists = sample.column("x").combine_chunks() if sample.num_rows else []
    found = [(lists[i].values.to_numpy(), int(y)) for i, y in enumerate(sample.column("label").to_pylist())]
    return train_ftrl(without_copies(found), bits, **options)


def toxicity(docs: DataFrame, model: Ftrl, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) and, as ``name``, the chance that a text is toxic; a column of that name is replaced."""
    columns = [c for c in (docs.columns if keep is None else keep) if c != name]
    rows = docs.select(*columns, *([] if "text" in columns else ["text"]))
    at, n = rows.columns.index("text"), len(columns)
    schema = docs.select(*columns).schema.add(name, "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 19):
            s = model.scores(*buffers(part.column(at)))
            yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(s)], names=[*columns, name])

    return map_batches(rows, score, schema)

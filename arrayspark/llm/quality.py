"""Document quality by a linear-chain conditional random field over lines.

Each line has features of its own bytes, whether it repeats, and the same features of its two
neighbours. The field has two states, bad and good, and a weight for each pair of neighbouring states.
Forward-backward gives each line's chance to be good; a document's score is their mean, weighted by length.

Chains of all documents of a block are worked on at once: the products of 2 x 2 matrices that the
forward and backward passes need are prefix products, made in log2(longest chain) steps.

Defined results: null and empty texts, and texts of line ends only, have the score of the empty line
alone; repeated rows have equal scores; an empty table gives an empty result; without a label for each
class the score is the share of label 1; a very long text is one task's, in time and memory proportional
to it; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import labelled_sample, map_batches, stored
from .textblocks import BLANK, BYTE_LOWER, buffers, runs, slices, span_hashes, tokens

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (9, 11, 12, 13, 32), "high": range(128, 256), "stop": b".,;:?", "mark": b"!|*#%&$~^_=<>{}[]@\\/+", "bang": b"!", "pipe": b"|"}
_TABLE = np.zeros((len(_CLASSES), 256), np.float32)
for _row, _bytes in zip(_TABLE, _CLASSES.values(), strict=True):
    _row[list(_bytes)] = 1
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
N_OWN = len(_CLASSES) + 10


def line_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own features of each line, its length in bytes, first line of each text); a text without lines has one empty line."""
    start, end, first = tokens(buf, off, _NEWLINE)
    lines = np.diff(first)
    empty = np.flatnonzero(lines == 0)
    if len(empty):  # an empty line where a text has none
        start = np.insert(start, first[empty], off[empty])
        end = np.insert(end, first[empty], off[empty])
        first = first + np.concatenate([[0], np.cumsum(lines == 0)])
    n = end - start
    size = np.maximum(n, 1).astype(np.float32)
    cols = []
    for row in _TABLE:
        total = np.concatenate([[0], np.cumsum(row[buf], dtype=np.float64)])
        cols.append(((total[end] - total[start]) / size).astype(np.float32))
    wstart, wend, _ = tokens(buf, off, BLANK)
    words = np.searchsorted(wstart, end) - np.searchsorted(wstart, start)
    # lines that their text holds again, by hash
    doc = runs(first)
    line_hash = span_hashes(buf, start, end, BYTE_LOWER)
    order = np.lexsort((line_hash, doc))
    same = np.zeros(len(n), bool)
    if len(n) > 1:
        equal = (line_hash[order][1:] == line_hash[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        same[order[1:]] |= equal
        same[order[:-1]] |= equal
    odd, again = np.zeros((2, len(wstart) + 1))
    if len(wstart):  # words that end in a mark, and words that repeat the one before
        odd[1:] = np.cumsum(_TABLE[6][buf[wend - 1]])
        h = span_hashes(buf, wstart, wend, BYTE_LOWER)
        again[2:] = np.cumsum(h[1:] == h[:-1])
    lo, hi = np.searchsorted(wstart, start), np.searchsorted(wstart, end)
    upper = np.array(cols[0]) / np.maximum(cols[0] + cols[1], 1e-6)
    count = np.diff(first)[doc]
    cols += [upper, np.log1p(n) / 5, n / size / np.maximum(words, 1), np.log1p(words) / 4, (odd[hi] - odd[lo]) / np.maximum(words, 1), (again[hi] - again[np.minimum(lo + 1, hi)]) / np.maximum(words, 1), same & (n > 0), n == 0, words <= 2, np.log1p(count) / 4]
    return np.stack([np.asarray(c, np.float32) for c in cols], axis=1), n, first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zeros beyond the ends), and a constant."""
    n, d = own.shape
    out = np.zeros((n, 3 * d + 1), np.float32)
    out[:, :d], out[:, -1] = own, 1
    out[1:, d : 2 * d] = own[:-1]
    out[:-1, 2 * d : 3 * d] = own[1:]
    begin, end = first[:-1], first[1:] - 1
    out[begin, d : 2 * d] = 0
    out[end, 2 * d : 3 * d] = 0
    return out


def _prefix(m: np.ndarray, begin: np.ndarray, longest: int) -> np.ndarray:
    """Products m[begin of chain] ... m[i] for each i, scaled; ``begin``: the first index of i's chain."""
    m = m.copy()
    step = 1
    at = np.arange(len(m))
    while step < longest:
        use = np.flatnonzero(at - step >= begin)
        left, right = m[use - step], m[use]
        new = np.empty_like(right)
        for i in (0, 1):
            for j in (0, 1):
                new[:, i, j] = left[:, i, 0] * right[:, 0, j] + left[:, i, 1] * right[:, 1, j]
        m[use] = new / new.max(axis=(1, 2), keepdims=True)
        step *= 2
    return m


def marginals(score: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chance that each line is good, chances of (state before, state) for each line but chains' first, else 0).

    ``score``: a line's log-odds for good; ``pairs``: log weights of (state before, state).
    """
    n = len(score)
    node = np.ones((n, 2))
    half = np.clip(score, -30, 30) / 2
    node[:, 0], node[:, 1] = np.exp(-half), np.exp(half)
    node /= node.max(axis=1, keepdims=True)
    edge = np.exp(pairs)
    begin = first[:-1][runs(first)]
    last = first[1:][runs(first)] - 1
    longest = int(np.diff(first).max(initial=1))
    m = edge[None, :, :] * node[:, None, :]
    m[first[:-1]] = node[first[:-1], None, :]
    alpha = _prefix(m, begin, longest)[:, 0, :]
    # from the right: beta of line i is the product of edge * node of i+1 ... last, on ones
    back = np.empty_like(m)
    back[:-1] = edge[None, :, :] * node[1:, None, :]
    back[last] = 1
    rev = back[::-1].transpose(0, 2, 1)
    beta = _prefix(rev, (n - 1 - last)[::-1], longest)[::-1][:, 0, :]
    both = alpha * beta
    good = both[:, 1] / both.sum(axis=1)
    pair = np.zeros((n, 2, 2))
    if n > 1:
        pair[1:] = alpha[:-1, :, None] * edge[None] * (node[1:] * beta[1:])[:, None, :]
        pair[first[:-1]] = 0
        pair /= np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-300)
    return good, pair


@dataclass(frozen=True)
class LineField:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray
    constant: float | None = None

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(off) - 1, self.constant)
        own, length, first = line_features(buf, off)
        good, _ = marginals(with_neighbours(self._scaled(own), first) @ self.weights, self.pairs, first)
        weight = length + 1.0
        total = np.add.reduceat(good * weight, first[:-1]) if len(good) else np.zeros(0)
        return np.clip(total / np.add.reduceat(weight, first[:-1]) if len(good) else total, 0, 1)

    def _scaled(self, own: np.ndarray) -> np.ndarray:
        return np.clip((own - self.mean) / self.scale, -4, 4)


def train_field(own: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = 250, rate: float = 0.08, ridge: float = 1e-3, batch: int = 512, seed: int = 7) -> LineField:
    """A field from the lines of labelled texts, each line with its text's label, by Adam on the conditional likelihood.

    Texts weigh alike, however long, and so do both labels. A step takes ``batch`` texts, in a seeded order.
    """
    share = float(label.mean()) if len(label) else 0.5
    mean, scale = (own.mean(axis=0), own.std(axis=0) + 1e-3) if len(own) else (np.zeros(N_OWN), np.ones(N_OWN))
    zero = np.zeros(3 * N_OWN + 1)
    if not len(label) or not 0 < share < 1:
        return LineField(mean, scale, zero, np.zeros((2, 2)), share)
    field = LineField(mean, scale, zero, np.zeros((2, 2)))
    x = with_neighbours(field._scaled(own), first)
    size = np.diff(first)
    each = 1 / size / np.where(label == 1, share, 1 - share) / 2
    w, t = zero.copy(), np.zeros((2, 2))
    m, s = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    rng = np.random.default_rng(seed)
    queue = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(queue) < min(batch, len(size)):
            queue = np.concatenate([queue, rng.permutation(len(size))])
        pick, queue = queue[:batch], queue[batch:]
        begin = np.concatenate([[0], np.cumsum(size[pick])])
        rows = np.repeat(first[pick] - begin[:-1], size[pick]) + np.arange(begin[-1])
        part, y = x[rows], np.repeat(label[pick], size[pick]).astype(np.float64)
        weight = np.repeat(each[pick], size[pick]) / len(pick)
        inner = weight.copy()
        inner[begin[:-1]] = 0
        good, pair = marginals(part @ w, t, begin)
        before = np.concatenate([[0], y[:-1]])
        seen = np.stack([[(inner * (before == a) * (y == b)).sum() for b in (0, 1)] for a in (0, 1)])
        g = np.concatenate([part.T @ (weight * (good - y)) + ridge * w, ((pair * inner[:, None, None]).sum(axis=0) - seen + ridge * t).ravel()])
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        d = rate * min(1.0, 2 * (1 - step / (steps + 1))) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
        w -= d[:-4]
        t -= d[-4:].reshape(2, 2)
    return LineField(mean, scale, w, t)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 4000, lines: int = 200_000, **options) -> LineField:
    """A field from at most ``rows`` labelled texts of ``lines`` lines together (documented bounds).

    Texts enter in the order of a hash of their id; one whose lines would exceed the bound is passed over.
    """
    sample = stored(labelled_sample(docs, labels, rows, 5, 0), "sample")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            first = line_features(*buffers(part.column(1)))[2]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first))], names=["doc_id", "n"])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            own, _, first = line_features(*buffers(part.column(1)))
            cells = pa.ListArray.from_arrays(pa.array((first * N_OWN).astype(np.int32)), pa.array(own.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.int32()), cells], names=["doc_id", "label", "x"])

    sizes = map_batches(sample, counted, "doc_id long, n long").select("doc_id", "n", F.xxhash64("doc_id", F.lit(19)).alias("h")).collect()
    left, chosen = lines, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if r["n"] <= left:
            left -= r["n"]
            chosen.append((r["doc_id"],))
    few = sample.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long")), "doc_id", "left_semi")
    got = map_batches(few, described, "doc_id long, label int, x array<float>").toArrow().sort_by([("doc_id", "ascending")])
    if not got.num_rows:
        return train_field(np.zeros((0, N_OWN), np.float32), np.zeros(1, np.int64), np.zeros(0), **options)
    cells = got.column("x").combine_chunks()
    first = cells.offsets.to_numpy().astype(np.int64) // N_OWN
    return train_field(cells.values.to_numpy().reshape(-1, N_OWN), first, got.column("label").to_numpy(), **options)


def quality(docs: DataFrame, field: LineField) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(field.scores(*buffers(part.column(1))))], names=["doc_id", "score"])

    return map_batches(docs.select("doc_id", "text"), score, "doc_id long, score double")

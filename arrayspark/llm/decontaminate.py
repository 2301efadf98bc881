"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

A CGK walk reads a sequence with a pointer: at step j it emits the word under the pointer, and a random
bit that depends on j and that word says whether the pointer moves. Two sequences at edit distance k
fall in step again after each edit, so their walks differ at O(k**2) steps: edit distance becomes
Hamming distance. LSH then samples some steps of the walk and looks their words up.

Every word of a document opens a window, and windows are walked all at once. A walk takes 24 steps and
reads about half as many words, so one walk serves items of every length: an item enters the index at
many anchors (every ``stride`` words, each word of a short one), and its windows together are as long
as the item. An edit near one anchor leaves others. A window belongs to the document that it opens in
and must end there, so what is found doesn't depend on the documents beside it. Candidates are verified
by exact word-level edit distance between the item and its best stretch of that document around the place.

Words are runs of letters and digits with A-Z lower-cased. Defined results: null and empty texts match
nothing, nor do items without words; ties go to the least start; repeated rows match alike, null ids
too; a very long text is one task's, in time and memory proportional to it; empty tables give an empty
result; further columns are ignored. The driver holds the benchmark, not the corpus: beyond
``max_items`` items the index is cut into parts of that many, each with a pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches
from .textblocks import NOT_WORD, buffers, mix, seeds, slices, span_hashes, tokens

_U = np.uint64


@dataclass(frozen=True)
class Plan:
    """Walks, and for each the samples: the steps whose words make a key. A key serves where its walk ends within the item.

    A key of fewer than ``distinct`` different positions of an item would be met by chance too often and isn't
    indexed. Items below ``dense`` words are indexed at each word, others at every ``stride``-th; items too short for
    the first sample use ``short`` at each of their words.
    """

    walks: tuple[int, ...] = (31, 37, 41)
    samples: tuple[tuple[int, ...], ...] = ((0, 4, 8, 11), (2, 6, 9, 13), (5, 8, 12, 15), (7, 11, 14, 18), (10, 13, 17, 20), (12, 16, 19, 23))
    short: tuple[tuple[int, ...], ...] = ((0,), (1, 2))
    stride: int = 4
    dense: int = 24
    distinct: int = 3


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least word edit distance between ``item`` and any stretch of ``text``, and where the first best one ends."""
    row = np.zeros(len(text) + 1, np.int64)  # a stretch may start anywhere
    span = np.arange(len(text) + 1)
    for i, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - span) + span  # insertions run along the row
    end = int(row.argmin())
    return int(row[end]), end


def _step(words: np.ndarray, bits: np.ndarray, at: np.ndarray, samples: tuple, walk: int, read: dict | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(sample, key, position of the last word) of the windows that open at ``at``, as the walk passes the samples' last steps.

    ``read``: gets the number of different positions under each sample.

    ``words`` ends in enough zeros for every window; ``bits`` holds 64 random bits for each word.
    """
    pointer = at.copy()
    last = max(max(s) for s in samples)
    factor = seeds(last + 1, walk) | _U(1)
    sums: dict[int, np.ndarray] = {}
    for j in range(last + 1):
        for k, s in enumerate(samples):
            if j in s:
                if read is not None:
                    before = read.get(k, (np.full(len(at), -1), np.zeros(len(at), np.int64)))
                    read[k] = pointer.copy(), before[1] + (before[0] != pointer)
                term = words[pointer] * factor[j]
                sums[k] = term if k not in sums else sums[k] + term
                if j == max(s):
                    yield k, mix(sums.pop(k)), pointer
        pointer = pointer + ((bits[pointer] >> _U(j)) & _U(1)).astype(np.int64)


class Index:
    """The items' words, and for each walk and sample a table from keys to (item, anchor)."""

    def __init__(self, items: list[tuple[int, str]], share: float, plan: Plan = Plan()):
        self.plan, self.share, self.verified = plan, share, 0
        buf, off = buffers(pa.array([t or "" for _, t in items], pa.string()))
        start, end, first = tokens(buf, off, NOT_WORD)
        h = span_hashes(buf, start, end)
        self.ids = [i for i, _ in items]
        self.items = [h[first[i] : first[i + 1]] for i in range(len(items))]
        self.longest = max((len(x) for x in self.items), default=0)
        self.tables: dict[tuple[int, int, bool], tuple[np.ndarray, np.ndarray]] = {}
        for walk in plan.walks:
            for short, samples in ((False, plan.samples), (True, plan.short)):
                keys: dict[int, list] = {k: [] for k in range(len(samples))}
                for i, words in enumerate(self.items):
                    if not len(words) or short != (len(words) < 3 + max(plan.samples[0])):
                        continue
                    pad = np.concatenate([words, np.zeros(64, _U)])
                    anchors = np.arange(0, len(words), 1 if len(words) < plan.dense else plan.stride)
                    read: dict = {}
                    for k, key, end in _step(pad, mix(pad ^ seeds(1, walk)[0]), anchors, samples, walk, read):
                        fits = (end < len(words)) & (short | (read[k][1] >= plan.distinct))
                        keys[k] += [(int(x), i, int(a)) for x, a in zip(key[fits], anchors[fits], strict=True)]
                for k, found in keys.items():
                    if found:
                        found = sorted(set(found))
                        self.tables[walk, k, short] = np.array([x for x, _, _ in found], _U), np.array([(i, a) for _, i, a in found], np.int64)

    def candidates(self, words: np.ndarray, first: np.ndarray, block: int = 1 << 15) -> np.ndarray:
        """Distinct (text, item, place in the text) of all windows whose key is in a table.

        ``words`` of all texts end in 64 zeros; a place may lie before its text.
        """
        found = [np.zeros((0, 3), np.int64)]
        n = len(words) - 64
        low = _U(0xFFFF)
        for walk in self.plan.walks:
            bits = mix(words ^ seeds(1, walk)[0])
            for short, samples in ((False, self.plan.samples), (True, self.plan.short)):
                tables = {k: self.tables[walk, k, short] for k in range(len(samples)) if (walk, k, short) in self.tables}
                if not tables:
                    continue
                marks = {}
                for k, (keys, _) in tables.items():
                    marks[k] = np.zeros(1 << 16, bool)
                    marks[k][(keys & low).astype(np.int64)] = True
                for begin in range(0, n, block):
                    at = np.arange(begin, min(n, begin + block))
                    for k, key, end in _step(words, bits, at, samples, walk):
                        if k not in tables:
                            continue
                        near = np.flatnonzero(marks[k][(key & low).astype(np.int64)])
                        keys, owner = tables[k]
                        lo, hi = np.searchsorted(keys, key[near], "left"), np.searchsorted(keys, key[near], "right")
                        near, lo, hi = near[hi > lo], lo[hi > lo], hi[hi > lo]
                        text = np.searchsorted(first, at[near], "right") - 1
                        own = end[near] < first[text + 1]  # the window ends in the text that it opens in
                        near, lo, hi, text = near[own], lo[own], hi[own], text[own]
                        if not len(near):
                            continue
                        many = hi - lo
                        row = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
                        place = np.repeat(at[near] - first[text], many) - owner[row, 1]
                        found.append(np.unique(np.stack([np.repeat(text, many), owner[row, 0], place], axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def matches(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, end word) of each text and item within the share of the item's words."""
        start, end, first = tokens(buf, off, NOT_WORD)
        h = span_hashes(buf, start, end)
        if not len(h) or not self.longest:
            return []
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done: set[tuple[int, int, int]] = set()
        for doc, i, place in self.candidates(np.concatenate([h, np.zeros(64, _U)]), first).tolist():
            item = self.items[i]
            slack = int(self.share * len(item)) + 1
            # places a few words apart look at the same stretch: it is wide enough for all of them
            cell = place // (slack + 4)
            if (doc, i, cell) in done:
                continue
            done.add((doc, i, cell))
            text = h[first[doc] : first[doc + 1]]
            lo = max(0, cell * (slack + 4) - slack)
            part = text[lo : max(0, (cell + 1) * (slack + 4) + len(item) + slack)]
            # words that the stretch lacks cost an edit each
            if not len(part) or len(item) - np.isin(item, part).sum() > self.share * len(item):
                continue
            self.verified += 1
            d, at = edit_distance(item, part)
            if d <= self.share * len(item):
                _, length = edit_distance(item[::-1], part[:at][::-1])
                hit = (d, lo + at - length, lo + at)
                best[doc, i] = min(best.get((doc, i), hit), hit)
        return [(doc, i, *hit) for (doc, i), hit in sorted(best.items())]


def _indexes(benchmark: DataFrame, share: float, max_items: int, plan: Plan) -> list[Index]:
    n = benchmark.count()
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    parts = max(1, -(-n // max_items))
    split = [items] if parts == 1 else [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)]
    return [Index([(r[0], r[1]) for r in part.orderBy("item_id", "text").toLocalIterator()], share, plan) for part in split]


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, max_items: int = 20_000, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, item_id, n_words, distance, start_word, end_word) of each document and item within an
    edit distance of ``share`` of the item's words; rows and items that repeat give equal rows once per row."""
    out = None
    for index in _indexes(benchmark, share, max_items, plan):

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                if hits := index.matches(*buffers(part.column(1))):
                    ids = part.column(0).take(pa.array([m[0] for m in hits]))
                    rest = [pa.array([index.ids[m[1]] for m in hits], pa.int64()), pa.array([len(index.items[m[1]]) for m in hits], pa.int64()), *(pa.array([m[k] for m in hits], pa.int64()) for k in (2, 3, 4))]
                    yield pa.RecordBatch.from_arrays([ids, *rest], names=["doc_id", "item_id", "n_words", "distance", "start_word", "end_word"])

        found = map_batches(docs.select("doc_id", "text"), find, "doc_id long, item_id long, n_words long, distance long, start_word long, end_word long")
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, max_items: int = 20_000, plan: Plan = Plan()) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item is found; no join and no shuffle."""
    out = docs
    for index in _indexes(benchmark, share, max_items, plan):

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                keep = np.ones(part.num_rows, bool)
                keep[[m[0] for m in index.matches(*buffers(part.column(part.schema.get_field_index("text"))))]] = False
                yield part.filter(pa.array(keep))

        out = map_batches(out, clean, out.schema)
    return out

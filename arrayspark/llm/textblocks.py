"""Vectorised text primitives over Arrow buffers.

A text column of a record batch is one run of UTF-8 bytes with offsets. Working on that run with
numpy gives words, hashes and counts of all its texts at once, without a Python object per word.
All functions take ``buf`` (uint8) and ``off`` (int64, one more than there are texts).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_MULT = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit values that depend on ``seed`` only."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(1_000_003)) * _GOLDEN)


#: One value for each byte, and the same with A-Z taken as a-z.
BYTE = seeds(256, 1)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]

#: The separators of ``[^\x20\x09-\x0D]+``.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

#: Everything in ASCII but letters and digits.
NOT_WORD = np.ones(256, bool)
NOT_WORD[48:58] = NOT_WORD[65:91] = NOT_WORD[97:123] = NOT_WORD[128:] = False

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant and of its inverse modulo 2**64, at least ``n`` of each."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = 1 << max(16, int(max(n, 1) - 1).bit_length())
        inverse = pow(int(_MULT), -1, 1 << 64)
        for key, base in (("up", int(_MULT)), ("down", inverse)):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` has about ``limit`` bytes; a longer text is one batch."""
    for batch in batches:
        _, off = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def tokens(buf: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes without separators, and the first run of each text (one more than texts)."""
    inside = ~separators[buf]
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, off)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = BYTE_LOWER) -> np.ndarray:
    """A 64-bit hash of each span of bytes: differences of one running polynomial sum, so a byte is read once."""
    up, down = _power(len(buf))
    total = np.zeros(len(buf) + 1, _U)
    np.cumsum(table[buf] * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] if len(start) else np.zeros(0, _U))


def runs(first: np.ndarray) -> np.ndarray:
    """The text of each token, from the first token of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def int64(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)

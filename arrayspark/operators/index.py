"""Boxes, index lists, views, and operations that change an array's shape."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce as fold
from itertools import islice, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..array import NDArray
from ..functions import ieee
from ..meta import ArrayError, DType, dtype
from .create import positions


def _box(a: NDArray, start: Sequence[int], stop: Sequence[int]) -> tuple[list[int], list[int]]:
    if len(start) != a.ndim or len(stop) != a.ndim:
        raise ArrayError("a box needs a start and a stop for each axis")
    lo = [s + n if s < 0 else s for s, n in zip(start, a.shape, strict=True)]
    hi = [s + n if s < 0 else s for s, n in zip(stop, a.shape, strict=True)]
    if any(not 0 <= x <= y <= n for x, y, n in zip(lo, hi, a.shape, strict=True)):
        raise ArrayError(f"no box from {list(start)} to {list(stop)} in {a.shape}")
    return lo, hi


def _all(conditions: Sequence[Column]) -> Column:
    return fold(lambda x, y: x & y, conditions, F.lit(True))


def get_slice(a: NDArray, start: Sequence[int], stop: Sequence[int], view: bool = False, **storage) -> NDArray:
    """The box [start, stop) of each axis; negative bounds count from the end. The filter reaches the scan."""
    lo, hi = _box(a, start, stop)
    shape = [y - x for x, y in zip(lo, hi, strict=True)]
    if (c := storage.get("chunkshape")) and any(x > n for x, n in zip(c, shape, strict=True)):
        raise ArrayError("chunks longer than the slice")
    inside = [(F.col(f"i{k}") >= x) & (F.col(f"i{k}") < y) for k, (x, y) in enumerate(zip(lo, hi, strict=True)) if x > 0 or y < a.shape[k]]
    return a.where_cells(_all(inside), lo, shape, view=view, **storage)


def get_slice_buffer(a: NDArray, start: Sequence[int], stop: Sequence[int], buflen: int | None = None) -> bytes:
    """The box as row-major bytes."""
    from ..sources.buffers import to_buffer

    return to_buffer(get_slice(a, start, stop), buflen)


def _writable(a: NDArray) -> None:
    if a.is_view:
        raise ArrayError("a view can't be written")


def set_slice(a: NDArray, start: Sequence[int], stop: Sequence[int], b: NDArray) -> NDArray:
    """``a`` with the box replaced by ``b``: what lies outside passes, the box comes from ``b``; no join."""
    _writable(a)
    lo, hi = _box(a, start, stop)
    if b.dtype != a.dtype or b.shape != tuple(y - x for x, y in zip(lo, hi, strict=True)):
        raise ArrayError("type or shape of the box and of what fills it differ")
    inside = _all([(F.col(f"i{k}") >= x) & (F.col(f"i{k}") < y) for k, (x, y) in enumerate(zip(lo, hi, strict=True))])
    moved = b.df.select(*[(F.col(f"i{k}") + F.lit(x)).alias(f"i{k}") for k, x in enumerate(lo)], "v")
    return NDArray.cells(a.df.where(~inside).unionByName(moved), a.meta.but(urlpath=None))


def set_slice_buffer(a: NDArray, start: Sequence[int], stop: Sequence[int], buffer: bytes) -> NDArray:
    from ..sources.buffers import from_buffer

    _writable(a)
    if any(s < 0 for s in start) or any(e < s for s, e in zip(start, stop, strict=True)):
        raise ArrayError("bounds of a written box must be in order and not negative")
    lo, hi = _box(a, start, stop)
    return set_slice(a, start, stop, from_buffer(a.spark, buffer, a.dtype, [y - x for x, y in zip(lo, hi, strict=True)]))


#: Index lists of so many entries at most go to every task (16 bytes each); longer ones are joined by exchange.
BROADCAST_INDICES = 1_000_000
#: Lists of so many different entries are filters of the scan themselves, longer ones by their bounds.
LISTED = 1000


def _indices(a: NDArray, selection: Sequence[Sequence[int]]) -> list[list[int]]:
    if len(selection) != a.ndim:
        raise ArrayError("a list of indices for each axis is needed")
    out = [[int(x) + n if x < 0 else int(x) for x in s] for s, n in zip(selection, a.shape, strict=True)]
    for k, at in enumerate(out):
        if any(not 0 <= x < a.shape[k] for x in at):
            raise ArrayError(f"an index beyond axis {k}")
    return out


def _lists(a: NDArray, indices: Sequence[Sequence[int]]) -> list[DataFrame]:
    tables = [a.spark.createDataFrame([(x, p) for p, x in enumerate(at)], f"i{k} long, p{k} long") for k, at in enumerate(indices)]
    return [F.broadcast(t) if len(at) <= BROADCAST_INDICES else t for t, at in zip(tables, indices, strict=True)]


def _within(indices: Sequence[Sequence[int]]) -> Column:
    """What the scan can tell of a selection."""
    known = []
    for k, at in enumerate(indices):
        i, values = F.col(f"i{k}"), sorted(set(at))
        known.append(i.isin(values) if len(values) <= LISTED else (i >= values[0]) & (i <= values[-1]))
    return _all(known)


def get_orthogonal(a: NDArray, selection: Sequence[Sequence[int]]) -> NDArray:
    """result[k0, k1, ...] = a[selection[0][k0], selection[1][k1], ...]; an index may repeat.

    The array is filtered by the lists and stays where it is; the lists go to it.
    """
    if a.is_view:
        raise ArrayError("index lists don't work on views")
    indices = _indices(a, selection)
    df = a.df.where(_within(indices))
    for k, table in enumerate(_lists(a, indices)):
        df = df.join(table, f"i{k}")
    cells = df.select(*[F.col(f"p{k}").alias(f"i{k}") for k in range(a.ndim)], "v")
    return NDArray.cells(cells, a.meta.but(shape=[len(s) for s in selection], urlpath=None))


def set_orthogonal(a: NDArray, selection: Sequence[Sequence[int]], values: np.ndarray | NDArray) -> NDArray:
    """``a`` with the cells of the selection replaced; of repeated indices the last one counts.

    What lies outside the selection passes and the selection comes from ``values``: a union, without a join of cells.
    """
    _writable(a)
    new = values if isinstance(values, NDArray) else NDArray.from_numpy(a.spark, np.asarray(values, a.dtype.numpy).reshape([len(s) for s in selection]))
    if new.shape != tuple(len(s) for s in selection) or new.dtype != a.dtype:
        raise ArrayError("type or shape of the selection and of what fills it differ")
    indices = _indices(a, selection)
    last = [list({x: p for p, x in enumerate(at)}.items()) for at in indices]
    tables = [a.spark.createDataFrame(rows, f"i{k} long, p{k} long") for k, rows in enumerate(last)]
    tables = [F.broadcast(t) if len(rows) <= BROADCAST_INDICES else t for t, rows in zip(tables, last, strict=True)]
    keys = [f"i{k}" for k in range(a.ndim)]
    fill = new.df.select(*[F.col(f"i{k}").alias(f"p{k}") for k in range(a.ndim)], "v")
    out = a.df
    for k, table in enumerate(tables):
        fill = fill.join(table, f"p{k}")
        out = out.join(table, f"i{k}", "left")
    outside = out.where(fold(lambda x, y: x | y, [F.col(f"p{k}").isNull() for k in range(a.ndim)], F.lit(False)))
    return NDArray.cells(outside.select(*keys, "v").unionByName(fill.select(*keys, "v")), a.meta.but(urlpath=None))


#: The casts that a type view may make.
VIEW_CASTS = {
    "f64": "i64 u64",
    "f32": "f64 i64 i32 u64 u32",
    "i64": "f64 u64",
    "i32": "f64 f32 i64 u64 u32",
    "i16": "f64 f32 i64 i32 u64 u32 u16",
    "i8": "f64 f32 i64 i32 i16 u64 u32 u16 u8 bool",
    "u64": "f64 i64",
    "u32": "f64 f32 i64 i32 u64",
    "u16": "f64 f32 i64 i32 i16 u64 u32",
    "u8": "f64 f32 i64 i32 i16 i8 u64 u32 u16 bool",
    "bool": "f64 f32 i64 i32 i16 i8 u64 u32 u16 u8",
}


def type_view(a: NDArray, kind: str | DType) -> NDArray:
    """``a`` cast cell by cell when read; only casts to types that aren't narrower."""
    kind = dtype(kind)
    if kind != a.dtype and kind.name not in VIEW_CASTS[a.dtype.name].split():
        raise ArrayError(f"no view of {a.dtype.name} as {kind.name}")
    return NDArray(a.origin, a.coords, ieee.cast(a.value, a.dtype, kind), a.meta.but(dtype=kind, view=True))


def transpose(a: NDArray) -> NDArray:
    """The two axes swapped: names change, no row moves."""
    if a.ndim != 2:
        raise ArrayError("two dimensions are needed")
    swap = lambda s: s and (s[1], s[0])
    meta = a.meta.but(shape=swap(a.shape), chunkshape=swap(a.meta.chunkshape), blockshape=swap(a.meta.blockshape), view=True)
    return NDArray(a.origin, (a.coords[1], a.coords[0]), a.value, meta)


def squeeze(a: NDArray, axes: Sequence[int] | None = None) -> NDArray:
    """Axes of length one dropped: all, or those named."""
    drop = {a.meta.axis(k) for k in axes} if axes is not None else {k for k, n in enumerate(a.shape) if n == 1}
    if any(a.shape[k] != 1 for k in drop):
        raise ArrayError("only axes of length one can go")
    keep = [k for k in range(a.ndim) if k not in drop]
    cut = lambda s: s and tuple(s[k] for k in keep)
    return NDArray(a.origin, tuple(a.coords[k] for k in keep), a.value, a.meta.but(shape=cut(a.shape) or (), chunkshape=cut(a.meta.chunkshape), blockshape=cut(a.meta.blockshape)))


def _zero_cells(a: NDArray, shape: Sequence[int], inside: Column) -> DataFrame:
    df, coords = positions(a.spark, shape)
    zero = F.lit(False) if a.dtype.kind == "b" else F.lit(0).cast(a.dtype.spark)
    return df.select(*[c.alias(f"i{k}") for k, c in enumerate(coords)], zero.alias("v")).where(inside)


def resize(a: NDArray, shape: Sequence[int], start: Sequence[int] | None = None) -> NDArray:
    """``a`` in another shape: along each axis cells are put in or taken out at ``start`` (the end by default); new ones are 0."""
    _writable(a)
    shape = tuple(shape)
    if len(shape) != a.ndim:
        raise ArrayError("resizing keeps the number of axes")
    at = list(start) if start is not None else [min(n, m) for n, m in zip(a.shape, shape, strict=True)]
    if any(not 0 <= s <= min(n, m) for s, n, m in zip(at, a.shape, shape, strict=True)):
        raise ArrayError("cells can only be put in or taken out within the array")
    keep, moved, new = [], [], F.lit(False)
    for k, (s, n, m) in enumerate(zip(at, a.shape, shape, strict=True)):
        i, more = F.col(f"i{k}"), m - n
        if more < 0:
            keep.append((i < s) | (i >= s - more))
        moved.append(F.when(i >= s, i + F.lit(more)).otherwise(i).alias(f"i{k}") if more else i)
        if more > 0:
            new = new | ((i >= s) & (i < s + more))
    out = a.df.where(_all(keep)).select(*moved, "v")
    if any(m > n for n, m in zip(a.shape, shape, strict=True)):
        out = out.unionByName(_zero_cells(a, shape, new))
    return NDArray.cells(out, a.meta.but(shape=shape, urlpath=None))


def insert(a: NDArray, b: NDArray | np.ndarray, axis: int, at: int) -> NDArray:
    """``b`` put in along ``axis`` before index ``at``."""
    _writable(a)
    axis = a.meta.axis(axis)
    b = b if isinstance(b, NDArray) else NDArray.from_numpy(a.spark, np.asarray(b, a.dtype.numpy))
    if b.dtype != a.dtype or b.ndim != a.ndim or any(x != y for k, (x, y) in enumerate(zip(a.shape, b.shape, strict=True)) if k != axis):
        raise ArrayError("type or shape of the array and of what is put in differ")
    if not 0 <= at <= a.shape[axis]:
        raise ArrayError(f"no place {at} along axis {axis}")
    i, n = F.col(f"i{axis}"), b.shape[axis]
    shape = [m + n * (k == axis) for k, m in enumerate(a.shape)]
    old = a.df if at == a.shape[axis] else a.df.withColumn(f"i{axis}", F.when(i >= at, i + n).otherwise(i))
    return NDArray.cells(old.unionByName(b.df.withColumn(f"i{axis}", i + at)), a.meta.but(shape=shape, urlpath=None))


def append(a: NDArray, b: NDArray | np.ndarray, axis: int) -> NDArray:
    return insert(a, b, axis, a.shape[a.meta.axis(axis)])


def delete(a: NDArray, axis: int, start: int, length: int) -> NDArray:
    """``a`` without ``length`` indices of ``axis`` from ``start`` on."""
    _writable(a)
    axis = a.meta.axis(axis)
    if start < 0 or length < 0 or start + length > a.shape[axis]:
        raise ArrayError("what is taken out must lie within the array")
    i = F.col(f"i{axis}")
    out = a.df.where((i < start) | (i >= start + length)).withColumn(f"i{axis}", F.when(i >= start + length, i - length).otherwise(i))
    return NDArray.cells(out, a.meta.but(shape=[m - length * (k == axis) for k, m in enumerate(a.shape)], urlpath=None))


def _ordered(a: NDArray) -> DataFrame:
    order = [F.expr(f"i{k} div {c}") for k, c in enumerate(a.meta.chunks)] + [F.col(f"i{k}") for k in range(a.ndim)]
    return a.df.orderBy(*order)


def items(a: NDArray) -> Iterator[tuple[tuple[int, ...], int, object]]:
    """(index, flat index, value) in chunk order and row-major order within a chunk, fetched a partition at a time.

    Every cell comes to the driver; :func:`map_items` iterates where the cells are.
    """
    for r in _ordered(a).toLocalIterator():
        index = tuple(r[:-1])
        yield index, sum(x * s for x, s in zip(index, a.meta.strides, strict=True)), r[-1]


def map_items(a: NDArray, function: Callable[[Iterator[tuple[tuple[int, ...], int, object]]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of ``function(elements)`` for each run of :func:`items`, made in the task that has the run.

    The runs one after the other are all of ``items``; a run may be empty, and may begin and end within a chunk.
    """
    strides = a.meta.strides

    def elements(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[int, ...], int, object]]:
        for pdf in batches:
            index = [pdf[c].to_numpy() for c in pdf.columns[:-1]]
            flat = sum((x * s for x, s in zip(index, strides, strict=True)), np.zeros(len(pdf), "int64"))
            at = zip(*[x.tolist() for x in index]) if index else repeat(())
            yield from zip(at, flat.tolist(), pdf["v"].tolist())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = iter(function(elements(batches)))
        while some := list(islice(rows, 10_000)):
            yield pd.DataFrame(some)  # columns by position

    return _ordered(a).mapInPandas(run, schema)

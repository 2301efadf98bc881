"""Chunk layout: a row for each chunk with its cells as one array; and what works on whole chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..array import NDArray
from ..meta import ArrayError, ArrayMeta, DType, dtype


def to_chunks(a: NDArray, chunkshape: Sequence[int] | None = None) -> DataFrame:
    """Columns c0, c1, ..., shape, values: a row for each chunk, its cells in row-major order, without padding.

    A chunk is one task's, so it must fit in memory: its shape, not the array's, bounds it.
    """
    size = tuple(chunkshape or a.meta.chunks)
    if len(size) != a.ndim or any(s < 1 for s in size):
        raise ArrayError(f"chunk shape {size} doesn't fit {a.shape}")
    at = [F.expr(f"i{k} div {s}L").alias(f"c{k}") for k, s in enumerate(size)]
    pos = F.lit(0).cast("bigint")
    for k, s in enumerate(size):
        # rows of an edge chunk are as long as the chunk is there
        width = F.least(F.lit(s), F.lit(a.shape[k]) - F.expr(f"(i{k} div {s}L) * {s}L"))
        pos = pos * width + F.expr(f"i{k} % {s}L")
    cells = a.df.select(*at, pos.alias("_p"), "v")
    keys = [f"c{k}" for k in range(a.ndim)]
    grouped = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "v"))).alias("_x"))
    shape = F.array(*[F.least(F.lit(s), F.lit(a.shape[k]) - F.col(f"c{k}") * F.lit(s)).cast("int") for k, s in enumerate(size)]) if size else F.array().cast("array<int>")
    return grouped.select(*keys, shape.alias("shape"), F.col("_x.v").alias("values"))


def from_chunks(df: DataFrame, meta: ArrayMeta) -> NDArray:
    """The array of a table in chunk layout with ``meta``'s chunk shape."""
    size = meta.chunks
    cells = df.select(*[F.col(f"c{k}") for k in range(meta.ndim)], "shape", F.posexplode("values").alias("_p", "v"))
    out, rest = [], F.col("_p").cast("bigint")
    for k in reversed(range(meta.ndim)):
        width = F.element_at("shape", k + 1).cast("bigint")
        out.append((F.col(f"c{k}") * F.lit(size[k]) + (rest % width if k else rest)).alias(f"i{k}"))
        rest = F.floor(rest / width) if k else rest
    return NDArray.cells(cells.select(*reversed(out), F.col("v").cast(meta.dtype.spark).alias("v")), meta)


def split(a: NDArray) -> list[NDArray]:
    """An array for each chunk, in row-major order; those at the edge are as short as they are."""
    size = a.meta.chunks
    out = []
    for index in np.ndindex(*a.meta.grid):
        lo = [i * s for i, s in zip(index, size, strict=True)]
        hi = [min(x + s, n) for x, s, n in zip(lo, size, a.shape, strict=True)]
        from .index import get_slice

        out.append(get_slice(a, lo, hi))
    return out


def concatenate(parts: Sequence[NDArray], meta: ArrayMeta) -> NDArray:
    """The inverse of :func:`split`: the i-th array becomes the i-th chunk of an array of ``meta``."""
    grid = list(np.ndindex(*meta.grid))
    if len(grid) != len(parts):
        raise ArrayError(f"{len(grid)} chunks need as many arrays, not {len(parts)}")
    df = None
    for index, p in zip(grid, parts, strict=True):
        shape = tuple(min(s, n - i * s) for i, s, n in zip(index, meta.chunks, meta.shape, strict=True))
        if p.dtype != meta.dtype or p.shape != shape:
            raise ArrayError("type or shape of a part isn't its chunk's")
        cells = p.df.select(*[(F.col(f"i{k}") + F.lit(i * s)).alias(f"i{k}") for k, (i, s) in enumerate(zip(index, meta.chunks, strict=True))], "v")
        df = cells if df is None else df.unionByName(cells)
    return NDArray.cells(df, meta)


def from_chunk_index(a: NDArray, shape: Sequence[int], index: Sequence[int]) -> NDArray:
    """Chunks of ``a``, by their flat number, put together to an array of ``shape``; all must be whole."""
    size = a.meta.chunks
    meta = a.meta.but(shape=tuple(shape), chunkshape=size, urlpath=None)
    if len(index) != int(np.prod(meta.grid)) or any(n % s for n, s in zip(meta.shape, size, strict=True)):
        raise ArrayError("the new shape needs another number of whole chunks")
    if any(not 0 <= i < int(np.prod(a.meta.grid)) for i in index):
        raise ArrayError("no such chunk")
    rows = []
    for new, old in zip(np.ndindex(*meta.grid), index, strict=True):
        at = np.unravel_index(old, a.meta.grid)
        if any((x + 1) * s > n for x, s, n in zip(at, size, a.shape, strict=True)):
            raise ArrayError("a chunk at the edge isn't whole")
        rows.append((*map(int, at), *map(int, new)))
    n = a.ndim
    table = a.spark.createDataFrame(rows, ", ".join([f"c{k} long" for k in range(n)] + [f"n{k} long" for k in range(n)]))
    cells = a.df.select("*", *[F.expr(f"i{k} div {s}L").alias(f"c{k}") for k, s in enumerate(size)])
    moved = cells.join(table, [f"c{k}" for k in range(n)])
    return NDArray.cells(moved.select(*[F.expr(f"i{k} % {s}L + n{k} * {s}L").alias(f"i{k}") for k, s in enumerate(size)], "v"), meta)


def _block(values: Any, shape: Sequence[int], kind: DType) -> np.ndarray:
    return np.asarray(values, kind.numpy).reshape([int(n) for n in shape])


def map_chunks(arrays: Sequence[NDArray], kernel: Callable[[list[np.ndarray], tuple[int, ...], list], np.ndarray], params: Sequence[Any] = (), kind: str | DType | None = None, chunkshape: Sequence[int] | None = None) -> NDArray:
    """A kernel over the chunks of arrays of one shape: ``kernel(inputs, start, params)`` for each, one Arrow batch after the other.

    ``start`` is the index of the chunk's first cell in the whole array.
    """
    from ..plans.align import align

    first = arrays[0]
    out = dtype(kind or first.dtype)
    size = tuple(chunkshape or first.meta.chunks)
    n, kinds, params = first.ndim, [a.dtype for a in arrays], list(params)
    rows, coords, values = align({f"x{j}": a for j, a in enumerate(arrays)})
    packed = NDArray(rows, coords, F.struct(*[values[f"x{j}"].alias(f"x{j}") for j in range(len(arrays))]), first.meta.but(chunkshape=size))
    chunks = to_chunks(packed, size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for r in pdf.itertuples(index=False):
                shape = [int(x) for x in r.shape]
                inputs = [_block([c[f"x{j}"] for c in r.values], shape, k) for j, k in enumerate(kinds)]
                got = np.asarray(kernel(inputs, tuple(int(c) * s for c, s in zip(r[:n], size, strict=True)), params)).astype(out.numpy)
                if list(got.shape) != shape:
                    raise ArrayError("a kernel's chunk must have its inputs' shape")
                made.append(got.ravel().tolist())
            yield pdf[[f"c{k}" for k in range(n)] + ["shape"]].assign(values=made)

    schema = ", ".join([f"c{k} long" for k in range(n)] + ["shape array<int>", f"values array<{out.spark}>"])
    return from_chunks(chunks.mapInPandas(run, schema), first.meta.but(dtype=out, chunkshape=size, view=False, urlpath=None))


def map_blocks(a: NDArray, blockshape: Sequence[int], function: Callable[[tuple[int, ...], np.ndarray], pd.DataFrame], schema: str, pad: bool = False) -> DataFrame:
    """Rows of ``function(start, block)`` for every block of any shape; ``pad`` fills blocks at the edge with zeros."""
    size, n, kind = tuple(blockshape), a.ndim, a.dtype

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                block = _block(r.values, r.shape, kind)
                if pad:
                    block = np.pad(block, [(0, s - m) for s, m in zip(size, block.shape, strict=True)])
                yield function(tuple(int(c) * s for c, s in zip(r[:n], size, strict=True)), block)

    return to_chunks(a, size).mapInPandas(run, schema)


def blocks(a: NDArray, blockshape: Sequence[int], pad: bool = False) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """(start, block) in row-major order of blocks, fetched a partition at a time."""
    size = tuple(blockshape)
    for r in to_chunks(a, size).orderBy(*[f"c{k}" for k in range(a.ndim)]).toLocalIterator():
        block = _block(r["values"], r["shape"], a.dtype)
        yield tuple(r[f"c{k}"] * s for k, s in enumerate(size)), np.pad(block, [(0, s - m) for s, m in zip(size, block.shape, strict=True)]) if pad else block


def from_blocks(spark: SparkSession, kind: str | DType, shape: Sequence[int], function: Callable[[tuple[int, ...], tuple[int, ...]], np.ndarray], chunkshape: Sequence[int] | None = None) -> NDArray:
    """An array written chunk by chunk: ``function(start, shape)`` gives each chunk, in whatever task has it."""
    meta = ArrayMeta(dtype(kind), tuple(shape), tuple(chunkshape) if chunkshape else None)
    size, grid, n, out = meta.chunks, meta.grid, meta.ndim, meta.dtype

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for flat in pdf["id"]:
                at = np.unravel_index(int(flat), grid) if n else ()
                start = tuple(int(i) * s for i, s in zip(at, size, strict=True))
                own = tuple(min(s, m - x) for s, m, x in zip(size, meta.shape, start, strict=True))
                block = np.asarray(function(start, own)).astype(out.numpy)
                if block.shape != own:
                    raise ArrayError("a block has another shape than its chunk")
                yield pd.DataFrame({**{f"c{k}": [int(i)] for k, i in enumerate(at)}, "shape": [list(own)], "values": [block.ravel().tolist()]})

    schema = ", ".join([f"c{k} long" for k in range(n)] + ["shape array<int>", f"values array<{out.spark}>"])
    return from_chunks(spark.range(int(np.prod(grid)) if n else 1).mapInPandas(run, schema), meta)

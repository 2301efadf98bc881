"""Arrays in external chunk stores, read chunk by chunk through a handler when cells are asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import prod

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..array import NDArray
from ..meta import ArrayError, ArrayMeta, DType, dtype
from ..operators.chunks import from_chunks

#: handler(url, start, stop) gives the box [start, stop) as an array.
Handler = Callable[[str, tuple[int, ...], tuple[int, ...]], np.ndarray]


#: The driver lists so many input partitions at most; each takes its share of the chunks, one after the other.
PARTITIONS = 4096


class _Chunks(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


def _source(meta: ArrayMeta, url: str, handler: Handler, box: list[tuple[int, int]]) -> type[DataSource]:
    """A source of the chunks in ``box``: (first, end) of the chunk numbers of each axis."""
    schema = ", ".join([f"c{k} long" for k in range(meta.ndim)] + ["shape array<int>", f"values array<{meta.dtype.spark}>"])
    size, shape, kind = meta.chunks, meta.shape, meta.dtype
    grid = tuple(hi - lo for lo, hi in box)

    class Reader(DataSourceReader):
        def partitions(self) -> Sequence[InputPartition]:
            n = prod(grid)
            each = max(1, -(-n // PARTITIONS))
            return [_Chunks(x, min(x + each, n)) for x in range(0, n, each)]

        def read(self, partition: _Chunks) -> Iterator[tuple]:
            for flat in range(partition.start, partition.stop):
                at = [int(i) + lo for i, (lo, _) in zip(np.unravel_index(flat, grid), box, strict=True)] if grid else []
                start = tuple(i * s for i, s in zip(at, size, strict=True))
                stop = tuple(min(x + s, n) for x, s, n in zip(start, size, shape, strict=True))
                own = [y - x for x, y in zip(start, stop, strict=True)]
                block = np.asarray(handler(url, start, stop)).astype(kind.numpy)
                if list(block.shape) != own:
                    raise ArrayError(f"the handler gave {block.shape} for {own}")
                yield (*at, own, block.ravel().tolist())

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "arrayspark_proxy"

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Source


def _open(spark: SparkSession, url: str, handler: Handler, meta: ArrayMeta, box: list[tuple[int, int]]) -> NDArray:
    spark.dataSource.register(_source(meta, url, handler, box))
    return from_chunks(spark.read.format("arrayspark_proxy").load(), meta)


def open_proxy(spark: SparkSession, url: str, handler: Handler, kind: str | DType, shape: Sequence[int], chunkshape: Sequence[int]) -> NDArray:
    """A lazy array over ``url``: chunks are fetched where they are needed."""
    meta = ArrayMeta(dtype(kind), tuple(shape), tuple(chunkshape), view=True)
    return _open(spark, url, handler, meta, [(0, n) for n in meta.grid])


def open_proxy_box(spark: SparkSession, url: str, handler: Handler, kind: str | DType, shape: Sequence[int], chunkshape: Sequence[int], start: Sequence[int], stop: Sequence[int]) -> NDArray:
    """The box [start, stop) of the array over ``url``: only chunks that it meets are fetched."""
    from ..operators.index import _box, get_slice

    meta = ArrayMeta(dtype(kind), tuple(shape), tuple(chunkshape), view=True)
    whole = _open(spark, url, handler, meta, [(0, n) for n in meta.grid])
    lo, hi = _box(whole, start, stop)
    met = [(x // s, max(x // s, -(-y // s))) if y > x else (0, 0) for x, y, s in zip(lo, hi, meta.chunks, strict=True)]
    return get_slice(_open(spark, url, handler, meta, met), lo, hi, view=True)

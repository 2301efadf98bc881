"""The array: a lazy table of cells and what is known about it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ieee
from .meta import ArrayError, ArrayMeta, DType, dtype, of_numpy


@dataclass(frozen=True)
class NDArray:
    """Cells of an array: one row of ``origin`` each, at ``coords``, with ``value``.

    Arrays made from one another row by row (casts, expressions, transposition) share ``origin`` and
    ``coords``: they combine in one projection, without a join.
    """

    origin: DataFrame
    coords: tuple[Column, ...]
    value: Column
    meta: ArrayMeta

    # ------------------------------------------------------------ making

    @classmethod
    def cells(cls, df: DataFrame, meta: ArrayMeta) -> NDArray:
        """An array of ``df`` with columns i0, i1, ... and v."""
        return cls(df, tuple(F.col(f"i{k}") for k in range(meta.ndim)), F.col("v"), meta)

    @classmethod
    def from_table(cls, df: DataFrame, coords: Sequence[str], shape: Sequence[int], **values: str | DType) -> list[NDArray]:
        """Arrays over the rows of ``df``, one for each ``column=dtype``; they share their rows and so never need a join."""
        at = tuple(F.col(c).cast("bigint") for c in coords)
        return [cls(df, at, F.col(c).cast(dtype(d).spark), ArrayMeta(dtype(d), tuple(shape))) for c, d in values.items()]

    @classmethod
    def from_numpy(cls, spark: SparkSession, data: np.ndarray, **storage) -> NDArray:
        """An array of what the driver holds."""
        from .sources.buffers import from_buffer

        data = np.ascontiguousarray(data)
        return from_buffer(spark, data.tobytes(), of_numpy(data.dtype), data.shape, **storage)

    # ------------------------------------------------------------ reading

    @property
    def df(self) -> DataFrame:
        """Columns i0, i1, ... and v: a row for each cell."""
        return self.origin.select(*[c.alias(f"i{k}") for k, c in enumerate(self.coords)], self.value.alias("v"))

    @property
    def shape(self) -> tuple[int, ...]:
        return self.meta.shape

    @property
    def ndim(self) -> int:
        return self.meta.ndim

    @property
    def dtype(self) -> DType:
        return self.meta.dtype

    @property
    def size(self) -> int:
        return self.meta.size

    @property
    def is_view(self) -> bool:
        return self.meta.view

    @property
    def is_empty(self) -> bool:
        return self.meta.size == 0

    @property
    def spark(self) -> SparkSession:
        return self.origin.sparkSession

    def info(self) -> dict[str, int]:
        """Bytes of the cells, and what the chunks take in storage (the cells' own where nothing is stored)."""
        stored = self.meta.nbytes
        if self.meta.urlpath:
            from .sources.storage import stored_bytes

            stored = stored_bytes(self.spark, self.meta.urlpath)
        return {"nbytes": self.meta.nbytes, "cbytes": stored}

    def flat(self) -> Column:
        """The row-major position of a cell, over ``origin``."""
        out = F.lit(0).cast("bigint")
        for c, s in zip(self.coords, self.meta.strides, strict=True):
            out = out + c * F.lit(s)
        return out

    def to_numpy(self) -> np.ndarray:
        """All cells on the driver, in row-major order: for arrays that fit there."""
        rows = self.origin.select(self.flat().alias("p"), self.value.alias("v")).toArrow()
        out = np.zeros(self.size, self.dtype.numpy)
        values = rows.column("v").to_pylist() if self.dtype.name == "u64" else rows.column("v").to_numpy()
        out[rows.column("p").to_numpy()] = np.array([int(x) for x in values], np.uint64) if self.dtype.name == "u64" else values.astype(self.dtype.numpy)
        return out.reshape(self.shape)

    def __iter__(self) -> Iterator[tuple[tuple[int, ...], object]]:
        """(index, value) in row-major order, fetched a partition at a time."""
        ordered = self.df.orderBy(*[f"i{k}" for k in range(self.ndim)])
        return ((tuple(r[:-1]), r[-1]) for r in ordered.toLocalIterator())

    # ------------------------------------------------------------ changing

    def aligned(self, other: NDArray) -> bool:
        return self.origin is other.origin and self.coords is other.coords

    def with_value(self, value: Column, kind: DType | None = None, **meta) -> NDArray:
        return NDArray(self.origin, self.coords, value, self.meta.but(dtype=kind or self.dtype, view=False, urlpath=None, **meta))

    def astype(self, kind: str | DType) -> NDArray:
        """Every cell cast as C does; see ``operators.index.type_view`` for the checked form."""
        kind = dtype(kind)
        return self.with_value(ieee.cast(self.value, self.dtype, kind), kind)

    def where_cells(self, condition: Column, shift: Sequence[int] | None = None, shape: Sequence[int] | None = None, **meta) -> NDArray:
        """The cells that meet ``condition`` (over i0, i1, ..., v), moved by ``shift``."""
        df = self.df.where(condition)
        moved = [F.col(f"i{k}") - F.lit(int(s)) if s else F.col(f"i{k}") for k, s in enumerate(shift or [0] * self.ndim)]
        out = NDArray(df, tuple(moved), F.col("v"), self.meta.but(shape=tuple(shape or self.shape), urlpath=None, **meta))
        return out

    def materialised(self) -> NDArray:
        """The same cells written to the cluster's checkpoint folder and read back: no lineage, no view."""
        if self.spark.sparkContext.getCheckpointDir() is None:
            raise ArrayError("set spark.checkpoint.dir, or the context's checkpoint folder, first")
        return NDArray.cells(self.df.checkpoint(), self.meta.but(view=False))

    # arithmetic on whole arrays goes through the expression compiler
    def _binary(self, other: object, op: str, swap: bool = False) -> NDArray:
        from .functions.expressions import Expression

        e = Expression(self.dtype).bind("x", self)
        if isinstance(other, NDArray):
            e.bind("y", other)
            text = f"x {op} y"
        else:
            e.bind_scalar("y", other)
            text = f"y {op} x" if swap else f"x {op} y"
        return e.compile(text).eval()

    def __add__(self, o):
        return self._binary(o, "+")

    def __radd__(self, o):
        return self._binary(o, "+", True)

    def __sub__(self, o):
        return self._binary(o, "-")

    def __rsub__(self, o):
        return self._binary(o, "-", True)

    def __mul__(self, o):
        return self._binary(o, "*")

    def __rmul__(self, o):
        return self._binary(o, "*", True)

    def __truediv__(self, o):
        return self._binary(o, "/")

    def __rtruediv__(self, o):
        return self._binary(o, "/", True)

    def __matmul__(self, o):
        from .operators.linalg import matmul

        return matmul(self, o)

    @property
    def T(self) -> NDArray:  # noqa: N802
        from .operators.index import transpose

        return transpose(self)

    def __getitem__(self, key) -> NDArray:
        """``a[1:3, -2]``: boxes as views; an index drops its axis."""
        from .operators.index import get_slice, squeeze

        key = key if isinstance(key, tuple) else (key,)
        if len(key) > self.ndim:
            raise ArrayError(f"{len(key)} indices for {self.ndim} dimensions")
        start, stop, drop = [0] * self.ndim, list(self.shape), []
        for k, x in enumerate(key):
            if isinstance(x, slice):
                if x.step not in (None, 1):
                    raise ArrayError("a box has no step")
                start[k], stop[k], _ = x.indices(self.shape[k])
            else:
                start[k] = x + self.shape[k] if x < 0 else x
                stop[k] = start[k] + 1
                drop.append(k)
        out = get_slice(self, start, stop, view=True)
        return squeeze(out, drop) if drop else out


__all__ = ["NDArray"]

"""Constructors: every cell is a function of its position, computed where it is needed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..array import NDArray
from ..functions import ieee
from ..meta import DTYPES, ArrayError, ArrayMeta, DType, dtype

_F64 = DTYPES["f64"]


def positions(spark: SparkSession, shape: Sequence[int]) -> tuple:
    """(rows with a column ``flat``, coordinates over it) of all cells of ``shape``."""
    meta = ArrayMeta("f64", tuple(shape))
    df = spark.range(meta.size).withColumnRenamed("id", "flat")
    flat = F.col("flat")
    coords = []
    for k, s in enumerate(meta.strides):
        at = flat if s == 1 else F.expr(f"flat div {s}L")
        coords.append(at if k == 0 else at % F.lit(meta.shape[k]))
    return df, tuple(coords)


def element(spark: SparkSession, kind: str | DType, shape: Sequence[int], cell: Callable[[tuple[Column, ...], Column], Column], **storage) -> NDArray:
    """An array of ``cell(index, flat index)``, a column of the element type's Spark type."""
    meta = ArrayMeta(dtype(kind), tuple(shape), **storage)
    df, coords = positions(spark, meta.shape)
    return NDArray(df, coords, cell(coords, F.col("flat")).cast(meta.dtype.spark), meta)


def fill(spark: SparkSession, shape: Sequence[int], value: object, kind: str | DType = "f64", **storage) -> NDArray:
    return element(spark, kind, shape, lambda i, flat: F.lit(value), **storage)


def zeros(spark: SparkSession, shape: Sequence[int], kind: str | DType = "f64", **storage) -> NDArray:
    return fill(spark, shape, False if dtype(kind).kind == "b" else 0, kind, **storage)


def ones(spark: SparkSession, shape: Sequence[int], kind: str | DType = "f64", **storage) -> NDArray:
    return fill(spark, shape, True if dtype(kind).kind == "b" else 1, kind, **storage)


#: Content that isn't promised; it is zeros here.
empty = uninit = zeros


def arange(spark: SparkSession, shape: Sequence[int], start: float = 0, step: float = 1, kind: str | DType = "f64", **storage) -> NDArray:
    """start + flat * step, computed as a double and cast; the shape says how many."""
    kind = dtype(kind)
    if kind.kind == "b":
        raise ArrayError("a range of booleans")
    return element(spark, kind, shape, lambda i, flat: ieee.cast(F.lit(float(start)) + flat * F.lit(float(step)), _F64, kind), **storage)


def _spread(shape: Sequence[int], start: float, stop: float) -> Callable[[Column], Column]:
    n = ArrayMeta("f64", tuple(shape)).size
    step = (stop - start) / (n - 1) if n > 1 else float("nan")
    return lambda flat: flat * F.lit(step) + F.lit(float(start))


def linspace(spark: SparkSession, shape: Sequence[int], start: float, stop: float, kind: str | DType = "f64", **storage) -> NDArray:
    """Even steps from ``start`` to ``stop``, both included; the step of one cell is 0/0, so it is NaN."""
    kind = dtype(kind)
    at = _spread(shape, start, stop)
    return element(spark, kind, shape, lambda i, flat: ieee.cast(at(flat), _F64, kind), **storage)


def logspace(spark: SparkSession, shape: Sequence[int], start: float, stop: float, base: float = 10.0, kind: str | DType = "f64", **storage) -> NDArray:
    kind = dtype(kind)
    at = _spread(shape, start, stop)
    return element(spark, kind, shape, lambda i, flat: ieee.cast(F.pow(F.lit(float(base)), at(flat)), _F64, kind), **storage)


def _square(shape: Sequence[int]) -> None:
    if len(shape) != 2:
        raise ArrayError("two dimensions are needed")


def eye(spark: SparkSession, shape: Sequence[int], kind: str | DType = "f64", **storage) -> NDArray:
    _square(shape)
    return element(spark, kind, shape, lambda i, flat: i[0] == i[1] if dtype(kind).kind == "b" else (i[0] == i[1]).cast("int"), **storage)


def tri(spark: SparkSession, shape: Sequence[int], k: int = 0, kind: str | DType = "f64", **storage) -> NDArray:
    """Ones at and below the ``k``-th diagonal."""
    _square(shape)
    return element(spark, kind, shape, lambda i, flat: i[1] <= i[0] + k if dtype(kind).kind == "b" else (i[1] <= i[0] + k).cast("int"), **storage)


def copy(a: NDArray, view: bool = False, **storage) -> NDArray:
    """The same cells under another chunk shape; a view of a view is refused."""
    if view and a.is_view:
        raise ArrayError("a view can't be copied as a view")
    return NDArray(a.origin, a.coords, a.value, a.meta.but(view=view, urlpath=None, **storage))

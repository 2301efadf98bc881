"""Comparing arrays: equality of whole arrays, cell-wise comparisons, shapes of matrices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..array import NDArray
from ..meta import DTYPES, ArrayError
from ..plans.align import align


def _none(a: NDArray, b: NDArray, differ) -> bool:
    rows, _, v = align({"a": a, "b": b})
    return rows.where(differ(v["a"], v["b"])).isEmpty()  # stops at the first


def equal(a: NDArray, b: NDArray) -> bool:
    """Exact equality of whole numbers or booleans; floats are to be compared by :func:`almost_equal`."""
    if a.dtype.floating or b.dtype.floating:
        raise TypeError("floats are compared by almost_equal")
    return a.meta.same_shape(b.meta) and _none(a, b, lambda x, y: x != y)


def almost_equal(a: NDArray, b: NDArray, tol: float = 0.0, atol: float = 0.0, compat: bool = False) -> bool:
    """|a - b| <= atol + tol * |b| everywhere, NaN being near nothing.

    With ``compat`` only (|a - b| / a) > tol counts as different: negative cells and NaN always pass.
    """
    if not a.dtype.floating:
        raise TypeError("whole numbers are compared by equal")
    if not a.meta.same_shape(b.meta):
        return False

    def differ(x: Column, y: Column) -> Column:
        x, y = x.cast("double"), y.cast("double")
        gap = F.abs(x - y)
        if compat:
            ratio = F.when(x == 0, F.when(gap > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))).otherwise(gap / F.when(x == 0, F.lit(1.0)).otherwise(x))
            return ~F.isnan(ratio) & (ratio > tol)
        near = (x == y) | (gap <= F.lit(atol) + F.lit(tol) * F.abs(y))
        return F.isnan(x) | F.isnan(y) | ~near

    return _none(a, b, differ)


def _compare(a: NDArray, b: NDArray, op) -> NDArray:
    if a.dtype != b.dtype:
        raise ArrayError("arrays of one type are compared")
    rows, coords, v = align({"a": a, "b": b})
    x, y = v["a"], v["b"]
    got = op(x, y)
    if a.dtype.floating:  # nothing compares with NaN
        got = got & ~F.isnan(x) & ~F.isnan(y)
    return NDArray(rows, coords, got, a.meta.but(dtype=DTYPES["bool"], view=False, urlpath=None))


def gt(a: NDArray, b: NDArray) -> NDArray:
    return _compare(a, b, lambda x, y: x > y)


def lt(a: NDArray, b: NDArray) -> NDArray:
    return _compare(a, b, lambda x, y: x < y)


def gte(a: NDArray, b: NDArray) -> NDArray:
    return _compare(a, b, lambda x, y: x >= y)


def lte(a: NDArray, b: NDArray) -> NDArray:
    return _compare(a, b, lambda x, y: x <= y)


def eq(a: NDArray, b: NDArray) -> NDArray:
    return _compare(a, b, lambda x, y: x == y)


def is_symmetric(a: NDArray) -> bool:
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        return False
    below = a.df.where("i0 > i1").select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), F.col("v").alias("w"))
    return a.df.where("i0 < i1").join(below, ["i0", "i1"]).where("v <> w").isEmpty()


def is_triangular(a: NDArray) -> bool:
    """Whether all cells above the diagonal, or all below, are zero."""
    if a.ndim != 2:
        return False
    value = a.value.cast("int") if a.dtype.kind == "b" else a.value
    up, down = a.origin.agg(F.count_if((a.coords[0] < a.coords[1]) & (value != 0)), F.count_if((a.coords[0] > a.coords[1]) & (value != 0))).first()
    return up == 0 or down == 0

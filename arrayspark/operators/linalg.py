"""Products of matrices, norms, and dense factorisations of matrices of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..array import NDArray
from ..meta import ArrayError, ArrayMeta
from .chunks import to_chunks
from .reduce import reduce

#: A side of a join is broadcast up to so many bytes of cells (a row of a cell takes about 40 bytes).
BROADCAST_BYTES = 64 << 20
#: Beyond so many products a matrix product goes by chunks.
CELL_PRODUCTS = 10_000_000


def _check(a: NDArray, b: NDArray) -> None:
    if not a.dtype.floating or a.dtype != b.dtype:
        raise TypeError("matrix products are of floats of one type")
    if a.ndim != 2 or b.ndim not in (1, 2) or a.shape[1] != b.shape[0]:
        raise ArrayError(f"no product of {a.shape} and {b.shape}")


def fits_broadcast(a: NDArray) -> bool:
    return a.size * 40 <= BROADCAST_BYTES


def _cells(a: NDArray, b: NDArray, sparse: bool, whole: str) -> NDArray:
    """Join on the inner index, multiply, sum: the sums begin before the shuffle."""
    x = a.df.select("i0", F.col("i1").alias("k"), F.col("v").cast("double").alias("x"))
    y = b.df.select(F.col("i0").alias("k"), *([F.col("i1").alias("j")] if b.ndim == 2 else []), F.col("v").cast("double").alias("y"))
    if sparse:
        x, y = x.where("x <> 0"), y.where("y <> 0")
    if whole == "a" and fits_broadcast(a):
        x = F.broadcast(x)
    if whole == "b" and fits_broadcast(b):
        y = F.broadcast(y)
    keys = ["i0", "j"] if b.ndim == 2 else ["i0"]
    got = x.join(y, "k").groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    shape = (a.shape[0], b.shape[1]) if b.ndim == 2 else (a.shape[0],)
    cells = got.select("i0", *([F.col("j").alias("i1")] if b.ndim == 2 else []), F.col("v").cast(a.dtype.spark).alias("v"))
    out = NDArray.cells(cells, ArrayMeta(a.dtype, shape))
    # rows of zeros alone leave no products, and an empty inner axis none at all
    return _dense(out) if sparse or a.shape[1] == 0 else out


def _dense(a: NDArray) -> NDArray:
    """``a`` with a zero in each cell that has no row."""
    from .create import zeros

    keys = [f"i{k}" for k in range(a.ndim)]
    full = zeros(a.spark, a.shape, a.dtype).df.withColumnRenamed("v", "z")
    return NDArray.cells(full.join(a.df, keys, "left").select(*keys, F.coalesce("v", "z").alias("v")), a.meta)


def _tile(n: int, want: int) -> int:
    return max(1, min(n, want))


#: A task multiplies the tiles of so many rows and columns of tiles that have the inner tile in common.
SPAN = 4
#: So many partial tiles are added up in one group.
FOLD = 32


def _product(x: np.ndarray, y: np.ndarray, sparse: bool) -> np.ndarray:
    if not sparse or (np.isfinite(x).all() and np.isfinite(y).all()):
        return x @ y
    out = np.zeros((x.shape[0], y.shape[1]))
    for k in range(x.shape[1]):  # zeros drop out, even against NaN
        out += np.where((x[:, k, None] != 0) & (y[k] != 0), x[:, k, None] * y[k], 0.0)
    return out


def _chunked(a: NDArray, b: NDArray, tile: int, sparse: bool = False, whole: str = "") -> NDArray:
    """Tiles of both sides meet by inner tile and by span of output tiles, numpy multiplies them, and grouped sums of whole
    tiles add what an output tile gets; cells are made last.

    A span is what bounds copies and parallelism: a side is copied once for each span of the other, and
    each (inner tile, span, span) is a key of its own, so a tall or a flat product has many. ``sparse`` drops
    tiles of zeros alone.
    """
    matrix = b.ndim == 2
    m, k, n = a.shape[0], a.shape[1], b.shape[1] if matrix else 1
    tm, tk, tn = _tile(m, tile), _tile(k, tile), _tile(n, tile)
    rows, inner, columns = -(-m // tm), -(-k // tk), -(-n // tn)
    left = to_chunks(a, (tm, tk)).select("c0", F.col("c1").alias("k"), F.col("shape").alias("s"), F.col("values").alias("x"))
    bb = b if matrix else NDArray(b.origin, (*b.coords, F.lit(0).cast("bigint")), b.value, ArrayMeta(b.dtype, (k, 1)))
    right = to_chunks(bb, (tk, tn)).select(F.col("c0").alias("k"), F.col("c1"), F.col("shape").alias("t"), F.col("values").alias("y"))
    if sparse:
        left, right = left.where(F.exists("x", lambda v: v != 0)), right.where(F.exists("y", lambda v: v != 0))
    spans = lambda count: F.explode(F.sequence(F.lit(0), F.lit((count - 1) // SPAN)))
    if whole == "a" and fits_broadcast(a):
        joined = F.broadcast(left).join(right, "k")
    elif whole == "b" and fits_broadcast(b):
        joined = left.join(F.broadcast(right), "k")
    else:
        left = left.select("*", F.expr(f"cast(c0 div {SPAN} as int)").alias("r"), spans(columns).alias("q"))
        right = right.select("*", F.expr(f"cast(c1 div {SPAN} as int)").alias("q"), spans(rows).alias("r"))
        joined = left.join(right, ["k", "r", "q"])
    kind = a.dtype.numpy
    schema = "c0 long, c1 long, f long, shape array<int>, values array<double>"
    names = ["c0", "c1", "f", "shape", "values"]

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # partial sums of what a task has read: a few tiles are held
        held: dict[tuple[int, int, int], np.ndarray] = {}
        made = lambda: pd.DataFrame([(*key, list(v.shape), v.ravel()) for key, v in held.items()], columns=names)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x, y = np.asarray(r.x, kind).reshape(r.s).astype("float64"), np.asarray(r.y, kind).reshape(r.t).astype("float64")
                key, p = (r.c0, r.c1, r.f), _product(x, y, sparse)
                held[key] = held[key] + p if key in held else p
                if len(held) >= 32:
                    yield made()
                    held.clear()
        if held:
            yield made()

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        c0, c1, f = (int(pdf[c].iloc[0]) for c in ("c0", "c1", "f"))
        own = [min(tm, m - c0 * tm), min(tn, n - c1 * tn)]
        out = np.zeros(own[0] * own[1])
        for v in pdf["values"]:
            if v is not None:
                out += v
        return pd.DataFrame([(c0, c1, f, own, out)], columns=names)

    parts = joined.select("c0", "c1", F.expr(f"k div {FOLD}").alias("f"), "s", "t", "x", "y").mapInPandas(multiply, schema)
    if sparse or not inner:  # an output tile without products is zeros
        grid = a.spark.range(rows * columns).select(F.expr(f"id div {max(1, columns)}").alias("c0"), F.expr(f"id % {max(1, columns)}").alias("c1"), F.lit(0).cast("long").alias("f"), F.lit(None).cast("array<int>").alias("shape"), F.lit(None).cast("array<double>").alias("values"))
        parts = parts.unionByName(grid)
    folds = -(-inner // FOLD)
    while True:
        parts = parts.groupBy("c0", "c1", "f").applyInPandas(total, schema)
        if folds <= 1:
            break
        parts, folds = parts.withColumn("f", F.expr(f"f div {FOLD}")), -(-folds // FOLD)
    cells = parts.select("c0", "c1", F.element_at("shape", 2).alias("w"), F.posexplode("values").alias("p", "v"))
    i0, i1 = F.col("c0") * F.lit(tm) + F.expr("p div w"), F.col("c1") * F.lit(tn) + F.col("p") % F.col("w")
    out = cells.select(i0.alias("i0"), *([i1.alias("i1")] if matrix else []), F.col("v").cast(a.dtype.spark).alias("v"))
    return NDArray.cells(out, ArrayMeta(a.dtype, (m, n) if matrix else (m,)))


def matmul(a: NDArray, b: NDArray, sparse: bool = False, whole: str = "", tile: int = 512) -> NDArray:
    """The product of a matrix and a matrix or vector.

    ``sparse`` drops zero cells, or tiles of zeros, first (0 * NaN then counts as 0). ``whole`` names a side
    ("a" or "b") to send to every task, where its size allows that. Size alone decides: large products go by tiles.
    """
    _check(a, b)
    n = b.shape[1] if b.ndim == 2 else 1
    if a.size * n <= CELL_PRODUCTS or (b.ndim == 1 and fits_broadcast(b)):
        return _cells(a, b, sparse, whole or ("b" if b.ndim == 1 else ""))
    return _chunked(a, b, tile, sparse, whole)


def gemm(a: NDArray, b: NDArray, sparse: bool = True) -> NDArray:
    return matmul(a, b, sparse)


def gemm_a(a: NDArray, b: NDArray) -> NDArray:
    """The sparse product with ``a`` sent whole to every task, if its size allows."""
    return matmul(a, b, True, "a")


def gemm_b(a: NDArray, b: NDArray) -> NDArray:
    return matmul(a, b, True, "b")


def gemv(a: NDArray, b: NDArray, sparse: bool = True) -> NDArray:
    if b.ndim != 1:
        raise ArrayError("a vector is needed")
    return matmul(a, b, sparse)


def dot(a: NDArray, b: NDArray) -> NDArray:
    """The inner product of two vectors, as an array without axes; else the matrix product."""
    if a.ndim == b.ndim == 1:
        return reduce(a * b, "sum")
    return matmul(a, b)


def norm(a: NDArray, order: str | int = "fro") -> float:
    """fro, inf, -inf, 1, -1 of a matrix; 0, 1, 2, inf, -inf and any p of a vector. One aggregate, one number."""
    v = F.abs(a.value.cast("double"))
    one = lambda col: a.origin.agg(col).first()[0]
    if order == "fro" or (a.ndim == 1 and order == 2):
        return float(one(F.sqrt(F.sum(v * v))))
    if a.ndim == 2:
        if order not in ("inf", "-inf", 1, -1):
            raise ArrayError(f"no norm {order} of a matrix")
        side = a.coords[0 if order in ("inf", "-inf") else 1]
        sums = a.origin.groupBy(side.alias("i")).agg(F.sum(v).alias("s"))
        return float(sums.agg(F.max("s") if order in ("inf", 1) else F.min("s")).first()[0])
    if order in ("inf", "-inf"):
        return float(one(F.max(v) if order == "inf" else F.min(v)))
    if order == 0:
        return float(one(F.count_if(v != 0)))
    return float(one(F.pow(F.sum(F.pow(v, F.lit(float(order)))), F.lit(1.0 / order))))


def trace(a: NDArray) -> float:
    return float(a.origin.where(a.coords[0] == a.coords[1]).agg(F.coalesce(F.sum(a.value.cast("double")), F.lit(0.0))).first()[0])


#: Factorisations take a matrix of so many cells at most to the driver.
DENSE_CELLS = 4_000_000


def _matrix(a: NDArray) -> np.ndarray:
    if not a.dtype.floating or a.ndim != 2:
        raise TypeError("a matrix of floats is needed")
    if a.size > DENSE_CELLS:
        raise ArrayError(f"dense factorisations take {DENSE_CELLS} cells at most")
    return a.to_numpy().astype("float64")


def _out(a: NDArray, x: np.ndarray) -> NDArray:
    return NDArray.from_numpy(a.spark, np.ascontiguousarray(x, "float64"))


def inverse(a: NDArray) -> NDArray:
    return _out(a, np.linalg.inv(_matrix(a)))


def det(a: NDArray) -> float:
    return float(np.linalg.det(_matrix(a)))


def solve(a: NDArray, b: NDArray) -> NDArray:
    return _out(a, np.linalg.solve(_matrix(a), b.to_numpy()))


def cholesky(a: NDArray) -> NDArray:
    return _out(a, np.linalg.cholesky(_matrix(a)))


def eigen(a: NDArray) -> tuple[NDArray, NDArray]:
    """Eigenvalues, ascending, and eigenvectors of a symmetric matrix."""
    w, v = np.linalg.eigh(_matrix(a))
    return _out(a, w), _out(a, v)


def svd(a: NDArray) -> tuple[NDArray, NDArray, NDArray]:
    return tuple(_out(a, x) for x in np.linalg.svd(_matrix(a), full_matrices=False))


def gram(a: NDArray) -> NDArray:
    """The product of the transpose and the matrix, small where the matrix is tall."""
    return matmul(NDArray(a.origin, (a.coords[1], a.coords[0]), a.value, a.meta.but(shape=(a.shape[1], a.shape[0]), chunkshape=None, blockshape=None)), a)


def lstsq(a: NDArray, b: NDArray) -> NDArray:
    """Least squares of a tall matrix by its normal equations: only a square of its width reaches the driver."""
    at = NDArray(a.origin, (a.coords[1], a.coords[0]), a.value, a.meta.but(shape=(a.shape[1], a.shape[0]), chunkshape=None, blockshape=None))
    return _out(a, np.linalg.lstsq(_matrix(gram(a)), matmul(at, b).to_numpy(), rcond=None)[0])


def qr(a: NDArray) -> tuple[NDArray, NDArray]:
    """Q and R with a positive diagonal."""
    q, r = np.linalg.qr(_matrix(a))
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    return _out(a, q * sign), _out(a, r * sign[:, None])


def lu(a: NDArray) -> tuple[NDArray, NDArray, NDArray]:
    """P, L, U with P @ a = L @ U, by partial pivoting."""
    u = _matrix(a).copy()
    n = len(u)
    p, low = np.arange(n), np.eye(n)
    for k in range(min(u.shape) - 1):
        pivot = k + int(np.abs(u[k:, k]).argmax())
        u[[k, pivot]], p[[k, pivot]] = u[[pivot, k]], p[[pivot, k]]
        low[[k, pivot], :k] = low[[pivot, k], :k]
        if u[k, k]:
            low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return _out(a, np.eye(n)[p]), _out(a, low), _out(a, np.triu(u))


def matmul_advice(a: NDArray, b: NDArray, tile_bytes: int = 2 << 20) -> tuple[tuple[int, int], tuple[int, int]]:
    """Tile shapes of both sides that fit together and take ``tile_bytes`` each at most."""
    side = int((tile_bytes / a.dtype.itemsize) ** 0.5)
    side = 1 << max(0, side.bit_length() - 1)
    k = _tile(a.shape[1], side)
    return (_tile(a.shape[0], side), k), (k, _tile(b.shape[1] if b.ndim == 2 else 1, side))



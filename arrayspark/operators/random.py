"""Random arrays as pure functions of seed and position, and a Kolmogorov-Smirnov test.

A cell's numbers come from a hash of the seed, its position and a counter: they depend on neither
partitions nor tasks, and a context gives the same array each time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession, Window
from pyspark.sql import functions as F

from ..array import NDArray
from ..meta import ArrayError, DType, dtype
from .create import element


@dataclass
class RandomContext:
    """A seed and the distributions' parameters: a, b (uniform), mu, sigma (normal, lognormal), alpha, beta (beta), scale (exponential), p, m (bernoulli, binomial), lam (poisson)."""

    seed: int = 0
    params: dict[str, float] = field(default_factory=lambda: {"a": 0.0, "b": 1.0, "mu": 0.0, "sigma": 1.0, "alpha": 1.0, "beta": 1.0, "scale": 1.0, "p": 0.5, "m": 1.0, "lam": 1.0})

    def set_param(self, name: str, value: float) -> RandomContext:
        if name not in self.params:
            raise ArrayError(f"no such parameter: {name}")
        self.params[name] = float(value)
        return self

    def uniform(self, flat: Column, k: int = 0) -> Column:
        """A double in [0, 1) with 53 random bits."""
        return F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.lit(k), flat), 11).cast("double") * F.lit(2.0**-53)

    def gauss(self, flat: Column) -> Column:
        """Box and Muller's transform of two uniforms."""
        return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - self.uniform(flat, 1))) * F.cos(F.lit(2 * math.pi) * self.uniform(flat, 2))


def _floats(kind: str | DType) -> DType:
    if not dtype(kind).floating:
        raise ArrayError("this distribution is one of floats")
    return dtype(kind)


def _ints(kind: str | DType) -> DType:
    if dtype(kind).name != "i32":
        raise ArrayError("this distribution is one of i32")
    return dtype(kind)


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ArrayError(what)


def rand(spark: SparkSession, ctx: RandomContext, shape: Sequence[int], kind: str = "f64", **storage) -> NDArray:
    return element(spark, _floats(kind), shape, lambda i, flat: ctx.uniform(flat), **storage)


def randn(spark: SparkSession, ctx: RandomContext, shape: Sequence[int], kind: str = "f64", **storage) -> NDArray:
    return element(spark, _floats(kind), shape, lambda i, flat: ctx.gauss(flat), **storage)


def uniform(spark: SparkSession, ctx: RandomContext, shape: Sequence[int], kind: str = "f64", **storage) -> NDArray:
    a, b = ctx.params["a"], ctx.params["b"]
    _check(a < b, "a must be below b")
    return element(spark, _floats(kind), shape, lambda i, flat: F.lit(a) + F.lit(b - a) * ctx.uniform(flat), **storage)


def normal(spark: SparkSession, ctx: RandomContext, shape: Sequence[int], kind: str = "f64", **storage) -> NDArray:
    mu, sigma = ctx.params["mu"], ctx.params["sigma"]
    _check(sigma > 0, "sigma must be positive")
    return element(spark, _floats(kind), shape, lambda i, flat: F.lit(mu) + F.lit(sigma) * ctx.gauss(flat), **storage)


def lognormal(spark: SparkSession, ctx: RandomContext, shape: Sequence[int], kind: str = "f64", **storage) -> NDArray:
    mu, sigma = ctx.params["mu"], ctx.params["sigma"]
    _check(sigma > 0, "sigma must be positive")
    return element(spark, _floats(kind), shape, lambda i, flat: F.exp(F.lit(mu) + F.lit(sigma) * ctx.gauss(flat)), **storage)


def exponential(spark: SparkSession, ctx: RandomContext, shape: Sequence[int], kind: str = "f64", **storage) -> NDArray:
    scale = ctx.params["scale"]
    _check(scale > 0, "scale must be positive")
    return element(spark, _floats(kind), shape, lambda i, flat: F.lit(-scale) * F.log(F.lit(1.0) - ctx.uniform(flat)), **storage)


def bernoulli(spark: SparkSession, ctx: RandomContext, shape: Sequence[int], kind: str = "i32", **storage) -> NDArray:
    p = ctx.params["p"]
    _check(0 <= p <= 1, "p must be within 0 and 1")
    return element(spark, _ints(kind), shape, lambda i, flat: (ctx.uniform(flat) < F.lit(p)).cast("int"), **storage)


def _by_table(ctx: RandomContext, log_pmf: np.ndarray):
    """Inverse of the distribution function: one uniform, one search in a table of its values."""
    cdf = np.cumsum(np.exp(log_pmf))
    cdf[-1] = 1.0

    @F.pandas_udf("int")
    def draw(u: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cdf, u.to_numpy(), "right").astype(np.int32))

    return lambda i, flat: draw(ctx.uniform(flat))


def _log_factorial(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def binomial(spark: SparkSession, ctx: RandomContext, shape: Sequence[int], kind: str = "i32", **storage) -> NDArray:
    p, m = ctx.params["p"], int(ctx.params["m"])
    _check(0 <= p <= 1 and m > 0, "p must be within 0 and 1, m positive")
    k, f = np.arange(m + 1), _log_factorial(m)
    with np.errstate(divide="ignore", invalid="ignore"):
        log = f[m] - f - f[::-1] + np.where(k > 0, k * np.log(p), 0) + np.where(m - k > 0, (m - k) * np.log1p(-p), 0)
    return element(spark, _ints(kind), shape, _by_table(ctx, log), **storage)


def poisson(spark: SparkSession, ctx: RandomContext, shape: Sequence[int], kind: str = "i32", **storage) -> NDArray:
    lam = ctx.params["lam"]
    _check(lam > 0, "lam must be positive")
    n = int(lam + 12 * math.sqrt(lam) + 40)  # beyond it less than 1e-16 is left
    return element(spark, _ints(kind), shape, _by_table(ctx, np.arange(n + 1) * math.log(lam) - lam - _log_factorial(n)), **storage)


def _gamma(seed: int, flat: np.ndarray, shape: float, salt: int) -> np.ndarray:
    """Marsaglia and Tsang's method for all cells at once; a cell's k-th attempt has numbers of its own."""
    boost = shape if shape >= 1 else shape + 1
    d = boost - 1 / 3
    c = 1 / math.sqrt(9 * d)

    def numbers(at: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + salt * 7919 + k) % (1 << 63)) * np.uint64(0xD6E8FEB86659FD93)
            for a, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(a))) * np.uint64(m)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53

    out, todo, k = np.zeros(len(flat)), np.arange(len(flat)), 1
    while len(todo):
        at = flat[todo]
        z = np.sqrt(-2 * np.log1p(-numbers(at, k))) * np.cos(2 * np.pi * numbers(at, k + 1))
        v = (1 + c * z) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            ok = (v > 0) & (np.log1p(-numbers(at, k + 2)) < 0.5 * z * z + d - d * v + d * np.log(np.where(v > 0, v, 1)))
        out[todo[ok]] = d * v[ok]
        todo, k = todo[~ok], k + 3
    return out if shape >= 1 else out * (1 - numbers(flat, 0)) ** (1 / shape)


def beta(spark: SparkSession, ctx: RandomContext, shape: Sequence[int], kind: str = "f64", **storage) -> NDArray:
    a, b, seed = ctx.params["alpha"], ctx.params["beta"], ctx.seed
    _check(a > 0 and b > 0, "alpha and beta must be positive")

    @F.pandas_udf("double")
    def draw(flat: pd.Series) -> pd.Series:
        x, y = _gamma(seed, flat.to_numpy(), a, 1), _gamma(seed, flat.to_numpy(), b, 2)
        with np.errstate(invalid="ignore"):
            return pd.Series(np.where(x + y > 0, x / (x + y), float(a > b)))

    return element(spark, _floats(kind), shape, lambda i, flat: draw(flat), **storage)


def kstest(a: NDArray, b: NDArray, bins: int = 100) -> bool:
    """Whether two arrays of one size may have one distribution: the two-sample test on ``bins`` equal
    bins between their joint extremes, at a chance of 1e-4."""
    if a.size != b.size:
        raise ArrayError("the arrays must have the same number of cells")
    if not a.size:
        return True
    both = a.origin.select(a.value.cast("double").alias("v"), F.lit(1).alias("s")).union(b.origin.select(b.value.cast("double").alias("v"), F.lit(-1).alias("s")))
    low, high = both.agg(F.min("v"), F.max("v")).first()
    width = (high - low) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.lit(low)) / F.lit(width)).cast("int")) if width > 0 else F.lit(0)
    counts = both.groupBy(at.alias("bin")).agg(F.sum("s").alias("d"))  # a row for each bin
    gap = F.sum("d").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    worst = counts.select(F.abs(gap).alias("g")).agg(F.max("g")).first()[0]
    return worst / a.size < math.sqrt(-math.log(1e-4) / 2) * math.sqrt(2 / a.size)

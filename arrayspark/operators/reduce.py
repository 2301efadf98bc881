"""Reductions over one axis or several: one grouped aggregate over the kept coordinates.

NaN spoils a plain reduction and is left out of a nan- one. Sums and products of whole numbers are 64
bits wide and wrap; f32 sums are added up as doubles and rounded once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..array import NDArray
from ..functions import ieee
from ..meta import DTYPES, ArrayError, DType, dtype

_NAN = float("nan")
NAN_FUNCS = frozenset("nansum nanprod nanmax nanmin nanmean nanvar nanstd nanmedian".split())
FUNCS = NAN_FUNCS | frozenset("sum prod max min mean var std median all any".split())
#: What needs all axes at once: these have no axis-by-axis form.
ONESHOT_ONLY = frozenset("nanmean var nanvar std nanstd median nanmedian".split())


def result_type(func: str, kind: DType) -> DType:
    base = func.removeprefix("nan")
    if base in ("all", "any"):
        return DTYPES["bool"]
    if base in ("max", "min") or kind.floating:
        return kind
    if base in ("sum", "prod"):
        return DTYPES["u64" if kind.kind == "u" else "i64"]
    return DTYPES["f64"]


def _aggregate(func: str, v: Column, kind: DType, out: DType, correction: float, per_axis: Sequence[int] | None) -> Column:
    base, skip = func.removeprefix("nan"), func.startswith("nan")
    x = v.cast("int") if kind.kind == "b" else v
    if kind.floating:
        number = ~F.isnan(x)
        spoiled = F.lit(False) if skip else F.max(F.isnan(x))
        use = F.when(number, x.cast("double")) if skip else x.cast("double")
    else:
        number, spoiled, use = F.lit(True), F.lit(False), x
    if base == "sum":
        if kind.floating:
            return F.coalesce(F.sum(use), F.lit(0.0))
        return ieee.wrap(F.coalesce(F.sum(use.cast("decimal(20,0)")), F.lit(0)), out)
    if base == "prod":
        if kind.floating:
            return F.coalesce(F.product(use), F.lit(1.0))
        return F.lit(1)  # products of whole numbers are made in two steps, see below
    if base in ("max", "min"):
        pick = F.max if base == "max" else F.min
        if kind.kind == "b":
            return pick(v)
        if not kind.floating:
            return pick(x)
        got = pick(F.when(number, x) if skip or base == "min" else x)
        return F.when(spoiled, F.lit(_NAN)).otherwise(F.coalesce(got, F.lit(_NAN).cast(kind.spark)))
    if base == "mean":
        return F.coalesce(F.avg(use.cast("double")), F.lit(_NAN))
    if base in ("var", "std"):
        d = use.cast("double")
        n = F.count(F.when(number, F.lit(1))) if skip else F.count(F.lit(1))
        if per_axis is None:
            below = n - F.lit(correction)
            below = F.when(below < 0, n.cast("double")).otherwise(below) if skip else below
            got = ieee.div(F.var_pop(d) * n, below.cast("double"))
        else:  # the product over axes of length - correction
            got = F.var_pop(d) * n
            for m in per_axis:
                got = ieee.div(got, F.lit(float(m - correction)))
        got = F.when(spoiled, F.lit(_NAN)).otherwise(F.coalesce(got, F.lit(_NAN)))
        return F.sqrt(got) if base == "std" else got
    if base == "median":
        got = F.median(F.when(number, x.cast("double")) if kind.floating else x.cast("double"))
        return F.when(spoiled, F.lit(_NAN)).otherwise(F.coalesce(got, F.lit(_NAN)))
    hit = v if kind.kind == "b" else x != 0
    return F.coalesce(F.bool_and(hit), F.lit(True)) if base == "all" else F.coalesce(F.bool_or(hit), F.lit(False))


def _fold(parts: Column, out: DType) -> Column:
    """The product modulo 2**64 of an array of whole numbers: each step multiplies by halves of 32 bits, in decimals."""
    big = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    two64, half = big(1 << 64), F.lit(str(1 << 32)).cast("decimal(10,0)")

    def times(a: Column, b: Column) -> Column:
        b = F.pmod(b.cast("decimal(38,0)"), two64)
        low = F.pmod(b, big(1 << 32))
        high = ((b - low) / big(1 << 32)).cast("decimal(10,0)")
        a = a.cast("decimal(20,0)")
        shifted = F.pmod((F.pmod((a * high).cast("decimal(38,0)"), two64).cast("decimal(20,0)") * half).cast("decimal(38,0)"), two64)
        return F.pmod(shifted + (a * low.cast("decimal(10,0)")).cast("decimal(38,0)"), two64).cast("decimal(38,0)")

    return ieee.wrap(F.aggregate(parts, big(1), times), out)


def _partial_products(keys: list[str]):
    """Products modulo 2**64 within a task: a row for each key that it has read, so a long axis stays no list."""

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        if not keys:
            return pd.DataFrame({"v": [np.multiply.reduce(pdf["v"].to_numpy())]})
        pdf = pdf.sort_values(keys, kind="stable", ignore_index=True)
        new = (pdf[keys].ne(pdf[keys].shift())).any(axis=1).to_numpy()
        at = np.flatnonzero(new)
        return pdf.loc[at, keys].assign(v=np.multiply.reduceat(pdf["v"].to_numpy(), at)).reset_index(drop=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if len(pdf):
                held = merged(pdf if held is None else pd.concat([held, pdf], ignore_index=True))
            if held is not None and len(held) > 200_000:
                yield held
                held = None
        if held is not None:
            yield held

    return run


#: Groups of more cells find their median by narrowing brackets instead of Spark's table of a group's values.
MEDIAN_CELLS = 10_000_000


def _large_median(rows: DataFrame, keys: list[str], skip: bool, most: int) -> DataFrame:
    """Exact medians of ``x`` (double) by ``keys`` in memory that doesn't grow with a group.

    An approximate percentile brackets the wanted ranks; what lies outside is only counted. Brackets
    shrink about a thousandfold each time, until ``most`` values are left in each, which are ranked.
    """
    number = ~F.isnan("x")
    total = rows.groupBy(*keys).agg(F.count_if(number).alias("n"), F.max(F.isnan("x")).alias("bad"), F.min(F.when(number, F.col("x"))).alias("lo"), F.max(F.when(number, F.col("x"))).alias("hi"))
    bracket = total.select(*keys, "n", "bad", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("m"))
    inside = rows.where(number)

    def within(b: DataFrame) -> DataFrame:
        b = b.select(*[F.col(k).alias(f"_{k}") for k in keys], "n", "lo", "hi", "below", "m")
        same = [F.col(k) == F.col(f"_{k}") for k in keys]
        return inside.join(b, [*same, F.col("x") >= F.col("lo"), F.col("x") <= F.col("hi")]) if keys else inside.crossJoin(b).where("x >= lo and x <= hi")  # one row

    while (bracket.agg(F.max("m")).first()[0] or 0) > most:
        near = within(bracket).groupBy(*keys, "n", "lo", "hi", "below").agg(F.count("*").alias("m"), F.percentile_approx("x", F.array(*[F.lit(i / 2000) for i in range(2001)]), 20_000).alias("q"))
        at = F.floor((F.col("n") / 2 - F.col("below")) / F.col("m") * 2000).cast("int")
        cut = near.select(*keys, "n", F.get("q", F.greatest(F.lit(0), at - 2)).alias("lo"), F.get("q", F.least(F.lit(2000), at + 3)).alias("hi"))
        named = cut.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("n").alias("_n"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        same = [F.col(k) == F.col(f"_{k}") for k in keys]
        counted = inside.join(named, same) if keys else inside.crossJoin(named)
        tight = counted.groupBy(*keys, F.col("_n").alias("n"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi")).agg(F.count_if(F.col("x") < F.col("_lo")).alias("below"), F.count_if(F.col("x").between(F.col("_lo"), F.col("_hi"))).alias("m"))
        before = bracket.agg(F.max("m")).first()[0]
        bracket = tight.checkpoint() if tight.sparkSession.sparkContext.getCheckpointDir() else tight
        if bracket.agg(F.max("m")).first()[0] >= before:
            break  # one value fills the bracket: ranking its counts is cheap
    counts = within(bracket).groupBy(*keys, "n", "below", "x").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy("x")
    ranked = counts.withColumn("to", F.sum("c").over(w) + F.col("below")).withColumn("from", F.col("to") - F.col("c"))
    pick = lambda r: F.max(F.when((F.col("from") <= r) & (F.col("to") > r), F.col("x")))
    middle = ranked.groupBy(*keys).agg(((pick(F.expr("(n - 1) div 2")) + pick(F.expr("n div 2"))) / 2).alias("v"))
    out = total.select(*keys, "bad").join(middle, keys, "left") if keys else total.select("bad").join(middle, F.lit(True), "left")
    good = F.coalesce("v", F.lit(_NAN))
    return out.select(*keys, (good if skip else F.when(F.col("bad"), F.lit(_NAN)).otherwise(good)).alias("v"))


def reduce(a: NDArray, func: str, axis: int | Sequence[int] | None = None, oneshot: bool = True, correction: float = 0.0, compat_correction: bool = False) -> NDArray:
    """``a`` reduced along ``axis`` (all axes by default); the reduced axes go.

    ``correction`` is taken from the number of values that a variance divides by; with
    ``compat_correction`` from the length of each reduced axis.
    """
    if func not in FUNCS:
        raise ArrayError(f"no reduction {func}")
    if func in NAN_FUNCS and not a.dtype.floating:
        raise ArrayError(f"{func} is a reduction of floats")
    if correction and func.removeprefix("nan") not in ("var", "std"):
        raise ArrayError("only variances take a correction")
    if not oneshot and func in ONESHOT_ONLY:
        raise ArrayError(f"{func} has no axis-by-axis form")
    axes = list(range(a.ndim)) if axis is None else [axis] if isinstance(axis, int) else list(axis)
    axes = [a.meta.axis(k) for k in axes]
    if len(set(axes)) < len(axes):
        if oneshot:
            raise ArrayError("an axis is named twice")
        axes = list(dict.fromkeys(axes))
    kept = [k for k in range(a.ndim) if k not in axes]
    out = result_type(func, a.dtype)
    shape = tuple(a.shape[k] for k in kept)
    if any(a.shape[k] == 0 for k in axes) and func.removeprefix("nan") in ("max", "min"):
        raise ArrayError(f"{func} of no cells")
    value = _aggregate(func, a.value, a.dtype, out, correction, [a.shape[k] for k in axes] if compat_correction else None)
    keys = [a.coords[k].alias(f"i{j}") for j, k in enumerate(kept)]
    rows = a.origin
    if func == "prod" and not a.dtype.floating:
        names = [f"i{j}" for j in range(len(kept))]
        bits = ieee.cast(a.value, a.dtype, DTYPES["i64"])
        schema = ", ".join([f"{n} long" for n in names] + ["v long"])
        rows = rows.select(*keys, bits.alias("v")).mapInPandas(_partial_products(names), schema)
        keys, value = names, _fold(F.collect_list("v"), out)
    if func.endswith("median") and prod(a.shape[k] for k in axes) > MEDIAN_CELLS:
        df = _large_median(rows.select(*keys, a.value.cast("double").alias("x")), [f"i{j}" for j in range(len(kept))], func in NAN_FUNCS, MEDIAN_CELLS)
        df = df.withColumn("v", F.col("v").cast(out.spark))
    else:
        df = rows.groupBy(*keys).agg(value.cast(out.spark).alias("v"))
    return NDArray.cells(df, a.meta.but(dtype=out, shape=shape, view=False, urlpath=None, chunkshape=None, blockshape=None))


def reduce_udf(a: NDArray, function: Callable[[np.ndarray], object], axis: int | Sequence[int] | None = None, kind: str | DType = "f64") -> NDArray:
    """``a`` reduced by a user function of the values of one group, in no particular order: a group is one task's."""
    out = dtype(kind)
    axes = range(a.ndim) if axis is None else [a.meta.axis(axis)] if isinstance(axis, int) else [a.meta.axis(k) for k in axis]
    kept = [k for k in range(a.ndim) if k not in axes]

    @F.pandas_udf(out.spark)
    def run(v: pd.Series) -> float:
        return np.asarray(function(v.to_numpy())).astype(out.numpy).item()

    df = a.origin.groupBy(*[a.coords[k].alias(f"i{j}") for j, k in enumerate(kept)]).agg(run(a.value).alias("v"))
    return NDArray.cells(df, a.meta.but(dtype=out, shape=tuple(a.shape[k] for k in kept), view=False, urlpath=None, chunkshape=None, blockshape=None))

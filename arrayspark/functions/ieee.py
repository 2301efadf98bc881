"""Columns that compute as C and IEEE 754 do, whatever the session's ANSI setting.

Spark raises on x/0, gives null for ln(0), makes bigint of floor() and lets NaN win in greatest(); the
arrays here have no nulls, and a zero division is an infinity. All of these stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..meta import DTYPES, ArrayError, DType

NAN, INF = float("nan"), float("inf")


def _dec(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(38,0)")


def div(a: Column, b: Column) -> Column:
    # 0.0 ** -1 is an infinity with the sign of the zero
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def fmod(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(NAN)).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b))


def log(a: Column, base10: bool = False) -> Column:
    f = F.log10 if base10 else F.log
    return F.when(a > 0, f(F.when(a > 0, a).otherwise(F.lit(1.0)))).when(a == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def whole(a: Column, up: bool) -> Column:
    big = F.isnan(a) | (F.abs(a) >= 2.0**52)
    safe = F.when(big, F.lit(0.0)).otherwise(a)
    return F.when(big, a).otherwise((F.ceil(safe) if up else F.floor(safe)).cast("double"))


def fmin(a: Column, b: Column) -> Column:
    return F.least(a, b)


def fmax(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def wrap(value: Column, kind: DType) -> Column:
    """A whole number of any size brought into ``kind`` by two's complement."""
    if kind.bits == 64:
        wide = value.cast("decimal(38,0)")
        if kind.kind == "u":
            return F.pmod(wide, _dec(1 << 64)).cast(kind.spark)
        return (F.pmod(wide + _dec(1 << 63), _dec(1 << 64)) - _dec(1 << 63)).cast("bigint")
    if kind.kind == "u":
        return F.pmod(value, F.lit(1 << kind.bits)).cast(kind.spark)
    gap = 64 - kind.bits
    return F.shiftright(F.shiftleft(value.cast("bigint"), gap), gap).cast(kind.spark)


def cast(value: Column, a: DType, b: DType) -> Column:
    """The C cast from ``a`` to ``b``: floats are cut toward zero, whole numbers wrap; what C leaves open
    (NaN, floats out of range) becomes the least 64-bit number before it wraps."""
    if a == b:
        return value
    if b.kind == "b":
        return value != 0
    if a.kind == "b":
        return value.cast("int").cast(b.spark)
    if b.floating:
        return value.cast(b.spark)
    if a.floating:
        x = value.cast("double")
        if b.name == "u64":
            fits = (x > -(2.0**63)) & (x < 2.0**64)
            # the cut is made on the double: a decimal cast would round
            return F.when(fits, wrap(F.when(fits, F.when(x < 0, whole(x, True)).otherwise(whole(x, False))).otherwise(F.lit(0.0)).cast("decimal(38,0)"), b)).otherwise(_dec(1 << 63).cast(b.spark))
        fits = (x >= -(2.0**63)) & (x < 2.0**63)
        long = F.when(fits, F.when(fits, x).otherwise(F.lit(0.0)).cast("bigint")).otherwise(F.lit(-(1 << 63)))
        return long if b.bits == 64 else wrap(long, b)
    if a.name == "u64" or b.bits == 64 and (b.kind == "u" or a.kind == "u" and a.bits == 64):
        return wrap(value, b) if b.bits == 64 else wrap(wrap(value, DTYPES["i64"]), b)
    if b.bits > a.bits and (b.kind == "i" or a.kind == "u"):
        return value.cast(b.spark)
    return wrap(value, b)


def integer(op: str, a: Column, b: Column, kind: DType) -> Column:
    """``a op b`` for whole numbers of ``kind``, wrapped."""
    if op == "/":
        safe = F.when(b == 0, F.lit(1).cast(kind.spark)).otherwise(b)
        # a zero divisor is open in C; the quotient is 0 here
        if kind.bits == 64:
            x, y = a.cast("decimal(38,0)"), safe.cast("decimal(38,0)")
            q = F.floor(F.abs(x) / F.abs(y)).cast("decimal(38,0)")
            exact = F.when((x < 0) == (y < 0), q).otherwise(-q)
            return F.when(b == 0, F.lit(0).cast("bigint")).otherwise(wrap(exact, kind))
        q = F.call_function("try_divide", a.cast("double"), safe.cast("double"))
        return F.when(b == 0, F.lit(0).cast(kind.spark)).otherwise(wrap(q.cast("bigint"), kind))
    if kind.bits == 64:
        a, b = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
    else:
        a, b = a.cast("bigint"), b.cast("bigint")
    made = {"+": a + b, "-": a - b, "*": a * b}.get(op)
    if made is None:
        raise ArrayError(f"no integer operator {op}")
    return wrap(made, kind)

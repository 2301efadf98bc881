"""Expressions over arrays: bind names, compile a text, evaluate lazily."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..array import NDArray
from ..meta import ArrayError, ArrayMeta, DType, dtype
from ..plans.align import align
from . import ieee
from .parser import Node, parse
from .udf import REGISTRY, Registry

MAX_BOUND = 128

_FLOAT_ONE: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "acos": F.acos, "asin": F.asin, "atan": F.atan, "ceil": lambda a: ieee.whole(a, True), "cos": F.cos, "cosh": F.cosh, "exp": F.exp,
    "floor": lambda a: ieee.whole(a, False), "log": ieee.log, "log10": lambda a: ieee.log(a, True), "negate": lambda a: -a,
    "sin": F.sin, "sinh": F.sinh, "sqrt": F.sqrt, "tan": F.tan, "tanh": F.tanh,
}
_FLOAT_TWO: dict[str, Callable[[Column, Column], Column]] = {"atan2": F.atan2, "max": ieee.fmax, "min": ieee.fmin, "pow": F.pow}
_FLOAT_OP: dict[str, Callable[[Column, Column], Column]] = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": ieee.div, "%": ieee.fmod, "^": F.pow}


def compile_tree(node: Node, names: dict[str, Column], kind: DType, registry: Registry) -> Column:
    """A column of ``kind`` (booleans compute as 8-bit integers)."""
    to = lambda n: compile_tree(n, names, kind, registry)
    if node.op == "number":
        if kind.floating:
            return F.lit(node.value).cast(kind.spark)
        return F.lit(int(node.value)).cast(kind.spark)  # literals are cut to the expression's type
    if node.op == "name":
        return names[node.value]
    args = [to(n) for n in node.args]
    if node.op == "call" and node.value not in _FLOAT_ONE and node.value not in _FLOAT_TWO:
        return registry.call(node.value, kind, args)
    if kind.floating:
        if node.op == "neg":
            out = -args[0]
        elif node.op == "call":
            out = (_FLOAT_ONE.get(node.value) or _FLOAT_TWO[node.value])(*args)
        else:
            out = _FLOAT_OP[node.op](*args)
        return out.cast("float") if kind.bits == 32 else out  # every step rounds to the type
    if node.op in ("+", "-", "*", "/"):
        return ieee.integer(node.op, args[0], args[1], kind)
    zero = F.lit(0).cast(kind.spark)
    if node.op == "neg" or node.value == "negate":
        return ieee.integer("-", zero, args[0], kind)
    if node.value == "abs":
        return F.when(args[0] < 0, ieee.integer("-", zero, args[0], kind)).otherwise(args[0])
    if node.value in ("min", "max"):
        return (F.least if node.value == "min" else F.greatest)(*args)
    raise TypeError(f"{node.value or node.op} is a function of floats, not of {kind.name}")


class Expression:
    """An expression of one element type; operands of other types are seen through type views first."""

    def __init__(self, kind: str | DType, registry: Registry = REGISTRY):
        self.dtype = dtype(kind)
        if self.dtype.kind == "u":
            raise ArrayError("expressions of unsigned types aren't supported")
        self.registry = registry
        self.arrays: dict[str, NDArray] = {}
        self.scalars: dict[str, float] = {}
        self.params: list[Any] = []
        self.out: ArrayMeta | None = None
        self.tree: Node | None = None
        self.kernel: Callable | None = None

    def _room(self, n: int) -> None:
        if n >= MAX_BOUND:
            raise ArrayError(f"at most {MAX_BOUND} can be bound")

    def bind(self, name: str, a: NDArray) -> Expression:
        self._room(len(self.arrays))
        if a.dtype != self.dtype:
            raise ArrayError(f"{name} is {a.dtype.name}; the expression is {self.dtype.name}: take a type view")
        self.arrays[name] = a
        return self

    def bind_scalar(self, name: str, value: float) -> Expression:
        self.scalars[name] = value
        return self

    def bind_param(self, value: Any) -> Expression:
        """A value for array kernels."""
        self._room(len(self.params))
        self.params.append(value)
        return self

    def bind_out(self, meta: ArrayMeta) -> Expression:
        """Shape and storage of the result; needed where no operand gives the shape."""
        self.out = meta
        return self

    def compile(self, text: str) -> Expression:
        self.tree = parse(text, {*self.arrays, *self.scalars}, self.registry.has)
        return self

    def compile_udf(self, kernel: Callable[..., np.ndarray]) -> Expression:
        """A kernel over chunks: ``kernel(inputs, start, params)`` gives a chunk of the inputs' shape."""
        self.kernel = kernel
        return self

    @property
    def nthreads(self) -> int:
        spark = next(iter(self.arrays.values())).spark
        return spark.sparkContext.defaultParallelism

    def eval(self, spark=None) -> NDArray:
        if self.kernel is not None:
            from ..operators.chunks import map_chunks

            return map_chunks(list(self.arrays.values()), self.kernel, self.params, self.dtype)
        if self.tree is None:
            raise ArrayError("compile first")
        kind = self.dtype
        small = dtype("i8") if kind.kind == "b" else kind
        names = {k: F.lit(int(v) if not kind.floating else float(v)).cast(small.spark) for k, v in self.scalars.items()}
        if self.arrays:
            rows, coords, values = align(self.arrays)
            first = next(iter(self.arrays.values()))
            meta, names = first.meta, names | {k: v.cast(small.spark) if kind.kind == "b" else v for k, v in values.items()}
            if self.out and self.out.shape != meta.shape:
                raise ArrayError("the result's shape isn't the operands'")
        elif self.out:
            from ..operators.create import positions

            if spark is None:
                from pyspark.sql import SparkSession

                spark = SparkSession.active()
            meta = self.out
            rows, coords = positions(spark, meta.shape)
        else:
            raise ArrayError("without operands the result's shape must be bound")
        value = compile_tree(self.tree, names, small, self.registry)
        storage = {"chunkshape": self.out.chunkshape, "blockshape": self.out.blockshape} if self.out else {}
        return NDArray(rows, coords, value != 0 if kind.kind == "b" else value, meta.but(dtype=kind, view=False, urlpath=None, **storage))


def evaluate(text: str, kind: str | DType | None = None, **arrays: NDArray) -> NDArray:
    """The value of ``text`` over named arrays of one type."""
    e = Expression(kind or next(iter(arrays.values())).dtype)
    for name, a in arrays.items():
        e.bind(name, a)
    return e.compile(text).eval()

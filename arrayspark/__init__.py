"""Chunked n-dimensional arrays as Spark DataFrames."""

from .array import NDArray
from .functions.expressions import Expression, evaluate
from .meta import ArrayError, ArrayMeta, DType

__all__ = ["ArrayError", "ArrayMeta", "DType", "Expression", "NDArray", "evaluate"]

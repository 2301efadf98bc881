"""User functions: a registry of libraries of scalar functions, and kernels over whole chunks.

A scalar function gets and gives numpy arrays (one Arrow batch at a time) and is called in expressions
as ``library.name(...)``; arguments and result have the expression's type.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..meta import ArrayError, DType


@dataclass
class Library:
    name: str
    functions: dict[str, tuple[Callable, int]] = field(default_factory=dict)

    def register(self, name: str, function: Callable[..., np.ndarray], arity: int) -> Library:
        if not 1 <= arity <= 7:
            raise ArrayError("a user function takes one to seven arguments")
        if name in self.functions:
            raise ArrayError(f"{self.name}.{name} is taken")
        self.functions[name] = function, arity
        return self


class Registry:
    def __init__(self) -> None:
        self.libraries: dict[str, Library] = {}

    def library(self, name: str) -> Library:
        """A new library."""
        if name in self.libraries:
            raise ArrayError(f"library {name} is taken")
        self.libraries[name] = Library(name)
        return self.libraries[name]

    def free(self, name: str) -> None:
        self.libraries.pop(name, None)

    def lookup(self, full: str) -> tuple[Callable, int]:
        """The function called ``library.name`` or ``library.name()``."""
        lib, dot, name = full.removesuffix("()").partition(".")
        if not dot or "." in name or name not in getattr(self.libraries.get(lib), "functions", {}):
            raise ArrayError(f"no user function {full}")
        return self.libraries[lib].functions[name]

    def has(self, full: str) -> bool:
        try:
            self.lookup(full)
        except ArrayError:
            return False
        return True

    def call(self, full: str, kind: DType, args: list[Column]) -> Column:
        function, arity = self.lookup(full)
        if len(args) != arity:
            raise ArrayError(f"{full} takes {arity} arguments")

        @F.pandas_udf(kind.spark)
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series(np.asarray(function(*[c.to_numpy() for c in columns])).astype(kind.numpy))

        return run(*args)


#: The registry that expressions use unless they are given another.
REGISTRY = Registry()

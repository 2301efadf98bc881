"""Bringing the operands of one expression together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..array import NDArray
from ..meta import ArrayError


def align(arrays: dict[str, NDArray]) -> tuple[DataFrame, tuple[Column, ...], dict[str, Column]]:
    """(rows, coordinates, value of each operand): no join among operands over the same rows.

    Operands of other origins are joined on all coordinates, one join for each origin; arrays are dense,
    so an inner join loses nothing. There is no broadcasting: shapes must be equal.
    """
    if not arrays:
        raise ArrayError("no operand")
    shapes = {a.shape for a in arrays.values()}
    if len(shapes) > 1:
        raise ArrayError(f"operands of different shapes: {sorted(shapes)}")
    groups: list[list[tuple[str, NDArray]]] = []
    for name, a in arrays.items():
        for g in groups:
            if g[0][1].aligned(a):
                g.append((name, a))
                break
        else:
            groups.append([(name, a)])
    if len(groups) == 1:
        first = groups[0][0][1]
        return first.origin, first.coords, {n: a.value for n, a in groups[0]}
    keys = [f"i{k}" for k in range(groups[0][0][1].ndim)]
    rows = None
    for g in groups:
        part = g[0][1].origin.select(*[c.alias(k) for c, k in zip(g[0][1].coords, keys, strict=True)], *[a.value.alias(f"v_{n}") for n, a in g])
        rows = part if rows is None else rows.join(part, keys) if keys else rows.crossJoin(part)  # without axes both have one row
    return rows, tuple(F.col(k) for k in keys), {n: F.col(f"v_{n}") for n in arrays}

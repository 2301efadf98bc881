"""Connected components of a table of links, without gathering links in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, stored


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for each node that is not the least of its group; the least node is the root."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:  # all links at once: hook the larger root to the smaller, then halve the paths
        low, high = np.minimum(parent[x], parent[y]), np.maximum(parent[x], parent[y])
        if (low == high).all():
            break
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    root = nodes[parent]
    changed = root != nodes
    return nodes[changed], root[changed]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars: as many rows at most as it has nodes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        size += batch.num_rows
        if size > 1 << 20:
            held = [union_find(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))]
            size = len(held[0][0])
    if held:
        a, b = union_find(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node with a link, but for the roots; ``links`` has long columns a and b.

    Each partition first reduces its own links by union-find. The stars that remain are joined by
    alternating two steps until nothing changes: each node hands its larger neighbours to its least
    neighbour, then its smaller ones. Steps are grouped minima and joins, so a node with very many
    links is no group that a task must hold; the number of steps grows with the logarithm of a path.
    """
    schema = "a long, b long"
    links = stored(map_batches(links.where("a <> b"), _local, schema), "links")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = None
    while seen != (now := state(links)):
        seen = now
        if not now[0]:
            break
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # now a > b in every row: small star of a node u is its rows (u, *)
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        links = stored(map_batches(small.select("a", "b"), _local, schema), "links")
    return links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")

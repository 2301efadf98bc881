"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sizes are counted in words. Each source gets a share of the wanted total by weight, at most ``cap``
times what it has; the excess is shared again. The wanted tokens are then cut into blocks of equal
size, and blocks go to sources one after the other, each to the source with the highest quotient
target / (2 * seats + 1). A source's blocks are apportioned in the same way to its groups of shards, by
size, and a group's to its shards, each group in a task of its own. In a shard, documents stand in a
seeded order, and its quota is a run of blocks around that circle from a seeded block on, as many full
turns as it takes: so each row's words taken follow from its place alone. Shards have the same size in
tables of all sizes; the driver sees a row for each source and for each group of 4096 shards.

Defined results: null and empty texts have size 0 and nothing is taken from them; null is a source of
its own, after all others; a document belongs to a shard by its id and its whole row, so rows of one id
are spread and rows that repeat are interchangeable; a document longer than a shard is a shard's, and
one row's work; an empty table gives an empty result; columns named in ``carry`` are kept, but for those
that are named as a result is; further ones are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size."""
    out = [0.0] * len(sizes)
    free = set(range(len(sizes)))
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        weight = sum(weights[i] for i in free)
        above = {i for i in free if left * weights[i] / weight > cap * sizes[i]}
        for i in free:
            out[i] = cap * sizes[i] if i in above else left * weights[i] / weight
        if not above:
            break
        free -= above
    return out


def sainte_lague(claims: list[float], seats: int, most: list[int]) -> list[int]:
    """``seats`` by the highest quotients claim / (2k + 1), none above ``most``; ties go to the earlier claim.

    The common divisor gives all but a few seats at once; the rest are dealt or taken back singly.
    """
    total = sum(claims)
    seats = min(seats, sum(most))
    if total <= 0 or seats <= 0:
        return [0] * len(claims)
    got = [min(m, int(c * seats / total + 0.5)) for c, m in zip(claims, most, strict=True)]
    more = seats - sum(got)
    sign = 1 if more > 0 else -1
    heap = []
    for i, c in enumerate(claims):
        if (sign > 0 and got[i] < most[i]) or (sign < 0 and got[i] > 0):
            heapq.heappush(heap, (-c / (2 * got[i] + 1), i) if sign > 0 else (c / (2 * got[i] - 1), -i))
    for _ in range(abs(more)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        i = abs(i)
        got[i] += sign
        if (sign > 0 and got[i] < most[i]) or (sign < 0 and got[i] > 0):
            heapq.heappush(heap, (-claims[i] / (2 * got[i] + 1), i) if sign > 0 else (claims[i] / (2 * got[i] - 1), -i))
    return got


def share_out(claims: list[float], words: int, most: list[int], block: int) -> list[int]:
    """``words`` apportioned in blocks by ``claims``, none above ``most``.

    The last block of a part may be shorter than others; what it lacks goes to the first parts that have room.
    """
    seats = sainte_lague(claims, round(words / block), [-(-m // block) for m in most])
    out = [min(k * block, m) for k, m in zip(seats, most, strict=True)]
    left = words - sum(out)
    for i, m in enumerate(most):
        if left <= 0:
            break
        more = min(left, m - out[i], block)
        out[i] += more
        left -= more
    return out


#: Layouts of so many sources at most are sent to every task; more are joined by exchange.
BROADCAST_SOURCES = 100_000
#: Shards whose quotas one task makes.
GROUP = 4096


def mixture(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 11, shard_words: int = 50_000, block: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, size, source_size, target, taken) of every row of ``docs`` (doc_id, text, source).

    Weights go to the sources in code-point order, over and over. Names and sizes of the sources are the driver's.
    """
    spark = docs.sparkSession
    carry = tuple(c for c in carry if c not in ("doc_id", "size", "source_size", "target", "taken"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    carried = F.struct(*carry) if carry else F.lit(None).cast("string")
    spot = F.xxhash64("doc_id", "text", *carry, F.lit(seed))
    sized = stored(docs.select("doc_id", F.col("source").alias("name"), carried.alias("carried"), spot.alias("spot"), size.alias("size")), "sized")
    found = sized.groupBy("name").agg(F.sum("size").alias("n")).collect()
    sources = sorted(found, key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8")))  # bytes of UTF-8 sort by code point
    sizes = [r["n"] for r in sources]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], share * sum(sizes), cap)
    quota = share_out(want, round(sum(want)), [int(cap * n) for n in sizes], block)

    rows = [(r[0], i, max(1, -(-n // shard_words)), n, want[i]) for i, (r, n) in enumerate(zip(sources, sizes, strict=True))]
    layout = spark.createDataFrame(rows, "known string, s int, shards long, source_size long, target double")
    if len(rows) <= BROADCAST_SOURCES:
        layout = F.broadcast(layout)
    placed = sized.join(layout, F.col("name").eqNullSafe(F.col("known"))).withColumn("shard", F.pmod("spot", "shards"))
    shards = placed.groupBy("s", "shard").agg(F.sum("size").alias("n"))
    shards = stored(shards.withColumn("g", F.expr(f"shard div {GROUP}")), "shards")
    groups: dict[int, list[tuple[int, int]]] = {}
    for r in shards.groupBy("s", "g").agg(F.sum("n").alias("n")).collect():
        groups.setdefault(r["s"], []).append((r["g"], r["n"]))
    rows = []
    for i, own in sorted(groups.items()):
        own = sorted(own)
        words = share_out([float(n) for _, n in own], quota[i], [int(cap * n) for _, n in own], block)
        rows += [(i, g, q) for (g, _), q in zip(own, words, strict=True)]
    given = spark.createDataFrame(rows, "s int, g long, q long")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        words = share_out([float(n) for n in pdf["n"]], int(pdf["q"].iloc[0]), [int(cap * n) for n in pdf["n"]], block)
        return pdf[["s", "shard", "n"]].assign(quota=words)

    plan = stored(shards.join(given, ["s", "g"]).groupBy("s", "g").applyInPandas(inside, "s int, shard long, n long, quota long"), "quotas")
    out = placed.join(plan, ["s", "shard"])
    order = Window.partitionBy("s", "shard").orderBy(F.xxhash64("spot", F.lit(seed + 1)), "doc_id", "spot", "size")
    out = out.withColumn("to", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("from", F.expr("to - size"))
    # the run of the quota's last turn begins at a seeded block
    out = out.withColumn("begin", F.expr(f"if(n > 0, pmod(xxhash64(name, shard, {seed + 2}L), greatest(1L, n div {block})) * {block}, 0L)"))
    out = out.withColumn("turns", F.expr("if(n > 0, quota div n, 0L)")).withColumn("end", F.expr("begin + if(n > 0, quota % n, 0L)"))
    cut = "greatest(0L, least(to, least(end, n)) - greatest(from, begin)) + greatest(0L, least(to, end - n) - from)"
    kept = [F.col("carried")[c].alias(c) for c in carry]
    return out.select("doc_id", *kept, "size", "source_size", "target", F.expr(f"turns * size + {cut}").alias("taken"))

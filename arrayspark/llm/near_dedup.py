"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and union-find.

SuperMinHash gives each element of a set one random permutation of the signature's positions; position
i holds the least (rank + fraction) at which any element reaches i. Ranks of one element are
correlated, which lowers the variance against independent minima. As ranks are visited in order, a
document is finished once each of its positions is filled: a text of a thousand words needs one rank.

Rows, not ids, are what is linked: each row has a key of its own inside, and ids come back at the end.

Defined results: null and empty texts and texts without words have ``n_shingles`` 0 and are linked
with nothing; repeated rows fall in one component; rows of one id with different texts are linked each by
its own text; a null id is never the name of a component that has another; a very long text is one
task's, in time and memory proportional to it; an empty table gives an empty result; further columns
are ignored by ``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import IdFilter, free_name, map_batches, stored
from .textblocks import BLANK, buffers, int64, mix, runs, seeds, slices, span_hashes, tokens

_U = np.uint64


def shingles(buf: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the shingles of each text, and where each text's begin.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer words has one shingle of all.
    """
    start, end, first = tokens(buf, off, BLANK)
    h = span_hashes(buf, start, end)
    factor = seeds(words, 3) | _U(1)
    count = np.diff(first)
    made = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(begin[-1], _U)
    # positions of the tokens that open a shingle
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], made)
    length = np.repeat(np.minimum(count, words), made)
    for k in range(words):
        use = length > k
        if use.all():
            out += h[at + k] * factor[k]
        else:
            out[use] += h[at[use] + k] * factor[k]
    out = mix(out + length.astype(_U))
    for i in np.flatnonzero(made > 1):
        out[begin[i] : begin[i + 1]].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[:-1][made > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[begin]


def super_minhash(values: np.ndarray, first: np.ndarray, size: int, seed: int = 5) -> np.ndarray:
    """Signatures (texts, size) of sets of hashes, one rank of all permutations at a time.

    Entry = rank * 2**25 + fraction, the least over the set's elements; all ones for empty sets.
    """
    docs, m = len(first) - 1, size
    sig = np.full(docs * m, 0xFFFFFFFF, np.uint32)
    doc = runs(first)
    state = mix(values ^ seeds(1, seed)[0])
    steps = seeds(m, seed + 1)
    order = None
    for rank in range(m):
        x = mix(state + steps[rank])
        k = rank + (((x >> _U(32)) * _U(m - rank)) >> _U(32)).astype(np.int64)
        if order is None:
            spot = k
        else:  # one step of Fisher and Yates' shuffle for every element that is still needed
            rows = np.arange(len(k))
            spot = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, rank]
        np.minimum.at(sig, doc * m + spot, (np.uint32(rank << 25) | (x & _U(0x1FFFFFF)).astype(np.uint32)))
        unfinished = (sig.reshape(docs, m) == 0xFFFFFFFF).any(axis=1)
        need = unfinished[doc]
        left = int(need.sum())
        if not left:
            break
        if order is None:
            state, doc, k = state[need], doc[need], k[need]
            order = np.empty((left, m), np.uint8)
            order[:] = np.arange(m, dtype=np.uint8)
            order[np.arange(left), k] = 0
        elif left < 0.7 * len(need):
            state, doc, order = state[need], doc[need], order[need]
    return sig.reshape(docs, m)


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """(texts, size / rows) hashes of ``rows`` neighbouring entries and the number of the band."""
    n = sig.shape[1] // rows
    parts = sig[:, : n * rows].reshape(len(sig), n, rows).astype(_U)
    return mix((parts * (seeds(rows, 7) | _U(1))).sum(axis=2, dtype=_U) + seeds(n, 8))


def _digests(values: np.ndarray, first: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Two longs of a 128-bit cryptographic digest of each whole set (sorted, so equal sets have equal bytes)."""
    joined = b"".join(hashlib.blake2b(values[a:b], digest_size=16).digest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
    pair = np.frombuffer(joined, np.int64).reshape(-1, 2)
    return pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())


def _signer(words: int, size: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            values, first = shingles(*buffers(part.column(3)), words)
            n = np.diff(first)
            band = int64(bands(super_minhash(values, first, size), rows))
            flat = pa.array(band[n > 0].ravel())
            width = np.where(n > 0, band.shape[1], 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n), *_digests(values, first), lists], names=["row", "doc_id", "t", "n", "k1", "k2", "bands"])

    return sign


def _shingler(words: int, keep):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = keep(np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1))
            for part in slices(iter([batch.filter(pa.array(hit))]), "text"):
                values, first = shingles(*buffers(part.column(0)), words)
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((first * 8).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*_digests(values, first), blob], names=["k1", "k2", "shingles"])

    return make


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of (id, part, shingles), with the size n of its set."""
    for batch in batches:
        buf, off = buffers(batch.column(2))
        n = np.diff(off) // 8
        at = pa.array(np.repeat(np.arange(batch.num_rows), n))
        token = pa.array(buf.view(np.int64).copy())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(n.astype(np.int64)).take(at), token], names=["id", "part", "n", "token"])


def _verifier(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (abuf, aoff), (bbuf, boff) = buffers(batch.column(2)), buffers(batch.column(3))
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = abuf[aoff[i] : aoff[i + 1]].view(_U), bbuf[boff[i] : boff[i + 1]].view(_U)
                small, large = min(len(x), len(y)), max(len(x), len(y))
                if 100 * small >= percent * large:
                    both = np.concatenate([x, y])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    ok[i] = 100 * shared >= percent * (len(both) - shared)
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return verify


def _grouped(docs: DataFrame, words: int, percent: int, size: int, rows: int, pivots: int) -> DataFrame:
    """(row, doc_id, n, component_id, first) of ``docs`` (row, doc_id, text); ``first``: one row of each component."""
    # t tells texts apart when they are read again; what has the same id and text has the same set
    hashed = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("t"), "text")
    signed = stored(map_batches(hashed, _signer(words, size, rows), "row long, doc_id long, t long, n long, k1 long, k2 long, bands array<long>"), "signed")
    # only sets that occur again; written, so that both sides of the join are plain exchanges and a set that
    # very many documents have is one side's skew, which Spark splits
    key = ["k1", "k2", "n"]
    again = signed.where("n > 0").groupBy(*key).agg(F.min("row").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    rep = F.when(F.col("n") > 0, F.coalesce("rep", "row")).alias("rep")
    members = stored(signed.drop("bands").join(stored(again, "classes"), key, "left").select("row", "doc_id", "t", *key, rep), "members")

    # one row of each class brings its bands
    reps = signed.join(members.where("row = rep").select("row"), "row", "left_semi")
    banded = reps.select(F.col("row").alias("id"), F.col("doc_id").alias("o"), "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("bucket")
    buckets = stored(banded.join(shared, "bucket"), "buckets")
    met = stored(members.join(buckets.select(F.col("id").alias("row")).distinct(), "row", "left_semi").select(F.col("row").alias("id"), "t", "k1", "k2"), "met")
    filt = IdFilter(met, "t")
    texts = map_batches(hashed.select("text", *filt.spots("t")), _shingler(words, filt.keep), "k1 long, k2 long, shingles binary")
    sets = stored(texts.groupBy("k1", "k2").agg(F.min("shingles").alias("shingles")).join(met.drop("t"), ["k1", "k2"]).select("id", "shingles"), "sets")

    linked = _link(buckets, sets, percent, pivots)
    component = F.coalesce("root", "rep", "row").alias("component")
    found = stored(members.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("row", "doc_id", "n", component), "found")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))).alias("least")
    named = found.groupBy("component").agg(least, F.count("*").alias("c")).where("c > 1").select("component", "least.doc_id", "least.row")
    named = stored(named.toDF("component", "least_id", "least_row"), "named")
    out = found.join(named, "component", "left")
    alone = F.col("least_row").isNull()
    return out.select("row", "doc_id", "n", F.when(alone, F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"), (alone | (F.col("row") == F.col("least_row"))).alias("first"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, size: int = 128, rows: int = 4, pivots: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Documents are linked if ``100 * shared >= percent * union`` of their shingle sets; a component is
    what links reach and is named by its least id; rows of that id are kept. With 128 entries in bands
    of 4, two sets at 0.8 meet in some band but for a chance of 5e-8.

    Sets that are equal become one class first, so copies cost one row each. In a bucket each class is
    compared with one centre, that of the least id, not with all others. In buckets that then still hold
    several components, all but the largest component are compared with ``pivots`` further classes
    drawn by hash. So a pass costs rows in proportion to a bucket, whatever its size. Centres alone can
    miss links, so what they leave apart is joined exactly on the rarest shingles of each set
    (``_rest``): no two sets that share a bucket stay unlinked.
    """
    # the key of a row is settled when the table of signatures is written
    found = _grouped(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), words, percent, size, rows, pivots)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80, size: int = 128, rows: int = 4, pivots: int = 4) -> DataFrame:
    """``docs`` with all its columns and one row of each component: the one of the least id, of equal ids one; null ids last.

    Rows are numbered and written once, so that they can be told apart whatever their ids.
    """
    key = free_name(docs, "_row")
    numbered = stored(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    found = _grouped(numbered.select(F.col(key).alias("row"), "doc_id", "text"), words, percent, size, rows, pivots)
    gone = found.where("not first").select(F.col("row").alias(key))
    return numbered.join(gone, key, "left_anti").select(*docs.columns)


def _rest(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of all classes in ``apart`` (id, part) of different components that may be linked; an exact prefix filter.

    Shingles that only one component holds come first in each set's order, then rarer ones. Two sets that
    are linked share ``o = percent * (n + m) / (100 + percent)`` shingles at least, so the first they share
    has ``o`` places from it to the end in both. Sets are paired by classes of sizes in steps of 3 %, as a
    set of a larger partner needs fewer places: shingles of a passage that all sets of a group hold
    stay out of reach where the passage alone makes no link.
    """
    schema = "id long, part long, n long, token long"
    tokens = stored(map_batches(apart.join(sets, "id").select("id", "part", "shingles"), _rows, schema), "tokens")
    common = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("token", "df")
    held = tokens.join(common, "token").groupBy("id", "part", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))
    # k: class of the size, least sizes of class c are step ** c; sizes in reach are percent / 100 * n .. 100 / percent * n
    step = 1.03
    k = lambda size: F.floor(F.log(F.greatest(size, F.lit(1.0))) / float(np.log(step)) + 1e-9)
    held = held.withColumn("k", k(F.col("n").cast("double")))
    held = held.withColumn("other", F.explode(F.sequence(k(F.col("n") * (percent / 100)) - 1, k(F.col("n") * (100 / percent)) + 1)))
    # no partner of the class is smaller than this, so at least ``need`` shingles are shared
    least = F.greatest(F.pow(F.lit(step), F.col("other")) - 1, F.col("n") * (percent / 100) - 1)
    need = F.greatest(F.floor((F.col("n") + least) * (percent / (100 + percent))), F.lit(1))
    places = F.greatest(F.col("n") - need + 1 - (F.col("n") - F.size("held")), F.lit(0)).cast("int")
    spots = held.select("id", "part", "n", "k", "other", F.size("held").alias("m"), F.posexplode(F.slice("held", F.lit(1), places)).alias("i", "h"))
    spots = stored(spots.select("id", "part", "n", "k", "other", F.col("h.token").alias("token"), (F.col("m") - F.col("i")).alias("left")), "spots")
    # rows of one size meet those of the other; all but the largest component of a key meet all of its rows, so
    # that a group already linked isn't paired with itself
    keys = ["token", "lo", "hi"]
    sided = spots.withColumns({"lo": F.least("k", "other"), "hi": F.greatest("k", "other")})
    parts = sided.groupBy(*keys, "part").agg(F.count("*").alias("c"), F.min("k").alias("low"), F.max("k").alias("high"))
    main = parts.groupBy(*keys).agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.count("*").alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"))
    main = main.where("parts > 1 and low = lo and high = hi").select(*keys, "main")
    x = sided.join(main, keys).where("part <> main").select("id", "part", "n", "token", "k", "other", "left")
    y = spots.select(F.col("id").alias("id2"), F.col("part").alias("part2"), F.col("n").alias("n2"), "token", F.col("other").alias("k"), F.col("k").alias("other"), F.col("left").alias("left2"))
    fits = f"part <> part2 and {100 + percent} * least(left, left2) >= {percent} * (n + n2) and 100 * least(n, n2) >= {percent} * greatest(n, n2)"
    pairs = x.join(y, ["token", "k", "other"]).where(fits)
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def _apart(buckets: DataFrame, root: DataFrame, pivots: int) -> tuple[DataFrame, DataFrame]:
    """(members, heads) of the buckets that hold several components: members with their component ``part``; of each
    bucket the component ``main`` with most members, and ``pivots`` members drawn by hash."""
    state = buckets.join(root.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "n", F.coalesce("root", "id").alias("part"))
    drawn = [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("o"), "id", "n", "part")).alias(f"p{k}") for k in range(pivots)]
    parts = state.groupBy("bucket", "part").agg(F.count("*").alias("c"), *drawn)
    heads = parts.groupBy("bucket").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.count("*").alias("parts"), *[F.min(f"p{k}").alias(f"p{k}") for k in range(pivots)])
    heads = heads.where("parts > 1").select("bucket", "main", F.array_distinct(F.array(*[f"p{k}" for k in range(pivots)])).alias("drawn"))
    return state, heads


def _link(buckets: DataFrame, sets: DataFrame, percent: int, pivots: int) -> DataFrame:
    """(node, root) over the classes in ``buckets`` (id, o, n, bucket): two passes of comparisons with centres, then all that is left."""

    def verified(pairs: DataFrame) -> DataFrame:
        texts = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        return stored(map_batches(texts.select("a", "b", "x", "y"), _verifier(percent), "a long, b long"), "verified")

    fits = f"id <> c.id and 100 * least(n, c.n) >= {percent} * greatest(n, c.n)"
    paired = lambda df: df.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct()
    centre = buckets.groupBy("bucket").agg(F.min(F.struct("o", "id", "n")).alias("c"))
    tested = stored(paired(buckets.join(centre, "bucket").where(fits)), "pairs")
    links = verified(tested)
    root = stored(components(links), "roots")

    # all but the largest component of a bucket meet its pivots
    state, heads = _apart(buckets, root, pivots)
    met = state.join(heads.select("bucket", "main", F.explode("drawn").alias("c")), "bucket").where("part <> main and part <> c.part").where(fits)
    pairs = stored(paired(met).join(tested, ["a", "b"], "left_anti"), "pairs")
    new = verified(pairs)
    if not new.isEmpty():
        tested, links = tested.union(pairs), links.union(new)
        root = stored(components(links), "roots")
        state, heads = _apart(buckets, root, pivots)
    rest = stored(state.join(heads.select("bucket"), "bucket").select("id", "part").distinct(), "rest")
    if rest.isEmpty():
        return root
    new = verified(stored(_rest(rest, sets, percent).join(tested, ["a", "b"], "left_anti"), "pairs"))
    return root if new.isEmpty() else stored(components(links.union(new)), "roots")

"""Arrays in files: Parquet in chunk layout, sorted by chunk, beside a line of JSON."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..array import NDArray
from ..meta import ArrayError, ArrayMeta, Config
from ..operators.chunks import from_chunks, to_chunks
from ..plans.advice import partitions


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def stored_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def scratch(spark: SparkSession) -> str:
    """A new path in the cluster's checkpoint folder; in a local temporary one only where Spark runs in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ArrayError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="arrayspark-")
    return f"{found.rstrip('/')}/array-{uuid.uuid4().hex}"


def trunc_prec(a: NDArray, bits: int) -> NDArray:
    """``a`` with only ``bits`` bits of each mantissa, as a filter before compression: the rest is cut, toward zero."""
    if not a.dtype.floating:
        raise TypeError("only floats have a mantissa")
    whole = 52 if a.dtype.bits == 64 else 23
    if not 0 < bits <= whole:
        raise ArrayError(f"between 1 and {whole} bits can stay")
    x = a.value.cast("double")
    size = F.floor(F.log2(F.when((x == 0) | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(1.0)).otherwise(F.abs(x))))
    # log2 may round up to the next whole number just below a power of two
    size = F.when(F.pow(F.lit(2.0), size) > F.abs(x), size - 1).otherwise(size)
    scale = F.pow(F.lit(2.0), F.lit(float(bits)) - size)
    cut = F.signum(x) * F.floor(F.abs(x) * scale).cast("double") / scale
    return a.with_value(F.when((x == 0) | F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(cut).cast(a.dtype.spark))


def save(a: NDArray, path: str, config: Config = Config(), contiguous: bool = False, overwrite: bool = False) -> NDArray:
    """``a`` written to ``path`` as ``config`` says: sorted by chunk, so a box reads the row groups that it meets.

    ``contiguous`` writes one file, for small arrays; else the number of files follows the array's bytes.
    """
    if a.is_view:
        raise ArrayError("a view can't be saved: copy it first", "READ_ONLY_VIEW")
    spark = a.spark
    if exists(spark, path) and not overwrite:
        raise ArrayError(f"{path} is taken", "INVALID_STORAGE")
    if config.mantissa_bits:
        a = trunc_prec(a, config.mantissa_bits)
    meta = a.meta.but(chunkshape=a.meta.chunks, urlpath=path, config=config)
    keys = [f"c{k}" for k in range(a.ndim)]
    chunks = to_chunks(a, meta.chunks)
    n = 1 if contiguous or not keys else min(partitions(meta.nbytes), config.max_tasks or 1 << 30)
    chunks = chunks.coalesce(1) if n == 1 else chunks.repartitionByRange(n, *keys)
    # written beside and then renamed, metadata last: the array may be read from the very path it replaces
    new, old = f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}"
    (chunks.sortWithinPartitions(*keys) if keys else chunks).write.options(**config.options()).parquet(f"{new}/chunks")
    write_meta(spark, meta, new)
    taken = exists(spark, path)
    if taken:
        _rename(spark, path, old)
    _rename(spark, new, path)
    if taken:
        remove(spark, old)
    spark.catalog.refreshByPath(path)
    return open_array(spark, path)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, source)
    if not fs.rename(p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)):
        raise ArrayError(f"{source} can't be moved to {target}")


def write_meta(spark: SparkSession, meta: ArrayMeta, path: str) -> None:
    fs, p = _fs(spark, f"{path}/meta.json")
    out = fs.create(p, True)
    try:
        out.write(bytearray(meta.to_json().encode()))
    finally:
        out.close()


def read_meta(spark: SparkSession, path: str) -> ArrayMeta:
    if not exists(spark, f"{path}/meta.json"):
        raise ArrayError(f"there is no array at {path}", "FILE_NOT_EXIST")
    return ArrayMeta.from_json(spark.read.text(f"{path}/meta.json", wholetext=True).first()[0], path)


def get_cfg(a: NDArray) -> Config:
    """How a stored array was written; the defaults for one that isn't stored."""
    return a.meta.config or Config()


def stored_chunks(spark: SparkSession, path: str, meta: ArrayMeta) -> DataFrame:
    """The chunks at ``path`` that lie within ``meta``'s shape: a stream may have written more than its metadata tell yet."""
    keys = ", ".join([f"c{k} long" for k in range(meta.ndim)] + ["shape array<int>", f"values array<{meta.dtype.spark}>"])
    df = spark.read.schema(keys).parquet(f"{path}/chunks")
    return df.where(F.col("c0") < meta.grid[0]) if meta.ndim else df


def open_array(spark: SparkSession, path: str) -> NDArray:
    """The array at ``path``, lazily."""
    meta = read_meta(spark, path)
    return from_chunks(stored_chunks(spark, path, meta), meta)


def open_box(spark: SparkSession, path: str, start: list[int], stop: list[int]) -> NDArray:
    """A box of the array at ``path``: chunks that it doesn't meet are skipped by their statistics."""
    from ..operators.index import _box, get_slice

    a = open_array(spark, path)
    lo, hi = _box(a, start, stop)
    df = stored_chunks(spark, path, a.meta)
    for k, (x, y, s) in enumerate(zip(lo, hi, a.meta.chunks, strict=True)):
        df = df.where((F.col(f"c{k}") >= x // s) & (F.col(f"c{k}") <= max(x, y - 1) // s))
    return get_slice(from_chunks(df, a.meta), lo, hi)


def load(spark: SparkSession, path: str) -> NDArray:
    """The array at ``path``, kept in the executors' memory and disks from its first use on."""
    a = open_array(spark, path)
    return NDArray.cells(a.df.persist(), replace(a.meta, urlpath=None))


def free(a: NDArray) -> None:
    a.origin.unpersist()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    if not fs.delete(p, True):
        raise ArrayError(f"there is nothing at {path}", "FILE_NOT_EXIST")


# ---------------------------------------------------------------- named blobs


def vlmeta_exists(a: NDArray, name: str) -> bool:
    return name in a.meta.attrs


def _changed(a: NDArray, attrs: dict[str, bytes]) -> NDArray:
    if a.is_view:
        raise ArrayError("a view's blobs are its root's, and can't be written", "READ_ONLY_VIEW")
    meta = replace(a.meta, attrs=attrs)
    if meta.urlpath:
        write_meta(a.spark, meta, meta.urlpath)
    return NDArray(a.origin, a.coords, a.value, meta)


def vlmeta_add(a: NDArray, name: str, blob: bytes) -> NDArray:
    if name in a.meta.attrs:
        raise ArrayError(f"there is a blob {name} already")
    return _changed(a, {**a.meta.attrs, name: bytes(blob)})


def vlmeta_update(a: NDArray, name: str, blob: bytes) -> NDArray:
    vlmeta_get(a, name)
    return _changed(a, {**a.meta.attrs, name: bytes(blob)})


def vlmeta_get(a: NDArray, name: str) -> bytes:
    if name not in a.meta.attrs:
        raise ArrayError(f"no blob {name}")
    return a.meta.attrs[name]


def vlmeta_delete(a: NDArray, name: str) -> NDArray:
    vlmeta_get(a, name)
    return _changed(a, {k: v for k, v in a.meta.attrs.items() if k != name})


def vlmeta_names(a: NDArray) -> list[str]:
    return list(a.meta.attrs)


def vlmeta_nitems(a: NDArray) -> int:
    return len(a.meta.attrs)

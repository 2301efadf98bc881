"""Appending a stream of cells to a stored array along its first axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..array import NDArray
from ..meta import ArrayError, ArrayMeta
from ..operators.chunks import to_chunks
from ..sources.storage import read_meta, write_meta


def append_stream(cells: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream of (i0, ..., v) to the array at ``path``, a batch of whole chunks at a time.

    Each batch's chunks lie in a folder named by the batch, so a batch that runs again replaces what it
    wrote; the length of the first axis grows to what has come in. A batch must hold whole chunks along
    the first axis: rows of one chunk in two batches would be two chunks, so a batch that meets a chunk of
    another one fails before it writes. Readers see no chunk before the metadata tell of it.
    """
    spark = cells.sparkSession
    start = read_meta(spark, path)

    def write(batch: DataFrame, number: int) -> None:
        top = batch.agg(F.max("i0")).first()[0]
        if top is None:
            return
        meta = read_meta(spark, path)
        _refuse_split(spark, path, meta, batch, number)
        grown = meta.but(shape=(max(meta.shape[0], top + 1), *meta.shape[1:]), chunkshape=meta.chunkshape, blockshape=meta.blockshape)
        to_chunks(NDArray.cells(batch, grown), start.chunkshape).write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
        write_meta(spark, grown, path)

    if not start.chunkshape:
        raise ArrayError("a stored array has a chunk shape")
    writer = cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def _refuse_split(spark: SparkSession, path: str, meta: ArrayMeta, batch: DataFrame, number: int) -> None:
    """Fails where a chunk of ``batch`` is stored by another batch already; only chunk numbers are read."""
    size = meta.chunkshape
    keys = [f"c{k}" for k in range(meta.ndim)]
    new = batch.select(*[F.expr(f"i{k} div {s}L").alias(f"c{k}") for k, s in enumerate(size)]).distinct()
    low, high = new.agg(F.min("c0"), F.max("c0")).first()
    schema = ", ".join([f"{c} long" for c in keys] + ["batch long"])
    old = spark.read.schema(schema).parquet(f"{path}/chunks").where(F.col("c0").between(low, high) & (F.coalesce("batch", F.lit(-1)) != number))
    hit = old.join(new, keys, "left_semi").first()
    if hit is not None:
        raise ArrayError(f"chunk {tuple(hit[c] for c in keys)} is stored already: a batch must hold whole chunks", "INVALID_STORAGE")


def windowed(events: DataFrame, time: str, value: str, window: str, slide: str, late: str) -> DataFrame:
    """(start, n, mean, low, high) of ``value`` in sliding windows; windows close once ``late`` has passed."""
    w = events.withWatermark(time, late).groupBy(F.window(time, window, slide).alias("w"))
    return w.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")).select(F.col("w.start").alias("start"), "n", "mean", "low", "high")



"""Tables in the folder that the cluster shares, and other things that several operators need."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.workers import reachable
from .textblocks import seeds


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where that is unset, as in tests on one machine."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir():
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="arrayspark-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends there, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/arrayspark-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Arrow batches carry whole texts, so their bytes are bounded, not their rows: a task holds a few of these at once.
BATCH_BYTES = "1m"


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` over batches of about 1 MB (one text may be longer); the bound is a setting of the session."""
    reachable(df.sparkSession).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(function, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes that ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, folds: int, fold: int) -> F.Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, folds: int, fold: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents outside ``fold``.

    The sample is the labels with the least hash of their id, so it doesn't depend on partitions. Its
    bound makes it safe to broadcast. Of an id with several texts, that of the least hash comes in, and of
    one with several labels the greatest.
    """
    chosen = (
        labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(rows)
    )
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    return one.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("x.text").alias("text"), "label")


class IdFilter:
    """A Bloom filter over ids: it lets rows pass that needn't, and never holds one back.

    It takes 16 bits an id and 4 MB at most, so it can go to every task at any scale; a fuller one lets more
    rows pass. Rows that pass are joined exactly afterwards.
    """

    def __init__(self, ids: DataFrame, column: str, most: int = 1 << 25):
        import numpy as np

        self.bits = min(most, 1 << max(16, (16 * ids.count()).bit_length()))
        self.words = np.zeros(self.bits >> 6, np.uint64)
        spots = ids.select(F.explode(F.array(*self.spots(column))).alias("at"))
        # one row for each word of the filter at most, whatever the number of ids
        got = spots.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("mask")).toArrow()
        self.words[got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)

    def keep(self, spots) -> object:
        """``spots``: the same two positions for each row, as (rows, 2)."""
        import numpy as np

        at = np.asarray(spots, np.int64)
        hit = (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        return hit.all(axis=1)

    def spots(self, column: str) -> list:
        return [F.pmod(F.xxhash64(F.col(column), F.lit(k)), F.lit(self.bits)).alias(f"_spot{k}") for k in (1, 2)]


__all__ = ["IdFilter", "free_name", "held_out", "labelled_sample", "map_batches", "seeds", "shared_dir", "stored", "table"]

"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, media, mixing, near_dedup, pii, quality, toxicity, warc
from .shared import held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    said = lambda only: F.array_join(F.transform(F.filter("spans", lambda s: s.fixed) if only else F.col("spans"), lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.fixed & (s.kind == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(said(True), 256).alias("base_sha256"), said(False).alias("spans"))


def op5_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are written as response records, read back from their bytes, and converted."""
    key = ("page_id",)
    written = warc.serialise(warc.as_records(warc.responses(table(spark, sf_dir, "pages"), carry=key), key), key)
    return warc.derive(warc.parse(written, key), key)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))
    scored = quality.quality(docs, field)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")))
    scored = toxicity.toxicity(docs.select("doc_id", "text"), model, ["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES: dict[str, Query] = {
    "op1_chat_rotation": op1_chat_rotation,
    "op2_decontamination": op2_decontamination,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_personal_data": op4_personal_data,
    "op5_media_sniffing": op5_media_sniffing,
    "op6_language": op6_language,
    "op7_mixture": op7_mixture,
    "op8_warc_derivatives": op8_warc_derivatives,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
}

SQL: dict[str, str] = {"op1_chat_rotation": chat.SQL, "op8_warc_derivatives": warc.SQL}

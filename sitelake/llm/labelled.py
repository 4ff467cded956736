"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.session import cut_lineage


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; -1 for null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % divisor, F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled rows, those whose ids hash lowest, as a written table.

    ``train`` says which ids may be learnt from. Null ids and labels other than 0 and 1 are left out; of several labels of one id
    the largest counts; of a repeated document each row does. The ids of the sample, at most ``limit``, are broadcast; no text is shuffled.
    """
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("_id").agg(F.max("label").alias("label"))
        .withColumnRenamed("_id", "doc_id").filter(train)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return cut_lineage(texts.join(F.broadcast(known), "doc_id"), "labelled")


def bounded_sample(docs: DataFrame, limit: int, *more: str) -> DataFrame:
    """(doc_id, text and the columns ``more``) of the documents with the ``limit`` ids that hash lowest; null ids and texts are left out. Only ids are sorted."""
    some = docs.select("doc_id").filter("doc_id is not null and text is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text", *more).filter("text is not null").join(F.broadcast(some), "doc_id")

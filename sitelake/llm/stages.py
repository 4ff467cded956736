"""Operators as stages of a pipeline over ``documents``: rows in, rows out, with the same columns.

Every stage keeps all columns, whatever their names, and all rows that its operator has nothing against. A null doc_id counts as one id of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.decontamination import decontaminate
from sitelake.llm.labelled import labelled_sample
from sitelake.llm.packing import pack as packed
from sitelake.llm.secrets import labelled_strings, redact_secrets, train_markov
from sitelake.llm.simhash import simhash_groups
from sitelake.llm.toxicity import SAMPLE, drop_toxic_rows, train_toxicity
from sitelake.session import cut_lineage


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is not among ``ids``; null is an id like others."""
    named = ids.select(F.col("doc_id").alias("_id"))
    return docs.join(named, docs["doc_id"].eqNullSafe(named["_id"]), "left_anti")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that the classifier does not reject; it learns from a bounded sample of all labels."""
    model = train_toxicity(labelled_sample(docs, labels, "toxic", F.lit(True), SAMPLE))
    return drop_toxic_rows(docs, model)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of linked fingerprints: that of the group's least id. Of repeated rows of this id one stays."""
    groups = cut_lineage(simhash_groups(docs), "near-duplicates")
    extra = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    kept = without(docs, extra)
    # An id that repeats is rare; only its rows are shuffled.
    again = cut_lineage(groups.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return kept
    named = again.select(F.col("doc_id").alias("_id"))
    repeated = kept.join(named, kept["doc_id"].eqNullSafe(named["_id"]), "left_semi")
    return without(kept, again).unionByName(repeated.dropDuplicates(["doc_id"]))


def drop_benchmark_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of documents that hold no benchmark item."""
    return decontaminate(docs, benchmark)


def mask_secrets(docs: DataFrame) -> DataFrame:
    """All rows, secrets in their texts masked; ``n_chars``, if it is there, is counted anew."""
    masked = redact_secrets(docs, train_markov(labelled_strings(docs)))
    if "n_chars" not in docs.columns:
        return masked
    count = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", count)


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """All pieces of all rows with their ids and places."""
    return packed(docs, tokenizer).drop("pid")

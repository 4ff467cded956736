"""Registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.llm.decontamination import contaminated
from sitelake.llm.kneser_ney import kneser_ney_scores
from sitelake.llm.labelled import remainder
from sitelake.llm.language import languages
from sitelake.llm.minhash import minhash_groups
from sitelake.llm.packing import pack_digest
from sitelake.llm.rules import quality
from sitelake.llm.secrets import KINDS, find_secrets, labelled_strings, train_markov
from sitelake.llm.simhash import simhash_groups
from sitelake.llm.spelling import document_spelling
from sitelake.llm.topk import top_k
from sitelake.llm.toxicity import toxicity
from sitelake.llm.url_filter import judge_urls, seed_labels, train_urls
from sitelake.llm.whitening import whiten


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_digest(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = find_secrets(docs, train_markov(labelled_strings(docs)))
    fixed = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(fixed), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op4_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    held = remainder(F.col("doc_id"), 7) == 2
    scores = kneser_ney_scores(table(spark, folder, "documents"), ~held)
    return scores.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    return languages(table(spark, folder, "documents"), table(spark, folder, "pages"))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return judge_urls(pages, train_urls(seed_labels(pages)), block=["net/", "example.com/de/"], allow=["example.net/en/", "org/fr/"])


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = remainder(F.col("doc_id"), 5) == 0
    return quality(docs, labels, ~held).select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = remainder(F.col("doc_id"), 4) == 2
    return toxicity(docs, labels, ~held).select("doc_id", held.alias("held_out"), "score", "predicted")


def op9_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_groups(table(spark, folder, "documents"))


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return document_spelling(table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"), k=4)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_packing, op3_secrets, op4_kneser_ney, op5_language, op6_url_filter, op7_quality_rules, op8_toxicity, op9_exact_topk, op10_simhash_dedup, op11_minhash_dedup, op12_spelling, op13_whitening)}
#: The search is the one whose whole result SQL states: every query against all rows.
ORACLES = {
    "op9_exact_topk": """
        with vectors as (
          select row_number() over () as row_id, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as terms
          from embeddings
          where vec_id is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
        scored as (
          select q.vec_id as query_id, d.vec_id,
                 cast(list_sum(list_transform(list_zip(q.terms, d.terms), lambda p: p[1] * p[2])) as bigint) as score
          from vectors q join vectors d on q.vec_id % 50 = 0 and q.vec_id <> d.vec_id),
        ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored)
        select query_id, rank, vec_id, score from ranked where rank <= 5""",
}

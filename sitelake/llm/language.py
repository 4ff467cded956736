"""Language of documents and pages: likelihood of the text, declared markup language, address suffix and host prior, fused by Bayes' rule."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.llm.bytes_of_text import LOWER, chunks, flat, ngram_buckets
from sitelake.llm.labelled import bounded_sample
from sitelake.llm.url_filter import url_host
from sitelake.session import cut_lineage

#: Production parameters: labelled documents to learn from, bytes of an n-gram, buckets (as a power of two), most n-grams that a text's evidence counts as, weight of the
#: level above in host priors, and of the overall shares in the other evidence.
SAMPLE = 4_000
ORDERS = (2, 3)
BITS = 16
EVIDENCE = 100.0
KAPPA = 20.0
SMALL = 100_000


@dataclass(frozen=True)
class LanguageModel:
    """Languages and, for each order, the log probability of each bucket under each of them (bucket by language)."""

    languages: tuple[str, ...]
    orders: tuple[int, ...]
    bits: int
    log_p: tuple[np.ndarray, ...]


def _buckets(data: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram that lies inside one text, and for each text where its n-grams begin (one entry more)."""
    bucket = ngram_buckets(data, n, bits)
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, offsets[:-1][counts > 0], 1)
    np.add.at(inside, (offsets[:-1] + counts)[counts > 0], -1)
    keep = np.cumsum(inside)[: len(bucket)] > 0
    return bucket[keep], np.concatenate([[0], np.cumsum(counts)])


def _letters(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; digits, signs and white space are all spaces."""
    low = LOWER.copy()
    low[:128] = np.where((low[:128] >= 97) & (low[:128] <= 122), low[:128], 32)
    return low[data]


def train_language(sample: DataFrame, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> LanguageModel:
    """Learn from a bounded sample (text, lang); n-grams are counted in Spark, one is added to each bucket. Null languages are left out; no rows give a model of no languages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), object)
            for name in set(names.tolist()):
                data, offsets = flat(batch.column("text").filter(pa.array(names == name)))
                held = sums.setdefault(name, np.zeros((len(orders), 1 << bits), np.int64))
                for a, b in chunks(offsets):
                    part = _letters(data[offsets[a] : offsets[b]])
                    for k, n in enumerate(orders):
                        held[k] += np.bincount(_buckets(part, offsets[a : b + 1] - offsets[a], n, bits)[0], minlength=1 << bits)
        for name, held in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name], "counts": [held.tobytes()]})

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in rows.column("counts"))
        return pa.table({"lang": rows.column("lang")[:1], "counts": [total.tobytes()]})

    shape = "lang string, counts binary"
    counted = sample.select("text", F.col("lang").cast("string").alias("lang")).filter("lang is not null").mapInArrow(count, shape)
    rows = sorted(counted.groupBy("lang").applyInArrow(add, shape).collect())  # one for each language of the sample
    each = [np.frombuffer(r["counts"], np.int64).reshape(len(orders), -1) + 1.0 for r in rows]
    log_p = tuple(np.stack([np.log(c[k] / c[k].sum()) for c in each], axis=1).astype(np.float32) if each else np.zeros((1 << bits, 0), np.float32) for k in range(len(orders)))
    return LanguageModel(tuple(r["lang"] for r in rows), orders, bits, log_p)


def text_evidence(rows: DataFrame, model: LanguageModel, evidence: float = EVIDENCE) -> DataFrame:
    """``rows`` (text, any others) with ``likelihood`` in place of ``text``: for each language the log likelihood of the whole text.

    N-grams are not independent, so a text of more than ``evidence`` n-grams weighs as much as ``evidence`` average ones of its own. Null and empty texts have no evidence: zeros.
    """
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(model.languages)
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            total, number = np.zeros((batch.num_rows, width)), np.zeros(batch.num_rows)
            for a, b in chunks(offsets, 1 << 19):
                part = _letters(data[offsets[a] : offsets[b]])
                for n, log_p in zip(model.orders, model.log_p):
                    bucket, begins = _buckets(part, offsets[a : b + 1] - offsets[a], n, model.bits)
                    some = np.flatnonzero(begins[1:] > begins[:-1])
                    if len(some) and width:
                        total[a + some] += np.add.reduceat(log_p[bucket], begins[some], axis=0, dtype=float)
                    number[a:b] += np.diff(begins)
            total *= np.minimum(1, evidence / np.maximum(number, 1))[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), lists], [*others, "likelihood"])

    shape = rows.select(*others, F.array(F.lit(0.0)).alias("likelihood")).schema
    return rows.select(*others, "text").mapInArrow(run, shape)


def _posterior(log_p: Column) -> Column:
    """Probabilities from log weights."""
    scaled = F.transform(log_p, lambda v: F.exp(v - F.array_max(log_p)))
    return scaled


def _normalized(weights: Column) -> Column:
    return F.transform(weights, lambda v: v / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x))


def visible_text(html: Column) -> Column:
    """What stands between tags, without scripts and styles; each pattern passes over the page once."""
    silent = F.regexp_replace(html, r"(?i)<(?:script|style)\b[^>]*+>(?:[^<]++|<(?!/(?:script|style)))*+", " ")
    return F.regexp_replace(silent, r"<[^>]*+>", " ")


def declared_language(html: Column) -> Column:
    """The primary code, two or three letters, of the ``lang`` of the page's ``html`` tag; null if there is none."""
    code = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})(?![a-z])", 1))
    return F.when(code != "", code)


def _decided(rows: DataFrame, languages: tuple[str, ...], *keys: str) -> DataFrame:
    """The likeliest language (ties: the first by name) and its probability, from the column ``posterior``; null where there is no language."""
    names = F.array(*[F.lit(x) for x in languages]) if languages else F.array().cast("array<string>")
    best = F.array_max("posterior")
    return rows.select(*keys, F.get(names, (F.array_position("posterior", best) - 1).cast("int")).alias("lang"), best.alias("confidence"))


def document_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang, confidence) of every row of ``docs`` (doc_id, text, any others), by the text and equal priors: a document has no markup and no address."""
    scored = text_evidence(docs.select("doc_id", "text"), model)
    weights = scored.withColumn("weights", _posterior(F.col("likelihood")))
    return _decided(weights.withColumn("posterior", _normalized(F.col("weights"))), model.languages, "doc_id")


def page_languages(pages: DataFrame, model: LanguageModel, kappa: float = KAPPA) -> DataFrame:
    """(page_id, lang, confidence) of every row of ``pages`` (page_id, url, html, any others), all evidence fused.

    Posterior ~ likelihood of the visible text * P(declared code | language) * P(address suffix | language) * prior of the host. The last three come from grouped sums over all
    pages of what the texts alone say. The prior of a host is smoothed towards that of its domain (last two labels), that towards all pages; a page's own text is taken out of
    both. Missing evidence (null url or html, no declaration, no suffix) counts nothing. Repeated rows and null ids are judged like all others.
    Sums are combined before they are shuffled; one join brings them to the pages, on the host, and a hot host's pages are split by adaptive execution.
    """
    n = len(model.languages)
    parts = pages.select(
        "page_id", url_host(F.col("url")).alias("host"), declared_language(F.coalesce("html", F.lit(""))).alias("declared"), visible_text(F.coalesce("html", F.lit(""))).alias("text")
    )
    scored = text_evidence(parts, model).withColumn("weights", _posterior(F.col("likelihood"))).withColumn("share", _normalized(F.col("weights"))).drop("weights")
    scored = cut_lineage(scored, "page-texts")

    def summed(rows: DataFrame, value: str, *keys: str) -> DataFrame:
        sums = rows.groupBy(*keys).agg(*[F.sum(F.col(value)[i]).alias(f"_{i}") for i in range(n)]) if n else rows.select(*keys).distinct()
        return sums.select(*keys, F.array(*[F.col(f"_{i}") for i in range(n)]).cast("array<double>").alias("total"))

    known = scored.withColumn("domain", F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0)).withColumn("suffix", F.regexp_extract("host", r"\.([^.]+)$", 1))
    hosts = cut_lineage(summed(known, "share", "host", "domain", "suffix"), "hosts")
    domains = summed(hosts, "total", "domain", "suffix").withColumnRenamed("total", "by_domain")
    suffixes = summed(domains, "by_domain", "suffix").withColumnRenamed("total", "by_suffix")
    everything = summed(suffixes, "by_suffix").first()  # one number for each language
    total = F.array(*[F.lit(float(x)) for x in (everything["total"] or [0.0] * n)] if everything else []).cast("array<double>")
    suffixes = cut_lineage(suffixes, "suffixes")
    if suffixes.count() <= SMALL:
        suffixes = F.broadcast(suffixes)
    table = hosts.withColumnRenamed("total", "by_host").join(domains, ["domain", "suffix"]).join(suffixes, "suffix")
    # There are at most 26 * 26 * 27 codes of two or three letters.
    declared = F.broadcast(summed(scored.filter("declared is not null"), "share", "declared").withColumnRenamed("total", "by_declared"))
    rows = scored.join(table, "host").join(declared, "declared", "left")

    size = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    overall = F.transform(total, lambda v: (v + 1) / (size(total) + n))
    minus = lambda a: F.zip_with(a, "share", lambda x, y: F.greatest(x - y, F.lit(0.0)))  # noqa: E731  a page is no evidence for itself
    rows = rows.select("page_id", "likelihood", "suffix", "declared", "by_suffix", "by_declared", minus(F.col("by_domain")).alias("by_domain"), minus(F.col("by_host")).alias("by_host"))
    smooth = lambda a, above: F.zip_with(a, above, lambda x, y: (x + kappa * y) / (size(a) + kappa))
    rows = rows.withColumn("domain_prior", smooth(F.col("by_domain"), overall)).withColumn("prior", smooth(F.col("by_host"), F.col("domain_prior")))
    # P(value | language), smoothed towards the share that the value has of all pages.
    given = lambda a: F.zip_with(a, total, lambda x, y: F.log((x + kappa * size(a) / size(total) + 1e-9) / (y + kappa + 1e-9)))
    nothing = F.transform("likelihood", lambda v: F.lit(0.0))
    evidence = [
        F.transform("prior", lambda p: F.log(p)),
        F.when(F.col("declared").isNotNull(), given(F.col("by_declared"))).otherwise(nothing),
        F.when(F.col("suffix") != "", given(F.col("by_suffix"))).otherwise(nothing),
    ]
    fused = F.col("likelihood")
    for more in evidence:
        fused = F.zip_with(fused, more, lambda x, y: x + y)
    rows = rows.withColumn("fused", fused).withColumn("weights", _posterior(F.col("fused"))).withColumn("posterior", _normalized(F.col("weights")))
    return _decided(rows, model.languages, "page_id")


def languages(docs: DataFrame, pages: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, page_id, lang, confidence) of every document (page_id null) and every page (doc_id null); learns from at most ``limit`` documents with ``lang``."""
    sample = bounded_sample(docs.filter("lang is not null"), limit, "lang")
    model = train_language(cut_lineage(sample, "languages"))
    key = pages.schema["page_id"].dataType.simpleString()
    by_text = document_languages(docs, model).select("doc_id", F.lit(None).cast(key).alias("page_id"), "lang", "confidence")
    return by_text.unionByName(page_languages(pages, model).select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "page_id", "lang", "confidence"))

"""URL filters: fixed rules, and logistic regression on hashed character n-grams of host and path for the rest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.llm.bytes_of_text import LOWER, chunks, flat, ngram_buckets
from sitelake.llm.logistic import Sparse, fit

#: Production parameters.
ORDERS = (3, 4, 5)
BITS = 18
SAMPLE = 4_000
THRESHOLD = 0.5


@dataclass(frozen=True)
class UrlModel:
    """Buckets that count, ascending, with their weights, and the intercept."""

    orders: tuple[int, ...]
    bits: int
    buckets: np.ndarray
    weights: np.ndarray
    intercept: float


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest of the rules (host, then path from its ``/`` on) that fits: the rule's host or a subdomain, and the start of the path; else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _features(column: pa.Array, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows: (first row, last row, row, bucket) of each different bucket of each row's ``host`` + path between two marks."""
    data, offsets = flat(column)
    for a, b in chunks(offsets, 1 << 20):
        part, at = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        keys = []
        for n in orders:
            bucket = ngram_buckets(part, n, bits)
            row = np.searchsorted(at, np.arange(len(bucket)), "right") - 1
            inside = np.arange(len(bucket)) + n <= at[row + 1]
            keys.append((row[inside] << bits) | bucket[inside])
        found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        yield a, b, found >> bits, found & ((1 << bits) - 1)


def _address(host: Column, path: Column) -> Column:
    return F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))


def train_urls(labelled: DataFrame, orders: tuple[int, ...] = ORDERS, bits: int = BITS, l2: float = 1e-4) -> UrlModel:
    """Learn from a small labelled table (url, label 1 to block or 0 to allow), which the driver holds: the caller bounds its rows.

    The score of a URL is the logistic of the intercept and the weights of the different n-grams of ``^host|path$``. No rows give the score one half; labels of one kind a
    score that says so. Rows of other labels are left out; null counts as a URL without host and path.
    """
    rows = labelled.filter(F.col("label").isin(0, 1)).select(_address(url_host(F.col("url")), url_path(F.col("url"))).alias("address"), F.col("label").cast("int").alias("label"))
    table = rows.toArrow()
    parts = list(_features(table.column("address"), orders, bits)) if table.num_rows else []
    row = np.concatenate([np.zeros(0, np.int64), *(a + r for a, _, r, _ in parts)])
    bucket = np.concatenate([np.zeros(0, np.int64), *(k for *_, k in parts)])
    buckets, columns = np.unique(bucket, return_inverse=True)
    starts = np.searchsorted(row, np.arange(table.num_rows + 1))
    weights, intercept = fit(Sparse(starts, columns, np.ones(len(columns)), len(buckets)), table.column("label").to_numpy().astype(float), l2=l2)
    return UrlModel(orders, bits, buckets, weights, intercept)


def score_addresses(rows: DataFrame, model: UrlModel) -> DataFrame:
    """``rows`` with host and path, all columns, and the column ``score``: the chance that the URL is one to block."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << model.bits)
        dense[model.buckets] = model.weights
        for batch in batches:
            sums = np.full(batch.num_rows, model.intercept)
            for a, b, row, bucket in _features(batch.column(len(names)), model.orders, model.bits):
                sums[a:b] += np.bincount(row, dense[bucket], b - a)
            score = pa.array(1 / (1 + np.exp(-np.clip(sums, -500, 500))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], score], [*names, "score"])

    shape = rows.select("*", F.lit(0.0).alias("score")).schema
    return rows.select("*", _address(F.col("host"), F.col("path")).alias("_address")).mapInArrow(run, shape)


def judge_urls(pages: DataFrame, model: UrlModel, block: list[str], allow: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of ``pages`` (page_id, url, any others).

    The verdict is that of the longest rule that fits (of ``block`` or ``allow``); where none fits, ``block`` if the model's score reaches ``threshold``, else ``allow``. Null
    URLs and those without ``://`` have empty host and path, which no rule fits. Repeated rows and null ids are judged like all others.
    """
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    ruled = score_addresses(parts, model).withColumn("rule", matching_rule(F.col("host"), F.col("path"), block + allow))
    verdict = F.when(F.col("rule").isin(*block), "block").when(F.col("rule").isNotNull(), "allow").when(F.col("score") >= threshold, "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


# Words in host names by which the sample's rows are labelled.
SEEDS = "(^|[.-])(ads?|track(er|ing)?|spam|casino|adult|porn|pills|viagra|bets?|poker|warez|xxx)([.-]|$)"


def seed_labels(pages: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(url, label): at most ``limit`` different URLs, those that hash lowest, half of either label where there are enough; 1 where a part of the host is a seed word."""
    urls = pages.select("url").filter(F.col("url").contains("://")).distinct().withColumn("label", url_host(F.col("url")).rlike(SEEDS).cast("int"))
    lowest = [urls.filter(F.col("label") == k).orderBy(F.xxhash64("url"), "url").limit(limit // 2) for k in (0, 1)]
    return lowest[0].unionAll(lowest[1])

"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.bytes_of_text import LOWER, chunks, flat, ngram_buckets
from sitelake.llm.labelled import labelled_sample
from sitelake.llm.logistic import Sparse, fit

#: Production parameters.
ORDERS = (3, 4, 5, 6)
BITS = 20
SAMPLE = 8_000
FEATURES = 1 << 11
THRESHOLD = 0.3


@dataclass(frozen=True)
class ToxicityModel:
    """Buckets that count, ascending, with weight times log-count ratio, and the intercept."""

    orders: tuple[int, ...]
    bits: int
    buckets: np.ndarray
    weights: np.ndarray
    intercept: float


def _present(data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], bits: int, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each different bucket of each text, sorted; ``wanted`` flags buckets to keep."""
    found = []
    data = LOWER[data]
    for n in orders:
        bucket = ngram_buckets(data, n, bits)
        at = np.flatnonzero(wanted[bucket]) if wanted is not None else np.arange(len(bucket))
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + n <= offsets[text + 1]  # the n-gram does not run into the next text
        found.append((text[inside] << bits) | bucket[at[inside]])
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys >> bits, keys & ((1 << bits) - 1)


def _counts(orders: tuple[int, ...], bits: int):
    """Per task: for each bucket the number of texts of either label that have it, as blocks of 2 to the 14 buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            for a, b in chunks(offsets, 1 << 18):
                text, bucket = _present(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], orders, bits, None)
                for label in (0, 1):
                    seen[label] += np.bincount(bucket[labels[a + text] == label], minlength=1 << bits)
        width = min(1 << 14, 1 << bits)
        for block in range((1 << bits) // width):
            part = seen[:, block * width : (block + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": [block], "clean": [part[0].tobytes()], "toxic": [part[1].tobytes()]})

    return run


def _added(parts: pa.Table) -> pa.Table:
    """The counts of one block, over all tasks; there are at most as many rows as tasks."""
    sums = {name: sum(np.frombuffer(x.as_py(), np.int64) for x in parts.column(name)).tobytes() for name in ("clean", "toxic")}
    return pa.table({"block": parts.column("block")[:1], **{name: [value] for name, value in sums.items()}})


def _rows(orders: tuple[int, ...], bits: int, chosen: np.ndarray):
    """Per text: its label and the places in ``chosen`` of the buckets it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << bits, bool)
        wanted[chosen] = True
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                text, bucket = _present(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], orders, bits, wanted)
                places = np.searchsorted(chosen, bucket).astype(np.int32)
                cuts = np.searchsorted(text, np.arange(b - a + 1))
                yield pa.RecordBatch.from_pydict({
                    "label": batch.column("label")[a:b].cast(pa.int32()),
                    "places": pa.array([places[cuts[i] : cuts[i + 1]].tobytes() for i in range(b - a)], pa.binary()),
                })

    return run


def train_toxicity(sample: DataFrame, orders: tuple[int, ...] = ORDERS, bits: int = BITS, features: int = FEATURES, l2: float = 1e-4) -> ToxicityModel:
    """Learn from a bounded sample (text, label 0 or 1).

    Buckets are counted over the whole sample in Spark. The log-count ratio of a bucket is log((a + 1) / (A + 1)) - log((b + 1) / (B + 1)),
    a and b of A toxic and B clean texts having it. The ``features`` buckets whose ratio stands out most from chance (by ratio times the root of
    the expected count) are the columns of a logistic regression on ratio-scaled presence. No rows, or one label only, give a
    model without features whose score is the (smoothed) share of the label.
    """
    width = min(1 << 14, 1 << bits)
    shape = "block long, clean binary, toxic binary"
    counted = sample.select("text", "label").mapInArrow(_counts(orders, bits), shape).groupBy("block").applyInArrow(_added, shape)
    count = np.zeros((2, 1 << bits))
    for row in counted.collect():  # the model's buckets, however many rows were learnt from
        at = slice(row["block"] * width, (row["block"] + 1) * width)
        count[0, at], count[1, at] = np.frombuffer(row["clean"], np.int64), np.frombuffer(row["toxic"], np.int64)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    ratio = np.log((count[1] + 1) / (toxic + 1)) - np.log((count[0] + 1) / (clean + 1))
    strength = np.abs(ratio) * np.sqrt(count.sum(0))
    strength[count.sum(0) < 3] = 0
    chosen = np.sort(np.argsort(-strength, kind="stable")[: min(features, int((strength > 0).sum()))]) if clean and toxic else np.zeros(0, np.int64)
    rows = sample.select("text", "label").mapInArrow(_rows(orders, bits, chosen), "label int, places binary").toArrow()
    places = [np.frombuffer(x.as_py(), np.int32) for x in rows.column("places")]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int64)
    columns = np.concatenate([*places, np.zeros(0, np.int32)])
    x = Sparse(starts, columns, ratio[chosen][columns], len(chosen))
    weights, intercept = fit(x, rows.column("label").to_numpy().astype(float), l2=l2)
    return ToxicityModel(orders, bits, chosen, weights * ratio[chosen], intercept)


def _scorer(model: ToxicityModel):
    """A function of a batch with a column ``text`` that gives the score of each row."""
    dense = np.zeros(1 << model.bits)
    dense[model.buckets] = model.weights
    wanted = dense != 0

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        data, offsets = flat(batch.column("text"))
        sums = np.full(batch.num_rows, model.intercept)
        for a, b in chunks(offsets):
            text, bucket = _present(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], model.orders, model.bits, wanted)
            sums[a:b] += np.bincount(text, dense[bucket], b - a)
        return 1 / (1 + np.exp(-np.clip(sums, -500, 500)))

    return scores


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text, any others): the chance that its whole text is toxic.

    Texts of any length are read whole. Null and empty texts, having no n-gram, get the score of the intercept. Repeated rows
    and null ids are scored like all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch))], ["doc_id", "score"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, score double")


def drop_toxic_rows(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, whose score is below ``threshold``; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, train=None, limit: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every document; learns from at most ``limit`` rows of ``labels`` (doc_id, toxic) with ``train``."""
    sample = labelled_sample(docs, labels, "toxic", F.lit(True) if train is None else train, limit)
    scored = score_toxicity(docs, train_toxicity(sample))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


"""Exact top-k search by inner product: document-range blocks with term maxima, scored block at a time until bounds fall below the kth score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sitelake.session import cut_lineage

#: Production parameters: rows of a block, blocks of a document range, queries of a batch.
BLOCK = 256
RANGE = 32
BATCH = 512
_NONE = -(1 << 62)  # below every score


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, terms) of vectors (vec_id, embedding, any others) that take part: each component as floor(scale * x), x as double.

    Left out: null ids, null vectors, and vectors with a null or non-finite component. An empty vector takes part with no terms.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * scale))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", whole.alias("terms"))


def _matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Rows of equal width; shorter vectors are filled with zeros, a term that one side lacks adds nothing."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    width = int(lengths.max(initial=0)) if width is None else width
    out = np.zeros((len(column), width), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(len(column), width).astype(np.int64)
    rows, places = np.repeat(np.arange(len(column)), lengths), np.concatenate([np.arange(n) for n in lengths] or [np.zeros(0, np.int64)])
    out[rows[places < width], places[places < width]] = values[places < width]
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows: by floating point where no sum can leave its whole numbers, else by integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1)
    if largest < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def _search(k: int, block: int):
    """One batch of queries against one document range, whose blocks are taken by falling bound."""

    def run(_key, queries: pa.Table, documents: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if queries.num_rows and documents.num_rows:
            order = np.argsort(documents.column("vec_id").to_numpy(), kind="stable")
            ids, vectors = documents.column("vec_id").to_numpy()[order], _matrix(documents.column("terms"))[order]
            query_ids, q = queries.column("query_id").to_numpy(), _matrix(queries.column("terms"))
            floor = queries.column("floor").to_numpy()  # a score that k candidates are known to reach, or the least number
            width = min(q.shape[1], vectors.shape[1])
            q, vectors = q[:, :width], vectors[:, :width]
            starts = np.arange(0, len(ids), block)
            most = np.maximum.reduceat(vectors, starts, axis=0) if width else np.zeros((len(starts), 0), np.int64)
            least = np.minimum.reduceat(vectors, starts, axis=0) if width else np.zeros((len(starts), 0), np.int64)
            # A query's summed term maxima: each term with the end of the block's range that serves it best.
            bounds = _products(np.maximum(q, 0), most) + _products(np.minimum(q, 0), least)
            best_ids, best = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64)
            turns = np.argsort(-bounds, axis=1, kind="stable")
            kth, active = floor.copy(), np.arange(len(q))
            for turn in range(len(starts)):
                # Ties count: a block stays while its bound reaches the kth score.
                active = active[bounds[active, turns[active, turn]] >= kth[active]]
                if not len(active):
                    break
                more_ids = np.zeros((len(q), block), np.int64)
                more = np.full((len(q), block), _NONE)
                for b in np.unique(turns[active, turn]):
                    rows = active[turns[active, turn] == b]
                    at = slice(starts[b], min(starts[b] + block, len(ids)))
                    scores = _products(q[rows], vectors[at])
                    scores[query_ids[rows][:, None] == ids[at][None, :]] = _NONE
                    more[rows, : scores.shape[1]] = scores
                    more_ids[rows, : scores.shape[1]] = ids[at]
                if best.shape[1] == 0:
                    best, best_ids = np.full((len(q), k), _NONE), np.zeros((len(q), k), np.int64)
                both, both_ids = np.concatenate([best[active], more[active]], axis=1), np.concatenate([best_ids[active], more_ids[active]], axis=1)
                top = np.stack([np.lexsort((i, -s))[:k] for i, s in zip(both_ids, both)])
                best[active], best_ids[active] = np.take_along_axis(both, top, 1), np.take_along_axis(both_ids, top, 1)
                kth[active] = np.maximum(kth[active], best[active, -1])
            rows, places = np.nonzero(best > _NONE)
            out = {"query_id": query_ids[rows], "vec_id": best_ids[rows, places], "score": best[rows, places]}
        return pa.table({name: pa.array(values, pa.int64()) for name, values in out.items()})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int, block: int = BLOCK, blocks: int = RANGE, batch: int = BATCH) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query, the ``k`` rows of highest inner product with it, ties to the smaller vec_id; all, if fewer.

    ``vectors`` has vec_id (a whole number) and embedding, ``is_query`` picks the queries by vec_id; every row but those of the query's own id is a candidate. Rows that take no part: see
    ``quantized``. A vec_id that repeats is a query once, by its least vector, and each of its rows is a candidate. Vectors of different length are compared over the
    shorter one. An empty table gives no rows.

    Candidates are dealt into document ranges of ``blocks`` blocks, queries into batches; a batch meets a range in one task, so a task holds no more than
    either. First each batch is scored against one range, for a floor that prunes the others.
    """
    rows = cut_lineage(quantized(vectors), "vectors")
    total, queried = rows.count(), rows.filter(is_query).select("vec_id").distinct().count()
    ranges, batches = max(1, -(-total // (block * blocks))), max(1, -(-queried // batch))
    documents = rows.withColumn("range", F.pmod(F.xxhash64("vec_id"), F.lit(ranges))).select("range", "vec_id", "terms")
    queries = rows.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("terms").alias("terms"))
    queries = queries.withColumn("batch", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(batches)))
    shape = "query_id long, vec_id long, score long"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def against(asked: DataFrame, wanted: Column, name: str) -> DataFrame:
        pairs = asked.withColumn("range", F.explode(wanted))
        # A document range goes to each batch that asks for it; there are batches * ranges tasks, and no row of one meets a row of the other outside them.
        dealt = documents.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))).withColumn("batch", F.col("batch").cast("long"))
        if name == "first":
            dealt = dealt.filter(F.col("range") == F.pmod(F.col("batch"), F.lit(ranges)))
        else:
            dealt = dealt.filter(F.col("range") != F.pmod(F.col("batch"), F.lit(ranges)))
        met = pairs.groupBy("batch", "range").cogroup(dealt.groupBy("batch", "range")).applyInArrow(_search(k, block), shape)
        return cut_lineage(met, f"top-{name}")

    first = against(queries.withColumn("floor", F.lit(_NONE).cast("long")), F.array(F.pmod(F.col("batch"), F.lit(ranges))), "first")
    found = first
    if ranges > 1:
        kth = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        floored = queries.join(kth, "query_id", "left").withColumn("floor", F.coalesce("kth", F.lit(_NONE).cast("long"))).drop("kth")
        rest = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(ranges - 1).cast("long")), lambda r: r != F.pmod(F.col("batch"), F.lit(ranges)))
        found = first.unionAll(against(floored, rest, "rest"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

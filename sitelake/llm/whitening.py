"""Embedding whitening: leading principal components by Chebyshev-filtered subspace iteration over distributed centred passes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.session import cut_lineage

#: Production parameters: components asked for, further columns of the block, degree of the filter, residual (against the largest eigenvalue) and rounds.
COMPONENTS = 4
GUARD = 8
DEGREE = 8
TOLERANCE = 1e-13
ROUNDS = 40
#: Entries x beyond this have no exact sums; their rows are left out.
LARGEST = 1 << 31


@dataclass(frozen=True)
class Components:
    """What a fit found: the centre as exact sums over ``n`` rows, and unit ``vectors`` (a column each) by falling ``values``."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    residual: float
    passes: int
    certified: bool


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x) of the rows of ``vectors`` (vec_id, embedding, any others) that take part: each entry c, as double, as the long floor(scale * c).

    Left out: vectors that are null, empty, or hold a null or non-finite entry or one whose x is beyond ``LARGEST``. Null and repeated ids stay.
    """
    c = F.transform("embedding", lambda v: v.cast("double"))
    fits = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * scale < LARGEST))
    whole = F.transform(c, lambda v: F.floor(v * scale).cast("long"))
    return vectors.filter(F.coalesce(fits, F.lit(False)) & (F.size("embedding") > 0)).select("vec_id", whole.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _passed(rows: DataFrame, shift: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Xᵀ X Q over all rows x of ``rows``, less ``shift`` each, for the columns ``block`` of Q.

    Each task reads its rows in batches and holds one product of the block's shape; the products are added by the rows of the block, so
    the driver receives a matrix of that shape, whatever the number of tasks.
    """
    wide = block.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                centred = _matrix(batch.column(0)) - shift
                part = centred.T @ (centred @ block)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *[pa.array(total[:, k]) for k in range(wide)]], ["at", *[f"q{k}" for k in range(wide)]])

    parts = rows.select("x").mapInArrow(run, "at long, " + ", ".join(f"q{k} double" for k in range(wide)))
    added = parts.groupBy("at").agg(*[F.sum(f"q{k}").alias(f"q{k}") for k in range(wide)]).toPandas().sort_values("at")
    return added[[f"q{k}" for k in range(wide)]].to_numpy()


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Each column with its entry of largest amount positive, so that a fit repeats."""
    return vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def fit_components(fit: DataFrame, k: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> Components | None:
    """Leading ``k`` eigenvectors of the covariance (divisor n) of the rows x of ``fit``, all of one length; None without rows.

    A block of k + guard columns is filtered by a Chebyshev polynomial of the covariance V that stays within one on the unwanted part of the spectrum, from zero
    to the block's least Ritz value, and grows fastest above it. Each degree is one distributed pass V Q = Xᵀ X Q / n over centred rows; V itself is
    never formed. Then QR and Rayleigh-Ritz: the small projected problem is solved and a last pass gives the residuals V q - e q. The fit is certified when the
    residual of every wanted pair is at most ``tolerance`` times the largest eigenvalue, or no longer falls (the limit of double precision). Equal
    eigenvalues leave their vectors free within the space they share. Components of no variance are left out, so fewer than k may come back.
    """
    shape = fit.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    if not shape["n"]:
        return None
    n, d = shape["n"], shape["d"]
    entries = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()  # a row a dimension
    sums = [0] * d
    for row in entries:
        sums[row["at"]] = int(row["s"])
    shift = np.array([s // n + (s % n) / n for s in sums])
    passes = 0

    def times_v(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return _passed(fit, shift, block) / n

    # The trace is the sum of the variances of the centred rows.
    centred = F.zip_with("x", F.array(*[F.lit(float(s)) for s in shift]), lambda v, s: (v - s) * (v - s))
    trace = fit.agg(F.sum(F.aggregate(centred, F.lit(0.0), lambda a, v: a + v))).first()[0] / n
    wide = min(d, k + guard)
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((d, wide)))[0]
    best, flat = np.inf, 0
    for _ in range(rounds):
        vq = times_v(q)
        small = q.T @ vq
        e, turn = np.linalg.eigh((small + small.T) / 2)
        e, turn = e[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        wanted = [i for i in range(min(k, wide)) if e[i] > max(e[0], trace / d) * d * np.finfo(float).eps]
        gaps = [np.linalg.norm(vq[:, i] - e[i] * q[:, i]) for i in wanted]
        residual = max(gaps, default=0.0) / max(e[0], np.finfo(float).tiny)
        flat = 0 if residual < best / 2 else flat + 1
        best = min(best, residual)
        # Beyond double precision the residual only wanders.
        certified = residual <= tolerance or (flat >= 2 and best <= 1e3 * tolerance)
        if certified or wide == d and residual <= 1e3 * tolerance:
            certified = True
            break
        if e[0] <= 0:
            break
        # The recurrence, scaled so that it is one at the largest Ritz value.
        low = max(float(e[-1]), float(e[0]) * 1e-12)
        half = low / 2
        sigma = first = half / (float(e[0]) - half)
        before, now = q, (vq - half * q) * (sigma / half)
        for _ in range(2, degree + 1):
            after = 1 / (2 / first - sigma)
            before, now = now, (times_v(now) - half * now) * (2 * after / half) - (sigma * after) * before
            sigma = after
        q = np.linalg.qr(now)[0]
    vectors = _signed(q[:, wanted])
    values = e[: len(wanted)]
    # Whitened rows' own covariance, in one more pass: Wᵀ V W with W the scaled vectors.
    scaled = vectors / np.sqrt(values)
    error = float(np.abs(scaled.T @ times_v(scaled) - np.eye(len(wanted))).max()) if wanted else 0.0
    return Components(n, tuple(sums), values, vectors, float(trace), error, float(best), passes, bool(certified))


def _projected(rows: DataFrame, found: Components, key: str) -> DataFrame:
    """(vec_id, deviation, y) of every row: the exact sum of (n x - S)^2, null if it is no long, and the whitened coordinates."""
    n, sums = found.n, found.sums
    shift = np.array([s // n + (s % n) / n for s in sums])
    scaled = found.vectors / np.sqrt(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            reach = max(abs(n * int(x.max()) - min(sums)), abs(n * int(x.min()) - max(sums)))
            if reach * reach * len(sums) < 1 << 63:
                off = n * x - np.array(sums, np.int64)
                deviation = (off * off).sum(axis=1).tolist()
            else:  # whole numbers of any size
                deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
                deviation = [v if v < 1 << 63 else None for v in deviation]
            y = (x - shift) @ scaled
            offsets = np.arange(0, y.size + 1, max(1, y.shape[1]), dtype=np.int32) if y.shape[1] else np.zeros(len(x) + 1, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(y.ravel()))], ["vec_id", "deviation", "y"]
            )

    return rows.mapInArrow(run, f"vec_id {key}, deviation long, y array<double>")


def whiten(vectors: DataFrame, k: int = COMPONENTS, scale: int = 256, keep: Column | None = None, **fitting) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, residual, certified) for every row that takes part and component up to ``k``.

    Rows that take part: see ``whole_vectors``; of vectors of several lengths those of the commonest length do (ties: the longer), optionally only
    those that ``keep`` holds for. The fit is over each distinct x once, so copies do not weigh; copies are combined before they are shuffled. Repeated rows and
    null ids give rows as often as they come. Fewer than ``k`` components come back where the rows have no more variance; an empty table, or equal rows, give no rows.
    A deviation beyond a long is null.
    """
    key = vectors.schema["vec_id"].dataType.simpleString()
    chosen = vectors if keep is None else vectors.filter(keep)
    rows = cut_lineage(whole_vectors(chosen, scale), "whole-vectors")
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        found = None
    else:
        rows = rows.filter(F.size("x") == length["d"])
        fit = cut_lineage(rows.select("x").distinct(), "fit-list")
        found = fit_components(fit, k, **fitting)
    shape = f"vec_id {key}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double, certified boolean"
    if found is None or not len(found.values):
        return rows.sparkSession.createDataFrame([], shape)
    explained = F.array(*[F.lit(float(e / found.trace)) for e in found.values])
    out = _projected(rows, found, key).select("vec_id", "deviation", F.posexplode("y").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(found.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(found.identity_error).alias("identity_error"),
        F.lit(found.residual).alias("residual"),
        F.lit(found.certified).alias("certified"),
    )

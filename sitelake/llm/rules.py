"""Quality by a sparse rule ensemble: tree paths as rules over statistics of the text, lasso weights, compiled into column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.llm.labelled import labelled_sample
from sitelake.llm.logistic import Dense, fit, sigmoid

#: Production parameters: labelled rows to learn from, trees and their depth, the lasso's weight, the least score of label 1.
SAMPLE = 8_000
TREES = 24
DEPTH = 3
LASSO = 3e-4
THRESHOLD = 0.3

Condition = tuple[str, str, float]  # statistic, "<=" or ">", value


@dataclass(frozen=True)
class RuleModel:
    """Rules, each a conjunction of conditions, with weights, and the intercept."""

    rules: tuple[tuple[Condition, ...], ...]
    weights: tuple[float, ...]
    intercept: float


def _count(pattern: str) -> Column:
    return F.regexp_count(F.col("text"), F.lit(pattern))


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics of the whole text) of every row; a null text counts as empty, for which every share is 0."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.select(
        "doc_id",
        F.length("text").alias("chars"),
        F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x != "").alias("lines"),
        _count("[A-Z]").alias("upper"),
        _count("[0-9]").alias("digits"),
        _count("[^A-Za-z0-9\\s.,;:'\"()\\u0080-\\x{10FFFF}-]").alias("signs"),
        _count("[.!?]").alias("stops"),
    )
    sized = counted.select(
        "*",
        F.size("words").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_different"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("lines")).alias("n_different_lines"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sized.select(
        "doc_id",
        F.log1p(F.col("n_words").cast("double")).alias("log_words"),
        share("chars", "n_words").alias("word_length"),
        share("n_different", "n_words").alias("different_words"),
        share("n_different_lines", "n_lines").alias("different_lines"),
        share("n_words", "n_lines").alias("line_words"),
        share("upper", "chars").alias("upper_share"),
        share("digits", "chars").alias("digit_share"),
        share("signs", "chars").alias("sign_share"),
        share("stops", "n_words").alias("stop_share"),
    )


STATISTICS = ("log_words", "word_length", "different_words", "different_lines", "line_words", "upper_share", "digit_share", "sign_share", "stop_share")


def _grow(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, depth: int, cuts: list[np.ndarray], path: tuple, out: list) -> np.ndarray:
    """A regression tree on the residuals: its value for each of ``rows``; the path to every node is appended to ``out``."""
    value = np.full(len(rows), residual[rows].mean())
    best = None
    if depth and len(rows) >= 20:
        r = residual[rows]
        for j, values in enumerate(cuts):
            place = np.searchsorted(values, x[rows, j])  # number of cuts below the value
            n = np.cumsum(np.bincount(place, minlength=len(values) + 1))[:-1]
            s = np.cumsum(np.bincount(place, r, len(values) + 1))[:-1]
            ok = (n >= 10) & (len(rows) - n >= 10)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, s * s / n + (r.sum() - s) ** 2 / (len(rows) - n), -np.inf)
            if len(gain) and gain.max() > r.sum() ** 2 / len(rows) + 1e-9 and (best is None or gain.max() > best[0]):
                best = (gain.max(), j, float(values[int(gain.argmax())]))
    if best is None:
        return value
    _, j, cut = best
    low = x[rows, j] <= cut
    for side, sign in ((low, "<="), (~low, ">")):
        step = (*path, (STATISTICS[j], sign, cut))
        out.append(step)
        value[side] = _grow(x, residual, rows[side], depth - 1, cuts, step, out)
    return value


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list[tuple[Condition, ...]]:
    """The different paths of boosted trees, each grown on a random half of the rows."""
    if not len(y) or y.min() == y.max():
        return []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65))) for j in range(x.shape[1])]
    cuts = [(c[1:] + c[:-1]) / 2 for c in cuts]
    random, score, paths = np.random.default_rng(seed), np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        residual = y - sigmoid(score)
        half = np.sort(random.permutation(len(y))[: max(1, len(y) // 2)])
        grown: list = []
        _grow(x, residual, half, depth, cuts, (), grown)
        leaves = [p for p in grown if not any(q[: len(p)] == p and len(q) > len(p) for q in grown)]
        for leaf in leaves:
            inside = holds(leaf, x)
            if inside.any():
                weight = (sigmoid(score[inside]) * (1 - sigmoid(score[inside]))).sum()
                score[inside] += 0.5 * np.clip(residual[inside].sum() / max(weight, 1e-3), -4, 4)
        paths += grown
    return list(dict.fromkeys(paths))


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    """Which rows of statistics the rule holds for."""
    return reduce(np.logical_and, [(x[:, STATISTICS.index(s)] <= v) == (sign == "<=") for s, sign, v in rule])


def train_rules(sample: DataFrame, lasso: float = LASSO, trees: int = TREES, depth: int = DEPTH) -> RuleModel:
    """Learn from a bounded sample (doc_id, text, label 0 or 1): its statistics are computed in Spark, trees and weights on the driver.

    Rules of weight zero are dropped. No rows give the score one half to every text, labels of one kind a score that says so.
    """
    rows = text_statistics(sample.select(F.struct("doc_id", "label").alias("doc_id"), "text")).select("doc_id.label", *STATISTICS).toArrow()
    y = rows.column("label").to_numpy().astype(float)
    x = np.stack([rows.column(s).to_numpy() for s in STATISTICS], axis=1) if len(y) else np.zeros((0, len(STATISTICS)))
    order = np.lexsort((*x.T, y))  # the same model whatever order rows arrive in
    x, y = x[order], y[order]
    rules = tree_rules(x, y, trees, depth)
    matrix = np.stack([holds(r, x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    weights, intercept = fit(Dense(matrix), y, l1=lasso, rounds=2000)
    kept = np.flatnonzero(weights)
    return RuleModel(tuple(rules[i] for i in kept), tuple(float(weights[i]) for i in kept), intercept)


def rule_score(model: RuleModel) -> Column:
    """The model as one expression over the statistics."""
    total = F.lit(model.intercept)
    for rule, weight in zip(model.rules, model.weights):
        parts = [F.col(s) <= v if sign == "<=" else F.col(s) > v for s, sign, v in rule]
        total = total + F.when(reduce(lambda a, b: a & b, parts), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def quality(docs: DataFrame, labels: DataFrame, train: Column | None = None, limit: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs`` (doc_id, text, any others): the chance that its text is of good quality.

    Learns from at most ``limit`` rows of ``labels`` (doc_id, quality) with ``train``. Null and empty texts are scored by the statistics of an empty text. Repeated rows
    and null ids are scored like all others.
    """
    model = train_rules(labelled_sample(docs, labels, "quality", F.lit(True) if train is None else train, limit))
    scored = text_statistics(docs).select("doc_id", rule_score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

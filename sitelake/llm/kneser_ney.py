"""Language model scores: interpolated modified Kneser-Ney bigrams, counted in Spark, stored as sorted hash arrays, mapped by workers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.llm.bytes_of_text import LOWER, chunks, flat, span_hashes, words
from sitelake.llm.files import map_array, write_array
from sitelake.llm.labelled import bounded_sample
from sitelake.session import new_folder

#: Documents whose bigrams place the borders of the shards. They only share out work; every count covers all documents.
BORDER_SAMPLE = 1_000
_END, _BEGIN = np.uint64(0xE4D0_0000_0000_0001), np.uint64(0xBE61_0000_0000_0001)
_HALF = np.uint64(32)
_FLUSH = 3_000_000
_WIDTH = 4 << 20


@dataclass(frozen=True)
class KneserNeyModel:
    """Where the arrays are, and the few numbers that hold for all of them."""

    folder: str
    word_borders: np.ndarray
    pair_borders: np.ndarray
    tokens: int  # N
    distinct: int  # V, the end included
    pair_types: int
    word_discounts: np.ndarray  # by count 0, 1, 2, 3 and more
    pair_discounts: np.ndarray
    word_rest: float  # the share that single words leave to the uniform distribution


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then its end; of the token before each; and where each text's tokens begin (one entry more)."""
    data = LOWER[data]
    starts, ends, before = words(data, offsets)
    begins = before + np.arange(len(before))
    token = np.empty(begins[-1], np.uint64)
    inner = np.ones(len(token), bool)
    inner[begins[1:] - 1] = False
    token[inner] = span_hashes(data, starts, ends)
    token[~inner] = _END
    previous = np.empty_like(token)
    previous[1:] = token[:-1]
    previous[begins[:-1]] = _BEGIN
    return token, previous, begins


def _pairs(token: np.ndarray, previous: np.ndarray) -> np.ndarray:
    """A bigram as one number: the upper half of either word's hash."""
    return ((previous >> _HALF) << _HALF) | (token >> _HALF)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, ascending, and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys, kind="stable")
    all_keys, all_counts = all_keys[order], all_counts[order]
    first = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]])) if len(all_keys) else np.zeros(0, np.int64)
    return all_keys[first], np.add.reduceat(all_counts, first) if len(first) else all_counts


def _even_borders(shards: int) -> np.ndarray:
    """The least hash of each shard but the first, evenly spaced."""
    return np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)


def _slices(keys: np.ndarray, borders: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = np.concatenate([[0], np.searchsorted(keys, borders), [len(keys)]])
    for shard in np.flatnonzero(cuts[1:] > cuts[:-1]):
        yield int(shard), slice(int(cuts[shard]), int(cuts[shard + 1]))


_SHAPE = "shard long, kind string, keys binary, counts binary"


def _message(shard: int, kind: str, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"shard": [shard], "kind": [kind], "keys": [keys.tobytes()], "counts": [counts.tobytes()]})


def _count(word_borders: np.ndarray, pair_borders: np.ndarray):
    """Per task: sorted words and bigrams with their counts, cut at the borders of the shards."""

    def flush(kept: dict[str, tuple[list, list]]) -> Iterator[pa.RecordBatch]:
        for kind, borders in (("word", word_borders), ("pair", pair_borders)):
            keys, counts = _summed(*kept[kind])
            for shard, part in _slices(keys, borders):
                yield _message(shard, kind, keys[part], counts[part].astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = {"word": ([], []), "pair": ([], [])}, 0
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets, _WIDTH):
                token, previous, _ = _tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for kind, keys in (("word", token), ("pair", _pairs(token, previous))):
                    found, counts = np.unique(keys, return_counts=True)
                    kept[kind][0].append(found)
                    kept[kind][1].append(counts)
                    size += len(found) if kind == "pair" else 0
                if size > _FLUSH:
                    yield from flush(kept)
                    kept, size = {"word": ([], []), "pair": ([], [])}, 0
        yield from flush(kept)

    return run


def _gathered(rows: pa.Table, kind: str, key_type, count_type, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a kind with their counts (``width`` to a key), unsorted."""
    chosen = [i for i, k in enumerate(rows.column("kind").to_pylist()) if k == kind]
    keys = [np.frombuffer(rows.column("keys")[i].as_py(), key_type) for i in chosen]
    counts = [np.frombuffer(rows.column("counts")[i].as_py(), count_type).reshape(-1, width) for i in chosen]
    if not keys:
        return np.zeros(0, key_type), np.zeros((0, width), count_type)
    return np.concatenate(keys), np.concatenate(counts)


def _occurrences(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3, 4, and 3 or more."""
    return np.array([*(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts >= 3).sum())], np.int64)


def _store_pairs(folder: str, word_borders: np.ndarray):
    """Per shard: write the bigrams of the shard; pass on what they say of their first and second words, and the words' own counts."""

    def run(rows: pa.Table) -> pa.Table:
        shard, out = rows.column("shard")[0].as_py(), []
        keys, counts = _gathered(rows, "pair", np.uint64, np.uint32)
        keys, counts = _summed([keys], [counts[:, 0].astype(np.int64)])
        # A count takes a byte; those beyond are in a list of their own, by place.
        large = np.flatnonzero(counts > 255)
        write_array(folder, f"pair-keys-{shard}", keys)
        write_array(folder, f"pair-counts-{shard}", np.minimum(counts, 255).astype(np.uint8))
        write_array(folder, f"pair-large-{shard}", np.stack([large, counts[large]]).astype(np.int64))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] >> _HALF != keys[:-1] >> _HALF])) if len(keys) else np.zeros(0, np.int64)
        if len(keys):
            context = keys[first] >> _HALF
            stats = np.stack([np.add.reduceat(x, first) for x in (counts, counts == 1, counts == 2, counts >= 3)], axis=1, dtype=np.int64)
            for to, part in _slices(context << _HALF, word_borders):
                out.append(_message(to, "context", context[part].astype(np.uint32), stats[part].astype(np.uint64)))
            second, types = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
            for to, part in _slices(second << _HALF, word_borders):
                out.append(_message(to, "second", second[part].astype(np.uint32), types[part].astype(np.uint32)))
        out.append(_message(shard, "pair-occurrences", np.zeros(1, np.uint8), _occurrences(counts)))
        word, count = _gathered(rows, "word", np.uint64, np.uint32)
        word, count = _summed([word], [count[:, 0].astype(np.int64)])
        out.append(_message(shard, "word", word, count.astype(np.uint64)))
        return pa.Table.from_batches(out)

    return run


_STATS = "tokens long, distinct long, types long, words binary, pairs binary"


def _store_words(folder: str):
    """Per shard: write the words' hashes with count, context count, numbers of followers seen once, twice, more often, and number of different words before."""

    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        word, count = _gathered(rows, "word", np.uint64, np.uint64)
        word, count = _summed([word], [count[:, 0].astype(np.int64)])
        context, stats = _gathered(rows, "context", np.uint32, np.uint64, 4)
        # A context without a word of its own is the beginning of a text.
        halves = word >> _HALF
        if len(context) and (_BEGIN >> _HALF) in context and not (halves == _BEGIN >> _HALF).any():
            at = int(np.searchsorted(word, _BEGIN))
            word, count = np.insert(word, at, _BEGIN), np.insert(count, at, 0)
            halves = word >> _HALF
        half, place = np.unique(halves.astype(np.uint32), return_inverse=True)
        fields = np.zeros((len(half), 5), np.uint64)
        if len(half):
            at = np.searchsorted(half, context)
            for k in range(4):
                fields[:, k] = np.bincount(at, stats[:, k].astype(float), len(half)).astype(np.uint64)
            second, types = _gathered(rows, "second", np.uint32, np.uint32)
            fields[:, 4] = np.bincount(np.searchsorted(half, second), types[:, 0].astype(float), len(half)).astype(np.uint64)
        write_array(folder, f"word-keys-{shard}", word)
        write_array(folder, f"word-counts-{shard}", count.astype(np.uint64))
        write_array(folder, f"word-fields-{shard}", fields[place] if len(half) else fields)
        _, occurrences = _gathered(rows, "pair-occurrences", np.uint8, np.int64, 5)
        before = fields[:, 4]
        return pa.table({
            "tokens": [int(count.sum())], "distinct": [int((count > 0).sum())], "types": [int(before.sum())],
            "words": [_occurrences(before[before > 0]).tobytes()], "pairs": [occurrences.sum(axis=0).astype(np.int64).tobytes()],
        })

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified discounts for counts 0, 1, 2, 3 and more, from how many counts are 1, 2, 3, 4; kept between a small number and the count where those are few."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))])


def train_kneser_ney(docs: DataFrame) -> KneserNeyModel:
    """Count words and bigrams of all ``docs`` (doc_id, text, any others) and store them as sorted arrays in the shared folder.

    Tokens: words between white space, A-Z lower-cased, and one end for each text. Tasks sum what they read before it is shuffled. Shards of bigrams are ranges of hashes with
    borders from a bounded sample, so the many followers of a frequent word spread over several shards; each shard is summed and written by one task.
    There are as many shards as shuffle partitions. Two words share counts of bigrams if the upper 32 bits of their hashes are equal.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark, "bigrams")
    even = _even_borders(shards)
    seen = bounded_sample(docs, BORDER_SAMPLE).select("text").mapInArrow(_count(even, np.zeros(0, np.uint64)), _SHAPE)
    sample = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["keys"], np.uint64) for r in seen.filter("kind = 'pair'").collect())]))
    borders = np.unique(sample[(np.arange(1, shards) * len(sample)) // shards]) if len(sample) > shards else even
    counted = docs.select("text").mapInArrow(_count(even, borders), _SHAPE)
    stored = counted.groupBy("shard").applyInArrow(_store_pairs(folder, even), _SHAPE)
    rows = stored.groupBy("shard").applyInArrow(_store_words(folder), _STATS).collect()  # a row for each shard
    total = {k: sum(np.frombuffer(r[k], np.int64) for r in rows) if rows else np.zeros(5, np.int64) for k in ("words", "pairs")}
    tokens, distinct, types = (sum(r[k] for r in rows) for k in ("tokens", "distinct", "types"))
    by_word, by_pair = discounts(total["words"]), discounts(total["pairs"])
    n = total["words"]
    rest = float(by_word[1] * n[0] + by_word[2] * n[1] + by_word[3] * n[4]) / types if types else 1.0
    return KneserNeyModel(folder, even, borders, tokens, distinct, types, by_word, by_pair, rest)


class _Reader:
    """Look-ups in the mapped arrays; keys are asked for in ascending order, shard by shard."""

    def __init__(self, model: KneserNeyModel) -> None:
        self.model, self.arrays = model, {}

    def _array(self, name: str, dtype) -> np.ndarray | None:
        if name not in self.arrays:
            try:
                self.arrays[name] = map_array(self.model.folder, name, dtype)
            except FileNotFoundError:  # a shard that no key fell into
                self.arrays[name] = None
        return self.arrays[name]

    def _places(self, kind: str, keys: np.ndarray, borders: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Shard, places in the shard, and places in ``keys`` (ascending) of those that are there."""
        for shard, part in _slices(keys, borders):
            known = self._array(f"{kind}-keys-{shard}", np.uint64)
            if known is None or not len(known):
                continue
            at = np.minimum(np.searchsorted(known, keys[part]), len(known) - 1)
            there = np.flatnonzero(known[at] == keys[part])
            yield shard, at[there], there + part.start

    def words(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, fields = np.zeros(len(keys)), np.zeros((len(keys), 5))
        for shard, at, to in self._places("word", keys, self.model.word_borders):
            counts[to] = self._array(f"word-counts-{shard}", np.uint64)[at]
            fields[to] = self._array(f"word-fields-{shard}", np.uint64).reshape(-1, 5)[at]
        return counts, fields

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        counts = np.zeros(len(keys))
        for shard, at, to in self._places("pair", keys, self.model.pair_borders):
            found = self._array(f"pair-counts-{shard}", np.uint8)[at].astype(float)
            large = self._array(f"pair-large-{shard}", np.int64).reshape(2, -1)
            over = np.flatnonzero(found == 255)
            if large.shape[1] and len(over):
                k = np.minimum(np.searchsorted(large[0], at[over]), large.shape[1] - 1)
                found[over] = np.where(large[0][k] == at[over], large[1][k], 255)
            counts[to] = found
        return counts


def score_kneser_ney(docs: DataFrame, model: KneserNeyModel) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of ``docs`` (doc_id, text, any others).

    ``score`` is the log10 probability of the whole text and its end under the model; ``base_score`` that of single tokens with one added to each count. Tokens not seen in
    training get the share of the uniform distribution. Null and empty texts are the one token end. A model of no documents gives every
    token the probability one. Repeated rows and null ids are scored like all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, m = _Reader(model), model
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            n = batch.num_rows
            tokens, known = np.zeros(n, np.int64), np.zeros(n, np.int64)
            base, score = np.zeros(n), np.zeros(n)
            for a, b in chunks(offsets, _WIDTH):
                token, previous, begins = _tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                word, place = np.unique(np.concatenate([token, previous]), return_inverse=True)
                counts, fields = reader.words(word)
                before = fields[:, 4]
                own = (before - m.word_discounts[np.minimum(before, 3).astype(int)]) / max(m.pair_types, 1) + m.word_rest / (m.distinct + 1)
                rest = np.where(fields[:, 0] > 0, fields[:, 1:4] @ m.pair_discounts[1:] / np.maximum(fields[:, 0], 1), 1.0)
                of_token, of_previous = place[: len(token)], place[len(token) :]
                pair, where = np.unique(_pairs(token, previous), return_inverse=True)
                seen = reader.pairs(pair)
                taken = (seen - m.pair_discounts[np.minimum(seen, 3).astype(int)])[where]
                chance = taken / np.maximum(fields[of_previous, 0], 1) + rest[of_previous] * own[of_token]
                text = np.repeat(np.arange(b - a), np.diff(begins))
                tokens[a:b] = np.diff(begins)
                known[a:b] = np.bincount(text, counts[of_token] > 0, b - a)
                base[a:b] = np.bincount(text, np.log10((counts[of_token] + 1) / (m.tokens + m.distinct + 1)), b - a)
                score[a:b] = np.bincount(text, np.log10(chance), b - a)
            names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (tokens, known, base, score))], names)

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n_tokens long, n_known long, base_score double, score double")


def kneser_ney_scores(docs: DataFrame, train: Column) -> DataFrame:
    """Scores of all ``docs`` under the model of those with ``train``; ``train_tokens`` is the number of tokens learnt from."""
    model = train_kneser_ney(docs.filter(train))
    return score_kneser_ney(docs, model).withColumn("train_tokens", F.lit(model.tokens).cast("long"))

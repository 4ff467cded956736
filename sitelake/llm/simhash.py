"""Near-duplicates by SimHash: fingerprints, an index of positional bytes with count filtering, and linked groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.bytes_of_text import LOWER_TABLE
from sitelake.session import cut_lineage

#: Production parameters.
WORDS = 3
MAX_BITS = 3
_BLOCK = 1 << 16


def _fingerprint(text: bytes, words: int) -> int:
    norm = b" ".join(text.translate(LOWER_TABLE).split())
    if not norm:
        return 0
    cuts = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts = np.concatenate([[0], cuts + 1])
    ends = np.concatenate([cuts, [len(norm)]])
    if len(starts) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), _BLOCK):
        spans = zip(starts[k : k + _BLOCK].tolist(), ends[k : k + _BLOCK].tolist())
        hashes = np.array([digest(norm[a:b], 42) for a, b in spans], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts)).view(np.uint64)[0])


def simhash_fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row of ``docs`` (doc_id, text, any others); ``fp`` is the fingerprint as a signed long.

    Words are what stands between white space (9 to 13 and 32), A-Z lower-cased; shingles of ``words`` words count as often as they occur.
    A text of fewer words is one shingle; a null, empty or blank text has fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            prints = np.fromiter((_fingerprint(x.as_py() or b"", words) for x in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, fp long")


# The index. Fingerprints of at most three differing bits share at least five of their eight positional bytes. Of any five
# places, three lie in the same half of the eight, so these eight triples of places suffice as posting keys.
_TRIPLES = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
_SHARED = 5
_HOT = 2048  # postings of a triple beyond which its list is dealt out by all sets of five places that hold the triple


def _mask(places: tuple[int, ...]) -> int:
    value = sum(0xFF << (8 * p) for p in places)
    return value - (1 << 64) if value >= 1 << 63 else value


def _postings(prints: DataFrame, sets: list[tuple[int, ...]], group: str | None = None) -> DataFrame:
    """(places, bytes, fp): a fingerprint stands once under the bytes that it has at each set of places."""
    keys = [F.struct(F.lit(i).alias("places"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("bytes")) for i, s in enumerate(sets)]
    return prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.places", "k.bytes", "fp")


_POPULATION = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _linked(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges that join the fingerprints of one posting list into groups, as few as it takes.

    From a fingerprint, pairs with those not yet reached are tallied: pairs of at least five shared positional bytes are verified by their
    differing bits, at most ``max_bits``. A list longer than ``_HOT`` holds fingerprints that share five places, so
    it has at most 2 to the 24 entries; there all values within the distance are looked up instead.
    """
    edges: list[tuple[int, int]] = []
    if len(prints) > 2 * _HOT:
        differing = np.bitwise_or.reduce(prints ^ prints[0])
        bits = [np.uint64(1 << i) for i in range(64) if int(differing) >> i & 1]
        masks = np.array([np.bitwise_xor.reduce(c) for r in range(1, max_bits + 1) for c in combinations(bits, r)], np.uint64)
        prints = np.sort(prints)
        left = np.ones(len(prints), bool)
        for seed in range(len(prints)):
            if not left[seed]:
                continue
            left[seed] = False
            frontier = np.array([seed])
            while len(frontier):
                reached = []
                for k in range(0, len(frontier), 256):
                    near = prints[frontier[k : k + 256], None] ^ masks[None, :]
                    at = np.searchsorted(prints, near)
                    at[at == len(prints)] = 0
                    rows, cols = np.nonzero((prints[at] == near) & left[at])
                    found, first = np.unique(at[rows, cols], return_index=True)
                    left[found] = False
                    edges += zip(prints[frontier[k + rows[first]]].tolist(), prints[found].tolist())
                    reached.append(found)
                frontier = np.concatenate(reached)
        return edges
    rest = prints
    while len(rest):
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            x, frontier = frontier[0], frontier[1:]
            apart = (rest ^ x).view(np.uint8).reshape(-1, 8)
            near = (apart == 0).sum(axis=1) >= _SHARED
            near[near] = _POPULATION[apart[near]].sum(axis=1) <= max_bits
            if near.any():
                edges += [(int(x), y) for y in rest[near].tolist()]
                frontier, rest = np.concatenate([frontier, rest[near]]), rest[~near]
    return edges


def _edges(lists: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): edges of the fingerprints (array column ``prints``) of each posting list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("prints")
            for i in range(batch.num_rows):
                prints = np.unique(column[i].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                if pairs := _linked(prints, max_bits):
                    ends = np.array(pairs, np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return lists.select("prints").mapInArrow(run, "a long, b long")


def simhash_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) over different fingerprints ``fp``: edges that connect just the fingerprints linked, directly or by others, at ``max_bits`` or fewer bits.

    Lists of one fingerprint are dropped where they are grouped. A triple that more than ``_HOT`` fingerprints share is dealt out once more by five
    places, so a list in a task has at most 2 to the 24 fingerprints however many copies a group has. Nothing is capped.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the guaranteed number of shared bytes holds for up to three bits")
    postings = cut_lineage(_postings(prints, _TRIPLES), "postings")
    sizes = postings.groupBy("places", "bytes").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    sizes = cut_lineage(sizes, "posting-sizes")
    usual = postings.join(sizes.filter(F.col("n") <= _HOT), ["places", "bytes"]).groupBy("places", "bytes").agg(F.collect_list("fp").alias("prints"))
    hot = postings.join(sizes.filter(F.col("n") > _HOT).drop("n"), ["places", "bytes"], "left_semi").select("fp").distinct()
    fives = list(combinations(range(8), _SHARED))
    dealt = _postings(hot, fives).groupBy("places", "bytes").agg(F.collect_list("fp").alias("prints")).filter(F.size("prints") > 1)
    return _edges(usual.select("prints"), max_bits).unionAll(_edges(dealt.select("prints"), max_bits)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every end of the edges (a, b): the least node that it reaches.

    Alternates large-star and small-star steps until nothing changes; the rounds grow with the logarithm of the longest chain.
    Each round is written to the shared folder.
    """
    both = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u <> v").distinct()
    pairs, before = cut_lineage(both, "links"), None
    while True:
        # Large star: each node's larger neighbours go to its least neighbour.
        each = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = each.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = each.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: each node and its smaller neighbours go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        pairs = cut_lineage(small.filter("u <> v").distinct(), "links")
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def simhash_groups(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) of every row: its fingerprint and the least id that it reaches over links of ``max_bits`` or fewer bits.

    Equal fingerprints are one node, so copies cost one row each and are never paired. Null ids take part in links but name a group only
    if it has no other id. Repeated rows come out as often as they go in. An empty table gives no rows.
    """
    prints = cut_lineage(simhash_fingerprints(docs, words), "fingerprints")
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    edges = simhash_links(nodes.select("fp"), max_bits)
    roots = components(edges)
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = cut_lineage(named.join(names, "root").select("fp", "component_id"), "groups")
    return prints.join(groups, "fp").select("doc_id", "fp", "component_id")

"""Near-duplicates by MinHash: an inverted join on signature coordinates, collisions counted over short lists, links confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.bytes_of_text import LOWER, chunks, flat, mixed, span_hashes, words
from sitelake.llm.simhash import components
from sitelake.session import cut_lineage

#: Production parameters: words of a shingle, least similarity in percent, coordinates of a signature, chance to miss a pair at just that similarity.
WORDS = 3
PERCENT = 85
COORDINATES = 64
MISS = 1e-8
#: Members of a block of a posting list, and shingles of a block of sets. A task holds two blocks.
LIST_BLOCK = 2048
SET_BLOCK = 1 << 20
#: Most bits (16 MB) of the filter by which documents without a candidate are passed over when sets are made; a fuller filter only lets more pass.
FILTER_BITS = 1 << 27

_ODD = np.random.default_rng(20250131).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(percent: int = PERCENT, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most coordinates one may ask two sets of this similarity to share so that they fail with a chance of at most ``miss``."""
    p, below, least = percent / 100, 0.0, 1
    for k in range(1, coordinates + 1):
        below += comb(coordinates, k - 1) * p ** (k - 1) * (1 - p) ** (coordinates - k + 1)
        if below > miss:
            break
        least = k
    return least


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text as sorted hashes, one text after the other, and where each text's begin (one entry more than texts)."""
    starts, ends, before = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    total = np.zeros(len(hashes), np.uint64)
    for k in range(min(size, len(hashes))):
        total[: len(hashes) - k] += hashes[k:] * _ODD[k]
    total = mixed(total)
    found = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= size:
            found.append(np.unique(total[a : b - size + 1]))
        elif b > a:  # fewer words: the whole sequence
            short = (hashes[a:b] * _ODD[: b - a]).sum(dtype=np.uint64, keepdims=True) + _ODD[b - a + size]
            found.append(mixed(short))
        else:
            found.append(np.zeros(0, np.uint64))
    at = np.zeros(len(found) + 1, np.int64)
    np.cumsum([len(f) for f in found], out=at[1:])
    return np.concatenate(found) if found else np.zeros(0, np.uint64), at


def _digests(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits that tell different sets apart, as two signed numbers a set."""
    out = np.zeros((len(at) - 1, 2), np.uint64)
    full = at[:-1] < at[1:]
    if full.any():
        first = at[:-1][full]
        out[full, 0] = np.add.reduceat(mixed(hashes ^ _ODD[-1]), first)
        out[full, 1] = np.bitwise_xor.reduceat(mixed(hashes * _ODD[-2]), first)
    return out.view(np.int64)


def signatures(docs: DataFrame, size: int = WORDS, coordinates: int = COORDINATES) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, signature, brief) of every row of ``docs`` (doc_id, text, any others).

    Words stand between white space (9 to 13 and 32), A-Z lower-cased; a text's set holds its different shingles of ``size`` words, with fewer words the whole
    sequence; null, empty and blank texts have empty sets. d1 and d2 are equal for equal sets. Each coordinate is the least value of one hash function
    over the set, mixed with the coordinate's number; ``brief`` holds a byte of each. Empty sets have no signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            sizes, digests, values = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)], [np.zeros((0, coordinates), np.uint64)]
            for a, b in chunks(offsets):
                hashes, at = _sets(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], size)
                full = at[:-1] < at[1:]
                part = np.zeros((b - a, coordinates), np.uint64)
                if full.any():
                    first = at[:-1][full]
                    for k in range(coordinates):
                        least = np.minimum.reduceat(hashes * _ODD[64 + 2 * k] + _ODD[65 + 2 * k], first)
                        part[full, k] = mixed(least ^ _ODD[64 + 2 * k])
                sizes.append(np.diff(at))
                digests.append(_digests(hashes, at))
                values.append(part)
            n, digest, value = np.concatenate(sizes), np.concatenate(digests), np.concatenate(values)
            lists = np.zeros(len(n) + 1, np.int32)
            np.cumsum(np.where(n > 0, coordinates, 0), out=lists[1:])
            brief = [bytes(row) for row in (value & np.uint64(255)).astype(np.uint8)]
            columns = [batch.column("doc_id"), pa.array(n), pa.array(digest[:, 0]), pa.array(digest[:, 1])]
            columns += [pa.ListArray.from_arrays(pa.array(lists), pa.array(value[n > 0].ravel().view(np.int64))), pa.array(brief, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "d1", "d2", "signature", "brief"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n_shingles long, d1 long, d2 long, signature array<long>, brief binary")


def _prefixes(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(uid, token) for the coordinate values under which a class is posted: its rarest, as many as its partners cannot all avoid.

    Two signatures that share ``matches`` values share one of their coordinates - matches + 1 rarest. Values that one class alone has come first and need no list; a
    class with fewer than ``matches`` others has no partner and no posting.
    """
    postings = classes.select("uid", F.explode("signature").alias("token"))
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1)
    ranked = postings.join(shared, "token").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))  # at most a row a coordinate
    kept = ranked.filter(F.size("ranked") >= matches)
    return kept.select("uid", F.explode(F.slice("ranked", F.lit(1), F.size("ranked") - (matches - 1))).alias("r")).select("uid", F.col("r.token").alias("token"))


def _forest(uids: np.ndarray, briefs: np.ndarray, matches: int) -> list[tuple[int, int]]:
    """Edges that connect just the members of a list joined by ``matches`` or more collisions, as few as it takes.

    Collisions with a member are counted over half the coordinates first; who cannot reach the threshold with the other half is skipped.
    """
    edges, half = [], briefs.shape[1] // 2
    rest = np.arange(len(uids))
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            count = (briefs[rest, :half] == briefs[x, :half]).sum(axis=1)
            able = np.flatnonzero(count >= matches - (briefs.shape[1] - half))
            near = able[count[able] + (briefs[rest[able], half:] == briefs[x, half:]).sum(axis=1) >= matches]
            if len(near):
                found = rest[near]
                edges += [(int(uids[x]), int(uids[y])) for y in found]
                frontier += found.tolist()
                rest = np.delete(rest, near)
    return edges


def candidate_edges(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(a, b): edges that connect just the classes (uid, signature, brief) joined, directly or by others, by ``matches`` or more equal coordinates.

    A list of more than ``LIST_BLOCK`` members is dealt out by pairs of blocks, so a task holds two blocks of any list however common its value is, and no
    pair of members is left out. Only edges of a forest leave a task, fewer than it has members.
    """
    # Counts and order of tokens are needed once; written, as lists are measured before they are dealt.
    posted = cut_lineage(_prefixes(classes, coordinates, matches).join(classes.select("uid", "brief"), "uid"), "minhash-postings")
    blocks = posted.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1).select("token", F.ceil(F.col("m") / LIST_BLOCK).cast("int").alias("blocks"))
    dealt = posted.join(blocks, "token").withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lists = dealt.groupBy("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.struct("uid", "brief")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("members")
            members, offsets = column.flatten(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            if not len(members):
                continue
            uids = members.field("uid").to_numpy()
            briefs = np.frombuffer(b"".join(members.field("brief").to_pylist()), np.uint8).reshape(len(uids), coordinates)
            # Most lists are joined by their first member alone.
            lengths = np.diff(offsets)
            first = np.repeat(offsets[:-1], lengths)
            joined = (briefs == briefs[first]).sum(axis=1) >= matches
            whole = np.logical_and.reduceat(joined, offsets[:-1])
            easy = np.repeat(whole, lengths) & (first != np.arange(len(uids)))
            ends = [np.stack([uids[first[easy]], uids[easy]], axis=1)]
            for k in np.flatnonzero(~whole & (lengths > 2)):
                at = slice(offsets[k], offsets[k + 1])
                if edges := _forest(uids[at], briefs[at], matches):
                    ends.append(np.array(edges, np.int64))
            out = np.unique(np.concatenate(ends), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    return lists.filter(F.size("members") > 1).select("members").mapInArrow(run, "a long, b long").distinct()


def _links(members: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that connect just the sets (sorted, of different hashes) linked, directly or by others, by ``percent`` of their union, as few as it takes.

    The sets' shingles are numbered; from a set, the shingles it shares with each set of a size that can be similar enough are counted in one pass.
    """
    order = np.argsort([len(m) for m in members], kind="stable")
    sizes = np.array([len(members[k]) for k in order])
    at = np.concatenate([[0], np.cumsum(sizes)])
    number = np.unique(np.concatenate([members[k] for k in order]), return_inverse=True)[1]
    hit = np.zeros(int(number.max(initial=-1)) + 1, bool)
    edges, left = [], np.ones(len(order), bool)
    for seed in range(len(order)):
        if not left[seed]:
            continue
        left[seed] = False
        frontier = [seed]
        while frontier and left.any():
            x = frontier.pop()
            own = number[at[x] : at[x + 1]]
            low = int(np.searchsorted(100 * sizes, percent * sizes[x], "left"))
            high = int(np.searchsorted(percent * sizes, 100 * sizes[x], "right"))
            if not left[low:high].any():
                continue
            hit[own] = True
            shared = np.add.reduceat(hit[number[at[low] : at[high]]], at[low:high] - at[low], dtype=np.int64)
            hit[own] = False
            near = low + np.flatnonzero(left[low:high] & (100 * shared >= percent * (sizes[low:high] + sizes[x] - shared)))
            left[near] = False
            edges += [(int(order[x]), int(order[y])) for y in near]
            frontier += near.tolist()
    return edges


def _family_sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(d1, d2, shingles) of the documents of ``members`` (first, d1, d2), once each.

    Documents are read again, and those whose id is not in a filter of bounded size are passed over in place, so that no text is shuffled.
    """
    bits = 1 << 15
    wanted = 16 * members.count()
    while bits < min(wanted, FILTER_BITS):
        bits *= 2
    place = lambda key: F.pmod(F.xxhash64(key), F.lit(bits))
    spots = members.select(place(F.col("first")).alias("p")).distinct().withColumn("bucket", F.floor(F.col("p") / 32768))
    built = spots.groupBy("bucket").agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits")).collect()  # at most FILTER_BITS bits
    table = np.zeros(bits // 8, np.uint8)
    for row in built:
        table[row["bucket"] * 4096 : row["bucket"] * 4096 + 4096] = np.frombuffer(row["bits"], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p").to_numpy()
            some = batch.filter(pa.array((table[p >> 3] >> (p & 7)) & 1 > 0))
            data, offsets = flat(some.column("text"))
            for a, b in chunks(offsets):
                hashes, at = _sets(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], size)
                digest = _digests(hashes, at)
                sets = pa.LargeListArray.from_arrays(pa.array(at), pa.array(hashes.view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(digest[:, 0]), pa.array(digest[:, 1]), sets], ["d1", "d2", "shingles"])

    made = docs.select(place(F.col("doc_id")).alias("p"), "text").mapInArrow(run, "d1 long, d2 long, shingles array<long>")
    return made.join(members.select("d1", "d2"), ["d1", "d2"], "left_semi").dropDuplicates(["d1", "d2"])


def confirmed_edges(docs: DataFrame, families: DataFrame, percent: int, size: int) -> DataFrame:
    """(a, b): edges that connect just the classes whose whole shingle sets are linked, directly or by others.

    ``families`` has (uid, family, first, d1, d2, n_shingles); links lie within a family. Its sets meet in one task, those of a family of more than ``SET_BLOCK`` shingles
    by pairs of blocks; small families share tasks. So a task holds no more than about two blocks, or two texts that are larger.
    """
    sizes = families.groupBy("family").agg(F.sum("n_shingles").alias("held"))
    total = sizes.agg(F.sum("held")).first()[0] or 0
    tasks = max(1, -(-total // SET_BLOCK))
    blocks = sizes.select("family", F.ceil(F.col("held") / SET_BLOCK).cast("int").alias("blocks"))
    dealt = families.join(blocks, "family").join(_family_sets(docs, families, size), ["d1", "d2"])
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("uid"), F.col("blocks"))).otherwise(-1).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(-1)))))
    task = F.when(F.col("blocks") > 1, F.col("family")).otherwise(F.pmod(F.xxhash64("family"), F.lit(tasks)))
    units = dealt.select(task.alias("task"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "family", "uid", "shingles")

    def run(rows: pa.Table) -> pa.Table:
        family, uid = rows.column("family").to_numpy(), rows.column("uid").to_numpy()
        column = rows.column("shingles").combine_chunks()
        values, at = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
        order = np.argsort(family, kind="stable")
        cuts = np.flatnonzero(np.diff(family[order], prepend=family[order][:1] - 1, append=family[order][-1:] + 1))
        edges: list[tuple[int, int]] = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = order[a:b]
            edges += [(uid[own[x]], uid[own[y]]) for x, y in _links([values[at[k] : at[k + 1]].view(np.uint64) for k in own], percent)]
        ends = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return units.groupBy("task", "i", "j").applyInArrow(run, "a long, b long").distinct()


def minhash_groups(docs: DataFrame, percent: int = PERCENT, size: int = WORDS, coordinates: int = COORDINATES, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text, any others).

    Two documents are linked if their shingle sets share at least ``percent`` of their union, which is checked on the whole sets; ``component_id`` is the least id reachable over links, and ``kept``
    holds where this is the row's own. Equal sets are one class and never paired. A pair of exactly that similarity fails to become a candidate
    with a chance of ``miss``, more similar ones with less. Documents without words are linked with nothing and keep their own id. Null ids name a
    group only if it has no other; repeated rows come out as often as they come in. An empty table gives no rows.
    """
    rows = cut_lineage(signatures(docs, size, coordinates), "signatures")
    any_ = [F.any_value(c).alias(c) for c in ("n_shingles", "signature", "brief")]
    classes = rows.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), *any_)
    classes = cut_lineage(classes.withColumn("uid", F.monotonically_increasing_id()), "shingle-sets")
    near = components(candidate_edges(classes, coordinates, least_matches(percent, coordinates, miss))).select(F.col("node").alias("uid"), F.col("root").alias("family"))
    families = cut_lineage(classes.select("uid", "first", "d1", "d2", "n_shingles").join(near, "uid"), "families")
    linked = components(confirmed_edges(docs, families, percent, size)).select(F.col("node").alias("uid"), "root")
    joined = cut_lineage(families.join(linked, "uid").select("d1", "d2", "root", "first"), "linked")
    least = joined.groupBy("root").agg(F.min("first").alias("least"))
    named = classes.select("d1", "d2", "first").join(joined.join(least, "root").select("d1", "d2", "least"), ["d1", "d2"], "left")
    named = named.select("d1", "d2", F.coalesce("least", "first").alias("component"))
    out = rows.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

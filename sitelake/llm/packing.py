"""Packing documents into training sequences: best fit, then local search by exchanges between underfull bins."""

from __future__ import annotations

import json
import re
import sys
import types
from array import array
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from sitelake.session import cut_lineage

#: Production parameters: tokens of a sequence, the id that ends a document, pieces that one task packs together.
CAPACITY = 1024
END = 2
GROUP = 16_384
_CACHE = 200_000

# White space as the tokenizers' patterns take it. A run of other characters with at most one space before it never shares a token with what stands around it.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNKS = re.compile(f" ?[^{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")


# Fixed value: how the byte-level tokenizer cuts a text before merging.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _merger(path: str):
    """Ids of one chunk. Where ids follow the order of merges, as in byte-level vocabularies of this kind, the ranks of the same file are merged by the
    faster library; other tokenizers run themselves."""
    spec = json.loads(Path(path).read_text())
    vocabulary = spec["model"].get("vocab") or {}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    own = {t["content"] for t in spec.get("added_tokens", [])}
    ordinary = {t: i for t, i in vocabulary.items() if t not in own}
    pairs = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"].get("merges", [])]
    known = spec["model"].get("type") == "BPE" and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and not spec.get("normalizer")
    if known and len(pairs) + 256 == len(ordinary) and all(ordinary.get(p) == 256 + i for i, p in enumerate(pairs)):
        import tiktoken

        ranks = {bytes(letters[c] for c in t): i for t, i in ordinary.items()}
        return tiktoken.Encoding("ranks", pat_str=_CUTS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    tokenizer = Tokenizer.from_file(path)
    return lambda chunk: tokenizer.encode(chunk, add_special_tokens=False).ids


class _Encoder(dict):
    """Ids of chunks as bytes (little-endian unsigned 32 bits each), remembered up to a bound; ids equal those of the tokenizer on the whole text."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = _merger(path)

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = self._bytes(self.merge(chunk))
        return ids

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.specials):  # these may take what stands around them
            return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self) > _CACHE:
            self.clear()
        return b"".join(map(self.__getitem__, _CHUNKS.findall(text)))

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if sys.byteorder == "little" else b"".join(i.to_bytes(4, "little") for i in ids)


def _encoder(path: str) -> _Encoder:
    """One for each worker process, whatever number of tasks it runs."""
    held = sys.modules.setdefault("_sitelake_encoders", types.ModuleType("_sitelake_encoders")).__dict__
    if path not in held:
        held[path] = _Encoder(path)
    return held[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(pid, doc_id, piece, start, length, ids) of every row of ``docs`` (doc_id, text, any others), as a written table.

    ``ids`` are the tokens of the whole text (null: empty) and then ``end``, as little-endian unsigned 32-bit numbers. Rows longer than ``capacity`` are cut; all pieces but
    the first are full. ``pid`` numbers pieces, so repeated rows and null ids stay apart. ``tokenizer`` is the path of a tokenizers file, readable by
    the workers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pid, last = _encoder(tokenizer), TaskContext.get().partitionId() << 40, end.to_bytes(4, "little")
        for batch in batches:
            names, rows, size = batch.column("doc_id"), [], 0
            for i, text in enumerate(batch.column("text")):
                ids = encoder.ids(text.as_py() or "") + last
                count, begin, piece = len(ids) // 4, 0, 0
                while begin < count:
                    stop = begin + (count - begin - 1) % capacity + 1
                    rows.append((pid, i, piece, begin, stop - begin, ids[4 * begin : 4 * stop]))
                    pid, begin, piece = pid + 1, stop, piece + 1
                size += len(ids)
                if size > 4 << 20 or i + 1 == batch.num_rows:
                    pids, at, pieces, starts, lengths, data = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pids, pa.int64()), names.take(pa.array(at)), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(data, pa.binary())],
                        ["pid", "doc_id", "piece", "start", "length", "ids"],
                    )
                    rows, size = [], 0

    key = docs.schema["doc_id"].dataType.simpleString()
    shape = f"pid long, doc_id {key}, piece int, start long, length long, ids binary"
    return cut_lineage(docs.select("doc_id", "text").mapInArrow(run, shape), "pieces")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: items by falling size, each into the bin that it fills most."""
    room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    some, bins = 0, []  # bit r of ``some``: there is a bin with room r
    for item in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[item]
        fitting = some >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            bin_ = room[left].pop()
            if not room[left]:
                some &= ~(1 << left)
        else:
            left, bin_ = capacity, []
            bins.append(bin_)
        bin_.append(item)
        room[left - size].append(bin_)
        if left > size:
            some |= 1 << (left - size)
    return bins


def _exchange(source: list[int], target: list[int], sizes: list[int], room: int) -> tuple[int, list[int], list[int]] | None:
    """The exchange that raises the target most, by at most ``room``: (gain, items to the target, items back)."""
    best = None
    for i, a in enumerate(source):
        for more in (None, *source[i + 1 :]):
            given = sizes[a] + (0 if more is None else sizes[more])
            if given <= room and more is None and (best is None or given > best[0]):
                best = (given, [a], [])
            for b in target:
                gain = given - sizes[b]
                if 0 < gain <= room and (best is None or gain > best[0]):
                    best = (gain, [a] if more is None else [a, more], [b])
            if best and best[0] == room:
                return best
    return best


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Exchange one for one, two for one, or move items between underfull bins as long as the sum of squared fills grows; bins that empty go.

    The least filled bin gives to fuller ones, fullest first, in exchanges that leave the fuller one fuller still, until it is empty or gives no more; then the next one
    gives. Every exchange from a bin to one at least as full raises the sum of squares, so the search ends.
    """
    full = [b for b in bins if sum(sizes[i] for i in b) >= capacity]
    open_ = sorted(([sum(sizes[i] for i in b), b] for b in bins if sum(sizes[i] for i in b) < capacity), key=lambda x: x[0])
    stuck = 0
    while stuck < min(8, len(open_)):
        fill, source = open_[stuck]
        gave = False
        for other in reversed(open_[stuck + 1 :]):
            if other[0] >= capacity or not source:
                continue
            # A target is at least as full as the source, which only loses.
            found = _exchange(source[:12], other[1], sizes, capacity - other[0])
            if found:
                gain, given, back = found
                for item in given:
                    source.remove(item)
                    other[1].append(item)
                for item in back:
                    other[1].remove(item)
                    source.append(item)
                other[0] += gain
                fill -= gain
                gave = True
        open_[stuck][0] = fill
        full += [b for f, b in open_ if f >= capacity]
        open_ = sorted((x for x in open_ if 0 < x[0] < capacity), key=lambda x: x[0])
        stuck = 0 if gave else stuck + 1
    return full + [b for _, b in open_]


def _packed(capacity: int):
    def run(pieces: pa.Table) -> pa.Table:
        pids, sizes = pieces.column("pid").to_pylist(), pieces.column("length").to_pylist()
        order = sorted(range(len(pids)), key=pids.__getitem__)  # the same bins whatever order rows arrive in
        pids, sizes = [pids[i] for i in order], [sizes[i] for i in order]
        bins = local_search(best_fit(sizes, capacity), sizes, capacity)
        out: dict[str, list] = {"pid": [], "length": [], "sequence": [], "at": [], "fill": []}
        for b in bins:
            place, total = 0, sum(sizes[i] for i in b)
            for i in b:
                for name, value in zip(out, (pids[i], sizes[i], pids[b[0]], place, total)):
                    out[name].append(value)
                place += sizes[i]
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(pid, sequence_id, offset) of every piece (pid, length up to ``capacity``).

    A full piece is a sequence of its own. The others are dealt out at random, about ``group`` to a task, packed by best fit and improved by local search. What
    stands in bins that stay underfull is dealt out again, to fewer tasks, as long as that at least halves it; so no more than the last groups' bins
    are underfull for want of partners. A sequence is named by its first piece.
    """
    shape = "pid long, length long, sequence long, at long, fill long"
    done = [pieces.filter(F.col("length") >= capacity).select("pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = pieces.filter(F.col("length") < capacity).select("pid", "length")
    left, turn = rest.count(), 0
    while left:
        groups = -(-left // group)
        dealt = rest.withColumn("group", F.pmod(F.xxhash64("pid", F.lit(turn)), F.lit(groups)))
        packed = cut_lineage(dealt.groupBy("group").applyInArrow(_packed(capacity), shape), "packed")
        open_ = packed.filter(F.col("fill") < capacity)
        before, left = left, open_.count()
        again = groups > 1 and left * 2 <= before
        kept = packed.filter(F.col("fill") >= capacity) if again else packed
        done.append(kept.select("pid", F.col("sequence").alias("sequence_id"), F.col("at").alias("offset")))
        if not again:
            break
        rest, turn = open_.select("pid", "length"), turn + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every piece of every document with its ids and its place: pid, doc_id, piece, start, length, ids, sequence_id, offset.

    Null and empty texts are the one token ``end``; an empty table gives no rows; see ``token_pieces`` and ``place_pieces``.
    """
    pieces = token_pieces(docs, tokenizer, capacity, end)
    return pieces.join(place_pieces(pieces, capacity), "pid")


def pack_digest(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The same with a checksum in place of the ids, which then needn't be shuffled: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer, capacity, end)
    digest = pieces.select("pid", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digest.join(place_pieces(pieces, capacity), "pid").drop("pid")

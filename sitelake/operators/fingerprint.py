"""Folder hashes in the layout of git trees, deepest folders first, up to one root hash per site.

A folder's hash covers the sorted list of its entries, one after the other. The entries of all folders of a level are dealt
out in ranges of their order, so a folder of any size spreads over as many tasks as it takes, and each task streams through its
range: a folder that lies within one range is hashed as it passes. Only folders that cross a border, fewer than there are
ranges, take a second step: their ranges hand over ordered pieces, over which one stream per folder runs. No task holds a folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake import fixed_values as fv
from sitelake.functions.hashing import as_bytes, tree_entry
from sitelake.functions.paths import base_name
from sitelake.operators.extract import ancestor_dirs
from sitelake.session import cut_lineage

_KEYS = ["site", "dir"]
#: Bytes of a piece that a folder across a border hands over; any number gives the same hashes.
PIECE = 8_192


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _depth(folder: Column) -> Column:
    return F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/")))


def _entry(name: Column, mode: Column, sha: Column, is_folder: bool) -> dict[str, Column]:
    """Sort key and bytes of an entry; folders sort as if their name ended in a slash."""
    return {
        "sort_key": F.concat(name, F.lit("/")) if is_folder else name,
        "entry": tree_entry(mode, name, sha),
    }


def _file_entries(tree: DataFrame) -> DataFrame:
    mode = F.ltrim(F.coalesce("mode", F.lit(fv.FILE_MODE)), F.lit("0"))
    name = base_name(F.col("path"))
    dir_ = _parent(F.col("path"))
    rows = tree.select("site", dir_.alias("dir"), _depth(dir_).alias("depth"), name.alias("name"), mode.alias("mode"), "sha")
    return rows.withColumns(_entry(F.col("name"), F.col("mode"), F.col("sha"), False)).select(
        "site", "dir", "depth", "sort_key", "entry"
    )


def _folder_entries(hashed: DataFrame) -> DataFrame:
    """Folders (site, dir, sha) as entries of the folders that hold them; the root is held by none."""
    below = hashed.filter("dir <> ''")
    name, dir_ = base_name(F.col("dir")), _parent(F.col("dir"))
    rows = below.select("site", dir_.alias("dir"), _depth(dir_).alias("depth"), name.alias("name"), "sha")
    return rows.withColumns(_entry(F.col("name"), F.lit(fv.FOLDER_MODE), F.col("sha"), True)).select(
        "site", "dir", "depth", "sort_key", "entry"
    )


# --- one level ------------------------------------------------------------------------------------


def _segments(batch: pa.RecordBatch, column: str) -> Iterator[tuple[tuple, int, int, memoryview]]:
    """Runs of rows of one folder: (site and dir, first row, row after the last, the bytes of ``column`` in between)."""
    sites, dirs = batch.column("site").to_pylist(), batch.column("dir").to_pylist()
    data = batch.column(column).cast(pa.large_binary())
    _, offsets, values = data.buffers()
    at = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1]
    view = memoryview(values) if values is not None else memoryview(b"")
    first = 0
    for row in range(1, len(sites) + 1):
        if row == len(sites) or sites[row] != sites[first] or dirs[row] != dirs[first]:
            yield (sites[first], dirs[first]), first, row, view[at[first] : at[row]]
            first = row


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash what passes, a head and then its folder's entries in order; a folder that is not whole here gets no hash."""
    key, state, due = None, None, 0
    out: list[tuple] = []

    def close() -> None:
        if key is not None:
            out.append((*key, state.hexdigest() if state is not None and due == 0 else None))

    for batch in batches:
        heads = batch.column("due")
        for name, first, _, data in _segments(batch, "entry"):
            if name != key:
                close()
                # Without a head the folder began in an earlier range.
                key, due = name, heads[first].as_py()
                state = None if due is None else hashlib.sha1()
            if state is not None:
                state.update(data)
                due -= len(data)
        if out:
            yield _hashes(out)
            out.clear()
    close()
    yield _hashes(out)


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["site", "dir", "sha"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's entries as pieces (site, dir, part, number, piece), a folder's pieces in order of part and number."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        sites, dirs, numbers, pieces = [], [], [], []
        for (site, dir_), _, _, data in _segments(batch, "entry"):
            for k in range(0, len(data), PIECE):
                sites.append(site)
                dirs.append(dir_)
                numbers.append(number)
                pieces.append(bytes(data[k : k + PIECE]))
                number += 1
        columns = [pa.array(sites, pa.string()), pa.array(dirs, pa.string()), pa.array([part] * len(sites), pa.int32()), pa.array(numbers, pa.int64()), pa.array(pieces, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["site", "dir", "part", "number", "piece"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each folder whose pieces pass, one folder after the other."""
    key, state = None, None
    out: list[tuple] = []
    for batch in batches:
        for name, _, _, data in _segments(batch, "piece"):
            if name != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = name, hashlib.sha1()
            state.update(data)
    if key is not None:
        out.append((*key, state.hexdigest()))
    yield _hashes(out)


_SHAPE = "site string, dir string, sha string"


def _ranged(rows: DataFrame, ranges: int | None) -> DataFrame:
    order = [*_KEYS, F.col("due").isNull(), "sort_key", "entry"]
    dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order)


def _level(entries: DataFrame, ranges: int | None) -> DataFrame:
    """Folder hashes (site, dir, sha) of the entries (site, dir, sort_key, entry) of folders that do not hold one another."""
    # A folder's head, with the length of all its entries, is its first row; ``due`` is the number of bytes that must follow for a whole folder.
    length = F.sum(F.octet_length("entry").cast("long")).alias("length")
    head = F.concat(as_bytes(F.concat(F.lit("tree "), F.col("length").cast("string"))), F.unhex(F.lit("00")))
    heads = entries.groupBy(*_KEYS).agg(length).select(*_KEYS, F.lit("").alias("sort_key"), head.alias("entry"), "length")
    rows = entries.select(*_KEYS, "sort_key", "entry", F.lit(None).cast("long").alias("due")).unionByName(
        heads.select(*_KEYS, "sort_key", "entry", (F.col("length") + F.octet_length("entry")).alias("due"))
    )
    folded = cut_lineage(_ranged(rows, ranges).mapInArrow(_fold, _SHAPE), "folder-hashes")
    # A whole folder has one row; of one across a border each range it touches gives a row without a hash: two a range at most.
    across = folded.filter("sha is null").select(F.col("site").alias("_site"), F.col("dir").alias("_dir")).distinct()
    if across.isEmpty():
        return folded
    across = cut_lineage(across, "border-folders")
    met = rows["site"].eqNullSafe(across["_site"]) & (rows["dir"] == across["_dir"])
    pieces = cut_lineage(
        _ranged(rows.join(across, met, "left_semi"), ranges).select(*_KEYS, "entry").mapInArrow(_cut, f"{_KEYS[0]} string, {_KEYS[1]} string, part int, number long, piece binary"),
        "folder-pieces",
    )
    ordered = pieces.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "part", "number")
    joined = cut_lineage(ordered.select(*_KEYS, "piece").mapInArrow(_joined, _SHAPE), "folder-hashes")
    return folded.filter("sha is not null").unionByName(joined)


def _fold_up(entries: DataFrame, ranges: int | None) -> DataFrame:
    """Hashes of all folders of the entries (site, dir, depth, sort_key, entry), level by level from the deepest up.

    Each level adds its folders as entries to the level above; there are as many rounds as the paths are deep.
    """
    deepest = entries.agg(F.max("depth")).first()[0]
    if deepest is None:
        return entries.select(*_KEYS, F.lit("").alias("sha"))
    columns = [*_KEYS, "sort_key", "entry"]
    levels: list[DataFrame] = []
    for depth in range(deepest, -1, -1):
        own = entries.filter(F.col("depth") == depth).select(*columns)
        if levels:
            own = own.unionByName(_folder_entries(levels[-1]).select(*columns))
        levels.append(_level(own, ranges))
    done = levels[0]
    for level in levels[1:]:
        done = done.unionByName(level)
    return done


def tree_fingerprint(tree: DataFrame, ranges: int | None = None) -> DataFrame:
    """Published tree (site, path, sha, mode) to folder hashes (site, dir, sha); the root folder is ''.

    ``ranges`` is the number of ranges the entries of a level are dealt into, by default that of the session's shuffle partitions; the hashes are the same
    for any number.
    """
    return _fold_up(cut_lineage(_file_entries(tree), "tree-entries"), ranges)


# --- keeping fingerprints up to date ----------------------------------------------------------------


def changed_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """(site, path) that were added, removed, or have another content or mode; of trees (site, path, sha, mode)."""

    def named(tree: DataFrame, name: str) -> DataFrame:
        return tree.select("site", "path", F.struct("sha", F.coalesce("mode", F.lit(fv.FILE_MODE)).alias("mode")).alias(name))

    both = named(before, "old").join(named(after, "new"), ["site", "path"], "full_outer")
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).select("site", "path")


def updated_fingerprint(nodes: DataFrame, before: DataFrame, after: DataFrame, ranges: int | None = None) -> DataFrame:
    """The fingerprint of ``after`` from the stored fingerprint ``nodes`` (site, dir, sha) of ``before``.

    Only folders above a changed path are hashed again: from their files in ``after``, their changed folders, and the stored
    hashes of their other folders. All other nodes are taken over. Equal to ``tree_fingerprint(after)``.
    """
    changed = changed_paths(before, after)
    touched = changed.select("site", F.explode(F.array_append(ancestor_dirs(F.col("path")), F.lit(""))).alias("dir")).distinct()
    touched = cut_lineage(touched, "touched-folders")
    kept = cut_lineage(nodes.select(*_KEYS, "sha").join(touched, _KEYS, "left_anti"), "kept-folders")
    beside = _folder_entries(kept).join(touched, _KEYS, "left_semi")
    files = _file_entries(after).join(touched, _KEYS, "left_semi")
    entries = cut_lineage(files.unionByName(beside), "tree-entries")
    return kept.unionByName(_fold_up(entries, ranges))


def root_hashes(fingerprints: DataFrame) -> DataFrame:
    return fingerprints.filter("dir = ''").select("site", F.col("sha").alias("root_sha"))

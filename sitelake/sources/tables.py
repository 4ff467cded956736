"""Sources and sinks of the engine's tables."""

from __future__ import annotations

import os
import re
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelake import fixed_values as fv
from sitelake.functions.text import entity_decode, lines
from sitelake.operators.crawl import crawl_reach
from sitelake.operators.extract import with_site
from sitelake.session import cut_lineage, new_folder

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
# A recursive listing of a remote snapshot: one document per site.
TREE = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("sha", T.StringType()),
        T.StructField("truncated", T.BooleanType()),
        T.StructField(
            "tree",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("path", T.StringType()),
                        T.StructField("mode", T.StringType()),
                        T.StructField("type", T.StringType()),
                        T.StructField("sha", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages with site, base and page_path."""
    return with_site(spark.read.schema(PAGES).parquet(path))


def text_lines(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """Trimmed non-empty lines of a text column."""
    return rows.select(*keys, F.explode(lines(F.col(text))).alias("row"))


def _task_count(spark: SparkSession) -> int:
    """Tasks over which names and files are dealt out."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def read_file_tree(spark: SparkSession, folder: str, site: str | None = None) -> DataFrame:
    """All files below a folder as files(site, path, body BINARY, size); without ``site`` the first folder names it.

    Tasks list the folders and read the files, so neither names nor splits pass through the driver. As with Spark's file readers, which read stores that tasks cannot open by
    themselves, files without a byte and hidden ones are left out. A folder without a scheme is looked for in the local store first.
    """
    whole = folder if ":" in folder.split("/")[0] else os.path.abspath(folder)
    try:
        store, top = _store_of(whole)
        listed = store.get_file_info(top).type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        listed = False
    below = _bodies(_listed_by_tasks(spark, whole), whole) if listed else _listed_by_spark(spark, folder)
    if site is not None:
        return below.select(F.lit(site).alias("site"), "path", "body", "size")
    parts = F.split("path", "/", 2)
    return below.select(F.get(parts, F.lit(0)).alias("site"), F.get(parts, F.lit(1)).alias("path"), "body", "size")


def _listed_by_spark(spark: SparkSession, folder: str) -> DataFrame:
    """(path below the folder, body, size) of all files that Spark's reader lists there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = "/" + folder.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    return files.select(
        F.substr("path", F.locate(root, F.col("path")) + len(root)).alias("path"), F.col("content").alias("body"), F.col("length").alias("size")
    )


def _passed_over(name: str, is_folder: bool) -> bool:
    """Whether Spark's readers pass over a file or folder of this name."""
    if is_folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name[0] == "." or (name[0] == "_" and "=" not in name) or name.endswith("._COPYING_")


#: Entries of folders after which a task leaves the folders it has found to the next round.
_LISTED = 1000
#: Rows of a batch that a task returns at once.
_ROWS = 10_000


def _listed_by_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """(path below the folder, size) of all files there with a byte that Spark's readers do not pass over.

    A round lists the folders that the last one found, dealt out over all tasks; it goes down a level at least, and further while a task has listed little.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store_of(folder)
        top = top.rstrip("/")
        rows: list[tuple[str, int | None]] = []
        seen = 0

        def batch_of(rows: list[tuple[str, int | None]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path for path, _ in rows], pa.string()), pa.array([size for _, size in rows], pa.int64())], ["path", "size"])

        for batch in batches:
            waiting = deque(batch.column("path").to_pylist())
            given = len(waiting)
            while waiting:
                at = waiting.popleft()
                given -= 1
                for info in store.get_file_info(fs.FileSelector(f"{top}/{at}".rstrip("/") or "/")):
                    is_folder = info.type == fs.FileType.Directory
                    seen += 1
                    if _passed_over(info.base_name, is_folder):
                        continue
                    path = f"{at}/{info.base_name}" if at else info.base_name
                    if is_folder and seen < _LISTED:
                        waiting.append(path)
                    elif is_folder:
                        rows.append((path, None))
                    elif info.type == fs.FileType.File and info.size:
                        rows.append((path, info.size))
                # What was given is listed in any case.
                if given <= 0 and seen >= _LISTED:
                    rows += [(path, None) for path in waiting]
                    waiting.clear()
                while len(rows) >= _ROWS:
                    yield batch_of(rows[:_ROWS])
                    rows = rows[_ROWS:]
        if rows:
            yield batch_of(rows)

    found, depth = new_folder(spark, "listing"), 0
    waiting = spark.range(1).select(F.lit("").alias("path"))
    while depth == 0 or not waiting.isEmpty():
        waiting.mapInArrow(run, "path string, size long").write.parquet(f"{found}/round={depth}")
        waiting = spark.read.schema("path string, size long").parquet(f"{found}/round={depth}").filter("size is null").select("path").repartition(_task_count(spark))
        depth += 1
    return spark.read.schema("path string, size long, round int").parquet(found).filter("size is not null").select("path", "size")


def _bodies(names: DataFrame, folder: str) -> DataFrame:
    """(path, body, size) of the files (path, size) below a folder, read by all tasks; no more than a file and a piece are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store_of(folder)
        top = top.rstrip("/")
        types = (pa.string(), pa.binary(), pa.int64())
        for batch in batches:
            found: list[tuple[str, bytes, int]] = []
            held = 0
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(f"{top}/{path}", compression=None) as stream:
                    body = stream.read()
                found.append((path, body, len(body)))
                held += len(body)
                if held > _PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types, strict=True)], ["path", "body", "size"])
                    found, held = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types, strict=True)], ["path", "body", "size"])

    return names.select("path").repartition(_task_count(names.sparkSession)).mapInArrow(run, "path string, body binary, size long")


def write_file_tree(files: DataFrame, folder: str) -> DataFrame:
    """Write files (site, path, body as text or BINARY) one by one below a folder that all executors reach, as ``<folder>/<site>/<path>``; (site, path, size) of those written.

    For an export that is served as files; tables are stored by ``write_snapshot``. A file is written beside its place and then moved there, so a task that runs
    again leaves the same files. Paths that lead out of the folder are left out. The result is lazy: files are written as it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store_of(folder)
        for batch in batches:
            sizes = []
            for row in batch.to_pylist():
                place = f"{top}/{row['site']}/{row['path']}"
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                part = f"{place}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(row["body"])
                store.move(part, place)
                sizes.append(len(row["body"]))
            yield pa.RecordBatch.from_arrays([batch.column("site"), batch.column("path"), pa.array(sizes, pa.int64())], ["site", "path", "size"])

    inside = files.filter(~F.concat(F.lit("/"), "site", F.lit("/"), "path", F.lit("/")).contains("/../") & F.col("body").isNotNull())
    return inside.select("site", "path", F.col("body").cast("binary").alias("body")).mapInArrow(run, "site string, path string, size long")


def tree_entries(documents: DataFrame) -> DataFrame:
    """Snapshot documents (schema ``TREE``) to baseline(site, path, sha, mode): files only."""
    entries = documents.select("site", F.inline("tree"))
    kept = entries.filter("type = 'blob' and path is not null and sha is not null")
    return kept.select("site", "path", "sha", F.coalesce("mode", F.lit(fv.FILE_MODE)).alias("mode"))


def parse_trees(rows: DataFrame, column: str) -> DataFrame:
    """Snapshot documents held as JSON text in a column."""
    return rows.select(F.from_json(F.col(column), TREE).alias("d")).select("d.*")


def read_tree_documents(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot documents, one JSON document per line."""
    return spark.read.schema(TREE).json(path)


def tree_meta(documents: DataFrame) -> DataFrame:
    """baseline_meta(site, tree_sha, truncated)."""
    return documents.select(
        "site", F.col("sha").alias("tree_sha"), F.coalesce("truncated", F.lit(False)).alias("truncated")
    )


def _first_loc(tag: str) -> Column:
    return F.regexp_extract("value", rf"(?s)<{tag}(?:\s[^>]*)?>(?:(?!<{tag}[\s>]).)*?<loc>\s*([^<\s]+)\s*</loc>", 1)


def _sitemap_rows(spark: SparkSession, folder: str, tag: str) -> DataFrame:
    """(file, loc): the first ``loc`` of every element ``tag`` in the files below a folder, its entities decoded.

    A record ends where an element does, so a large file is split between tasks, and no task holds more than an element of it.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("lineSep", f"</{tag}>").text(folder)
    # Readers name local files with one slash after the scheme or with three.
    file = F.regexp_replace(F.col("_metadata.file_path"), "^([a-z0-9]+):/(?!/)", "$1:///")
    return rows.select(file.alias("file"), _first_loc(tag).alias("loc")).filter("loc <> ''").select("file", entity_decode(F.col("loc")).alias("loc"))


#: Bytes of a sitemap that a task reads at once.
_PIECE = 1 << 20


def _store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder that tasks reach, and the folder's name in it."""
    return fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)


def _elements(pieces: Iterator[bytes], tag: bytes) -> Iterator[bytes]:
    """What lies between an opening ``tag`` and the next closing one; no more than one element and a piece are held."""
    rest, begin, end = b"", b"<" + tag, b"</" + tag + b">"
    for piece in pieces:
        *whole, rest = (rest + piece).split(end)
        yield from (part[part.index(begin) :] for part in whole if begin in part)
        rest = rest[at:] if (at := rest.find(begin)) >= 0 else rest[-len(end) :]
    if begin in rest:
        yield rest


def _named_locs(names: DataFrame, folder: str) -> DataFrame:
    """(file, tag, loc) of the files of these names (file) below a folder, as ``_sitemap_rows`` finds them for both tags. Each task opens its files, so no listing passes through the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store_of(folder)
        bare = lambda name: re.sub(r"^[a-z0-9]+:/*", "", unquote(name)).strip("/")
        inside = f"{bare(folder)}/"

        def place(name: str) -> str | None:
            """The file in the store, unless it lies elsewhere or Spark's readers would not list it there."""
            below = bare(name).removeprefix(inside)
            if not bare(name).startswith(inside) or any(part in ("", "..") or part[0] == "." or (part[0] == "_" and "=" not in part) for part in below.split("/")):
                return None
            return f"{top.rstrip('/')}/{below}"

        for batch in batches:
            found: list[tuple[str, str, bytes]] = []
            held = 0
            for name in batch.column("file").to_pylist():
                at = place(name) if name else None
                if at is None or store.get_file_info(at).type != fs.FileType.File:
                    continue
                for tag in ("sitemap", "url"):
                    with store.open_input_stream(at) as stream:
                        for text in _elements(iter(lambda: stream.read(_PIECE), b""), tag.encode()):
                            found.append((name, tag, text))
                            held += len(text)
                            if held > _PIECE:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types, strict=True)], ["file", "tag", "value"])
                                found, held = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types, strict=True)], ["file", "tag", "value"])

    types = (pa.string(), pa.string(), pa.binary())
    texts = names.select("file").repartition(_task_count(names.sparkSession)).mapInArrow(run, "file string, tag string, value binary").withColumn("value", F.col("value").cast("string"))
    locs = texts.select("file", "tag", F.when(F.col("tag") == "url", _first_loc("url")).otherwise(_first_loc("sitemap")).alias("loc"))
    return locs.filter("loc <> ''").select("file", "tag", entity_decode(F.col("loc")).alias("loc"))


def read_sitemaps(spark: SparkSession, folder: str, locate: Callable[[Column], Column], roots: DataFrame) -> DataFrame:
    """Page entries of all sitemaps that the root sitemaps lead to: (file, loc, depth).

    The folder holds captured sitemap files. An index lists further sitemaps, which may be indexes again: from ``roots`` (file), children are followed until no
    new file is reached; ``locate`` turns an entry's URL into the name of its file, as ``_metadata.file_path`` gives it. Files that lead to one another are
    read once, entries of files that no root leads to are left out. Names of local files begin with ``file:///``. ``depth`` is the least number of indexes above a file.

    A round reads the files that the last one found, by name and in tasks; a list of all files, which Spark's readers gather in the driver, is only made in stores
    that tasks cannot open by themselves.
    """
    try:
        _store_of(folder)
    except (pa.ArrowException, OSError):
        return _listed_sitemaps(spark, folder, locate, roots)
    top, depth = new_folder(spark, "sitemap-entries"), 0
    new = known = cut_lineage(roots.select("file").distinct(), "sitemap-files")
    while depth == 0 or not new.isEmpty():
        _named_locs(new, folder).write.parquet(f"{top}/depth={depth}")
        rows = spark.read.schema("file string, tag string, loc string").parquet(f"{top}/depth={depth}")
        children = rows.filter("tag = 'sitemap'").select(locate(F.col("loc")).alias("file")).distinct()
        new = cut_lineage(children.join(known, "file", "left_anti"), "sitemap-files")
        known, depth = known.unionByName(new), depth + 1
    return spark.read.schema("file string, tag string, loc string, depth int").parquet(top).filter("tag = 'url'").select("file", "loc", "depth")


def _listed_sitemaps(spark: SparkSession, folder: str, locate: Callable[[Column], Column], roots: DataFrame) -> DataFrame:
    """As ``read_sitemaps``, over all files that Spark's readers list below the folder."""
    children = _sitemap_rows(spark, folder, "sitemap")
    entries = cut_lineage(_sitemap_rows(spark, folder, "url"), "sitemap-entries")
    edges = children.select(F.lit("").alias("site"), F.col("file").alias("src"), locate(F.col("loc")).alias("dst"))
    files = entries.select("file").union(children.select("file")).distinct().select(F.lit("").alias("site"), F.col("file").alias("url"))
    reached = crawl_reach(edges, roots.select(F.lit("").alias("site"), F.col("file").alias("url")), files)
    return entries.join(reached.select(F.col("url").alias("file"), "depth"), "file")


#: Folders of a stored snapshot. All paths of a site lie in one shard, so a list of sites prunes folders; files within it are as many as tasks wrote them.
SHARDS = 64


def site_shard(site: Column, shards: int = SHARDS) -> Column:
    """The shard of a site in a stored snapshot."""
    return F.pmod(F.xxhash64(site), F.lit(shards)).cast("int")


def write_snapshot(files: DataFrame, path: str, run: str, shards: int = SHARDS) -> None:
    """Files as rows of a table partitioned by run and shard of their site, not as one file each.

    A run writes its own folder and nothing else: written again, it leaves the same rows, whatever an earlier attempt left, and other
    runs stay. A large site's rows are spread over the tasks that hold them and are not gathered.
    """
    files.withColumn("shard", site_shard(F.col("site"), shards)).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/run={run}")


def read_snapshot(spark: SparkSession, path: str, run: str, columns: str) -> DataFrame:
    """One run of a stored snapshot with the given columns and ``shard``, by which folders are pruned."""
    return spark.read.schema(f"{columns}, shard int").parquet(f"{path}/run={run}")


def changed_only(files: DataFrame, old: str = "body", new: str = "new_body") -> DataFrame:
    """Rows whose new body differs from the old one; only these are written."""
    return files.filter(~F.col(new).eqNullSafe(F.col(old)))


def write_changed(files: DataFrame, path: str, run: str, shards: int = SHARDS) -> None:
    """The changed files of a run, as ``write_snapshot`` stores them."""
    write_snapshot(changed_only(files).select("site", "path", F.col("new_body").alias("body")), path, run, shards)


def write_findings(findings: DataFrame, broken: DataFrame, path: str) -> None:
    """The report as tables: one folder each for findings and broken links."""
    findings.write.mode("overwrite").parquet(f"{path}/findings")
    broken.write.mode("overwrite").parquet(f"{path}/broken_links")


def report_lines(findings: DataFrame, broken: DataFrame) -> DataFrame:
    """The report per site as ordered lines (site, section, rank, line): header with count, then the entries.

    Both inputs stand for a pass over all page texts: their lines are written down in one table, which is read for the counts and for
    the entries. Counts are one row per site; the entries keep their own order columns, so nothing is gathered.
    """
    sections = ((1, "BROKEN LINKS", "no internal link is broken"), (2, "SEO AUDIT", "no SEO finding"))
    links = broken.select("site", F.lit(1).alias("section"), F.concat("page_path", F.lit(" -> "), "ref").alias("line"))
    seo = findings.select("site", F.lit(2).alias("section"), F.concat(F.lit("["), "code", F.lit("] "), "page_path", F.lit(": "), "detail").alias("line"))
    entries = cut_lineage(links.unionByName(seo), "report")
    counts = entries.groupBy("site").agg(*[F.count_if(F.col("section") == number).alias(f"n{number}") for number, _, _ in sections])

    def row(number: int, rank: int, line: Column) -> Column:
        return F.struct(F.lit(number).alias("section"), F.lit(rank).alias("rank"), line.alias("line"))

    heads = F.array(*[row(number, 0, F.concat(F.lit(f"{title} ("), F.col(f"n{number}").cast("string"), F.lit(")"))) for number, title, _ in sections])
    empty = [F.when(F.col(f"n{number}") == 0, row(number, 1, F.lit(none))) for number, _, none in sections]
    each = F.concat(heads, F.filter(F.array(*empty), lambda r: r.isNotNull()))
    return counts.select("site", F.inline(each)).unionByName(entries.select("site", "section", F.lit(1).alias("rank"), "line"))


def write_report(lines_: DataFrame, path: str) -> None:
    """The report as text, sorted by site and section over all tasks."""
    lines_.orderBy("site", "section", "rank", "line").select("line").write.mode("overwrite").text(path)


def write_failed(failed: DataFrame, path: str) -> None:
    failed.write.mode("overwrite").parquet(path)

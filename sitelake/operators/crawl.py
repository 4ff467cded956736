"""Crawling as table work: split captures, find new URLs, follow links to a fixpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake import fixed_values as fv
from sitelake.functions.urls import is_crawlable, url_parts
from sitelake.session import BucketedTable, bucketed, cut_lineage


def capture_outcome() -> dict[str, Column]:
    """outcome (ok / failed / empty) and reason of a capture (status, error, body)."""
    error, status = F.col("error"), F.col("status")
    failed = error.isNotNull() | (status >= 400)
    return {
        "outcome": F.when(failed, "failed").when(F.col("body") == "", "empty").otherwise("ok"),
        "reason": F.when(error.isNotNull(), error).when(
            status >= 400, F.concat(F.lit("HTTP "), status.cast("string"))
        ),
    }


def capture_split(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures with a body, and failures with a reason; an empty body is neither."""
    marked = captures.withColumns(capture_outcome())
    ok = marked.filter("outcome = 'ok'").drop("outcome", "reason")
    failed = marked.filter("outcome = 'failed'").select("site", "url", "reason")
    return ok, failed


def crawlable(links: DataFrame, excludes: Column | None = None) -> DataFrame:
    """Links (site, base, url, ...) that may be crawled, with the URL in its normal form and its key.

    The URL is taken apart once, in a generator, so that the filters read plain columns.
    """
    parts = F.inline(F.transform(F.array("url"), lambda url: url_parts(url).dropFields("scheme")))
    apart = links.select("*", parts)
    allowed = apart.filter(is_crawlable(F.col("host"), F.col("path"), F.col("query"), F.col("site"), excludes))
    normal = allowed.withColumn("url", F.concat("base", "path")).drop("host", "path", "query")
    return normal.withColumn("url_key", F.md5("url"))


def new_urls(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Found URLs that were not seen before, one row each.

    Duplicates go first: a URL linked from everywhere is one row per task before the shuffle.
    """
    return found.select("site", "url_key", "url").distinct().join(
        seen.select("site", "url_key"), ["site", "url_key"], "left_anti"
    )


#: Bits of the filter that found URLs leave for those seen: 2 MB at most, whatever the number of either.
FILTER_BITS = 1 << 24
_BUCKET = 32_768  # bits that Spark's bitmap aggregate holds


def possibly_found(found: DataFrame, seen: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(site, url_key) of the seen URLs that may be among the found ones; all that are, and few others while ``found`` is small against ``bits``.

    The found keys set bits in bitmaps of fixed total size, which are broadcast; seen keys without their bit are passed over in place and
    never shuffled.
    """
    place = F.pmod(F.xxhash64("site", "url_key"), F.lit(bits))
    marks = found.select(place.alias("p")).distinct().groupBy(F.floor(F.col("p") / _BUCKET).alias("bucket"))
    bitmaps = marks.agg(F.bitmap_construct_agg(F.col("p") % _BUCKET).alias("bitmap"))
    marked = seen.select("site", "url_key", place.alias("p")).withColumn("bucket", F.floor(F.col("p") / _BUCKET))
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("p") % _BUCKET / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(byte, cast(p % 8 as int)) & 1") == 1
    return marked.join(F.broadcast(bitmaps), "bucket").withColumn("byte", byte).filter(is_set).select("site", "url_key")


def new_urls_of_many(found: DataFrame, seen: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """As ``new_urls`` for a seen table that is very much larger than what was found: only its possible matches are shuffled.

    The found URLs, distinct and narrow, are written once, as the filter and the join both read them.
    """
    fresh = cut_lineage(found.select("site", "url_key", "url").distinct(), "found")
    return fresh.join(possibly_found(fresh, seen, bits), ["site", "url_key"], "left_anti")


def dedupe_captures(captures: DataFrame, order: list[str]) -> DataFrame:
    """The first capture per (site, url_key) in the given total order; narrow columns only.

    A minimum per key is combined before the shuffle, so copies of one URL never meet in one task.
    """
    rest = [c for c in captures.columns if c not in ("site", "url_key", *order)]
    first = F.min(F.struct(*order, *rest)).alias("first")
    return captures.groupBy("site", "url_key").agg(first).select("site", "url_key", "first.*")


def crawl_progress(captures: DataFrame, seen: DataFrame) -> DataFrame:
    """Per site: URLs done, URLs seen (at least 1), failures."""
    done = captures.withColumns(capture_outcome()).groupBy("site").agg(
        F.count("*").alias("done"), F.count_if(F.col("outcome") == "failed").alias("failed")
    )
    known = seen.groupBy("site").agg(F.count("*").alias("n_seen"))
    return done.join(known, "site", "full_outer").select(
        "site",
        F.coalesce("done", F.lit(0)).alias("done"),
        F.greatest(F.lit(1), F.coalesce("n_seen", F.lit(0))).alias("total"),
        F.coalesce("failed", F.lit(0)).alias("failed"),
    )


def percent_done(current: Column, total: Column, status: Column) -> Column:
    """Progress in whole percent: at most 100, and 100 once the run is done."""
    share = F.round(100 * current / F.greatest(F.lit(1), total)).cast("int")
    return F.when(status == "done", 100).otherwise(F.least(F.lit(100), share))


def first_failures(failed: DataFrame, n: int = fv.FAILURES_SHOWN) -> DataFrame:
    """The failures shown in a report: the first ``n`` by site and URL."""
    return failed.orderBy("site", "url", "reason").limit(n)


def unvisited(frontier: DataFrame, links: DataFrame, visited: DataFrame) -> DataFrame:
    """(site, url) of the URLs that links lead to from the frontier and that were not visited.

    With links placed by (site, src), frontier and visited by (site, url), only the URLs found are shuffled, after
    repeats were combined in their tasks.
    """
    found = (
        frontier.select("site", F.col("url").alias("src"))
        .join(links, ["site", "src"])
        .select("site", F.col("dst").alias("url"))
        .distinct()
    )
    return found.join(visited.select("site", "url"), ["site", "url"], "left_anti")


def crawl_reach(edges: DataFrame, seeds: DataFrame, captured: DataFrame) -> DataFrame:
    """Breadth-first walk from the seeds over internal links among captured pages.

    edges(site, src, dst), seeds(site, url), captured(site, url) to reach(site, url, depth). One round
    per level of links. Links lie in buckets of their source; the URLs visited lie in buckets of their own, to which each
    round appends what it found under its depth. So neither is shuffled again: a round reads the last depth as its frontier,
    follows its links, and moves only the URLs these lead to. The walk ends when a round finds nothing new. Rounds are files in the
    shared folder: plans stay short and a lost executor costs one task.
    """
    spark = edges.sparkSession
    pages = captured.select("site", "url").distinct()
    inner = edges.select("site", "src", "dst").distinct().join(
        pages.withColumnRenamed("url", "dst"), ["site", "dst"], "left_semi"
    )
    start = seeds.select("site", "url").distinct().join(pages, ["site", "url"], "left_semi")
    visited = BucketedTable(spark, "reach", "site", "url", part="depth")
    links = None
    try:
        links = bucketed(inner, "reach-links", "site", "src")
        depth, rows = 0, visited.append(start.withColumn("depth", F.lit(0)))
        while not rows.filter(F.col("depth") == depth).isEmpty():
            new = unvisited(rows.filter(F.col("depth") == depth), links.rows(), rows)
            depth += 1
            rows = visited.append(new.withColumn("depth", F.lit(depth)))
    finally:
        # The rounds' files stay for the result; the catalog keeps nothing, whether the walk ended or failed.
        visited.drop()
        if links is not None:
            links.drop()
    return spark.read.schema("site string, url string, depth int").parquet(visited.folder)

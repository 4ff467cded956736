"""Incremental ingest, audit and language tallies over arriving captures.

A scheduled pass is one run with the trigger ``availableNow`` and the checkpoint of the runs before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from sitelake.config import SiteConfig
from sitelake.functions.urls import url_key
from sitelake.operators.audit import page_findings
from sitelake.operators.extract import with_site
from sitelake.operators.languages import slug_tally, slugs_of
from sitelake.session import cut_lineage
from sitelake.sources.tables import PAGES


def stream_pages(spark: SparkSession, folder: str, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Capture files as they arrive, with site, base and page_path."""
    reader = spark.readStream.schema(PAGES).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_site(reader.parquet(folder))


def _keyed(pages: DataFrame) -> DataFrame:
    return pages.select("site", url_key(F.col("url"), F.col("base")).alias("url_key"), "page_id", "url")


#: How long a URL is remembered. One that is captured again later counts as new, as a site's pages are worth another look by then.
LIFE = "90 days"
#: Keyed state lives on the executors' disks and in the checkpoint, not in their heaps.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KEY = ["site", "url_key"]
_ROW = "site string, url_key string, page_id bigint, url string"


def _first_in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each key among a task's rows the one of least page_id; no more than one row a key is held."""

    def least(rows: pa.Table) -> pa.Table:
        frame = rows.to_pandas(types_mapper=pd.ArrowDtype).sort_values(["page_id", "url"], kind="stable")
        return pa.Table.from_pandas(frame.drop_duplicates(_KEY), rows.schema, preserve_index=False)

    kept, fresh = None, 0
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        kept = rows if kept is None else pa.concat_tables([kept, rows])
        fresh += batch.num_rows
        if fresh > max(100_000, kept.num_rows // 2):
            kept, fresh = least(kept), 0
    if kept is not None and kept.num_rows:
        yield from least(kept).to_batches()


def first_seen(pages: DataFrame, life: str = LIFE) -> DataFrame:
    """The first capture per (site, url_key) of a stream, as keyed state that forgets a key ``life`` after it was first seen.

    A micro-batch costs what arrives in it: its rows are dealt out by key, copies within it are combined to the one of least page_id, and each key is
    looked up in the state of its partition; what was seen earlier is not read again. Time is that of the batch, so no capture is late, however old, and a batch
    that is run again comes out the same.
    """
    spark = pages.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    once = _keyed(pages).repartition(*_KEY).mapInArrow(_first_in_batch, _ROW)
    seen = once.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", life)
    return seen.dropDuplicatesWithinWatermark(_KEY).drop("arrived")


def ingest_new(pages: DataFrame, seen_folder: str, checkpoint: str, life: str = LIFE) -> DataStreamWriter:
    """New URLs (see ``first_seen``) appended to a table; the sink's log takes each batch in once, also when it is run again."""
    return first_seen(pages, life).writeStream.format("parquet").outputMode("append").option("path", seen_folder).option(
        "checkpointLocation", checkpoint
    )


def state_sizes(query: StreamingQuery) -> list[dict]:
    """Per batch of a query with rows: (batch, keys held, keys added, bytes of state, rows dropped as late) over its state operators."""
    out = []
    for progress in query.recentProgress:
        states = progress["stateOperators"]
        if states:
            out.append(
                {
                    "batch": progress["batchId"],
                    "keys": sum(s["numRowsTotal"] for s in states),
                    "added": sum(s["numRowsUpdated"] for s in states),
                    "bytes": sum(s["memoryUsedBytes"] for s in states),
                    "late": sum(s["numRowsDroppedByWatermark"] for s in states),
                }
            )
    return out


def audit_stream(pages: DataFrame, cfg: SiteConfig, out: str, checkpoint: str) -> DataStreamWriter:
    """Findings of arriving pages, appended to a table; the page checks need no state."""
    findings = page_findings(pages, cfg)
    return findings.writeStream.format("parquet").outputMode("append").option("path", out).option(
        "checkpointLocation", checkpoint
    )


_TALLY = "site string, slug string, declared bigint, links bigint, batch bigint, bucket int"
_TALLY_KEY = ["bucket", "site", "slug"]
#: Buckets of a tally, by site: a batch rewrites the buckets whose sites it holds.
TALLY_BUCKETS = 64


def _latest(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The totals as the last batch (before a given one) left them in each bucket; only those folders are read."""
    try:
        rows = spark.read.schema(_TALLY).parquet(out)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # The first batch finds no folder yet.
        rows = spark.createDataFrame([], _TALLY)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    # At most a row a bucket, from the names of the folders.
    newest = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(newest), ["bucket", "batch"])


def store_tally(batch: DataFrame, number: int, out: str, buckets: int = TALLY_BUCKETS) -> None:
    """Add a batch's occurrences to the totals of the buckets it touches, as a new version of these buckets under the batch's number.

    Earlier versions are read and never changed, so a batch that is run again, after a failure or a restart, starts from the same
    totals and replaces its own version: each batch counts once.
    """
    spark = batch.sparkSession
    fresh = cut_lineage(slug_tally(batch).withColumn("bucket", F.pmod(F.xxhash64("site"), F.lit(buckets)).cast("int")), "tally")
    known = _latest(spark, out, number).join(F.broadcast(fresh.select("bucket").distinct()), "bucket", "left_semi")  # at most a row a bucket
    columns = [*_TALLY_KEY, "declared", "links"]
    both = known.select(*columns).unionByName(fresh.select(*columns)).groupBy(*_TALLY_KEY)
    total = both.agg(F.sum("declared").alias("declared"), F.sum("links").alias("links"))
    total.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/batch={number}")


def tally_stream(pages: DataFrame, out: str, checkpoint: str, buckets: int = TALLY_BUCKETS) -> DataStreamWriter:
    """Running totals of language slugs (see ``store_tally``); ``tally_total`` reads them."""
    return pages.writeStream.foreachBatch(lambda batch, number: store_tally(batch, number, out, buckets)).option("checkpointLocation", checkpoint)


def tally_total(spark: SparkSession, out: str) -> DataFrame:
    """Running totals (site, slug, declared, links) of all batches so far."""
    return _latest(spark, out).select("site", "slug", "declared", "links")


def languages_so_far(spark: SparkSession, out: str) -> DataFrame:
    return slugs_of(tally_total(spark, out))


def run_once(writer: DataStreamWriter) -> StreamingQuery:
    """Take in everything that has arrived, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query

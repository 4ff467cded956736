"""Export runs: retention, sizes, logs, listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake import fixed_values as fv
from sitelake.config import with_config


def run_time(run_id: str) -> Column:
    """Start of a run from an id like 20240131-235959 (UTC); NULL for any other text."""
    return F.try_to_timestamp(F.col(run_id), F.lit("yyyyMMdd-HHmmss"))


def retain_newest(runs: DataFrame, keep: int = fv.EXPORTS_KEPT) -> DataFrame:
    """Every run with a flag whether it stays: the newest ``keep`` of its site do.

    It is applied before the next run starts, so that ``keep`` + 1 runs exist afterwards. The newest are
    found by a rank that is cut to ``keep`` rows per site before the shuffle; the flag then comes
    from a join on the unique (site, run_id), so a site with very many runs is never sorted in one task.
    """
    newest = Window.partitionBy("site").orderBy(F.desc("run_id"))
    kept = (
        runs.select("site", "run_id")
        .withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= keep)
        .select("site", "run_id", F.lit(True).alias("keep"))
    )
    return runs.join(kept, ["site", "run_id"], "left").withColumn("keep", F.coalesce("keep", F.lit(False)))


def retain_configured(runs: DataFrame, config: DataFrame) -> DataFrame:
    """As ``retain_newest``, where each site's setting ``keep_exports``, held to its bounds, says how many runs stay.

    The rank is cut to the largest number allowed, so a site's settings meet only few of its runs.
    """
    newest = Window.partitionBy("site").orderBy(F.desc("run_id"))
    ranked = runs.select("site", "run_id").withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= fv.EXPORTS_KEPT_MOST)
    allowed = F.greatest(F.lit(fv.EXPORTS_KEPT_LEAST), F.least(F.lit(fv.EXPORTS_KEPT_MOST), F.col("keep_exports")))
    kept = with_config(ranked, config).filter(F.col("rank") <= allowed).select("site", "run_id", F.lit(True).alias("keep"))
    return runs.join(kept, ["site", "run_id"], "left").withColumn("keep", F.coalesce("keep", F.lit(False)))


def status_tail(logs: DataFrame) -> DataFrame:
    """What a status view shows of each run's log."""
    return log_tail(logs, fv.LOG_LINES_STATUS)


def log_tail(logs: DataFrame, n: int = fv.LOG_LINES) -> DataFrame:
    """The last ``n`` lines of each run; (run_id, line, ...), to be read in line order."""
    latest = Window.partitionBy("run_id").orderBy(F.desc("line"))
    return logs.withColumn("back", F.row_number().over(latest)).filter(F.col("back") <= n).drop("back")


def run_list(runs: DataFrame) -> DataFrame:
    """Runs, newest first."""
    return runs.orderBy(F.desc("run_id"), "site")


def export_size(runs: DataFrame) -> DataFrame:
    """Size and number of deletable runs per site, and for all sites (site NULL)."""
    return runs.rollup("site").agg(
        F.sum("size_bytes").alias("size_bytes"),
        F.count("*").alias("runs"),
        F.count_if(F.col("status") != "running").alias("deletable"),
    )


def run_files(artifacts: DataFrame) -> DataFrame:
    """Artifacts (run_id, name, size) to one row per run with a map of its few named files."""
    named = artifacts.filter(F.col("name").isin("raw.zip", "main.zip", "report.txt", "log.txt"))
    once = named.groupBy("run_id", "name").agg(F.max("size").alias("size"))
    return once.groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "size")))).alias("files")
    )

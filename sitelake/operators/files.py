"""The exported file tree: what is kept, renamed, added, and what clashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake import fixed_values as fv
from sitelake.config import SiteConfig
from sitelake.functions.paths import extension, file_class, webp_path
from sitelake.functions.rewrite import ads_txt_line
from sitelake.functions.text import is_blank
from sitelake.operators.extract import ancestor_dirs


def utf8_warnings(files: DataFrame) -> DataFrame:
    """Text files (BINARY body) that are not UTF-8; they are reported and left alone."""
    return files.filter(~F.is_valid_utf8(F.col("body"))).withColumn("warning", F.lit("not UTF-8: left as it is"))


def allowed_script(text: Column, cfg: SiteConfig) -> Column:
    """The text contains an entry of the script allow-list, in any case; blank entries name no script."""
    lowered = F.lower(text)
    return F.exists(cfg.col("script_allowlist"), lambda entry: ~is_blank(entry) & F.contains(lowered, F.lower(entry)))


def _folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def kept_in_tree(path: Column, cfg: SiteConfig) -> Column:
    """No removed script, and in no folder that is dropped at any depth."""
    script = (extension(path) == "js") & ~cfg.col("keep_js") & ~allowed_script(path, cfg)
    dropped = F.arrays_overlap(_folders(path), F.array(*[F.lit(name) for name in fv.PRUNED_FOLDERS]))
    return ~script & ~dropped


def prune_tree(files: DataFrame, cfg: SiteConfig) -> DataFrame:
    return files.filter(kept_in_tree(F.col("path"), cfg))


def promote_not_found(files: DataFrame) -> DataFrame:
    """The captured not-found page becomes ``404.html``, over an existing one; its folder goes.

    ``files`` has one row per (site, path). The files are read for the rows that stay as they are and for the few that may become the
    page: of these the captured one wins in each site.
    """
    caught = F.col("path") == f"{fv.NOT_FOUND_FOLDER}/index.html"
    others = files.filter(~F.startswith("path", F.lit(f"{fv.NOT_FOUND_FOLDER}/")) & (F.col("path") != fv.NOT_FOUND_PAGE))
    named = files.filter(F.col("path").isin(f"{fv.NOT_FOUND_FOLDER}/index.html", fv.NOT_FOUND_PAGE))
    columns = [F.lit(fv.NOT_FOUND_PAGE).alias(c) if c == "path" else F.col(c) for c in files.columns]
    winner = F.max_by(F.struct(*columns), caught.cast("int")).alias("page")
    return others.unionByName(named.groupBy("site").agg(winner).select("page.*"))


def missing_ads_txt(config: DataFrame, files: DataFrame) -> DataFrame:
    """An ``ads.txt`` for sites that have an account and want one, but have no such file: (site, path, body)."""
    cfg = SiteConfig.from_columns()
    wanted = config.filter(cfg.col("ads_txt") & ~is_blank(cfg.col("ads_client")))
    present = files.filter("path = 'ads.txt'").select("site")
    return wanted.join(present, "site", "left_anti").select(
        "site", F.lit("ads.txt").alias("path"), ads_txt_line(cfg.col("ads_client")).alias("body")
    )


def same_path_urls(captures: DataFrame) -> DataFrame:
    """URLs that fall on one path: (site, path, n_urls, kept); the last URL in order is the one kept."""
    return (
        captures.groupBy("site", "path")
        .agg(F.count("*").alias("n_urls"), F.max("url").alias("kept"))
        .filter("n_urls > 1")
    )


def file_folder_clash(files: DataFrame) -> DataFrame:
    """Paths that are a file and also a folder of other files.

    Folders are reduced per task before the shuffle, so a large folder is one row per task.
    """
    folders = files.select("site", F.explode(ancestor_dirs(F.col("path"))).alias("path")).distinct()
    return files.select("site", "path").join(folders, ["site", "path"], "left_semi")


def path_clash(captures: DataFrame) -> DataFrame:
    """Both kinds of clash in one table: (site, path, kind, n_urls)."""
    same = same_path_urls(captures).select("site", "path", F.lit("same path").alias("kind"), "n_urls")
    files = captures.select("site", "path").distinct()
    both = file_folder_clash(files).select(
        "site", "path", F.lit("file and folder").alias("kind"), F.lit(1).cast("long").alias("n_urls")
    )
    return same.unionByName(both)


def image_rename_plan(files: DataFrame) -> DataFrame:
    """Images and the WebP path each will get; ``clash`` where two originals want the same one."""
    images = files.filter(file_class(F.col("path")) == "image").select("site", "path", webp_path(F.col("path")).alias("webp"))
    shared = images.groupBy("site", "webp").agg(F.count("*").alias("n")).filter("n > 1")
    return images.join(shared.select("site", "webp", F.lit(True).alias("clash")), ["site", "webp"], "left").select(
        "site", "path", "webp", F.coalesce("clash", F.lit(False)).alias("clash")
    )


def sorted_inventory(files: DataFrame) -> DataFrame:
    """Files in path order, byte by byte."""
    return files.orderBy("site", "path")

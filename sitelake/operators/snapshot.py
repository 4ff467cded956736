"""Snapshots by content hash: what is new, reused, kept, gone, and one fingerprint per folder and site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake import fixed_values as fv
from sitelake.config import SiteConfig
from sitelake.functions.hashing import blob_sha
from sitelake.operators.extract import ancestor_dirs


def snapshot(files: DataFrame) -> DataFrame:
    """Files (site, path, body BINARY) to snapshot(site, path, sha, size); the bodies go no further."""
    return files.select("site", "path", blob_sha(F.col("body")).alias("sha"), F.octet_length("body").alias("size"))


def publish_delta(local: DataFrame, baseline: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Local files as needed or reused: (site, path, sha, action).

    A file is reused if its content occurs anywhere in the site's baseline, under any path. Where the
    baseline is known to be cut short (``meta.truncated``) nothing is reused.
    """
    known = baseline
    if meta is not None:
        # A left join on the site: an anti join against a filtered list may be planned as a nested loop.
        cut = meta.groupBy("site").agg(F.bool_or("truncated").alias("cut"))
        known = known.join(cut, "site", "left").filter(~F.coalesce("cut", F.lit(False))).drop("cut")
    shas = known.select("site", "sha").distinct().withColumn("known", F.lit(True))
    action = F.when(F.col("known"), "reused").otherwise("needed")
    return local.join(shas, ["site", "sha"], "left").select("site", "path", "sha", action.alias("action"))


def delta_summary(delta: DataFrame) -> DataFrame:
    """Per site: files, reused, needed."""
    return delta.groupBy("site").agg(
        F.count("*").alias("files"),
        F.count_if(F.col("action") == "reused").alias("reused"),
        F.count_if(F.col("action") == "needed").alias("needed"),
    )


def preserve_list(cfg: SiteConfig) -> Column:
    """Lower-case names that a publish keeps."""
    names = F.transform(cfg.col("preserve_files"), F.lower)
    return F.array_distinct(F.concat(names, F.array(F.lit(fv.ALWAYS_PRESERVED))))


def preserved_files(local: DataFrame, baseline: DataFrame, cfg: SiteConfig) -> DataFrame:
    """Baseline files at the root with a preserved name, in any case, that the export does not bring itself."""
    kept = baseline.filter(
        ~F.col("path").contains("/") & F.array_contains(preserve_list(cfg), F.lower("path"))
    )
    return kept.join(local.select("site", "path"), ["site", "path"], "left_anti").select("site", "path", "sha", "mode")


def merged_tree(local: DataFrame, preserved: DataFrame) -> DataFrame:
    """The published tree: exported files, and preserved ones they do not cover; (site, path, sha, mode)."""
    own = local.select("site", "path", "sha", F.lit(fv.FILE_MODE).alias("mode"))
    extra = preserved.join(local.select("site", "path"), ["site", "path"], "left_anti")
    return own.unionByName(extra.select("site", "path", "sha", "mode"))


def removed_paths(local: DataFrame, baseline: DataFrame, preserved: DataFrame) -> DataFrame:
    """Baseline paths that a publish makes disappear: neither exported nor preserved."""
    gone = baseline.select("site", "path").join(local.select("site", "path"), ["site", "path"], "left_anti")
    return gone.join(preserved.select("site", "path"), ["site", "path"], "left_anti")


def snapshot_diff(local: DataFrame, baseline: DataFrame, cfg: SiteConfig) -> DataFrame:
    """added / changed / unchanged / preserved / removed per path, in one join on the unique (site, path)."""
    old = baseline.select("site", "path", F.col("sha").alias("old_sha"))
    new = local.select("site", "path", F.col("sha").alias("new_sha"))
    keeps = ~F.col("path").contains("/") & F.array_contains(preserve_list(cfg), F.lower("path"))
    action = (
        F.when(F.col("old_sha").isNull(), "added")
        .when(F.col("new_sha").isNull() & keeps, "preserved")
        .when(F.col("new_sha").isNull(), "removed")
        .when(F.col("new_sha") == F.col("old_sha"), "unchanged")
        .otherwise("changed")
    )
    return new.join(old, ["site", "path"], "full_outer").select(
        "site", "path", F.coalesce("new_sha", "old_sha").alias("sha"), action.alias("action")
    )


def paired_roots(roots: DataFrame, baseline_roots: DataFrame) -> DataFrame:
    """(site, root_sha, old_root_sha) of all sites of either side; null where a side lacks the site."""
    old = baseline_roots.select("site", F.col("root_sha").alias("old_root_sha"))
    return roots.select("site", "root_sha").join(old, "site", "full_outer")


def changed_sites(paired: DataFrame) -> DataFrame:
    """Of paired roots the sites whose whole tree is not as before: new, gone, or with another root hash."""
    return paired.filter(~F.col("root_sha").eqNullSafe(F.col("old_root_sha")))


def site_changes(local: DataFrame, baseline: DataFrame, paired: DataFrame, cfg: SiteConfig) -> DataFrame:
    """What ``snapshot_diff`` says of the paths that are not as before, reading only sites whose roots differ.

    ``paired`` has (site, shard, root_sha, old_root_sha). Both snapshots are stored by shard of their site (see ``write_snapshot``): where the list
    of changed sites is small, its shards prune the folders before a path is read.
    """
    named = changed_sites(paired).select("site", "shard")

    def of_sites(stored: DataFrame) -> DataFrame:
        return stored.join(named, ["shard", "site"])

    return snapshot_diff(of_sites(local), of_sites(baseline), cfg).filter("action <> 'unchanged'")


def common_content(local: DataFrame, baseline: DataFrame) -> DataFrame:
    """Content hashes that occur on both sides."""
    return local.select("site", "sha").intersect(baseline.select("site", "sha"))


def unique_blobs(delta: DataFrame) -> DataFrame:
    """The first path of each needed content. A minimum, so that a much-copied content is combined early."""
    return delta.filter("action = 'needed'").groupBy("site", "sha").agg(F.min("path").alias("path"))


def sha_mismatch(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files whose stored hash is not the expected one; the stored hash wins."""
    both = expected.select("site", "path", F.col("sha").alias("expected")).join(
        actual.select("site", "path", F.col("sha").alias("actual")), ["site", "path"]
    )
    return both.filter("expected <> actual").withColumn("sha", F.col("actual"))


def confirmed_snapshot(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """The snapshot with stored hashes in place of expected ones."""
    stored = actual.select("site", "path", F.col("sha").alias("actual"))
    return expected.join(stored, ["site", "path"], "left").select(
        "site", "path", F.coalesce("actual", "sha").alias("sha")
    )


def folder_count(files: DataFrame) -> DataFrame:
    """Folders per site, the root included."""
    folders = files.select("site", F.explode(ancestor_dirs(F.col("path"))).alias("dir")).distinct()
    counts = folders.groupBy("site").agg(F.count("*").alias("n"))
    return files.select("site").distinct().join(counts, "site", "left").select(
        "site", (F.coalesce("n", F.lit(0)) + 1).alias("folders")
    )


def object_counts(fingerprints: DataFrame, delta: DataFrame) -> DataFrame:
    """Objects of a publish per site: one commit, each distinct folder object, each distinct needed content."""
    trees = fingerprints.select("site", "sha").distinct().groupBy("site").agg(F.count("*").alias("trees"))
    blobs = unique_blobs(delta).groupBy("site").agg(F.count("*").alias("blobs"))
    return trees.join(blobs, "site", "left").select(
        "site", (F.lit(1) + F.col("trees") + F.coalesce("blobs", F.lit(0))).alias("objects")
    )


def unchanged_sites(roots: DataFrame, baseline_roots: DataFrame) -> DataFrame:
    """Sites whose whole tree is as before; their files need no comparison at all."""
    return roots.select("site", "root_sha").join(baseline_roots.select("site", "root_sha"), ["site", "root_sha"], "left_semi")

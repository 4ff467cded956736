"""Queries over stored snapshots, file trees and sitemap files: each writes what it reads to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.config import SiteConfig
from sitelake.functions.hashing import blob_sha
from sitelake.operators import fingerprint as fp
from sitelake.operators import snapshot as sn
from sitelake.plans.catalog import query
from sitelake.plans.q_snapshot import _LEVELS, _LOCAL, _OLD, _SHA, _TREE, _kept, _local, _old
from sitelake.session import cut_lineage, new_folder
from sitelake.sources import tables as tb

# --- stores -----------------------------------------------------------------------------------------


@query(f"select site, path, {_SHA} as sha, octet_length(encode(body)) as size from [[exported]]")
def file_tree_source(source):
    files = source("exported")
    folder = new_folder(files.sparkSession, "export")
    written = cut_lineage(tb.write_file_tree(files, folder), "written")
    # Hashed where they are read: the join moves no bodies.
    found = tb.read_file_tree(files.sparkSession, folder).select("site", "path", blob_sha(F.col("body")).alias("sha"), "size")
    checked = found.join(written.withColumnRenamed("size", "_size").hint("merge"), ["site", "path"]).filter("size = _size")
    return checked.select("site", "path", "sha", "size")


@query("select site, path, body from [[exported]]")
def snapshot_sink(source):
    """Two runs, of which one is written again after an attempt that had left other rows."""
    files = source("exported")
    folder = new_folder(files.sparkSession, "snapshots")
    tb.write_snapshot(files.withColumn("body", F.lit("of a failed attempt")), folder, "b", 8)
    tb.write_snapshot(source("baseline").select("site", "path", "body"), folder, "a", 8)
    tb.write_snapshot(files, folder, "b", 8)
    return tb.read_snapshot(files.sparkSession, folder, "b", "site string, path string, body string").drop("shard")


@query("select site, path, body from [[baseline]] b where not exists (select 1 from [[exported]] e where e.site = b.site and e.path = b.path and e.body = b.body)")
def changed_only_store(source):
    new = source("exported").select("site", "path", F.col("body").alias("old"))
    files = source("baseline").withColumnRenamed("body", "new_body").join(new, ["site", "path"], "left")
    folder = new_folder(files.sparkSession, "changed")
    tb.write_changed(files.withColumnRenamed("old", "body"), folder, "a", 8)
    return tb.read_snapshot(files.sparkSession, folder, "a", "site string, path string, body string").drop("shard")


# Each sitemap lies below two indexes: the first names the second and a file that is not there, the second names the sitemap and the first.
@query(
    "select site, replace(url, '&amp;', '&') || case when page_id % 9 = 0 then '/feed/' else '' end as loc, 2 as depth from [[sited]]"
)
def sitemap_source(source):
    maps = source("sitemaps").withColumn("m", F.md5("xml"))

    def index(*names):
        each = [F.concat(F.lit("<sitemap><loc> https://"), "site", F.lit("/"), name, F.lit("\n</loc></sitemap>")) for name in names]
        return F.concat(F.lit('<?xml version="1.0"?>\n<sitemapindex>'), *each, F.lit("</sitemapindex>"))

    path = {name: F.concat(F.lit("maps/"), "m", F.lit(f"/{name}.xml")) for name in ("root", "index", "pages", "gone", "unlinked")}
    body = {"root": index(path["index"], path["gone"]), "index": index(path["pages"], path["root"]), "pages": F.col("xml"), "unlinked": F.col("xml")}
    files = maps.select("site", F.inline(F.array(*[F.struct(path[name].alias("path"), text.alias("body")) for name, text in body.items()])))
    spark = maps.sparkSession
    folder = new_folder(spark, "sitemaps")
    written = cut_lineage(tb.write_file_tree(files, folder), "written")
    # Names as the reader gives them.
    top = folder if ":" in folder.split("/")[0] else f"file:{folder}"
    top = "file:///" + top.removeprefix("file:").lstrip("/") if top.startswith("file:") else top
    roots = written.filter(F.col("path").endswith("/root.xml")).select(F.concat(F.lit(f"{top}/"), "site", F.lit("/"), "path").alias("file"))
    entries = tb.read_sitemaps(spark, folder, lambda url: F.concat(F.lit(f"{top}/"), F.regexp_extract(url, "^[a-z]+://(.*)$", 1)), roots)
    return entries.select(F.regexp_extract("file", r"/([^/]+)/maps/[0-9a-f]+/pages\.xml$", 1).alias("site"), "loc", "depth")


# --- fingerprints kept up to date -------------------------------------------------------------------


@query(f"with {_LEVELS} select site, dir, sha from prints")
def updated_fingerprint(source):
    before, after = _old(source), sn.merged_tree(_local(source), _kept(source))
    return fp.updated_fingerprint(fp.tree_fingerprint(before), before, after)


_DIFF = (
    "differs as (select site from (select site, path, sha, mode from tree except select site, path, sha, mode from b) d "
    "union select site from (select site, path, sha, mode from b except select site, path, sha, mode from tree) d)"
)


def _roots(source):
    before, after = _old(source), sn.merged_tree(_local(source), _kept(source))
    nodes = fp.tree_fingerprint(before)
    return fp.root_hashes(fp.updated_fingerprint(nodes, before, after)), fp.root_hashes(nodes)


@query(f"with {_LEVELS}, {_DIFF} select site, sha as root_sha from t0 where site not in (select site from differs)")
def unchanged_baseline_sites(source):
    return sn.unchanged_sites(*_roots(source))


@query(f"with {_TREE}, {_DIFF} select distinct site from differs")
def changed_sites(source):
    return sn.changed_sites(sn.paired_roots(*_roots(source))).select("site")


@query(
    f"with {_LOCAL}, {_OLD}, x as (select coalesce(l.site, b.site) as site, coalesce(l.path, b.path) as path, coalesce(l.sha, b.sha) as sha, "
    "case when b.path is null then 'added' when l.path is null then 'removed' when l.sha = b.sha then 'unchanged' else 'changed' end as action "
    "from l full join b on l.site = b.site and l.path = b.path) "
    "select site, path, sha, case when action = 'removed' and path = 'readme.MD' then 'preserved' else action end as action from x "
    "where action <> 'unchanged' and site in (select site from x where action in ('added', 'changed', 'removed') and path <> 'readme.MD')"
)
def site_changes(source):
    local, old = _local(source).select("site", "path", "sha"), _old(source).select("site", "path", "sha")
    spark = local.sparkSession
    folder, shards = new_folder(spark, "snapshots"), 16
    tb.write_snapshot(local, folder, "new", shards)
    tb.write_snapshot(old, folder, "old", shards)
    roots = cut_lineage(sn.paired_roots(*_roots(source)).withColumn("shard", tb.site_shard(F.col("site"), shards)), "roots")
    stored = [tb.read_snapshot(spark, folder, run, "site string, path string, sha string") for run in ("new", "old")]
    return sn.site_changes(*stored, roots, SiteConfig())

"""Queries over snapshots, folder hashes and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.config import SiteConfig, complete_config
from sitelake.functions.hashing import as_bytes, blob_sha
from sitelake.functions.urls import url_to_path
from sitelake.operators import files as fi
from sitelake.operators import runs as ru
from sitelake.operators import snapshot as sn
from sitelake.operators.extract import with_site
from sitelake.operators.fingerprint import root_hashes, tree_fingerprint
from sitelake.plans import duck as d
from sitelake.plans.catalog import query
from sitelake.sources.tables import changed_only, parse_trees, tree_entries

_SHA = "sha1(concat('blob ', octet_length(encode(body)), chr(0), body))"
_LOCAL = f"l as (select site, path, {_SHA} as sha from [[exported]])"
_OLD = f"b as (select site, path, {_SHA} as sha, mode from [[baseline]])"
_ACTIONS = "delta as (select site, path, sha, case when (site, sha) in (select (site, sha) from b) then 'reused' else 'needed' end as action from l)"
_DELTA = f"{_LOCAL}, {_OLD}, {_ACTIONS}"
_KEPT = "kept as (select * from b where path not like '%/%' and lower(path) in ('readme.md', '.gitignore', 'cname', '.git') and (site, path) not in (select (site, path) from l))"


def _local(source):
    return sn.snapshot(source("exported").withColumn("body", as_bytes(F.col("body"))))


def _old(source):
    rows = source("baseline")
    return rows.select("site", "path", blob_sha(as_bytes(F.col("body"))).alias("sha"), "mode")


def _delta(source):
    return sn.publish_delta(_local(source), _old(source))


def _kept(source):
    return sn.preserved_files(_local(source), _old(source), SiteConfig())


@query("select page_id, sha1(concat('blob ', octet_length(encode(html)), chr(0), html)) as sha from [[pages]]")
def blob_sha_pages(source):
    return source("pages").select("page_id", blob_sha(as_bytes(F.col("html"))).alias("sha"))


@query("select doc_id, sha1(concat('blob ', octet_length(encode(text)), chr(0), text)) as sha from [[documents]]", "blob_sha")
def blob_sha_documents(source):
    return source("documents").select("doc_id", blob_sha(as_bytes(F.col("text"))).alias("sha"))


@query(f"with {_DELTA} select site, path, sha, action from delta")
def publish_delta(source):
    return _delta(source)


@query(f"with {_DELTA} select site, path, sha, case when site like 'www.%' then 'needed' else action end as action from delta")
def publish_delta_truncated(source):
    meta = source("sited").select("site").distinct().withColumn("truncated", F.col("site").startswith("www."))
    return sn.publish_delta(_local(source), _old(source), meta)


@query(
    f"with {_DELTA} select site, count(*) as files, count(*) filter (where action = 'reused') as reused, count(*) filter (where action = 'needed') as needed from delta group by site"
)
def delta_summary(source):
    return sn.delta_summary(_delta(source))


@query(f"with {_LOCAL}, {_OLD}, {_KEPT} select site, path, sha, mode from kept")
def preserved_files(source):
    return _kept(source)


_TREE = f"{_LOCAL}, {_OLD}, {_KEPT}, tree as (select site, path, sha, '100644' as mode from l union all select site, path, sha, mode from kept)"


@query(f"with {_TREE} select site, path, sha, mode from tree")
def merged_tree(source):
    return sn.merged_tree(_local(source), _kept(source))


@query(f"with {_TREE} select site, path from b where (site, path) not in (select (site, path) from tree)")
def removed_paths(source):
    return sn.removed_paths(_local(source), _old(source), _kept(source))


@query(
    f"with {_TREE} select coalesce(l.site, b.site) as site, coalesce(l.path, b.path) as path, coalesce(l.sha, b.sha) as sha, "
    "case when b.path is null then 'added' when l.path is null then case when (b.site, b.path) in (select (site, path) from kept) then 'preserved' else 'removed' end "
    "when l.sha = b.sha then 'unchanged' else 'changed' end as action from l full join b on l.site = b.site and l.path = b.path"
)
def snapshot_diff(source):
    return sn.snapshot_diff(_local(source), _old(source), SiteConfig())


@query(f"with {_LOCAL}, {_OLD} select site, sha from l intersect select site, sha from b")
def common_content(source):
    return sn.common_content(_local(source), _old(source))


@query(f"with {_DELTA} select site, sha, min(path) as path from delta where action = 'needed' group by site, sha")
def unique_blobs(source):
    return sn.unique_blobs(_delta(source))


@query(f"with {_LOCAL}, {_OLD} select l.site, l.path, l.sha as expected, b.sha as actual, b.sha as sha from l join b on l.site = b.site and l.path = b.path where l.sha <> b.sha")
def sha_mismatch(source):
    return sn.sha_mismatch(_local(source), _old(source))


@query(f"with {_LOCAL}, {_OLD} select l.site, l.path, coalesce(b.sha, l.sha) as sha from l left join b on l.site = b.site and l.path = b.path")
def confirmed_snapshot(source):
    return sn.confirmed_snapshot(_local(source), _old(source))


# --- folder hashes: the oracle hashes the three levels of the exported paths one by one --------------


def _hashed(entries: str) -> str:
    """(site, dir, sha) from (site, dir, k, mode, name, sha)."""
    one = "encode(mode || ' ' || name || chr(0)) || unhex(sha)"
    return (
        f"select site, dir, sha1(encode('tree ' || octet_length(raw) || chr(0)) || raw) as sha from "
        f"(select site, dir, unhex(string_agg(hex({one}), '' order by encode(k))) as raw from ({entries}) group by site, dir)"
    )


_PARTS = "p as (select site, string_split(path, '/') as s, sha, mode from tree)"
_LEVELS = f"""{_TREE}, {_PARTS},
 files as (select site, array_to_string(s[:-2], '/') as dir, s[-1] as name, s[-1] as k, ltrim(mode, '0') as mode, sha, len(s) - 1 as depth from p),
 t3 as ({_hashed("select * from files where depth = 3")}),
 t2 as ({_hashed("select site, dir, k, mode, name, sha from files where depth = 2 union all select site, array_to_string(string_split(dir, '/')[:-2], '/'), string_split(dir, '/')[-1] || '/', '40000', string_split(dir, '/')[-1], sha from t3")}),
 t1 as ({_hashed("select site, dir, k, mode, name, sha from files where depth = 1 union all select site, array_to_string(string_split(dir, '/')[:-2], '/'), string_split(dir, '/')[-1] || '/', '40000', string_split(dir, '/')[-1], sha from t2")}),
 t0 as ({_hashed("select site, dir, k, mode, name, sha from files where depth = 0 union all select site, '', dir || '/', '40000', dir, sha from t1")}),
 prints as (select * from t3 union all select * from t2 union all select * from t1 union all select * from t0)"""


def _prints(source, **kw):
    return tree_fingerprint(sn.merged_tree(_local(source), _kept(source)), **kw)


@query(f"with {_LEVELS} select site, dir, sha from prints", "tree_fingerprint")
def tree_fingerprint_query(source):
    return _prints(source)


@query(f"with {_LEVELS} select site, sha as root_sha from t0")
def tree_fingerprint_roots(source):
    # More ranges than folders have entries, so that folders also lie across borders.
    return root_hashes(_prints(source, ranges=50))


@query(
    f"with {_LEVELS}, {_ACTIONS}, n as (select site, count(distinct sha) as t from prints group by site), "
    "u as (select site, count(distinct sha) as b from delta where action = 'needed' group by site) "
    "select site, 1 + t + coalesce(b, 0) as objects from n left join u using (site)"
)
def object_counts(source):
    return sn.object_counts(_prints(source), _delta(source))


@query(f"with {_LEVELS} select site, sha as root_sha from t0 where site not like 'www.%'")
def unchanged_sites(source):
    roots = root_hashes(_prints(source))
    before = roots.withColumn(
        "root_sha", F.when(F.col("site").startswith("www."), F.reverse("root_sha")).otherwise(F.col("root_sha"))
    )
    return sn.unchanged_sites(roots, before)


@query(
    "with e as (select distinct site, array_to_string(string_split(path, '/')[:n], '/') as dir from (select site, path, unnest(range(1, len(string_split(path, '/')))) as n from [[exported]])) "
    "select site, count(*) + 1 as folders from e group by site"
)
def folder_count(source):
    return sn.folder_count(_local(source))


@query("select site, path, sha1(body) as sha, mode from (select site, path, body, '100644' as mode from [[baseline]] where path <> 'readme.MD' union all select site, path, body, mode from [[baseline]] where path = 'readme.MD')")
def baseline_source(source):
    mode = F.when(F.col("mode") == "100755", F.col("mode"))
    kinds = F.array(
        F.struct(F.col("path"), mode.alias("mode"), F.lit("blob").alias("type"), F.sha1("body").alias("sha")),
        F.struct(F.lit("p").alias("path"), mode.alias("mode"), F.lit("tree").alias("type"), F.sha1("path").alias("sha")),
        F.struct(F.col("path"), mode.alias("mode"), F.lit("blob").alias("type"), F.lit(None).cast("string").alias("sha")),
    )
    documents = source("baseline").select(F.to_json(F.struct("site", kinds.alias("tree"))).alias("json"))
    return tree_entries(parse_trees(documents, "json"))


@query("select site, path, body from [[baseline]] b where not exists (select 1 from [[exported]] e where e.site = b.site and e.path = b.path and e.body = b.body)")
def changed_only_sink(source):
    new = source("exported").select("site", "path", F.col("body").alias("new_body"))
    return changed_only(source("baseline").join(new, ["site", "path"], "left")).select("site", "path", "body")


# --- files ----------------------------------------------------------------------------------------

_PATHS = f"c as (select site, url, {d.file_path('url')} as path from [[sited]] union all select site, url || '/sub', {d.file_path('url')} || '/sub' from [[sited]] where url_path like '%.html' union all select site, 'https://' || site || '/dup/' || (page_id % 9) || '?' || page_id, 'dup/' || (page_id % 9) || '/index.html' from [[sited]])"


@query(
    f"with {_PATHS} select site, path, 'same path' as kind, count(*) as n_urls from c group by site, path having count(*) > 1 union all "
    "select distinct site, path, 'file and folder', 1 from c a where exists (select 1 from c b where b.site = a.site and b.path like a.path || '/%')"
)
def path_clash(source):
    pages = with_site(source("pages")).select("site", "url", F.col("page_path").alias("path"))
    below = pages.filter(F.col("path").endswith(".html") & ~F.col("path").endswith("index.html")).select(
        "site", F.concat("url", F.lit("/sub")).alias("url"), F.concat("path", F.lit("/sub")).alias("path")
    )
    n = F.col("page_id") % 9
    twins = source("sited").select(
        "site", F.concat(F.lit("https://"), "site", F.lit("/dup/"), n, F.lit("?"), "page_id").alias("url")
    )
    captures = pages.unionByName(below).unionByName(twins.withColumn("path", url_to_path(F.col("url"))))
    return fi.path_clash(captures)


@query(
    "with i as (select 's' || p_size as site, concat('i/', p_partkey % 400, case p_partkey % 3 when 0 then '.png' when 1 then '.JPG' else '.gif' end) as path from [[part]]), "
    r"w as (select site, path, regexp_replace(path, '(?i)[.](png|jpe?g)$', '.webp') as webp from i where not path like '%.gif') "
    "select site, path, webp, count(*) over (partition by site, webp) > 1 as clash from w"
)
def image_rename_plan(source):
    files = source("part").select(
        F.concat(F.lit("s"), "p_size").alias("site"),
        F.expr("concat('i/', p_partkey % 400, case p_partkey % 3 when 0 then '.png' when 1 then '.JPG' else '.gif' end)").alias("path"),
    )
    return fi.image_rename_plan(files)


@query(
    "select site, 'ads.txt' as path, 'google.com, ' || replace(ads_client, 'ca-', '') || ', DIRECT, f08c47fec0942fa0' || chr(10) as body "
    "from [[site_config]] where ads_txt and ads_client <> '' and site not like 'm.%'"
)
def missing_ads_txt(source):
    files = source("sited").filter(F.col("site").startswith("m.")).select("site", F.lit("ads.txt").alias("path"))
    return fi.missing_ads_txt(complete_config(source("site_config")), files)


@query("select p_partkey, case when p_partkey % 2 = 0 then 'google.com, pub-' || p_partkey || ', DIRECT, f08c47fec0942fa0' || chr(10) else '' end as line from [[part]]")
def ads_txt_line(source):
    from sitelake.functions.rewrite import ads_txt_line as line

    given = F.expr("case p_partkey % 4 when 0 then concat('CA-pub-', p_partkey) when 2 then concat('-', p_partkey) else ' ' end")
    return source("part").select("p_partkey", line(given).alias("line"))


@query("select site, path, octet_length(encode(body)) as size from [[exported]]")
def sorted_inventory(source):
    return fi.sorted_inventory(_local(source)).select("site", "path", F.col("size").cast("long").alias("size"))


# --- runs -----------------------------------------------------------------------------------------


@query("select run_id, site, row_number() over (partition by site order by run_id desc) <= 2 as keep from [[runs]]")
def retain_newest(source):
    return ru.retain_newest(source("runs").select("site", "run_id"))


@query(
    "select run_id, site, row_number() over (partition by site order by run_id desc) <= greatest(1, least(10, cast(substr(site, 5) as int) % 13)) as keep from [[runs]]"
)
def retain_configured(source):
    runs = source("runs").select("run_id", "site")
    config = runs.select("site", (F.substring("site", 5, 9).cast("int") % 13).alias("keep_exports")).distinct()
    return ru.retain_configured(runs, config).select("run_id", "site", "keep")


@query("select run_id, line, level, message from (select *, row_number() over (partition by run_id order by line desc) as back from [[logs]]) t where back <= 80")
def status_tail(source):
    return ru.status_tail(source("logs").select("run_id", "line", "level", "message"))


@query("select run_id, line, level, message from (select *, row_number() over (partition by run_id order by line desc) as back from [[logs]]) t where back <= 5")
def log_tail(source):
    return ru.log_tail(source("logs").select("run_id", "line", "level", "message"), 5)


@query("select run_id, site, status, size_bytes from [[runs]]")
def run_list(source):
    return ru.run_list(source("runs").select("run_id", "site", "status", "size_bytes"))


@query("select site, sum(size_bytes)::bigint as size_bytes, count(*) as runs, count(*) filter (where status <> 'running') as deletable from [[runs]] group by rollup(site)")
def export_size(source):
    return ru.export_size(source("runs"))


@query("select run_id, strftime(started, '%Y-%m-%d %H:%M:%S') as started from [[runs]]")
def run_time(source):
    stamped = source("runs").select("run_id", F.date_format("started", "yyyyMMdd-HHmmss").alias("stamp"))
    return stamped.select("run_id", F.date_format(ru.run_time("stamp"), "yyyy-MM-dd HH:mm:ss").alias("started"))


@query("select run_id, max(size_bytes) filter (where run_id % 3 = 0) as raw_zip, max(size_bytes) filter (where run_id % 3 = 1) as report from [[runs]] where run_id % 3 <> 2 group by run_id")
def run_files(source):
    name = F.expr("case run_id % 3 when 0 then 'raw.zip' when 1 then 'report.txt' else 'other.bin' end")
    listed = ru.run_files(source("runs").select("run_id", name.alias("name"), F.col("size_bytes").alias("size")))
    files = F.col("files")
    return listed.select("run_id", files["raw.zip"].alias("raw_zip"), files["report.txt"].alias("report"))

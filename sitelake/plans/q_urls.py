"""Queries over URLs and paths: projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake import fixed_values as fv
from sitelake.config import SiteConfig
from sitelake.functions import paths, urls
from sitelake.operators.crawl import crawlable as crawlable_links
from sitelake.operators.extract import extract, with_site
from sitelake.operators.files import allowed_script, promote_not_found, prune_tree as pruned, utf8_warnings
from sitelake.plans import duck as d
from sitelake.plans.catalog import query

_REFS = f"refs as ({d.unnested('html', fv.LINK_ATTRIBUTE, 'site, page_id, url', '[[rich]]')})"
_BASE = "'https://' || site"
_ROOT = "regexp_replace(url_path, '^/', '')"


def _refs(source):
    """Link references of the enriched pages with their page."""
    return extract(with_site(source("rich")), "html", "link", "site", "base", "page_id", "url", "page_path")


@query(
    f"select page_id, regexp_extract(url, '^[a-z]+') as scheme, {d.host_of('url')} as host, {d.or_slash(d.path_of('url'))} as path, "
    f"{d.query_of('url')} as query from [[pages]]"
)
def url_parts(source):
    return source("pages").select("page_id", urls.url_parts(F.col("url")).alias("p")).select("page_id", "p.*")


@query(f"select page_id, md5({_BASE} || {d.or_slash('url_path')}) as url_key from [[sited]]")
def url_key(source):
    return with_site(source("pages")).select("page_id", urls.url_key(F.col("url"), F.col("base")).alias("url_key"))


@query(f"with {_REFS} select page_id, pos, ref, {d.resolve('ref', 'url', _BASE)} as absolute from refs")
def resolve_refs(source):
    absolute = urls.resolve_ref(F.col("ref"), F.col("url"), F.col("base"))
    return _refs(source).select("page_id", "pos", "ref", absolute.alias("absolute"))


@query(f"with {_REFS} select page_id, pos, nullif(regexp_replace({d.trim('ref')}, '#.*$', ''), '') as ref from refs")
def fragment_strip(source):
    return _refs(source).select("page_id", "pos", urls.without_fragment(F.col("ref")).alias("ref"))


@query(f"select page_id, {d.file_path('url')} as path from [[pages]]")
def url_to_path(source):
    return source("pages").select("page_id", urls.url_to_path(F.col("url")).alias("path"))


_INNER = d.fold(
    f"replace(case when {d.path_of('h')} like '/%' then {d.path_of('h')} else concat({d.folder('pp')}, {d.path_of('h')}) end, chr(92), '/')"
)


@query(
    f"with {_REFS}, clean as (select *, regexp_replace({d.entity(d.trim('ref'))}, '[#?].*$', '') as h, {d.file_path('url')} as pp from refs) "
    f"select page_id, pos, case when regexp_matches(h, '(?i)^(data|mailto|tel|javascript):') or {d.path_of('h')} = '' "
    f"or {d.host_of('h')} not in ('', site, 'www.' || site) then null else nullif({_INNER}, '') end as path from clean"
)
def internal_href_path(source):
    cfg = SiteConfig(source_host=F.col("site"), target_host=F.concat(F.lit("www."), F.col("site")))
    path = urls.internal_href_path(F.col("ref"), F.col("page_path"), cfg)
    return _refs(source).select("page_id", "pos", path.alias("path"))


@query(
    f"with {_REFS}, placed as (select *, {d.file_path('url')} as pp from refs) "
    f"select page_id, pos, {d.audit_target('ref', 'pp')} as target from placed"
)
def audit_target(source):
    target = urls.audit_target(F.col("ref"), F.col("page_path"))
    return _refs(source).select("page_id", "pos", target.alias("target"))


@query(
    "select page_id, case when page_id % 3 = 0 then 'https' else regexp_extract(url, '^[a-z]+') end || '://' || site as site_url from [[sited]]"
)
def normalize_site_url(source):
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("//"), F.upper("site"), F.lit("/x"))).otherwise(
        F.concat(F.lit(" "), F.col("url"))
    )
    return source("sited").select("page_id", urls.normalize_site_url(raw).alias("site_url"))


@query(
    "select distinct site, case when len(string_split(site, '.')) >= 3 then regexp_replace(site, '^[^.]*[.]', '') else site end as domain, "
    "regexp_replace(site, '^(www|blog|m)[.]', '') as unstaged from "
    "(select site from [[sited]]) t where len(string_split(site, '.')) >= 4 or site like 'www.%'"
    " union all select distinct site, regexp_replace(site, '^[^.]*[.]', ''), regexp_replace(site, '^[^.]*[.]', '') from [[sited]] "
    "where len(string_split(site, '.')) < 4 and site not like 'www.%'"
)
def registrable_domain(source):
    host = F.col("site")
    staging = F.when(host.rlike("^(blog|m)[.]"), F.regexp_extract(host, "^[^.]*", 0)).otherwise("admin")
    return source("sited").select("site").distinct().select(
        "site",
        urls.registrable_domain(F.lit("x.org"), host, F.lit("")).alias("domain"),
        urls.registrable_domain(host, F.lit(""), staging).alias("unstaged"),
    )


@query(
    "select page_id, case when site like 'www.%' then 'admin' else string_split(site, '.')[1] end as label from [[sited]]"
)
def staging_label(source):
    return source("sited").select("page_id", urls.staging_label(F.col("site")).alias("label"))


_TYPES = "case page_id % 5 when 0 then 'Text/HTML; charset=utf-8' when 1 then 'text/css' when 2 then 'application/xml' when 3 then 'text/plain' end"


@query(
    f"select page_id, case when page_id % 5 = 0 or url_path like '%.html' then 'html' when page_id % 5 = 1 then 'css' "
    f"when page_id % 5 = 2 and page_id % 2 = 0 then 'sitemap' else 'other' end as kind from [[sited]]"
)
def resource_kind(source):
    body = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<?xml?><URLset>"), "html")).otherwise(F.col("html"))
    kind = urls.resource_kind(F.ltrim(F.col("url_path"), F.lit("/")), F.expr(_TYPES), body)
    return source("sited").select("page_id", kind.alias("kind"))


_FILES = (
    "select page_id, concat('a.b/', page_id, case page_id % 6 when 0 then '.JS' when 1 then '.jpeg' when 2 then '.htm' when 3 then '.woff2' when 4 then '' else '.PNG' end) as path from [[pages]]"
)


def _mixed_files(source):
    return source("pages").select(
        "page_id",
        F.expr(
            "concat('a.b/', page_id, case page_id % 6 when 0 then '.JS' when 1 then '.jpeg' when 2 then '.htm' when 3 then '.woff2' when 4 then '' else '.PNG' end)"
        ).alias("path"),
    )


@query(
    f"select page_id, path, case regexp_extract(lower(path), '[.]([a-z0-9]+)$', 1) when 'js' then 'js' when 'jpeg' then 'image' when 'png' then 'image' "
    f"when 'htm' then 'text' else 'other' end as file_class from ({_FILES}) t"
)
def file_class(source):
    return _mixed_files(source).select("page_id", "path", paths.file_class(F.col("path")).alias("file_class"))


@query("select site, regexp_matches(left(xml, 2048), '(?i)<(sitemapindex|urlset)') as is_sitemap, length(xml) as n from [[sitemaps]] "
       "union all select site, regexp_matches(left(html, 2048), '(?i)<(sitemapindex|urlset)'), length(html) from [[sited]]")
def is_sitemap(source):
    bodies = source("sitemaps").select("site", F.col("xml").alias("body")).unionByName(
        source("sited").select("site", F.col("html").alias("body"))
    )
    return bodies.select("site", urls.is_sitemap(F.col("body")).alias("is_sitemap"), F.length("body").alias("n"))


@query(
    f"with {_REFS} select page_id, pos, case when {d.host_of(d.trim('ref'))} in ('', site) and "
    f"regexp_matches(lower(regexp_extract({d.path_of(d.trim('ref'))}, '^/*([^/]*)', 1)), '^[a-z]{{2}}(?:-[a-z]{{2}})?$') "
    f"then lower(regexp_extract({d.path_of(d.trim('ref'))}, '^/*([^/]*)', 1)) end as slug from refs"
)
def lang_slug(source):
    return _refs(source).select("page_id", "pos", urls.lang_slug(F.col("ref"), F.col("site")).alias("slug"))


@query(
    "select doc_id, case when lang = 'en' then 'en,pt-br' else lang || ',en,pt-br' end as slugs from [[documents]]"
)
def slug_list(source):
    raw = F.concat(F.upper("lang"), F.lit("; /en/ , x1,pt-BR "), F.col("lang"), F.lit(" english"))
    return source("documents").select("doc_id", F.array_join(urls.slug_list(raw), ",").alias("slugs"))


@query(
    "select p_partkey, case p_partkey % 4 when 3 then 'acct-' || p_partkey else 'ca-pub-' || p_partkey end as client from [[part]]"
)
def normalize_ads_client(source):
    raw = F.expr(
        "case p_partkey % 4 when 0 then concat('CA-PUB-', p_partkey) when 1 then concat(' pub-', p_partkey) "
        "when 2 then cast(p_partkey as string) else concat('acct-', p_partkey) end"
    )
    return source("part").select("p_partkey", urls.normalize_ads_client(raw).alias("client"))


# --- filters --------------------------------------------------------------------------------------

_RESOLVED = f"{_REFS}, found as (select site, page_id, pos, {d.resolve('ref', 'url', _BASE)} as url from refs)"


def _found(source):
    absolute = urls.resolve_ref(F.col("ref"), F.col("url"), F.col("base"))
    return _refs(source).select("site", "base", "page_id", "pos", absolute.alias("url")).filter("url is not null")


@query(f"with {_RESOLVED} select page_id, pos, url from found where url is not null and {d.host_of('url')} = site")
def internal_only(source):
    return _found(source).filter(urls.url_host(F.col("url")) == F.col("site")).select("page_id", "pos", "url")


@query(
    f"with {_RESOLVED} select page_id, pos, url from found where url is not null and not regexp_matches({d.or_slash(d.path_of('url'))}, '^({d.DENY[1:-1]}|/de)')"
)
def deny_paths(source):
    excludes = urls.exclude_prefixes(F.lit("de/\n \n/"))
    return _found(source).filter(~urls.denied(urls.url_path(F.col("url")), excludes)).select("page_id", "pos", "url")


@query(
    f"with {_RESOLVED} select page_id, pos, url from found where url is not null and not regexp_matches({d.or_slash(d.path_of('url'))}, '(?i)/(feed|trackback)(/|$)')"
)
def feed_paths(source):
    return _found(source).filter(~urls.is_feed(urls.url_path(F.col("url")))).select("page_id", "pos", "url")


@query(
    f"with {_RESOLVED} select page_id, pos, url from found where {d.query_of('url')} in ('', '0') or regexp_matches({d.path_of('url')}, '(?i)[.][a-z0-9]{{2,5}}$')"
)
def query_pages(source):
    url = F.col("url")
    return _found(source).filter(~urls.is_query_page(urls.url_path(url), urls.url_query(url))).select("page_id", "pos", "url")


@query(f"with {_REFS} select page_id, pos, ref from refs where not regexp_matches(ref, '(?i)^(mailto|tel|javascript|data|sms|ftp):')")
def scheme_filter(source):
    return _refs(source).filter(~F.regexp_like("ref", F.lit(fv.CRAWL_SKIPPED_SCHEMES))).select("page_id", "pos", "ref")


@query(f"with {_REFS} select page_id, pos, ref from refs where not contains({d.decoded(d.path_of('ref'))}, '..')")
def traversal(source):
    return _refs(source).filter(~urls.leaves_site(urls.raw_path(F.col("ref")))).select("page_id", "pos", "ref")


@query(
    f"with {_RESOLVED} select page_id, pos, {_BASE} || {d.or_slash(d.path_of('url'))} as url, md5({_BASE} || {d.or_slash(d.path_of('url'))}) as url_key "
    f"from found where url is not null and {d.crawlable('url', 'site')}"
)
def crawlable(source):
    return crawlable_links(_found(source)).select("page_id", "pos", "url", "url_key")


@query("select doc_id, 'not UTF-8: left as it is' as warning from [[documents]] where doc_id % 5 = 0")
def utf8_guard(source):
    bad = F.when(F.col("doc_id") % 5 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("ff")))).otherwise(
        F.encode("text", "UTF-8")
    )
    return utf8_warnings(source("documents").withColumn("body", bad)).select("doc_id", "warning")


@query(
    "select p_partkey, p_partkey % 3 = 0 as allowed from [[part]]"
)
def script_allowlist(source):
    src = F.expr("concat('/js/', case when p_partkey % 3 = 0 then 'FUSE.js' else 'app.js' end, '?', p_partkey)")
    return source("part").select("p_partkey", allowed_script(src, SiteConfig()).alias("allowed"))


_TREE = (
    "concat(case p_partkey % 5 when 0 then 'feed/' when 1 then 'a/wp-json/b/' when 2 then 'feeds/' else '' end, 'x', p_partkey, "
    "case p_partkey % 4 when 0 then '.js' when 1 then '-fuse.js' else '.html' end)"
)


@query(
    f"select path from (select {_TREE} as path from [[part]]) t where not regexp_matches(path, '(^|/)(feed|wp-json)/') "
    f"and (path not like '%.js' or path like '%fuse.js')"
)
def prune_tree(source):
    files = source("part").select(F.lit("s").alias("site"), F.expr(_TREE).alias("path"))
    return pruned(files, SiteConfig()).select("path")


_CAUGHT = "concat('s', p_size) as site, case p_partkey % 4 when 0 then '404_not_found/index.html' when 1 then '404.html' when 2 then concat('404_not_found/', p_partkey) else concat('k/', p_partkey) end as path, p_name as body"


@query(
    f"with f as (select distinct * from (select {_CAUGHT} from [[part]]) t), m as (select site, min(body) as body, max(case when path like '4%l' and path like '404_%' then 1 else 0 end) as p, path from f group by site, path) "
    "select site, case when path = '404_not_found/index.html' then '404.html' else path end as path, body from m a "
    "where path not like '404!_not!_found/%' escape '!' and not (path = '404.html' and exists (select 1 from m b where b.site = a.site and b.path = '404_not_found/index.html')) "
    "or path = '404_not_found/index.html'"
)
def promote_404(source):
    files = source("part").selectExpr(*[c.strip() for c in (
        "concat('s', p_size) as site",
        "case p_partkey % 4 when 0 then '404_not_found/index.html' when 1 then '404.html' when 2 then concat('404_not_found/', p_partkey) else concat('k/', p_partkey) end as path",
        "p_name as body",
    )]).groupBy("site", "path").agg(F.min("body").alias("body"))
    return promote_not_found(files)

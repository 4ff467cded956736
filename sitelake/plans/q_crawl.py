"""Queries that crawl: split captures, find new URLs, follow links, tell progress and languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake import fixed_values as fv
from sitelake.functions.urls import normal_url, url_key
from sitelake.operators import crawl as cr
from sitelake.operators import languages as la
from sitelake.operators.extract import discovered_links, with_site
from sitelake.plans import duck as d
from sitelake.plans.catalog import query

_BASE = "'https://' || site"
_REFS = f"refs as ({d.unnested('html', fv.LINK_ATTRIBUTE, 'site, page_id, url', '[[rich]]')})"
_REASON = "case when error is not null then error when status >= 400 then 'HTTP ' || status end"


@query(
    f"select page_id, case when {_REASON} is not null then 'failed' when body = '' then 'empty' else 'ok' end as outcome, {_REASON} as reason from [[captures]]"
)
def capture_split(source):
    return source("captures").withColumns(cr.capture_outcome()).select("page_id", "outcome", "reason")


@query(
    f"select site, url, {_REASON} as reason from [[captures]] where {_REASON} is not null order by site, url, reason limit 20"
)
def first_failures(source):
    return cr.first_failures(cr.capture_split(source("captures"))[1])


@query(f"select site, url, {_REASON} as reason from [[captures]] where {_REASON} is not null")
def failed_urls(source):
    return cr.capture_split(source("captures"))[1]


# What the pages mention, by any extractor, as URLs that may be crawled.
_FOUND = (
    f"{_REFS}, abs as (select site, {d.resolve('ref', 'url', _BASE)} as u from refs "
    "union all select site, 'https://' || site || unnest(['/img/s.jpg', '/img/x.jpeg', '/img/l.png', '/css/x.css', '/i/bg.png']) from [[rich]] "
    "union all select site, 'https://' || site || '/og/' || page_id || '.jpg' from [[rich]]), "
    f"found as (select distinct site, {_BASE} || {d.or_slash(d.path_of('u'))} as url from abs where u is not null and {d.crawlable('u', 'site')})"
)


def _found(source):
    pages = with_site(source("rich")).withColumns({"body": F.col("html"), "content_type": F.lit("text/html")})
    return cr.crawlable(discovered_links(pages))


@query(f"with {_FOUND} select site, url from found")
def discovered_urls(source):
    return _found(source).select("site", "url").distinct()


@query(
    f"with {_FOUND}, seen as (select distinct {_BASE} || {d.or_slash('url_path')} as url from [[sited]]) "
    "select site, url, md5(url) as url_key from found where url not in (select url from seen)"
)
def new_urls(source):
    seen = with_site(source("pages")).select("site", url_key(F.col("url"), F.col("base")).alias("url_key"))
    return cr.new_urls(_found(source), seen).select("site", "url", "url_key")


@query(
    f"with {_FOUND}, seen as (select distinct {_BASE} || {d.or_slash('url_path')} as url from [[sited]]) "
    "select site, url, md5(url) as url_key from found where url not in (select url from seen)"
)
def new_urls_of_many(source):
    seen = with_site(source("pages")).select("site", url_key(F.col("url"), F.col("base")).alias("url_key"), "page_id")
    return cr.new_urls_of_many(_found(source), seen, 1 << 17).select("site", "url", "url_key")


@query(
    f"select site, md5({_BASE} || {d.or_slash('url_path')}) as url_key, min(page_id) as page_id from [[sited]] group by 1, 2"
)
def dedupe_captures(source):
    rows = with_site(source("pages")).select("site", url_key(F.col("url"), F.col("base")).alias("url_key"), "page_id")
    return cr.dedupe_captures(rows, ["page_id"])


@query(
    "with recursive n as (select page_id % 3 as s, cast(floor(page_id / 3) as bigint) as i from [[pages]]), "
    "reach(s, i, depth) as (select s, i, 0 from n where i = 0 union all "
    "select n.s, n.i, r.depth + 1 from reach r join n on n.s = r.s and n.i in (2 * r.i + 1, 2 * r.i + 2) where r.i % 11 <> 3) "
    "select 's' || s || '.example.com' as site, 'https://s' || s || '.example.com/p/' || i || '/' as url, depth from reach"
)
def crawl_reach(source):
    pages = source("linked").withColumns(
        {
            "base": F.concat(F.lit("https://"), F.col("site")),
            "page_path": F.concat(F.lit("p/"), F.col("i"), F.lit("/index.html")),
            "content_type": F.lit("text/html"),
            "body": F.col("html"),
        }
    )
    links = cr.crawlable(discovered_links(pages))
    edges = links.select("site", normal_url(F.col("page_url"), F.col("base")).alias("src"), F.col("url").alias("dst"))
    captured = pages.select("site", normal_url(F.col("url"), F.col("base")).alias("url"))
    seeds = captured.filter(F.col("url").endswith("/p/0/"))
    return cr.crawl_reach(edges, seeds, captured)


@query(
    f"with {_FOUND} , done as (select site, count(*) as done, count(*) filter (where {_REASON} is not null) as failed from [[captures]] group by site), "
    "k as (select site, count(*) as n from found group by site) "
    "select site, coalesce(done, 0) as done, greatest(1, coalesce(n, 0)) as total, coalesce(failed, 0) as failed, "
    "least(100, cast(round(100.0 * coalesce(done, 0) / greatest(1, coalesce(n, 0))) as int)) as percent from done full join k using (site)"
)
def crawl_progress(source):
    seen = _found(source).select("site", "url_key").distinct()
    progress = cr.crawl_progress(source("captures"), seen)
    return progress.withColumn("percent", cr.percent_done(F.col("done"), F.col("total"), F.lit("running")))


def _slug(x):
    first = f"lower(regexp_extract({d.path_of(x)}, '^/*([^/]*)', 1))"
    return f"case when {d.host_of(x)} in ('', site) and regexp_matches({first}, '^[a-z]{{2}}(?:-[a-z]{{2}})?$') then {first} end"


_TALLY = (
    f"links as (select site, unnest(regexp_extract_all(html, {d.q(fv.HREF_ATTRIBUTE)}, 1)) as ref from [[rich]]), "
    f"langs as (select site, regexp_extract(tag, {d.q(fv.HREF_ATTRIBUTE)}, 1) as ref from (select site, unnest(regexp_extract_all(html, {d.q(fv.HREFLANG_TAG)})) as tag from [[rich]])), "
    f"tally as (select site, slug, sum(dec) as declared, sum(1 - dec) as links from (select site, {_slug('ref')} as slug, 0 as dec from links "
    f"union all select site, {_slug('ref')}, 1 from langs) where slug is not null group by site, slug)"
)


@query(f"with {_TALLY} select site, slug, cast(declared as bigint) as declared, cast(links as bigint) as links from tally")
def slug_tally(source):
    return la.slug_tally(source("rich"))


@query(f"with {_TALLY} select site, slug from tally where declared > 0 or links >= 2")
def site_languages(source):
    return la.site_languages(source("rich"))


_HOME = _TALLY.replace("[[rich]]", "(select h.* from [[homed]] h join (select site, min(page_id) as page_id from [[sited]] group by site) f using (site, page_id)) t")


@query(f"with {_HOME} select site, slug from tally where declared > 0 or links >= 2")
def home_languages(source):
    return la.home_languages(with_site(source("homed")))


@query(f"with {_TALLY} select site, slug from tally where declared > 0 or links >= 2 union select site, 'it' from [[sited]]")
def slug_union(source):
    configured = source("sited").select("site", F.lit("it").alias("slug"))
    return la.all_languages(configured, la.site_languages(source("rich")))

"""Queries over references: everything a text mentions, and what its real elements link to."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake import fixed_values as fv
from sitelake.config import complete_config
from sitelake.functions.urls import resolve_ref
from sitelake.operators import extract as ex
from sitelake.plans import duck as d
from sitelake.plans.catalog import query
from sitelake.sources.tables import text_lines


def _from_rich(source, kind):
    return ex.extract(source("rich"), "html", kind, "site", "page_id")


@query(d.unnested("html", fv.LINK_ATTRIBUTE, "site, page_id", "[[rich]]"))
def extract_links(source):
    return _from_rich(source, "link")


_SRCSETS = (
    f"select page_id, unnest(regexp_extract_all(html, {d.q(fv.SRCSET_ATTRIBUTE)}, 1)) as v from [[rich]]"
)


@query(
    f"with sets as ({_SRCSETS}), parts as (select page_id, unnest(string_split(v, ',')) as p from sets), "
    rf"firsts as (select page_id, regexp_split_to_array({d.trim('p')}, '\s+')[1] as ref from parts) "
    "select page_id, ref, count(*) as n from firsts where ref not in ('', '0') group by page_id, ref"
)
def extract_srcset(source):
    return _from_rich(source, "srcset").groupBy("page_id", "ref").agg(F.count("*").alias("n"))


@query(d.unnested("html", fv.META_IMAGE, "site, page_id", "[[rich]]"))
def extract_meta_images(source):
    return _from_rich(source, "meta_image")


_CSS = "select site, path as page, body from [[stylesheets]] union all select site, 'p' || page_id, html from [[rich]]"


def _css(source):
    return source("stylesheets").selectExpr("site", "path as page", "body").unionByName(
        source("rich").selectExpr("site", "concat('p', page_id) as page", "html as body")
    )


@query(
    f"with css as ({_CSS}), m as (select site, page, list_filter(regexp_extract_all(body, {d.q(fv.CSS_URL)}, 1), lambda u: u not like 'data:%') as m from css) "
    "select site, page, generate_subscripts(m, 1) - 1 as pos, unnest(m) as ref from m"
)
def extract_css_urls(source):
    return ex.extract(_css(source), "body", "css_url", "site", "page")


@query(f"with css as ({_CSS}) {d.unnested('body', fv.CSS_IMPORT, 'site, page', 'css')}")
def extract_css_imports(source):
    return ex.extract(_css(source), "body", "css_import", "site", "page")


_ENTRY = "select site, page_id, url, url_path from [[sited]]"
_LOC = "url || case when page_id % 9 = 0 then '/feed/' else '' end"


@query(f"select site, {_LOC} as ref from [[sited]]")
def sitemap_locs(source):
    return ex.extract(source("sitemaps"), "xml", "sitemap_loc", "site").select("site", "ref")


@query("select site, 'https://' || site || '/img/' || page_id || '.png' as ref from [[sited]]")
def sitemap_media(source):
    return ex.extract(source("sitemaps"), "xml", "sitemap_media", "site").select("site", "ref")


@query("select site, 'https://' || site || '/de/' || page_id || '?a=1&b=2' as ref from [[sited]]")
def sitemap_alternates(source):
    return ex.extract(source("sitemaps"), "xml", "sitemap_alternate", "site").select("site", "ref")


@query("select site, 'https://' || site || '/main-sitemap.xsl' as url from [[sited]]")
def sitemap_stylesheets(source):
    base = F.concat(F.lit("https://"), F.col("site"))
    refs = ex.extract(source("sitemaps"), "xml", "sitemap_stylesheet", "site")
    return refs.select("site", resolve_ref(F.col("ref"), F.concat(base, F.lit("/maps/a.xml")), base).alias("url"))


@query(
    "select page_id, 'http://' || site || '/sm-' || page_id || '.xml' as url from [[sited]] "
    "union all select page_id, 'https://' || site || '/og/' || page_id || '.png' from [[sited]]"
)
def robots_sitemaps(source):
    return ex.extract(source("robots"), "txt", "robots_sitemap", "page_id").select("page_id", F.col("ref").alias("url"))


@query(
    r"select page_id, unnest(list_filter(list_transform(regexp_split_to_array(txt, '\r\n|\r|\n'), lambda r: "
    f"{d.trim('r')}), lambda r: r <> '')) as row from [[robots]]"
)
def line_source(source):
    return text_lines(source("robots"), "txt", "page_id").select("page_id", "row")


# Elements with a reference, their attributes, and the parts of srcset values.
ELEMENTS = (
    f"shown as (select site, page_id, url, {d.all_tags(d.shown('html'))} as tags from [[rich]]), "
    "t as (select site, page_id, url, generate_subscripts(tags, 1) - 1 as pos, unnest(tags) as tag from shown), "
    f"singles as (select site, page_id, url, pos, 'href' as source, {d.entity(d.attr('tag', 'href'))} as ref from t where tag not like '</%' and {d.has_attr('tag', 'href')} "
    f"union all select site, page_id, url, pos, 'src', {d.entity(d.attr('tag', 'src'))} from t where tag not like '</%' and {d.has_attr('tag', 'src')}), "
    f"sets as (select site, page_id, url, pos, unnest(string_split({d.attr('tag', 'srcset')}, ',')) as part from t where tag not like '</%' and {d.has_attr('tag', 'srcset')}), "
    rf"element_refs as (select * from singles union all select site, page_id, url, pos, 'srcset', regexp_split_to_array({d.trim('part')}, '\s+')[1] from sets "
    f"where {d.trim('part')} not in ('', '0'))"
)


@query(f"with {ELEMENTS} select page_id, {d.file_path('url')} as page_path, pos, source, ref from element_refs")
def audit_refs(source):
    return ex.audit_refs(ex.with_site(source("rich"))).select("page_id", "page_path", "pos", "source", "ref")


@query(
    f"with tags as (select site, page_id, unnest(regexp_extract_all(html, {d.q(fv.HREFLANG_TAG)})) as tag from [[rich]]) "
    f"select site, page_id, regexp_extract(tag, {d.q(fv.HREF_ATTRIBUTE)}, 1) as ref from tags"
)
def hreflang_tags(source):
    from sitelake.operators.languages import hreflang_refs

    return source("rich").select("site", "page_id", F.explode(hreflang_refs(F.col("html"))).alias("ref"))


_HOME = ", ".join(d.q(p) for p in fv.HOME_SEEDS)


@query(
    f"select site, 'https://' || site || unnest([{_HOME}, '/de/', '/pt-br/', '/x']) as url from [[site_config]] "
    "union all select site, 'https://cdn.example.org/y' from [[site_config]]"
)
def seed_urls(source):
    config = source("site_config").withColumns(
        {
            "language_slugs": F.array(F.lit("de"), F.lit("pt-br")),
            "extra_urls": F.array(F.lit("x"), F.lit("https://cdn.example.org/y"), F.lit("/x")),
        }
    )
    return ex.seed_urls(complete_config(config))


@query(
    "with e as (select site, path, string_split(path, '/') as parts from [[exported]]), "
    "n as (select site, path, parts, unnest(range(1, len(parts))) as n from e) "
    "select site, path, array_to_string(parts[:n], '/') as dir from n"
)
def ancestor_dirs(source):
    return source("exported").select("site", "path", F.explode(ex.ancestor_dirs(F.col("path"))).alias("dir"))

"""Queries that rewrite text: hosts, schemes, extensions, stylesheets, sitemaps, robots."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.config import SiteConfig, complete_config, with_config
from sitelake.functions import rewrite as rw
from sitelake.functions.text import entity_decode as decode
from sitelake.plans import duck as d
from sitelake.plans.catalog import query

_CONFIGURED = "c as (select r.*, s.source_host, s.target_host, s.target_scheme, s.site_domain from [[rich]] r join [[site_config]] s using (site))"
_MAPPED = "target_host <> ''"


def _configured(source, table="rich"):
    """Rows with the settings of their site."""
    return with_config(source(table), complete_config(source("site_config")))


def _text(source, expression):
    return _configured(source).select("page_id", expression(F.col("html"), SiteConfig.from_columns()).alias("html"))


@query(
    f"with {_CONFIGURED} select page_id, case when {_MAPPED} then {d.rewrite_host('html', 'source_host', 'target_host', 'target_scheme')} else html end as html from c"
)
def rewrite_host(source):
    return _text(source, rw.rewrite_host)


@query(f"select page_id, {d.rewrite_staging('html')} as html from [[rich]]")
def rewrite_staging(source):
    return _text(source, rw.rewrite_staging)


@query(f"with {_CONFIGURED} select page_id, {d.force_https('html', 'site_domain')} as html from c")
def force_https(source):
    return _text(source, rw.force_https)


@query(f"select page_id, {d.image_ext('html')} as html from [[rich]]")
def rewrite_image_ext(source):
    return _text(source, lambda text, cfg: rw.rewrite_image_ext(text))


CHAIN = d.chain("{x}", _MAPPED, "source_host", "target_host", "target_scheme", "site_domain")


def chain(x: str) -> str:
    return CHAIN.replace("{x}", x)


@query(f"with {_CONFIGURED} select page_id, {chain('html')} as html from c")
def rewrite_chain(source):
    return _text(source, rw.rewrite_chain)


SRCSET = (
    r"array_to_string(list_transform(list_filter(list_transform(string_split({x}, ','), lambda part: regexp_split_to_array(trim(part), '\s+')), "
    r"lambda ts: ts[1] not in ('', '0')), lambda ts: array_to_string(list_concat([regexp_replace(ts[1], '(?i)[.](png|jpe?g)$', '.webp')], ts[2:]), ' ')), ', ')"
)


@query("with s as (select p_partkey, concat('/img/', p_partkey, '.PNG  1x , /i/x.jpeg,,0 2x,/y.gif 3x') as v from [[part]]) select p_partkey, " + SRCSET.replace("{x}", "v") + " as v from s")
def rewrite_srcset(source):
    v = F.concat(F.lit("/img/"), "p_partkey", F.lit(".PNG  1x , /i/x.jpeg,,0 2x,/y.gif 3x"))
    return source("part").select("p_partkey", rw.rewrite_srcset(v).alias("v"))


_CSS = "select site, path, body from [[stylesheets]] union all select site, 'p' || page_id, html from [[rich]]"


def _css(source):
    rows = source("rich").select("site", F.concat(F.lit("p"), "page_id").alias("path"), F.col("html").alias("body"))
    return source("stylesheets").unionByName(rows)


@query(f"with c as ({_CSS}) select site, path, {d.font_display('body')} as body from c")
def font_display(source):
    return _css(source).select("site", "path", rw.font_display(F.col("body")).alias("body"))


@query(r"select site, path, regexp_replace(body, 'url\([.][.]/', 'url(/', 'g') as body from [[stylesheets]]")
def css_urls_to_root(source):
    return source("stylesheets").select("site", "path", rw.css_urls_to_root(F.col("body"), F.lit("css")).alias("body"))


@query("select site, path, replace(body, '@charset \"utf-8\";', '') as body from [[stylesheets]]")
def css_charset_strip(source):
    return source("stylesheets").select("site", "path", rw.without_charset(F.col("body")).alias("body"))


@query(f"select page_id, {d.filled_lines('html')} as html from [[rich]]")
def blank_line_removal(source):
    return _text(source, lambda text, cfg: rw.without_blank_lines(text))


_FIRST_MAP = "'sitemap: http://' || site || '/sm-' || page_id || '.xml'"
_SECOND_MAP = "'Sitemap:https://' || site || '/og/' || page_id || '.png'"
_ROBOTS = "r as (select r.*, s.source_host, s.target_host, s.target_scheme, s.site_domain from [[robots]] r join [[site_config]] s using (site))"


@query(
    f"with {_ROBOTS} select page_id, 'User-agent: *' || chr(10) || 'Disallow:' || chr(10) || {chain(_FIRST_MAP)} "
    f"|| chr(10) || {chain(_SECOND_MAP)} || chr(10) || 'sitemap:' || chr(10) as txt from r"
)
def clean_robots(source):
    cfg = SiteConfig.from_columns()
    return _configured(source, "robots").select("page_id", rw.clean_robots(F.col("txt"), cfg).alias("txt"))


_SITEMAPS = "m as (select r.*, s.source_host, s.target_host, s.target_scheme, s.site_domain from [[sitemaps]] r join [[site_config]] s using (site))"


@query(
    f"with {_SITEMAPS} select site, {d.filled_lines(chain('case when regexp_matches(xml, ' + d.q('<loc>[^<]*/feed/') + ') then regexp_replace(xml, ' + d.q('(?s)<url>.*</url>') + ', ' + d.q('') + ') else xml end'))} as xml from m"
)
def clean_sitemap(source):
    return _configured(source, "sitemaps").select(
        "site", rw.clean_sitemap(F.col("xml"), SiteConfig.from_columns()).alias("xml")
    )


@query(f"select doc_id, {d.entity('text')} as text from [[documents]]")
def entity_decode(source):
    return source("documents").select("doc_id", decode(F.col("text")).alias("text"))


@query(
    "select r.site, r.page_id, coalesce(s.target_host, '') as target_host, s.ads_txt from [[sited]] r left join [[site_config]] s using (site)"
)
def config_join(source):
    return _configured(source, "sited").select("site", "page_id", "target_host", "ads_txt")

"""Queries of the link and SEO audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.config import SiteConfig
from sitelake.operators import audit as au
from sitelake.operators.extract import with_site
from sitelake.plans import duck as d
from sitelake.plans.catalog import query
from sitelake.plans.q_extract import ELEMENTS
from sitelake.sources.tables import report_lines

_SHOWN = f"seen_text as (select site, page_id, url, html, {d.shown('html')} as s from [[rich]])"
_PP = d.file_path("url")


def _mapped() -> SiteConfig:
    return SiteConfig(source_host=F.col("site"), target_host="www.new.example", site_domain=F.col("site"))


def _staged() -> SiteConfig:
    return SiteConfig(staging_label="admin")



def _first(name: str, where: str, get: str) -> str:
    tags = f"list_filter({d.all_tags('s', name)}, lambda t: {where})"
    return f"coalesce({d.attr(f'{tags}[1]', get)}, '')"


def _blank(x: str) -> str:
    return f"{d.trim(x)} = ''"


_TITLE = rf"regexp_extract(s, {d.q(r'(?is)<title(?:[ ][^>]*)?>(.*?)(?:</title|\z)')}, 1)"
_OWN_HOST = f"'(?i){d.BEFORE}' || {d.literal('site')} || '{d.AFTER}'"
_PLAIN_HTTP = f"'(?i)http:{d.SLASHES}([a-z0-9-]+[.])*' || {d.literal('site')} || '{d.AFTER}'"

_N = {
    "TITLE": f"case when {_blank(_TITLE)} then 1 end",
    "META": f"case when {_blank(_first('meta', 'lower(' + d.attr('t', 'name') + ') = ' + d.q('description'), 'content'))} then 1 end",
    "CANONICAL": f"case when {_blank(_first('link', 'contains(lower(' + d.attr('t', 'rel') + '), ' + d.q('canonical') + ')', 'href'))} then 1 end",
    "H1": f"nullif({d.count('s', d.q('(?i)<h1[ />]'))}, 1)",
    "LANG": f"case when {_blank(_first('html', 'true', 'lang'))} then 1 end",
    "ALT": f"nullif(len(list_filter({d.all_tags('s', 'img')}, lambda t: not {d.has_attr('t', 'alt')})), 0)",
    "DOMINIO": f"nullif({d.count('html', _OWN_HOST)}, 0)",
    "STAGING": r"case when regexp_matches(html, '(?i)(^|[^\w.\-])admin\.[a-z0-9\-]+\.[a-z0-9\-]') then 1 end",
    "HTTPS": f"nullif({d.count('html', _PLAIN_HTTP)}, 0)",
}


def _finding(code: str) -> str:
    detail = (
        d.q(au.DETAILS[code]) if code in au.DETAILS else f"n || {d.q(au.COUNTED_DETAILS[code])}"
    )
    return (
        f"select site, page_path, '{code}' as code, cast(n as bigint) as n, {detail} as detail "
        f"from (select site, {_PP} as page_path, {_N[code]} as n from seen_text) where n is not null"
    )


def _register(name: str, code: str, cfg) -> None:
    @query(f"with {_SHOWN} {_finding(code)}", name)
    def run(source):
        return au.page_findings(with_site(source("rich")), cfg(), (code,))


for _name, _code, _cfg in (
    ("seo_title", "TITLE", _mapped),
    ("seo_description", "META", _mapped),
    ("seo_canonical", "CANONICAL", _mapped),
    ("seo_h1", "H1", _mapped),
    ("seo_lang", "LANG", _mapped),
    ("seo_alt", "ALT", _mapped),
    ("seo_host_residue", "DOMINIO", _mapped),
    ("seo_staging_residue", "STAGING", _staged),
    ("seo_http_residue", "HTTPS", _mapped),
):
    _register(_name, _code, _cfg)

_ALL = " union all ".join(_finding(code) for code in au.CODES if code != "STAGING")


@query(f"with {_SHOWN} {_ALL}")
def page_findings(source):
    return au.page_findings(with_site(source("rich")), _mapped())


# Export files: each page, some images, one original whose WebP is missing.
_FILES = f"files as (select site, {_PP} as path from [[rich]] union select site, 'img/s.jpg' from [[rich]] union select site, 'w/' || page_id || '.JPG' from [[rich]])"


def _files(source):
    pages = with_site(source("rich"))
    return (
        pages.select("site", F.col("page_path").alias("path"))
        .unionByName(pages.select("site", F.lit("img/s.jpg").alias("path")))
        .unionByName(pages.select("site", F.concat(F.lit("w/"), F.col("page_id"), F.lit(".JPG")).alias("path")))
        .distinct()
    )


_BROKEN = (
    f"{ELEMENTS}, {_FILES}, aimed as (select distinct site, {_PP} as page_path, ref, {d.audit_target('ref', _PP)} as target from element_refs), "
    "broken as (select a.site, page_path, ref, target from aimed a where target is not null "
    "and not exists (select 1 from files f where f.site = a.site and f.path = target) "
    "and not exists (select 1 from files f where f.site = a.site and f.path = rtrim(target, '/') || '/index.html'))"
)


@query(f"with {_BROKEN} select site, page_path, ref from broken")
def broken_links(source):
    return au.broken_links(with_site(source("rich")), _files(source))


@query(
    f"with {_BROKEN} select site, page_path, ref from broken b where lower(target) like '%.webp' and exists (select 1 from files f "
    r"where f.site = b.site and regexp_replace(f.path, '(?i)[.](png|jpe?g)$', '.webp') = target and f.path <> target)"
)
def orphan_webp(source):
    return au.orphan_webp(with_site(source("rich")), _files(source))


@query(
    f"with {_BROKEN}, {_SHOWN}, seo as ({_ALL}), rows_ as (select site, code, n from seo union all select site, 'LINK', 1 from broken) "
    "select site, code, count(*) as findings, cast(sum(n) as bigint) as total from rows_ group by site, code"
)
def site_audit(source):
    return au.site_audit(with_site(source("rich")), _files(source), _mapped())


@query(
    f"with {_BROKEN}, {_SHOWN}, seo as ({_ALL}), sites as (select distinct site from [[sited]]), "
    "c as (select site, (select count(*) from broken b where b.site = s.site) as nb, (select count(*) from seo b where b.site = s.site) as ns from sites s) "
    "select site, 1 as section, 0 as rank, 'BROKEN LINKS (' || nb || ')' as line from c union all select site, 2, 0, 'SEO AUDIT (' || ns || ')' from c "
    "union all select site, 1, 1, page_path || ' -> ' || ref from broken union all select site, 2, 1, '[' || code || '] ' || page_path || ': ' || detail from seo "
    "union all select site, 1, 1, 'no internal link is broken' from c where nb = 0 union all select site, 2, 1, 'no SEO finding' from c where ns = 0"
)
def findings_report(source):
    pages = with_site(source("rich"))
    return report_lines(au.page_findings(pages, _mapped()), au.broken_links(pages, _files(source)))

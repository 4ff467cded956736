"""Queries that clean pages. Each step runs alone on the tokens of the enriched pages, then all in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake import fixed_values as fv
from sitelake.config import SiteConfig, complete_config, with_config
from sitelake.functions import markup as mk
from sitelake.operators import clean as cl
from sitelake.operators.extract import with_site
from sitelake.plans import duck as d
from sitelake.plans.catalog import query
from sitelake.plans.q_rewrite import SRCSET, chain

_ALLOWED = "(?i)fuse[.]js|fuse-js|sfs-|new Fuse[(]"
_PP = d.file_path("url")


def _start(x: str, name: str) -> str:
    return f"regexp_matches({x}, '(?i)^<{name}[[:space:]/>]')"


def _tag_edit(t: str, cond: str, new: str) -> str:
    raw = "regexp_matches(x, '(?i)^<(script|style|textarea|noscript)[[:space:]/>]')"
    return f"list_transform({t}, lambda x: case when regexp_matches(x, '^<[a-zA-Z]') and not {raw} and ({cond}) then {new} else x end)"


# --- the steps in the oracle's words: lists of tokens, edited by list functions and plain patterns --------

def _comments(t):
    return f"list_filter({t}, lambda x: x not like '<!--%')"


def _scripts(t):
    content = r"regexp_replace(x, '(?is)^<script[^>]*>|</script\s*>$', '', 'g')"
    return (
        f"list_filter({t}, lambda x: not {_start('x', 'script')} or lower(trim({d.attr('x', 'type')})) = 'application/ld+json' "
        f"or regexp_matches({d.attr('x', 'src')} || chr(10) || {d.attr('x', 'id')} || chr(10) || {content}, '{_ALLOWED}'))"
    )


def _js_links(t):
    rel, href = f"lower({d.trim(d.attr('x', 'rel'))})", f"lower({d.trim(d.attr('x', 'href'))})"
    return (
        f"list_filter({t}, lambda x: not {_start('x', 'link')} or regexp_matches({href}, '{_ALLOWED}') or not "
        rf"(regexp_matches({rel}, '(^|\s)modulepreload(\s|$)') or (regexp_matches({rel}, '(^|\s)(preload|prefetch)(\s|$)') and lower({d.attr('x', 'as')}) = 'script') "
        f"or regexp_matches({href}, '^[^?#]*[.]js([?#]|$)')))"
    )


def _fonts(t):
    return f"list_transform({t}, lambda x: case when {_start('x', 'style')} then {d.font_display('x')} else x end)"


_V = r"""("[^"]*"|'[^']*'|[^\s>"']+)"""
_HANDLER = rf"(?i)\s+on[^\s=>/]*\s*=\s*{_V}"
_LAZY = rf"(?i)\s+data-(lazy-)?src(set)?\s*=\s*{_V}"


def _handlers(t):
    return _tag_edit(t, "true", f"regexp_replace(x, {d.q(_HANDLER)}, '', 'g')")


def _js_refs(t):
    pattern = r"""(?i)\s+(href|src)\s*=\s*("\s*javascript:[^"]*"|'\s*javascript:[^']*'|javascript:[^\s>"']+)"""
    return _tag_edit(t, "true", f"regexp_replace(x, {d.q(pattern)}, '', 'g')")


def _lazy(t):
    def real(t, name, first, second):
        lazy = f"coalesce(nullif({d.attr('x', first)}, ''), {d.attr('x', second)})"
        placed = rf"""regexp_replace(x, '(?i)(\s){name}\s*=\s*("[^"]*"|''[^'']*'')', '\1{name}="' || {lazy} || '"')"""
        added = rf"""regexp_replace(x, '(\s*/?>)$', ' {name}="' || {lazy} || '"\1')"""
        return _tag_edit(
            t, f"{d.attr('x', name)} in ('', '0') and {lazy} not in ('', '0')", f"case when {d.has_attr('x', name)} then {placed} else {added} end"
        )

    drop = _tag_edit(
        real(real(t, "src", "data-src", "data-lazy-src"), "srcset", "data-srcset", "data-lazy-srcset"),
        "true",
        f"regexp_replace(x, {d.q(_LAZY)}, '', 'g')",
    )
    return drop


def _noscript(t):
    inner = r"regexp_replace(x, '(?i)^<noscript\b[^>]*>|</noscript\s*>$', '', 'g')"
    return (
        rf"list_transform({t}, lambda x: case when not regexp_matches(x, '(?i)^</?noscript\b') then x when {d.trim(inner)} = '' then '' "
        f"when contains({inner}, '&lt;') then {d.entity(inner)} else {inner} end)"
    )


def _renamed(t):
    value = rf"""(?i)(\s(?:src|href|poster|content)\s*=\s*(?:"[^"]*|'[^']*))[.](?:png|jpe?g)(["'?#,)])"""
    new_set = SRCSET.replace("{x}", d.attr("x", "srcset"))
    one = f"regexp_replace(x, {d.q(value)}, '\\1.webp\\2', 'g')"
    both = rf"""(case when {d.has_attr('x', 'srcset')} then regexp_replace({one}, '(?i)(\ssrcset\s*=\s*)("[^"]*"|''[^'']*'')', '\1"' || {new_set} || '"') else {one} end)"""
    return _tag_edit(t, "true", both)


def _hints(t, sizes="null::map(varchar, varchar)"):
    def add(x, name, value, cond="true"):
        return rf"""(case when {cond} and not {d.has_attr(x, name)} then regexp_replace({x}, '(\s*/?>)$', ' {name}="' || {value} || '"\1') else {x} end)"""

    first = f"list_position(list_transform({t}, lambda y: {_start('y', 'img')}), true)"
    size = f"({sizes})[{d.attr('x', 'src')}]"
    sized = rf"""(case when {size} is not null then regexp_replace(x, '(\s*/?>)$', ' ' || {size} || '\1') else x end)"""
    stage = f"list_transform({t}, lambda x: case when {_start('x', 'img')} then {sized} else x end)"
    stage = f"list_transform({stage}, lambda x: case when {_start('x', 'img')} then {add('x', 'decoding', d.q('async'))} else x end)"
    loading = rf"""regexp_replace({add('x', 'fetchpriority', d.q('high'))}, '(?i)\s+loading\s*=\s*"[^"]*"', '')"""
    return (
        f"list_transform({stage}, lambda x, i: case when not {_start('x', 'img')} then x when i = {first} then {loading} "
        f"else {add('x', 'loading', d.q('lazy'))} end)"
    )


_SPACES = r"[\s\x0b\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _spaces(html):
    return (
        f"array_to_string(list_transform(regexp_extract_all({html}, {d.q(d.SPACE_TOKEN)}), lambda x: case when x like '<%' then x "
        f"else regexp_replace(x, '{_SPACES}', ' ', 'g') end), '')"
    )


def _at_head(html, addition):
    return rf"regexp_replace({html}, '(?i)(<head>)', '\1' || {addition})"


_GA = (
    "'<script async=\"\" src=\"https://www.googletagmanager.com/gtag/js?id=' || analytics_id || '\"></script><script>window.dataLayer = window.dataLayer || [];"
    "function gtag(){dataLayer.push(arguments);}gtag(''js'', new Date());gtag(''config'', ''' || analytics_id || ''');</script>'"
)
_ADS = "'<script async=\"\" src=\"https://pagead2.googlesyndication.com/pagead/js/adsbygoogle.js?client=' || ads_client || '\" crossorigin=\"anonymous\"></script>'"


def _analytics(html):
    return _at_head(html, f"case when analytics_id <> '' then {_GA} else '' end || case when ads_client <> '' then {_ADS} else '' end")


def _csp(html):
    return f"case when regexp_matches({html}, '(?i)http-equiv=.content-security-policy') then {html} else {_at_head(html, d.q(fv.UPGRADE_POLICY))} end"


_FONT_LINKS = (
    "case when contains({o}, 'fonts.googleapis.com') then '<link rel=\"preconnect\" href=\"https://fonts.googleapis.com\"><link rel=\"preconnect\" href=\"https://fonts.gstatic.com\" crossorigin=\"\">' else '' end"
)
_PRELOAD = "'<link rel=\"preload\" href=\"/f/a.woff2\" as=\"font\" type=\"font/woff2\" crossorigin=\"\"><link rel=\"preload\" href=\"/f/B.ttf\" as=\"font\" crossorigin=\"\">'"


def _preloads(html, original="html"):
    return _at_head(html, f"{_FONT_LINKS.replace('{o}', original)} || {_PRELOAD}")


# --- single steps ---------------------------------------------------------------------------------

_TOKENS = f"t as (select page_id, regexp_extract_all(html, {d.q(d.TOKEN)}) as t from [[rich]])"


def _cfg() -> SiteConfig:
    return SiteConfig(preload_fonts=("/f/a.woff2", "/f/B.ttf"))


def _register_step(name, oracle_step, step):
    @query(f"with {_TOKENS} select page_id, array_to_string({oracle_step('t')}, '') as html from t", name)
    def run(source):
        return source("rich").select("page_id", F.array_join(step(mk.tokens(F.col("html"))), "").alias("html"))


for _name, _oracle, _step in (
    ("tokens", lambda t: t, lambda t: t),
    ("strip_comments", _comments, cl.strip_comments),
    ("strip_scripts", _scripts, lambda t: cl.strip_scripts(t, _cfg())),
    ("strip_js_links", _js_links, lambda t: cl.strip_js_links(t, _cfg())),
    ("style_font_display", _fonts, lambda t: cl.style_font_display(t, _cfg())),
    ("strip_handlers", _handlers, lambda t: cl.strip_handlers(t, _cfg())),
    ("strip_js_refs", _js_refs, lambda t: cl.strip_js_refs(t, _cfg())),
    ("promote_lazy", _lazy, cl.promote_lazy),
    ("unwrap_noscript", _noscript, lambda t: cl.unwrap_noscript(t, _cfg())),
    ("rename_images_in_tags", _renamed, cl.rename_images),
    ("image_hints", _hints, lambda t: cl.hint_images(t, F.lit(None).cast("map<string,struct<width:int,height:int>>"), _cfg())),
):
    _register_step(_name, _oracle, _step)


@query(f"select page_id, {_spaces('html')} as html from [[rich]]")
def whitespace_collapse(source):
    return source("rich").select("page_id", cl.collapse_space(F.col("html")).alias("html"))


_SET = "c as (select r.*, s.source_host, s.target_host, s.target_scheme, s.site_domain, s.analytics_id, s.ads_client from [[rich]] r join [[site_config]] s using (site))"
_MAPPED = "target_host <> ''"


def _settings(source):
    """The settings of every site; each preloads two fonts."""
    return complete_config(source("site_config").withColumn("preload_fonts", F.array(F.lit("/f/a.woff2"), F.lit("/f/B.ttf"))))


def _configured(source):
    """Pages with the settings of their site."""
    return with_config(with_site(source("rich")), _settings(source))


def _page_text(source, expression):
    return _configured(source).select("page_id", expression(F.col("html"), SiteConfig.from_columns()).alias("html"))


@query(f"with {_SET} select page_id, {_analytics('html')} as html from c")
def inject_analytics(source):
    return _page_text(source, cl.inject_analytics)


@query(f"with {_SET} select page_id, {_csp('html')} as html from c")
def inject_csp(source):
    return _page_text(source, cl.inject_csp)


@query(f"with {_SET} select page_id, {_preloads('html')} as html from c")
def inject_preloads(source):
    return _page_text(source, lambda html, cfg: cl.inject_preloads(html, html, cfg))


@query("select page_id, '/img/' || page_id || '.png' as src from [[rich]]")
def lcp_image(source):
    return source("rich").select("page_id", cl.lcp_image(F.col("html")).alias("src"))


# --- look-ups -------------------------------------------------------------------------------------

# The two stylesheet links of each page that lead to a file of the site; the larger file is over the limit.
_INLINED = d.font_display(r"regexp_replace(replace(body, '@charset \"utf-8\";', ''), 'url\([.][.]/', 'url(/', 'g')".replace('\\"', '"'))
_SHEETS = (
    f"sheets as (select s.site, s.path, {d.chain(_INLINED, _MAPPED, 'source_host', 'target_host', 'target_scheme', 'site_domain')} as css "
    "from [[stylesheets]] s join [[site_config]] using (site) where octet_length(encode(body)) between 1 and 15360)"
)


@query(
    # Captures that share a path are one page of the tree: their links count once.
    f"with {_SHEETS} select distinct r.site, {_PP} as page_path, '/' || path as href, css from [[rich]] r join sheets s on s.site = r.site and s.path = 'css/' || (r.page_id % 7) || '.css'"
)
def inline_css(source):
    return cl.inline_css(with_site(source("rich")), source("stylesheets"), SiteConfig.from_columns(), _settings(source))


_MEDIA = "' media=\"print\"'"
_LINKED = "'<link rel=\"stylesheet\" media=\"print\" href=\"/css/' || (page_id % 7) || '.css\">'"


@query(
    f"with {_SHEETS} select page_id, replace(html, {_LINKED}, coalesce('<style media=\"print\">' || css || '</style>', {_LINKED})) as html "
    "from [[rich]] r left join sheets s on s.site = r.site and s.path = 'css/' || (r.page_id % 7) || '.css'"
)
def inlined_pages(source):
    pages = cl.inlined_pages(with_site(source("rich")), source("stylesheets"), SiteConfig.from_columns(), _settings(source))
    return pages.select("page_id", "html")


_DIMS = "dims as (select distinct site, path, width, height from [[img_dims]] where width > 0 and height > 0)"
_SRCS = (
    f"srcs as (select site, page_id, {_PP} as page_path, '/img/' || page_id || '.webp' as src, 'img/' || page_id || '.png' as path from [[rich]] "
    f"union select site, page_id, {_PP}, '/img/' || (page_id % 50) || '.webp', 'img/' || (page_id % 50) || '.png' from [[rich]] "
    f"union select site, page_id, {_PP}, '/img/n.webp', 'img/n.png' from [[rich]])"
)


@query(f"with {_DIMS}, {_SRCS} select distinct s.site, page_path, src, width, height from srcs s join dims using (site, path)")
def image_dims(source):
    return cl.image_dims(with_site(source("rich")), source("img_dims"), SiteConfig.from_columns(), _settings(source))


# --- the whole pass -------------------------------------------------------------------------------

_PASS = f"""{_SET}, {_SHEETS}, {_DIMS}, {_SRCS},
 sizes as (select page_id, map(list(src), list('width="' || width || '" height="' || height || '"')) as sizes from srcs join dims using (site, path) group by page_id),
 a as (select c.*, sizes, {_js_links(_scripts(_comments(f"regexp_extract_all({_spaces('html')}, {d.q(d.TOKEN)})")))} as t, css, {_LINKED} as linked
       from c left join sheets s on s.site = c.site and s.path = 'css/' || (c.page_id % 7) || '.css' left join sizes using (page_id)),
 b as (select *, list_transform(t, lambda x: case when x = linked then coalesce('<style media="print">' || css || '</style>', x) else x end) as t1 from a),
 e as (select *, array_to_string({_noscript(_lazy(_js_refs(_handlers(_fonts('t1')))))}, '') as h1 from b),
 f as (select *, {_renamed(f"regexp_extract_all(h1, {d.q(d.TOKEN)})")} as t2 from e),
 g as (select *, array_to_string({_hints('t2', 'sizes')}, '') as h2 from f),
 h as (select *, {_analytics('h2')} as h3 from g),
 i as (select *, {_csp('h3')} as h4 from h),
 j as (select *, {_preloads('h4')} as h5 from i),
 k as (select *, {chain('h5')} as h6 from j),
 done as (select site, page_id, url, {d.filled_lines('h6')} || chr(10) as html from k)"""


@query(f"with {_PASS} select page_id, html from done")
def clean_pages(source):
    pages = cl.clean_pages(with_site(source("rich")), SiteConfig.from_columns(), source("stylesheets"), source("img_dims"), _settings(source))
    return pages.select("page_id", F.col("cleaned").alias("html"))


# Files of every class: the pages, the stylesheets, a robots file per page, an image and a script per part.
_OTHERS = (
    f"css as (select s.site, s.path, s.path as new_path, 'css' as kind, {d.font_display(chain('body'))} as new_body from [[stylesheets]] s "
    "left join (select site, source_host, coalesce(target_host, '') as target_host, target_scheme, site_domain from [[site_config]]) x using (site) where s.site <> 'shop.example.com'), "
    "shop as (select site, path, path as new_path, 'css' as kind, " + d.font_display(d.image_ext("body")) + " as new_body from [[stylesheets]] where site = 'shop.example.com')"
)
_PARTS = "select 'shop.example.com' as site, 'img/' || p_partkey || '.PNG' as path, 'img/' || p_partkey || '.webp' as new_path, 'image' as kind, p_name as new_body from [[part]]"


@query(
    f"with {_PASS}, {_OTHERS} select site, {_PP} as path, {_PP} as new_path, 'html' as kind, html as new_body from done "
    f"union all select * from css union all select * from shop union all {_PARTS} "
    "union all select 'shop.example.com', 'js/fuse.js', 'js/fuse.js', 'js', 'x' from (select count(*) as n from [[part]]) t"
)
def optimize_files(source):
    parts = source("part")
    images = parts.select(
        F.lit("shop.example.com").alias("site"), F.concat(F.lit("img/"), "p_partkey", F.lit(".PNG")).alias("path"), F.col("p_name").alias("body")
    )
    scripts = parts.select(
        F.lit("shop.example.com").alias("site"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("js/"), "p_partkey", F.lit(".js"))).otherwise("js/fuse.js").alias("path"),
        F.lit("x").alias("body"),
    ).distinct()
    pages = with_site(source("rich")).select("site", F.col("page_path").alias("path"), F.col("html").alias("body"))
    files = pages.unionByName(source("stylesheets")).unionByName(images).unionByName(scripts)
    return cl.optimize_files(files, SiteConfig.from_columns(), source("img_dims"), _settings(source))

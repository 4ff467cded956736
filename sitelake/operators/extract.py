"""References out of pages, stylesheets, sitemaps and robots files (one row to many).

Each operator reads the text once and hands on narrow rows only; the text itself never
enters a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake import fixed_values as fv
from sitelake.config import SiteConfig
from sitelake.functions import markup
from sitelake.functions.text import bind, entity_decode, is_empty, trimmed
from sitelake.functions.urls import resolve_ref, resource_kind, url_host, url_to_path

NO_REFS = "array<struct<source:string,ref:string>>"


def with_site(pages: DataFrame) -> DataFrame:
    """Add site, base and page_path to captured pages (page_id, url, html)."""
    url = F.col("url")
    return pages.withColumns(
        {
            "site": url_host(url),
            "base": F.concat(F.lit("https://"), url_host(url)),
            "page_path": url_to_path(url),
        }
    )


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def first_tokens(srcset: Column) -> Column:
    """The URLs of one srcset value."""
    urls = F.transform(F.split(srcset, ","), lambda part: F.split(trimmed(part), r"\s+")[0])
    return F.filter(urls, lambda url: ~is_empty(url))


# --- arrays of references in one text -------------------------------------------------------------


def link_refs(html: Column) -> Column:
    return _matches(html, fv.LINK_ATTRIBUTE)


def srcset_refs(html: Column) -> Column:
    return F.flatten(F.transform(_matches(html, fv.SRCSET_ATTRIBUTE), first_tokens))


def meta_image_refs(html: Column) -> Column:
    return _matches(html, fv.META_IMAGE)


def css_url_refs(css: Column) -> Column:
    return F.filter(_matches(css, fv.CSS_URL), lambda ref: ~F.startswith(ref, F.lit("data:")))


def css_import_refs(css: Column) -> Column:
    """The pattern is tried at each character, so a text is first cut at each ``@``: few have an ``@import`` at all."""
    named = lambda text: F.exists(F.split(text, "@", -1), lambda piece: F.regexp_like(piece, F.lit("(?i)^import")))
    none = F.array().cast("array<string>")
    return bind(css, lambda text: F.when(named(text), _matches(text, fv.CSS_IMPORT)).when(text.isNotNull(), none))


def sitemap_loc_refs(xml: Column) -> Column:
    return F.transform(_matches(xml, fv.SITEMAP_LOC), entity_decode)


def sitemap_media_refs(xml: Column) -> Column:
    return F.transform(_matches(xml, fv.SITEMAP_MEDIA_LOC), entity_decode)


def sitemap_alternate_refs(xml: Column) -> Column:
    return F.transform(_matches(xml, fv.SITEMAP_ALTERNATE), entity_decode)


def sitemap_stylesheet_refs(xml: Column) -> Column:
    return F.transform(_matches(xml, fv.SITEMAP_STYLESHEET), entity_decode)


def robots_sitemap_refs(txt: Column) -> Column:
    rows = F.transform(F.split(txt, r"\r\n|\r|\n"), trimmed)
    named = F.filter(rows, lambda row: F.startswith(F.lower(row), F.lit("sitemap:")))
    return F.filter(F.transform(named, lambda row: trimmed(F.substr(row, F.lit(9)))), lambda url: url != "")


EXTRACTORS = {
    "link": link_refs,
    "srcset": srcset_refs,
    "meta_image": meta_image_refs,
    "css_url": css_url_refs,
    "css_import": css_import_refs,
    "sitemap_loc": sitemap_loc_refs,
    "sitemap_media": sitemap_media_refs,
    "sitemap_alternate": sitemap_alternate_refs,
    "sitemap_stylesheet": sitemap_stylesheet_refs,
    "robots_sitemap": robots_sitemap_refs,
}
_BY_KIND = {
    "html": ("link", "srcset", "meta_image", "css_url", "css_import"),
    "css": ("css_url", "css_import"),
    "sitemap": ("sitemap_loc", "sitemap_media", "sitemap_alternate", "sitemap_stylesheet"),
    "robots": ("robots_sitemap",),
}
# Entries of sitemaps and robots files count only as they stand; all others are resolved.
_ABSOLUTE_ONLY = ("sitemap_loc", "sitemap_media", "sitemap_alternate", "robots_sitemap")


def extract(rows: DataFrame, text: str, source: str, *keys: str) -> DataFrame:
    """All references of one source: the key columns, pos and ref."""
    return rows.select(*keys, F.posexplode(EXTRACTORS[source](F.col(text))).alias("pos", "ref"))


def discovered_refs(text: Column, kind: Column) -> Column:
    """All references of a captured text by its kind, as array of (source, ref)."""

    def named(source: str) -> Column:
        return F.transform(EXTRACTORS[source](text), lambda ref: F.struct(F.lit(source).alias("source"), ref.alias("ref")))

    def of_kind(name: str) -> Column:
        return F.concat(*[named(source) for source in _BY_KIND[name]])

    refs = F.when(kind == "html", of_kind("html"))
    for name in ("css", "sitemap", "robots"):
        refs = refs.when(kind == name, of_kind(name))
    return refs.otherwise(F.array().cast(NO_REFS))


def discovered_links(captures: DataFrame) -> DataFrame:
    """Captures (site, base, url, page_path, content_type, body) to (site, base, page_url, source, ref, url)."""
    kind = resource_kind(F.col("page_path"), F.col("content_type"), F.col("body"))
    found = captures.select(
        "site", "base", F.col("url").alias("page_url"), F.explode(discovered_refs(F.col("body"), kind)).alias("r")
    ).select("site", "base", "page_url", "r.source", "r.ref")
    resolved = F.when(F.col("source").isin(*_ABSOLUTE_ONLY), trimmed(F.col("ref"))).otherwise(
        resolve_ref(F.col("ref"), F.col("page_url"), F.col("base"))
    )
    # A generator rather than a projection and a filter: later filters cannot repeat the resolution.
    return found.select("*", F.explode(F.filter(F.array(resolved), lambda url: url.isNotNull())).alias("url"))


# --- references of real elements ------------------------------------------------------------------


def element_refs(html: Column) -> Column:
    """href, src and srcset of the elements of a page, as array of (pos, source, ref); pos is the tag's index.

    Text in scripts, styles and comments is no element.
    """

    def of_attribute(item: Column, pos: Column) -> Column:
        def refs(name: Column, value: Column) -> Column:
            urls = F.when(name == "srcset", first_tokens(value)).otherwise(F.array(value))
            return F.transform(urls, lambda url: F.struct(pos.alias("pos"), name.alias("source"), url.alias("ref")))

        return refs(markup.attribute_name(item), entity_decode(markup.attribute_value(item)))

    def of_tag(tag: Column, pos: Column) -> Column:
        named = F.filter(
            markup.attributes(tag), lambda item: F.regexp_like(item, F.lit(r"(?i)^[\s/]*(?:href|src|srcset)\s*="))
        )
        return F.flatten(F.transform(named, lambda item: of_attribute(item, pos)))

    # Most tags carry no reference and are dropped before their attributes are looked at.
    placed = F.transform(
        markup.tags(markup.visible_markup(html)),
        lambda tag, i: F.when(
            ~F.startswith(tag, F.lit("</")) & F.regexp_like(tag, F.lit(r"""(?i)[\s/"'](?:href|src|srcset)\s*=""")), of_tag(tag, i)
        ),
    )
    return F.flatten(F.filter(placed, lambda refs: refs.isNotNull()))


def audit_refs(pages: DataFrame) -> DataFrame:
    """Pages (site, page_id, page_path, html) to links(site, page_id, page_path, pos, source, ref)."""
    return pages.select("site", "page_id", "page_path", F.explode(element_refs(F.col("html"))).alias("r")).select(
        "site", "page_id", "page_path", "r.*"
    )


# --- seeds and folders ----------------------------------------------------------------------------


def seed_urls(config: DataFrame) -> DataFrame:
    """Start URLs per site from a complete ``site_config`` table: home files, languages, configured extras."""
    cfg = SiteConfig.from_columns()
    base = F.concat(F.lit("https://"), F.col("site"))

    def under_base(path: Column) -> Column:
        return F.concat(base, F.lit("/"), F.ltrim(path, F.lit("/")))

    home = F.transform(F.array(*[F.lit(p) for p in fv.HOME_SEEDS]), under_base)
    languages = F.transform(cfg.col("language_slugs"), lambda slug: F.concat(under_base(slug), F.lit("/")))
    extras = F.transform(
        cfg.col("extra_urls"), lambda url: F.when(F.startswith(url, F.lit("http")), url).otherwise(under_base(url))
    )
    urls = F.array_distinct(F.concat(home, languages, extras))
    return config.select("site", F.explode(urls).alias("url"))


def ancestor_dirs(path: Column) -> Column:
    """All folders above a path, outermost first."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    return F.when(
        depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ).otherwise(F.array().cast("array<string>"))



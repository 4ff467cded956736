"""URL expressions.

Three resolvers differ on purpose: ``resolve_ref`` (crawling), ``internal_href_path`` (cleaning)
and ``audit_target`` (auditing) treat fragments, queries, own-host links and folding in their own way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelake import fixed_values as fv
from sitelake.config import SiteConfig
from sitelake.functions.paths import base_name, folded, folder_prefix, percent_decoded
from sitelake.functions.text import bind, entity_decode, is_empty, trimmed

# scheme, authority, path, query of any text; never fails, unlike a strict URL parser.
_URL = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
# The same four parts where the text must carry a host.
_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def url_host(url: Column) -> Column:
    """Lower-case host without user or port; empty if the text has none."""
    return F.lower(F.regexp_extract(url, _HOST, 1))


def raw_path(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 3)


def url_path(url: Column) -> Column:
    path = raw_path(url)
    return F.when(path == "", "/").otherwise(path)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 4)


def url_base(url: Column) -> Column:
    """Scheme and host of a page, as the base of its site."""
    return F.concat(url_scheme(url), F.lit("://"), url_host(url))


def url_parts(url: Column) -> Column:
    return F.struct(
        url_scheme(url).alias("scheme"),
        url_host(url).alias("host"),
        url_path(url).alias("path"),
        url_query(url).alias("query"),
    )


def without_fragment(ref: Column) -> Column:
    """The reference without ``#...``; NULL if nothing is left."""
    return F.nullif(F.regexp_replace(trimmed(ref), "#.*$", ""), F.lit(""))


def normal_url(url: Column, base: Column) -> Column:
    """The one form under which a URL counts as seen: site base and path, nothing else."""
    return F.concat(base, url_path(url))


def url_key(url: Column, base: Column) -> Column:
    return F.md5(normal_url(url, base))


def resolve_ref(ref: Column, page_url: Column, base: Column) -> Column:
    """A reference found on a page as absolute URL; NULL if it cannot be crawled."""

    def resolved(clean: Column) -> Column:
        joined = F.concat(folder_prefix(url_path(page_url)), clean)
        slash = F.when(clean.endswith("/"), "/").otherwise("")
        return (
            F.when(clean.startswith("//"), F.concat(F.lit("https:"), clean))
            .when(clean.startswith("/"), F.concat(base, clean))
            .when(F.regexp_like(clean, F.lit("(?i)^https?://")), clean)
            .when(~F.regexp_like(clean, F.lit(fv.CRAWL_SKIPPED_SCHEMES)), F.concat(base, F.lit("/"), folded(joined), slash))
        )

    return bind(without_fragment(ref), resolved)


def url_to_path(url: Column, content_type: Column | None = None) -> Column:
    """File path of a captured URL; NULL if the path tries to leave the site."""
    kind = F.lit("") if content_type is None else F.coalesce(F.lower(content_type), F.lit(""))

    def placed(path: Column) -> Column:
        stem = F.rtrim(path, F.lit("/"))
        return (
            F.when(path.contains(".."), F.lit(None))
            .when(stem == "", "index.html")
            .when(path.endswith("/"), F.concat(stem, F.lit("/index.html")))
            .when(base_name(path).contains("."), path)
            .when((kind == "") | kind.contains("text/html"), F.concat(path, F.lit("/index.html")))
            .otherwise(path)
        )

    return bind(raw_path(url), lambda raw: bind(F.ltrim(percent_decoded(raw), F.lit("/")), placed))


def internal_href_path(href: Column, page_path: Column, cfg: SiteConfig) -> Column:
    """Export path a link on an exported page points to, for the source and the target host."""

    def resolved(clean: Column) -> Column:
        host, path = url_host(clean), raw_path(clean)
        known = (host == F.lower(cfg.col("source_host"))) | (host == F.lower(cfg.col("target_host")))
        target = F.when(path.startswith("/"), path).otherwise(F.concat(folder_prefix(page_path), path))
        plain = folded(F.translate(target, "\\", "/"))
        return F.when(
            ~F.regexp_like(clean, F.lit(fv.EXPORT_SKIPPED_SCHEMES)) & ((host == "") | known) & (path != ""),
            F.nullif(plain, F.lit("")),
        )

    clean = F.regexp_replace(entity_decode(trimmed(href)), "[#?].*$", "")
    return bind(clean, resolved)


def audit_target(link: Column, page_path: Column, strict: bool = False) -> Column:
    """Export path a link should find, or NULL if it is not checked.

    Absolute links are never checked, own host or not. A link to the site root means ``index.html``;
    with ``strict`` it stays the empty path, which no file has, so that every such link is reported.
    """

    def resolved(clean: Column) -> Column:
        target = F.when(clean.startswith("/"), clean).otherwise(F.concat(folder_prefix(page_path), clean))
        plain = folded(F.translate(target, "\\", "/"))
        whole = F.when(clean.endswith("/") & (plain != ""), F.concat(plain, F.lit("/"))).otherwise(plain)
        return whole if strict else F.when(whole == "", "index.html").otherwise(whole)

    bare = F.regexp_replace(link, "[#?].*$", "")
    checked = (bare != "") & ~F.regexp_like(bare, F.lit(fv.AUDIT_SKIPPED_SCHEMES))
    return bind(F.when(checked, percent_decoded(bare)), lambda clean: F.when(clean.isNotNull(), resolved(clean)))


def normalize_site_url(raw: Column) -> Column:
    """``scheme://host`` in lower case, https unless http is given; empty if there is no host."""
    given = trimmed(raw)
    full = F.when(F.regexp_like(given, F.lit("(?i)^https?://")), given).otherwise(
        F.concat(F.lit("https://"), F.ltrim(given, F.lit("/")))
    )
    scheme = F.when(url_scheme(full) == "http", "http").otherwise("https")
    host = url_host(full)
    return F.when((given == "") | (host == ""), "").otherwise(F.concat(scheme, F.lit("://"), host))


def _without_first_label(host: Column) -> Column:
    return F.regexp_replace(host, r"^[^.]*\.", "")


def _has_subdomain(host: Column) -> Column:
    return F.size(F.split(host, r"\.")) >= 3


def registrable_domain(host: Column, target_host: Column, staging: Column) -> Column:
    """Domain of the site: of the target host if there is one, else of the host without its sub-domain."""
    shorter_target = F.when(_has_subdomain(target_host), _without_first_label(target_host)).otherwise(target_host)
    label = F.lower(staging)
    return (
        F.when(target_host != "", shorter_target)
        .when((label != "") & F.startswith(host, F.concat(label, F.lit("."))), F.substr(host, F.length(label) + 2))
        .when(host.startswith("www."), F.substr(host, F.lit(5)))
        .when(_has_subdomain(host), _without_first_label(host))
        .otherwise(host)
    )


def staging_label(host: Column) -> Column:
    """First label of a host with a sub-domain other than www, else ``admin``."""
    first = F.regexp_extract(F.lower(host), r"^[^.]*", 0)
    return F.when(_has_subdomain(host) & (first != "www"), first).otherwise("admin")


def is_sitemap(body: Column) -> Column:
    """Recognised by content: a sitemap root element within the first 2048 bytes."""
    head = F.lower(F.substring(body.cast("binary"), 1, fv.SITEMAP_HEAD).cast("string"))
    return head.contains(fv.SITEMAP_ROOTS[0]) | head.contains(fv.SITEMAP_ROOTS[1])


def resource_kind(path: Column, content_type: Column, body: Column) -> Column:
    """html / css / sitemap / robots / other, by content type or extension, in this order."""
    kind = F.coalesce(F.lower(content_type), F.lit(""))
    xml = kind.contains("xml") | F.regexp_like(path, F.lit(r"(?i)\.xml$"))
    return (
        F.when(kind.contains("text/html") | F.regexp_like(path, F.lit(r"(?i)\.html?$")), "html")
        .when(kind.contains("text/css") | F.regexp_like(path, F.lit(r"(?i)\.css$")), "css")
        .when(xml & is_sitemap(body), "sitemap")
        .when(path == "robots.txt", "robots")
        .otherwise("other")
    )


def lang_slug(url: Column, site: Column) -> Column:
    """First path segment if it looks like a language (en, pt-br) and the URL is relative or of this site."""
    clean = trimmed(url)
    host = url_host(clean)
    first = F.lower(F.regexp_extract(raw_path(clean), "^/*([^/]*)", 1))
    return F.when(((host == "") | (host == site)) & F.regexp_like(first, F.lit(fv.LANGUAGE_SLUG)), first)


def slug_list(raw: Column) -> Column:
    """Distinct valid language slugs of a free-text list, in order of appearance."""
    parts = F.transform(F.split(F.lower(raw), r"[\s,;]+"), lambda s: F.btrim(s, F.lit("/ \t")))
    return F.array_distinct(F.filter(parts, lambda s: F.regexp_like(s, F.lit(fv.LANGUAGE_SLUG))))


def normalize_ads_client(raw: Column) -> Column:
    """``ca-pub-N`` for any of the usual spellings; other text stays as it is."""
    given = trimmed(raw)
    return (
        F.when(F.regexp_like(given, F.lit("(?i)^ca-pub-")), F.concat(F.lit("ca-pub-"), F.substr(given, F.lit(8))))
        .when(F.regexp_like(given, F.lit("(?i)^pub-")), F.concat(F.lit("ca-"), given))
        .when(F.regexp_like(given, F.lit("^[0-9]+$")), F.concat(F.lit("ca-pub-"), given))
        .otherwise(given)
    )


# --- crawl filters --------------------------------------------------------------------------------


def denied(path: Column, excludes: Column | None = None) -> Column:
    """The path starts with a fixed or a configured prefix."""
    hit = F.lit(False)
    for prefix in fv.DENY_PREFIXES:
        hit = hit | path.startswith(prefix)
    if excludes is None:
        return hit
    return hit | F.exists(excludes, lambda prefix: F.startswith(path, prefix))


def exclude_prefixes(text: Column) -> Column:
    """Configured exclusions, one per line, as prefixes with a leading and without a trailing slash."""
    rows = F.transform(
        F.split(text, r"\r\n|\r|\n"), lambda row: F.concat(F.lit("/"), F.ltrim(trimmed(row), F.lit("/")))
    )
    return F.transform(F.filter(rows, lambda row: row != "/"), lambda row: F.rtrim(row, F.lit("/\\")))


def is_feed(path: Column) -> Column:
    return F.regexp_like(path, F.lit(fv.FEED_PATH))


def is_query_page(path: Column, query: Column) -> Column:
    """A page with a query; for a file the query is only dropped."""
    return ~is_empty(query) & ~F.regexp_like(path, F.lit(fv.ASSET_PATH))


def leaves_site(path: Column) -> Column:
    return percent_decoded(path).contains("..")


def is_crawlable(
    host: Column, path: Column, query: Column, site: Column, excludes: Column | None = None
) -> Column:
    """Internal, not denied, no feed, no page with a query, not out of the site. Cheap tests come first."""
    return (host == site) & ~denied(path, excludes) & ~is_feed(path) & ~is_query_page(path, query) & ~leaves_site(path)

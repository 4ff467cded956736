"""Page cleaning on token arrays.

A page is cut into tokens, edited by filters and transforms, and joined again: no shuffle and no Python.
Only the two look-ups that need other files (small stylesheets, image sizes) are joins; they run on narrow
rows and come back as one small map per page.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake import fixed_values as fv
from sitelake.config import SiteConfig, complete_config, heavy_sites, with_config, with_config_by_key
from sitelake.functions import markup as mk
from sitelake.functions.paths import extension, file_class, webp_path
from sitelake.functions.rewrite import (
    clean_robots,
    font_display,
    inlined_css,
    rewrite_chain,
    rewrite_image_ext,
    rewrite_srcset,
    without_blank_lines,
    without_feed_entries,
)
from sitelake.functions.text import bind, entity_decode, is_blank, is_empty, trimmed
from sitelake.functions.urls import internal_href_path, is_sitemap
from sitelake.operators.files import allowed_script, kept_in_tree
from sitelake.session import cut_lineage

KEYS = ["site", "page_path"]


# Settings are tested inside the lambdas: a branch around a step would repeat all steps before it.


def _words(value: Column) -> Column:
    return F.split(F.lower(trimmed(value)), r"\s+")


# --- whole tokens ---------------------------------------------------------------------------------


def strip_comments(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~F.startswith(t, F.lit("<!--")))


def _script_stays(script: Column, cfg: SiteConfig) -> Column:
    content = F.regexp_replace(script, r"(?is)^<script[^>]*>|</script\s*>$", "")
    return (
        (F.lower(trimmed(mk.attr(script, "type"))) == "application/ld+json")
        | allowed_script(mk.attr(script, "src"), cfg)
        | allowed_script(mk.attr(script, "id"), cfg)
        | allowed_script(content, cfg)
    )


def strip_scripts(tokens: Column, cfg: SiteConfig) -> Column:
    """Drop scripts, but for structured data and the allow-list."""
    return F.filter(tokens, lambda t: cfg.col("keep_js") | ~mk.is_start(t, "script") | _script_stays(t, cfg))


def _serves_scripts(link: Column, cfg: SiteConfig) -> Column:
    rels, href = _words(mk.attr(link, "rel")), F.lower(trimmed(mk.attr(link, "href")))
    fetched = (F.array_contains(rels, "preload") | F.array_contains(rels, "prefetch")) & (
        F.lower(trimmed(mk.attr(link, "as"))) == "script"
    )
    aimed = F.regexp_replace(href, "[?#].*$", "").endswith(".js")
    return (F.array_contains(rels, "modulepreload") | fetched | aimed) & ~allowed_script(href, cfg)


def strip_js_links(tokens: Column, cfg: SiteConfig) -> Column:
    """Drop links that only load scripts."""
    return F.filter(tokens, lambda t: cfg.col("keep_js") | ~mk.is_start(t, "link") | ~_serves_scripts(t, cfg))


def inline_styles(tokens: Column, styles: Column, cfg: SiteConfig) -> Column:
    """Put the small stylesheets (map from href to CSS) in place of their links."""

    def style(link: Column) -> Column:
        media = trimmed(mk.attr(link, "media"))
        shown = F.when((media == "") | (F.lower(media) == "all"), "").otherwise(mk.new_attribute("media", media))
        css = F.try_element_at(styles, mk.attr(link, "href"))
        return F.concat(F.lit("<style"), shown, F.lit(">"), css, F.lit("</style>"))

    def of(t: Column) -> Column:
        wanted = cfg.col("inline_css") & styles.isNotNull() & mk.is_start(t, "link")
        sheet = wanted & F.array_contains(_words(mk.attr(t, "rel")), "stylesheet")
        return F.when(sheet, F.coalesce(style(t), t)).otherwise(t)

    return F.transform(tokens, of)


def style_font_display(tokens: Column, cfg: SiteConfig) -> Column:
    wanted = lambda t: cfg.col("font_display") & mk.is_start(t, "style")
    return F.transform(tokens, lambda t: F.when(wanted(t), font_display(t)).otherwise(t))


def is_escaped(text: Column) -> Column:
    """Whether a text holds escaped markup and no tag of its own."""
    return text.contains("&lt;") & ~text.contains("<")


def unwrap_noscript(tokens: Column, cfg: SiteConfig) -> Column:
    """Keep what noscript holds, without the element; text that is escaped markup, and nothing else, is decoded."""

    def of(t: Column) -> Column:
        inner = F.regexp_replace(t, r"(?i)^<noscript\b[^>]*>|</noscript\s*>$", "")
        shown = F.when(is_blank(inner), "").when(is_escaped(inner), entity_decode(inner)).otherwise(inner)
        element = F.startswith(t, F.lit("<")) & F.regexp_like(t, F.lit(r"(?i)^</?noscript\b"))
        return F.when(~cfg.col("keep_js") & element, shown).otherwise(t)

    return F.transform(tokens, of)


# --- attributes -----------------------------------------------------------------------------------


def _value(items: Column, name: str) -> Column:
    found = F.get(F.filter(items, lambda item: mk.attribute_name(item) == name), F.lit(0))
    return F.coalesce(mk.attribute_value(found), F.lit(""))


def _has(items: Column, name: str) -> Column:
    return F.exists(items, lambda item: mk.attribute_name(item) == name)


def _put(items: Column, name: str, value: Column) -> Column:
    """Set an attribute, in its place if it exists, else at the end."""
    new = mk.new_attribute(name, value)

    def put(old: Column) -> Column:
        replaced = F.transform(old, lambda item: F.when(mk.attribute_name(item) == name, new).otherwise(item))
        return F.when(_has(old, name), replaced).otherwise(F.concat(old, F.array(new)))

    return bind(items, put)


_RAW_START = r"(?i)^<(?:script|style|textarea|noscript)[\s/>]"


def _edit_tags(tokens: Column, pattern: str, edit, active: Column | None = None) -> Column:
    """Rebuild the start tags that ``pattern`` finds worth a look; all other tokens pass as they are."""
    on = F.lit(True) if active is None else active

    def worth(t: Column) -> Column:
        # Text is ruled out by its first letter, before any pattern looks at it.
        return on & mk.is_start_tag(t) & F.regexp_like(t, F.lit(pattern)) & ~F.regexp_like(t, F.lit(_RAW_START))

    def rebuilt(t: Column) -> Column:
        return bind(mk.attributes(t), lambda items: mk.rebuilt(t, edit(items)))

    return F.transform(tokens, lambda t: F.when(worth(t), rebuilt(t)).otherwise(t))


def strip_handlers(tokens: Column, cfg: SiteConfig) -> Column:
    """Drop attributes whose name starts with ``on``."""
    drop = lambda items: F.filter(items, lambda item: ~F.startswith(mk.attribute_name(item), F.lit("on")))
    return _edit_tags(tokens, r"""(?i)[\s/"']on""", drop, ~cfg.col("keep_js"))


def strip_js_refs(tokens: Column, cfg: SiteConfig) -> Column:
    """Drop href and src that hold ``javascript:``."""

    def runs(item: Column) -> Column:
        value = F.lower(F.ltrim(mk.attribute_value(item)))
        return mk.attribute_name(item).isin("href", "src") & F.startswith(value, F.lit("javascript:"))

    drop = lambda items: F.filter(items, lambda item: ~runs(item))
    return _edit_tags(tokens, "(?i)javascript:", drop, ~cfg.col("keep_js"))


def promote_lazy(tokens: Column) -> Column:
    """Lazy-loading attributes become the real ones where these are empty, and go."""

    def real(items: Column, name: str, lazy: tuple[str, str]) -> Column:
        old, first, second = (_value(items, n) for n in (name, *lazy))
        lazy_value = F.when(is_empty(first), second).otherwise(first)
        return F.when(is_empty(old) & ~is_empty(lazy_value), _put(items, name, lazy_value)).otherwise(items)

    def edit(items: Column) -> Column:
        promoted = bind(real(items, "src", fv.LAZY_SRC), lambda x: real(x, "srcset", fv.LAZY_SRCSET))
        return F.filter(promoted, lambda item: ~mk.attribute_name(item).isin(*fv.LAZY_SRC, *fv.LAZY_SRCSET))

    return _edit_tags(tokens, r"""(?i)[\s/"']data-(?:lazy-)?src""", edit)


def rename_images(tokens: Column) -> Column:
    """Image extensions in src, href, poster, content and srcset."""

    def of(item: Column) -> Column:
        def renamed(name: Column) -> Column:
            value = mk.attribute_value(item)
            return (
                F.when(name == "srcset", mk.with_value(item, rewrite_srcset(value)))
                .when(
                    name.isin("src", "href", "poster", "content") & F.regexp_like(value, F.lit(r"(?i)\.(?:png|jpe?g)")),
                    mk.with_value(item, rewrite_image_ext(value)),
                )
                .otherwise(item)
            )

        return bind(mk.attribute_name(item), renamed)

    return _edit_tags(tokens, r"""(?i)\.(?:png|jpe?g)|[\s/"']srcset""", lambda items: F.transform(items, of))


def hint_images(tokens: Column, sizes: Column, cfg: SiteConfig) -> Column:
    """Sizes (map from src to width and height), asynchronous decoding, and priority for the first image.

    The first image of a page loads at once; all later ones load lazily unless they say otherwise.
    """

    def missing(items: Column, name: str, value: Column) -> Column:
        return F.when(_has(items, name), items).otherwise(F.concat(items, F.array(mk.new_attribute(name, value))))

    def sized(items: Column) -> Column:
        size = F.try_element_at(sizes, _value(items, "src"))
        both = _has(items, "width") & _has(items, "height")
        return bind(
            size,
            lambda s: F.when(
                s.isNotNull() & ~both,
                _put(_put(items, "width", s["width"].cast("string")), "height", s["height"].cast("string")),
            ).otherwise(items),
        )

    def edit(items: Column, first: Column) -> Column:
        urgent = lambda x: F.filter(
            missing(x, "fetchpriority", F.lit("high")), lambda item: mk.attribute_name(item) != "loading"
        )
        lazy = lambda x: missing(x, "loading", F.lit("lazy"))
        decoded = bind(sized(items), lambda x: missing(x, "decoding", F.lit("async")))
        return bind(decoded, lambda x: F.when(first, urgent(x)).otherwise(lazy(x)))

    def hinted(all_tokens: Column, first: Column) -> Column:
        return F.transform(
            all_tokens,
            lambda t, i: F.when(
                mk.is_start(t, "img"), bind(mk.attributes(t), lambda items: mk.rebuilt(t, edit(items, (i + 1) == first)))
            ).otherwise(t),
        )

    first_image = F.array_position(F.transform(tokens, lambda t: mk.is_start(t, "img")), True)
    return F.when(
        cfg.col("image_hints"), bind(first_image, lambda first: hinted(tokens, first))
    ).otherwise(tokens)


def lcp_image(html: Column) -> Column:
    """src of the first image of a page: the one that is never loaded lazily."""
    return mk.attr(F.get(mk.tags(mk.visible_markup(html), "img"), F.lit(0)), "src")


# --- text -----------------------------------------------------------------------------------------


# Any run of white space but the single plain space, which would only be replaced by itself.
_SPACE_RUN = r"(?U)[^\S ]\s*| \s+"


def collapse_space(html: Column) -> Column:
    """Runs of white space, Unicode spaces included, in text outside preformatted elements become one space."""
    pieces = F.regexp_extract_all(html, F.lit(mk.SPACE_TOKEN), F.lit(0))
    closed = F.transform(
        pieces, lambda t: F.when(F.startswith(t, F.lit("<")), t).otherwise(F.regexp_replace(t, _SPACE_RUN, " "))
    )
    return F.array_join(closed, "")


def _script_in_head(head: Column, mark: str) -> Column:
    scripts = mk.tags(head, "script")
    return F.exists(scripts, lambda tag: mk.attr(tag, "src").contains(mark))


def _with_head(html: Column) -> Column:
    """The page with a head, made if there is none."""
    root = F.regexp_extract(html, r"(?is)^.*?<html(?:>|[\s/][^>]*>)", 0)
    made = F.concat(root, F.lit("<head></head>"), F.substr(html, F.length(root) + 1))
    return F.when(mk.has_head(html), html).otherwise(made)


def inject_analytics(html: Column, cfg: SiteConfig) -> Column:
    """Analytics and advertising loaders at the start of the head, unless they are there already."""
    analytics, ads = trimmed(cfg.col("analytics_id")), trimmed(cfg.col("ads_client"))

    def tag(src: Column, more: str) -> Column:
        return F.concat(F.lit('<script async="" src="'), src, F.lit(f'"{more}></script>'))

    def injected(page: Column) -> Column:
        def additions(head: Column) -> Column:
            config = F.concat(F.lit("gtag('config', '"), F.replace(analytics, F.lit("'"), F.lit("\\'")), F.lit("');"))
            inline = F.concat(
                F.lit(
                    "<script>window.dataLayer = window.dataLayer || [];function gtag(){dataLayer.push(arguments);}"
                    "gtag('js', new Date());"
                ),
                config,
                F.lit("</script>"),
            )
            first = F.when(
                (analytics != "") & ~_script_in_head(head, fv.ANALYTICS_MARK),
                F.concat(tag(F.concat(F.lit(fv.ANALYTICS_LOADER), analytics), ""), inline),
            ).otherwise("")
            second = F.when(
                (ads != "") & ~_script_in_head(head, fv.ADS_MARK),
                tag(F.concat(F.lit(fv.ADS_LOADER), ads), ' crossorigin="anonymous"'),
            ).otherwise("")
            return F.concat(first, second)

        return mk.at_head_start(page, bind(mk.head_section(page), additions))

    return F.when((analytics == "") & (ads == ""), html).otherwise(bind(_with_head(html), injected))


def inject_csp(html: Column, cfg: SiteConfig) -> Column:
    """A policy that upgrades insecure requests, where https is forced and the head has no policy yet."""

    def wanted(head: Column) -> Column:
        metas = mk.tags(head, "meta")
        has = F.exists(metas, lambda m: F.lower(mk.attr(m, "http-equiv")) == "content-security-policy")
        return (head != "") & ~has

    return F.when(
        cfg.col("force_https") & bind(mk.head_section(html), wanted), mk.at_head_start(html, F.lit(fv.UPGRADE_POLICY))
    ).otherwise(html)


def inject_preloads(html: Column, original: Column, cfg: SiteConfig) -> Column:
    """Early connections to the font host a page uses, and preloads of the configured fonts."""
    lowered = F.lower(original)
    uses_fonts = lowered.contains("fonts.googleapis.com") | lowered.contains("fonts.gstatic.com")

    def additions(head: Column) -> Column:
        present = F.transform(
            mk.tags(head, "link"), lambda t: F.lower(F.concat(mk.attr(t, "rel"), F.lit("|"), mk.attr(t, "href")))
        )

        def links(existing: Column) -> Column:
            parts = []
            for origin, cross in zip(fv.FONT_ORIGINS, ("", ' crossorigin=""'), strict=True):
                absent = ~F.array_contains(existing, "preconnect|" + origin)
                parts.append(F.when(uses_fonts & absent, f'<link rel="preconnect" href="{origin}"{cross}>').otherwise(""))
            fonts = F.filter(
                cfg.col("preload_fonts"), lambda f: ~F.array_contains(existing, F.concat(F.lit("preload|"), F.lower(f)))
            )
            loads = F.transform(
                fonts,
                lambda f: F.concat(
                    F.lit('<link rel="preload" href="'), f, F.lit('" as="font"'),
                    F.when(F.regexp_like(f, F.lit(r"(?i)\.woff2(\?|$)")), ' type="font/woff2"').otherwise(""),
                    F.lit(' crossorigin="">'),
                ),
            )
            return F.concat(*parts, F.array_join(loads, ""))

        return bind(present, links)

    return F.when(mk.has_head(html), mk.at_head_start(html, bind(mk.head_section(html), additions))).otherwise(html)


# --- look-ups in other files ----------------------------------------------------------------------


def _sheet_hrefs(html: Column) -> Column:
    sheets = F.filter(
        mk.tags(html, "link"), lambda t: F.array_contains(_words(mk.attr(t, "rel")), "stylesheet")
    )
    return F.array_distinct(F.transform(sheets, lambda t: mk.attr(t, "href")))


_NOSCRIPT = r"(?is)<noscript\b[^>]*>(.*?)</noscript\s*>"


def _unsized_sources(html: Column) -> Column:
    """src of the images without both sizes, as it will read after lazy loading, decoding of escaped noscript, and renaming."""
    escaped = F.filter(F.regexp_extract_all(html, F.lit(_NOSCRIPT), F.lit(1)), is_escaped)
    hidden = F.flatten(F.transform(escaped, lambda text: mk.tags(entity_decode(text), "img")))
    lacking = F.filter(F.concat(mk.tags(html, "img"), hidden), lambda t: ~(mk.has_attr(t, "width") & mk.has_attr(t, "height")))

    def shown(t: Column) -> Column:
        values = F.array(mk.attr(t, "src"), *[mk.attr(t, name) for name in fv.LAZY_SRC])
        return F.get(F.filter(values, lambda v: ~is_empty(v)), F.lit(0))

    sources = F.array_distinct(F.transform(lacking, lambda t: rewrite_image_ext(shown(t))))
    return F.filter(sources, lambda src: src.isNotNull())


def _candidates(kind: Column, path: Column) -> Column:
    """Paths to try, in order: the path itself; for a ``.webp`` image also the png, jpg or jpeg it is made from."""
    stem = F.regexp_replace(path, r"(?i)\.webp$", ".")
    originals = F.array(*[F.concat(stem, F.lit(e)) for e in fv.IMAGE_EXTENSIONS])
    made = (kind == "image") & F.regexp_like(path, F.lit(r"(?i)\.webp$"))
    return F.when(made, F.concat(F.array(path), originals)).otherwise(F.array(path))


def page_lookups(
    pages: DataFrame, cfg: SiteConfig, styles: bool = True, images: bool = True, config: DataFrame | None = None, heavy: DataFrame | None = None
) -> DataFrame:
    """What pages look up in other files, in one pass over their text: (site, page_path, kind, key, rank, path).

    Two captures may share a path; their look-ups count once. The pages hold the columns that ``cfg`` reads, unless ``config``
    gives every site's settings, which then meet the look-ups and not the texts.
    """

    def of_kind(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda key: F.struct(F.lit(kind).alias("_kind"), key.alias("_key")))

    parts = []
    if styles:
        parts.append(of_kind("style", _sheet_hrefs(F.col("html"))))
    if images:
        parts.append(of_kind("image", _unsized_sources(F.col("html"))))
    if config is None:
        listed = pages.select("*", F.inline(F.concat(*parts)))
    else:
        refs = pages.select(*KEYS, F.concat(*parts).alias("_refs"))
        listed = with_config(refs, config, "page_path", heavy=heavy).select("*", F.inline("_refs"))
    path = internal_href_path(F.col("_key"), F.col("page_path"), cfg)
    # A generator again, so that the path is resolved once and not once more in a filter.
    aimed = listed.select(
        *KEYS, F.col("_kind").alias("kind"), F.col("_key").alias("key"),
        F.explode(F.filter(F.array(path), lambda p: p.isNotNull())).alias("aim"),
    )
    tried = aimed.select(*KEYS, "kind", "key", F.posexplode(_candidates(F.col("kind"), F.col("aim"))).alias("rank", "path"))
    return tried.distinct()


def _small_sheets(stylesheets: DataFrame, cfg: SiteConfig, config: DataFrame | None) -> DataFrame:
    """The stylesheets that any site's limit lets be inlined, written as a table.

    Most of what a tree's stylesheets hold may lie in texts far above the limit; they are read, or made, once here and not again for sizes, names and texts.
    A generator keeps the optimizer from computing a text for the filter and once more for the rows.
    """
    most = cfg.col("inline_css_max_bytes")
    if config is not None:
        # Rows of unknown sites get the defaults.
        unknown = complete_config(config.sparkSession.range(1).select(F.lit(None).cast("string").alias("site")))
        most = F.lit(complete_config(config).unionByName(unknown).agg(F.max(most)).first()[0])
        stylesheets = stylesheets.select("site", "path", "body")
    rows = stylesheets.select(*[name for name in stylesheets.columns if name != "body"], F.explode(F.array("body")).alias("body"))
    return cut_lineage(rows.filter(F.octet_length("body") <= most), "small-sheets")


def _inlinable(stylesheets: DataFrame, cfg: SiteConfig, config: DataFrame | None) -> DataFrame:
    """(site, path) of the stylesheets that are small enough to be inlined; their texts stay where they are."""
    size = F.octet_length("body")
    if config is not None:
        stylesheets = with_config(stylesheets.select("site", "path", size.alias("_size")), config)
        size = F.col("_size")
    return stylesheets.filter((size > 0) & (size <= cfg.col("inline_css_max_bytes"))).select("site", "path")


def _prepared(stylesheets: DataFrame, used: DataFrame, cfg: SiteConfig, config: DataFrame | None) -> DataFrame:
    """(site, path, css) of the stylesheets named in ``used`` (site, path), each prepared once.

    Texts over every site's limit are passed over where they are read. The others are never broadcast: what Spark takes for the size
    of a computed text says nothing about its length.
    """
    limit = cfg.col("inline_css_max_bytes")
    if config is None:
        sheets = stylesheets.filter(F.octet_length("body") <= limit).hint("merge").join(used, ["site", "path"], "left_semi")
    else:
        # One row.
        most = with_config(used, config).agg(F.max(limit).alias("_most"))
        small = stylesheets.select("site", "path", "body").join(F.broadcast(most), F.octet_length("body") <= F.col("_most")).drop("_most")
        sheets = small.hint("merge").join(with_config(used, config), ["site", "path"])
    return sheets.select("site", "path", inlined_css(F.col("body"), F.col("path"), cfg).alias("css"))


def lookup_targets(
    stylesheets: DataFrame | None, dims: DataFrame | None, cfg: SiteConfig, config: DataFrame | None = None
) -> DataFrame:
    """What can be found: (site, path, kind, width, height); stylesheets are named here and brought later."""
    found = []
    if stylesheets is not None:
        none = F.lit(None).cast("int")
        named = _inlinable(stylesheets, cfg, config)
        found.append(named.select("site", "path", F.lit("style").alias("kind"), none.alias("width"), none.alias("height")))
    if dims is not None:
        found.append(
            dims.filter("width > 0 and height > 0").select(
                "site", "path", F.lit("image").alias("kind"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")
            )
        )
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _looked_up(
    pages: DataFrame, cfg: SiteConfig, stylesheets: DataFrame | None, dims: DataFrame | None, config: DataFrame | None = None, heavy: DataFrame | None = None
) -> DataFrame:
    """Look-ups with what they found. A file used by every page of a large site is a hot key, which adaptive
    execution splits on the side of the pages."""
    wanted = page_lookups(pages, cfg, stylesheets is not None, dims is not None, config, heavy)
    return wanted.join(lookup_targets(stylesheets, dims, cfg, config), ["site", "path", "kind"])


def inline_css(pages: DataFrame, stylesheets: DataFrame, cfg: SiteConfig, config: DataFrame | None = None) -> DataFrame:
    """Small internal stylesheets of each page, ready to be placed: (site, page_path, href, css)."""
    stylesheets = _small_sheets(stylesheets, cfg, config)
    found = _looked_up(pages, cfg, stylesheets, None, config).select(*KEYS, F.col("key").alias("href"), "path")
    found = cut_lineage(found, "sheets-of-pages")
    css = _prepared(stylesheets, found.select("site", "path").distinct(), cfg, config)
    return found.join(css.hint("merge"), ["site", "path"]).select(*KEYS, "href", "css")


def image_dims(pages: DataFrame, dims: DataFrame, cfg: SiteConfig, config: DataFrame | None = None) -> DataFrame:
    """Sizes of the images that lack one: (site, page_path, src, width, height).

    ``src`` is the value after lazy loading and renaming; the first candidate with a size decides.
    """
    best = F.min(F.struct("rank", "width", "height")).alias("best")
    found = _looked_up(pages, cfg, None, dims, config).groupBy(*KEYS, F.col("key").alias("src")).agg(best)
    return found.select(*KEYS, "src", "best.width", "best.height")


_NO_STYLES = "map<string,string>"
_NO_SIZES = "map<string,struct<width:int,height:int>>"


def _bundles(named: DataFrame, stylesheets: DataFrame, cfg: SiteConfig, config: DataFrame | None) -> DataFrame:
    """(site, sheets, styles): each different set of stylesheets of a site's pages with its texts, as a map from href.

    Pages of a site share few sets, so a stylesheet's text is gathered once a set and not once a page.
    """
    sets = named.select("site", "sheets").filter(F.size("sheets") > 0).distinct()
    listed = sets.select("site", "sheets", F.inline("sheets"))
    css = _prepared(stylesheets, listed.select("site", "path").distinct(), cfg, config)
    texts = F.map_from_entries(F.collect_list(F.struct("key", "css"))).alias("styles")
    return listed.join(css.hint("merge"), ["site", "path"]).groupBy("site", "sheets").agg(texts)


def with_assets(
    pages: DataFrame,
    cfg: SiteConfig,
    stylesheets: DataFrame | None = None,
    dims: DataFrame | None = None,
    config: DataFrame | None = None,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Pages with the maps ``styles`` and ``sizes`` of what they look up, and with ``config`` their site's settings.

    One pass over the text finds all look-ups; they meet the names of the files and come back as one row per page, whose
    size is the number of look-ups of that page. These rows are written, so that the pass is not repeated for the sets. Stylesheets' texts are brought last, by
    set (see ``_bundles``). With ``config`` the settings, too, come to narrow rows; so a page's text moves once, in the last join, to its unique key.
    """
    maps = None
    if config is not None:
        heavy = cut_lineage(heavy_sites(pages), "heavy-sites") if heavy is None else heavy
    if stylesheets is not None:
        stylesheets = _small_sheets(stylesheets, cfg, config)
    if stylesheets is not None or dims is not None:
        entry = F.struct("kind", "key", "rank", "path", F.struct("width", "height").alias("size"))
        found = _looked_up(pages, cfg, stylesheets, dims, config, heavy).groupBy(*KEYS).agg(F.array_sort(F.collect_list(entry)).alias("found"))

        def first_of(kind: str, *wanted: str) -> Column:
            mine = F.filter("found", lambda e: e["kind"] == kind)
            # Sorted by key and rank: the first entry of a key is the best one.
            best = bind(mine, lambda es: F.filter(es, lambda e, i: (i == 0) | (F.get(es, i - 1)["key"] != e["key"])))
            return F.transform(best, lambda e: F.struct(*[e[name].alias(name) for name in wanted]))

        maps = found.select(*KEYS, first_of("style", "key", "path").alias("sheets"), F.map_from_entries(first_of("image", "key", "size")).alias("sizes"))
        maps = cut_lineage(maps, "assets")
        if stylesheets is None:
            maps = maps.select(*KEYS, F.lit(None).cast(_NO_STYLES).alias("styles"), "sizes")
        else:
            bundles = _bundles(maps, stylesheets, cfg, config).hint("merge")
            maps = maps.join(bundles, ["site", "sheets"], "left").select(*KEYS, "styles", "sizes")
    if config is not None:
        rows = with_config_by_key(pages, config, "page_path", heavy=heavy, beside=maps)
    else:
        rows = pages if maps is None else pages.join(maps.hint("merge"), KEYS, "left")
    if maps is None:
        return rows.withColumns({"styles": F.lit(None).cast(_NO_STYLES), "sizes": F.lit(None).cast(_NO_SIZES)})
    return rows


# --- the whole pass -------------------------------------------------------------------------------


def scripts_and_styles(tokens: Column, styles: Column, cfg: SiteConfig) -> Column:
    """The steps on whole tokens, then those on attributes, then noscript."""
    whole = strip_js_links(strip_scripts(strip_comments(tokens), cfg), cfg)
    styled = style_font_display(inline_styles(whole, styles, cfg), cfg)
    attributes = promote_lazy(strip_js_refs(strip_handlers(styled, cfg), cfg))
    return unwrap_noscript(attributes, cfg)


def inlined_pages(pages: DataFrame, stylesheets: DataFrame, cfg: SiteConfig, config: DataFrame | None = None) -> DataFrame:
    """Pages with their small stylesheets in place of the links, and nothing else changed."""
    rows = with_assets(pages, cfg, stylesheets, config=config)
    placed = inline_styles(mk.tokens(F.col("html")), F.col("styles"), cfg)
    return rows.withColumn("html", F.array_join(placed, "")).select(*pages.columns)


def clean_pages(
    pages: DataFrame,
    cfg: SiteConfig,
    stylesheets: DataFrame | None = None,
    dims: DataFrame | None = None,
    config: DataFrame | None = None,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Pages (site, page_path, html and the columns ``cfg`` reads) with the cleaned text as ``cleaned``.

    With ``config``, the settings of all sites, pages and stylesheets hold no settings of their own and ``cfg`` reads the table's columns (``SiteConfig.from_columns()``).
    Each step is a column of its own where later expressions use it more than once.
    """
    steps = {
        # White space is closed up within each piece of text as captured: pieces that only come to stand
        # side by side because a script between them goes keep a space each.
        "_spaced": lambda: collapse_space(F.col("html")),
        "_tokens": lambda: scripts_and_styles(mk.tokens(F.col("_spaced")), F.col("styles"), cfg),
        # Decoded noscript text may hold tags: cut again before the images are edited.
        "_again": lambda: mk.tokens(F.array_join("_tokens", "")),
        "_renamed": lambda: rename_images(F.col("_again")),
        "_text": lambda: F.array_join(hint_images(F.col("_renamed"), F.col("sizes"), cfg), ""),
        "_tracked": lambda: inject_analytics(F.col("_text"), cfg),
        "_safe": lambda: inject_csp(F.col("_tracked"), cfg),
        "_loaded": lambda: inject_preloads(F.col("_safe"), F.col("html"), cfg),
        "_chained": lambda: rewrite_chain(F.col("_loaded"), cfg),
        "cleaned": lambda: F.concat(without_blank_lines(F.col("_chained")), F.lit("\n")),
    }
    with ThreadPoolExecutor(1) as beside:
        # Building the expressions takes the driver seconds, in which the look-ups run.
        found = beside.submit(with_assets, pages, cfg, stylesheets, dims, config, heavy)
        named = [step().alias(name) for name, step in steps.items()]
        rows = found.result()
    # Each selection's later columns read its earlier ones. There are two, since the analyzer resolves nested functions
    # level by level, in a bounded number of rounds for each.
    return rows.select("*", *named[:2]).select("*", *named[2:]).select(*pages.columns, "cleaned")


def optimize_files(files: DataFrame, cfg: SiteConfig, dims: DataFrame | None = None, config: DataFrame | None = None) -> DataFrame:
    """Files (site, path, body and the columns ``cfg`` reads) after the whole pass: (site, path, new_path, kind, new_body).

    Removed scripts are left out, images get the path of their WebP, and text goes through the step for its kind. ``config`` as for ``clean_pages``.
    """
    path, body = F.col("path"), F.col("body")
    ext = extension(path)
    kind = (
        F.when(file_class(path) != "text", file_class(path))
        .when(~F.is_valid_utf8(body), "skipped")
        .when(ext.isin("html", "htm"), "html")
        .when((ext == "xml") & is_sitemap(body), "sitemap")
        .when((ext == "txt") & (F.lower(F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1)) == "robots"), "robots")
        .when(ext == "css", "css")
        .otherwise("text")
    )
    every = files.withColumn("kind", kind)
    others = every.filter("kind <> 'html'")
    heavy = None
    if config is not None:
        heavy = cut_lineage(heavy_sites(files), "heavy-sites")
        others = with_config_by_key(others, config, "path", heavy=heavy)
    new_path = F.when(F.col("kind") == "image", webp_path(path)).otherwise(path)
    others = others.filter(kept_in_tree(path, cfg)).select("*", new_path.alias("new_path"))
    # Robots files are rewritten line by line; all other text goes through one chain, prepared and finished by kind.
    rewritten = F.col("kind").isin("sitemap", "css", "js", "text")
    prepared = F.when(F.col("kind") == "sitemap", without_feed_entries(body)).when(rewritten, body)
    finished = (
        F.when(F.col("kind") == "robots", clean_robots(body, cfg))
        .when(F.col("kind") == "sitemap", without_blank_lines(F.col("chained")))
        .when(F.col("kind") == "css", font_display(F.col("chained"), cfg.col("font_display")))
        .otherwise(F.coalesce("chained", body))
    )
    texts = others.withColumn("chained", rewrite_chain(prepared, cfg)).withColumn("new_body", finished)
    columns = ["site", "path", "new_path", "kind", "new_body"]
    # Settings decide about scripts only, which pages are not.
    kept = every.filter("kind = 'html'").filter(kept_in_tree(path, SiteConfig()))
    pages = kept.withColumnsRenamed({"path": "page_path", "body": "html"})
    stylesheets = files.filter(extension(path) == "css")
    cleaned = clean_pages(pages, cfg, stylesheets, dims, config, heavy).select(
        "site", F.col("page_path").alias("path"), F.col("page_path").alias("new_path"), "kind", F.col("cleaned").alias("new_body")
    )
    return texts.select(*columns).unionByName(cleaned)

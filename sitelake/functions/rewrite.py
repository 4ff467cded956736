"""Text rewrites: hosts, schemes, image extensions, stylesheets, sitemaps, robots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelake import fixed_values as fv
from sitelake.config import SiteConfig
from sitelake.functions.paths import folded
from sitelake.functions.text import LINE_END, bind, is_blank, is_empty, quoted, replace_each, trimmed

# Slashes plain or JSON-escaped, and what must not touch a host name on either side.
SLASHES = r"(\\?/\\?/)"
NOT_BEFORE = r"(?<![\w.\-])"
NOT_AFTER = r"(?![a-z0-9\-.])"
IMAGE_TOKEN_END = r"""(?i)\.(png|jpe?g)(?=["'),?#<>]|$)"""
SUBDOMAINS = r"(?:[a-z0-9\-]+\.)*"
STAGING_DOMAIN = r"\.([a-z0-9\-]+(?:\.[a-z0-9\-]+)+)"


def _around(before: str, name: Column, after: str) -> Column:
    return F.concat(F.lit("(?i)" + before), quoted(name), F.lit(after))


def bare_host_pattern(host: Column) -> Column:
    """The host as a whole name: no longer name on either side of it."""
    return _around(NOT_BEFORE, host, NOT_AFTER)


def staging_pattern(label: Column) -> Column:
    return _around(NOT_BEFORE, label, STAGING_DOMAIN)


def insecure_pattern(domain: Column) -> Column:
    """``http:`` URLs of the domain and its sub-domains, JSON-escaped ones included."""
    return _around("http:" + SLASHES + "(" + SUBDOMAINS, domain, ")" + NOT_AFTER)


# A pattern that matches nothing. A rewrite that is off gets it instead of a branch, so that the text
# stands in every expression once and a chain of rewrites does not double at each link. Its length
# lets the search end at once instead of trying every position.
NOTHING = "(?!).{1000000000}"


def _where(active: Column, pattern: Column) -> Column:
    return F.when(active, pattern).otherwise(F.lit(NOTHING))


def rewrite_host(text: Column, cfg: SiteConfig, active: Column | None = None) -> Column:
    """Source host to target host: with a scheme the target's scheme, else protocol-relative or bare."""
    source, target = cfg.col("source_host"), cfg.col("target_host")
    mapped = cfg.has_host_map() if active is None else active
    steps = (
        (_around("https?:" + SLASHES, source, NOT_AFTER), F.concat(cfg.col("target_scheme"), F.lit(":$1"), target)),
        (_around(SLASHES, source, NOT_AFTER), F.concat(F.lit("$1"), target)),
        (bare_host_pattern(source), target),
    )
    for pattern, new in steps:
        text = F.regexp_replace(text, _where(mapped, pattern), new)
    return text


def rewrite_staging(text: Column, cfg: SiteConfig, active: Column | None = None) -> Column:
    """``admin.shop.tld`` to ``www.shop.tld``, for the configured labels."""
    pattern = staging_pattern(cfg.col("staging_label"))
    new = F.concat(cfg.col("production_label"), F.lit(".$1"))
    return F.regexp_replace(text, pattern if active is None else _where(active, pattern), new)


def force_https(text: Column, cfg: SiteConfig, active: Column | None = None) -> Column:
    domain = cfg.col("site_domain")
    wanted = cfg.col("force_https") & (domain != "")
    pattern = _where(wanted if active is None else wanted & active, insecure_pattern(domain))
    return F.regexp_replace(text, pattern, F.lit("https:$1$2"))


def rewrite_image_ext(text: Column) -> Column:
    """``.png/.jpg/.jpeg`` to ``.webp`` where the extension ends a URL."""
    return F.regexp_replace(text, IMAGE_TOKEN_END, ".webp")


def rewrite_chain(text: Column, cfg: SiteConfig) -> Column:
    """Hosts (mapped, else from staging to production), then https, then image extensions.

    A plain search of the lower-case text decides first which patterns can match at all; most texts need few.
    """

    def chained(whole: Column, lowered: Column) -> Column:
        mapped = cfg.has_host_map() & F.contains(lowered, F.lower(cfg.col("source_host")))
        staged = ~cfg.has_host_map() & F.contains(lowered, F.lower(F.concat(cfg.col("staging_label"), F.lit("."))))
        hosted = rewrite_staging(rewrite_host(whole, cfg, mapped), cfg, staged)
        # A mapped host may bring a new http URL.
        return rewrite_image_ext(force_https(hosted, cfg, mapped | F.contains(lowered, F.lit("http:"))))

    return bind(text, lambda whole: bind(F.lower(whole), lambda lowered: chained(whole, lowered)))


def rewrite_srcset(value: Column) -> Column:
    """Image extensions in the URL of each candidate; descriptors stay, separators become ``, ``."""
    parts = F.transform(F.split(value, ","), lambda part: F.split(trimmed(part), r"\s+"))
    kept = F.filter(parts, lambda tokens: ~is_empty(tokens[0]))
    new = F.transform(
        kept,
        lambda tokens: F.array_join(
            F.concat(
                F.array(F.regexp_replace(tokens[0], fv.IMAGE_EXTENSION_AT_END, ".webp")),
                F.slice(tokens, 2, F.size(tokens)),
            ),
            " ",
        ),
    )
    return F.array_join(new, ", ")


def _at_rules(css: Column, opening: str, end: str, body: Callable[[Column, Column], Column], whole: Callable[[Column], Column], untouched: bool) -> Column:
    """Rewrite every at-rule that begins as ``opening`` after its ``@``, up to the first ``end``: ``body(head, rest)`` gives the new strings.

    The text is cut at each ``@``, which costs far less than a search by pattern at each character, and only what begins as such a rule is looked at. If one
    is not closed before the next ``@``, the text goes through ``whole``. ``untouched``: texts without such a rule stay as they are, byte by byte.
    """
    opens = lambda piece: F.regexp_like(piece, F.lit(rf"(?i)^{opening}"))

    def rewritten(piece: Column, i: Column) -> Column:
        new = bind(F.split(piece, end, 2), lambda parts: F.when(F.size(parts) == 2, body(parts[0], F.get(parts, F.lit(1)))))
        return F.when(i == 0, F.array(piece)).when(opens(piece), new).otherwise(F.array(F.lit("@"), piece))

    def joined(text: Column, pieces: Column) -> Column:
        rules = F.exists(F.slice(pieces, 2, F.size(pieces)), opens)
        new = bind(F.transform(pieces, rewritten), lambda parts: F.when(F.exists(parts, lambda part: part.isNull()), whole(text)).otherwise(F.concat_ws("", F.flatten(parts))))
        return F.when(rules, new).otherwise(text) if untouched else new

    return bind(css, lambda text: F.when(text.isNotNull(), bind(F.split(text, "@", -1), lambda pieces: joined(text, pieces))))


def font_display(css: Column, active: Column | None = None) -> Column:
    """Add ``font-display:swap`` to every @font-face block without a font-display."""
    skipped = F.lit(False) if active is None else ~active
    given = lambda block: skipped | F.lower(block).contains("font-display")

    def whole(text: Column) -> Column:
        return replace_each(
            text, fv.FONT_FACE, lambda block: F.when(given(block), block).otherwise(F.regexp_replace(block, r"\}$", ";font-display:swap;}"))
        )

    def block(head: Column, rest: Column) -> Column:
        return F.array(F.lit("@"), head, F.when(given(head), "}").otherwise(";font-display:swap;}"), rest)

    return _at_rules(css, r"font-face\s*\{", r"\}", block, whole, untouched=True)


#: Stands between pieces of a text while it is rewritten.
_MARK = "\0"
_ROOTED = "(?:data:|https?:|/|#)"
#: The start of a reference that is not rooted.
_UNROOTED = rf"""(?i)(url\(\s*+["']?+)(?!{_ROOTED}|["')\s])"""
_SEGMENT = r"""(?!\.{1,2}+[/"')\s])[^"')\s/(]++"""
#: What is neither a rooted reference nor one that climbs so many times (the number stands in between) or more and then only descends.
_UNLIKE = (rf"""(?i)url\((?!\s*+["']?+(?:{_ROOTED}[^"')\s(]*+|(?:\.\./){{""", rf""",}}+{_SEGMENT}(?:/{_SEGMENT})*+)["']?+\s*+\))""")


def css_urls_to_root(css: Column, css_folder: Column) -> Column:
    """Relative ``url()`` references of a stylesheet as root-relative ones.

    Most references only climb at their start, and are put behind one of the folders above the stylesheet. A text of such references is replaced as a whole: in one pass
    if all climb to the root, else in a pass for each folder above. Other texts are cut at their references, and those that do not only climb are folded segment by segment.
    """
    above = F.filter(F.split(folded(css_folder), "/"), lambda part: part != "")

    def unlike(text: Column, climbs: Column) -> Column:
        return F.regexp_like(text, F.concat(F.lit(_UNLIKE[0]), climbs, F.lit(_UNLIKE[1])))

    def to_root(text: Column, depth: Column) -> Column:
        return F.regexp_replace(text, F.concat(F.lit(_UNROOTED + r"(?:\.\./){"), depth, F.lit(",}+")), F.lit("$1/"))

    def to_folders(text: Column, parts: Column) -> Column:
        depth = F.size(parts)

        def to_folder(new: Column, climbs: Column) -> Column:
            folder = F.regexp_replace(F.array_join(F.slice(parts, 1, depth - climbs), "/"), r"([\\$])", r"\\$1")
            pattern = F.concat(F.lit(_UNROOTED + r"(?:\.\./){"), climbs, F.lit(r"}+(?!\.\./)"))
            return F.regexp_replace(new, pattern, F.concat(F.lit("$1/"), folder, F.lit("/")))

        return to_root(F.aggregate(F.filter(F.sequence(F.lit(0), depth), lambda n: n < depth), text, to_folder), depth)

    def moved(ref: Column, folders: Column) -> Column:
        climbs = F.regexp_extract(ref, r"^(?:\.\./)*", 0)
        rest = F.substr(ref, F.length(climbs) + 1)
        folder = F.get(folders, F.least((F.length(climbs) / 3).cast("int"), F.size(folders) - 1))
        plain = ~F.regexp_like(rest, F.lit(r"(?:^|/)\.{0,2}(?:/|$)"))
        whole = F.concat(F.lit("/"), folded(F.concat(css_folder, F.lit("/"), ref)))
        return F.when(F.regexp_like(ref, F.lit(fv.CSS_ROOTED_URL)), ref).when(plain, F.concat(folder, rest)).otherwise(whole)

    def cut(text: Column, folders: Column) -> Column:
        pieces = F.split(F.regexp_replace(text, fv.CSS_URL_PARTS, f"$1{_MARK}$2{_MARK}$3"), _MARK, -1)
        return F.array_join(F.transform(pieces, lambda piece, i: F.when(i % 2 == 0, piece).otherwise(moved(piece, folders))), "")

    def one_by_one(match: Column) -> Column:
        part = lambda i: F.regexp_extract(match, fv.CSS_URL_PARTS, i)
        new = F.concat(part(1), F.lit("/"), folded(F.concat(css_folder, F.lit("/"), part(2))), part(3))
        return F.when(F.regexp_like(part(2), F.lit(fv.CSS_ROOTED_URL)), match).otherwise(new)

    def replaced(text: Column) -> Column:
        folders = bind(
            above,
            lambda parts: F.transform(
                F.reverse(F.sequence(F.lit(0), F.size(parts))),
                lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/"), F.when(n > 0, "/").otherwise("")),
            ),
        )
        # A text that holds the mark itself, or lies in no known folder, is cut by the same pattern without groups.
        marked = replace_each(text, r"""(?i)url\(\s*["']?[^"')\s]+["']?\s*\)""", one_by_one)
        cut_up = F.when(F.contains(text, F.lit(_MARK)) | css_folder.isNull(), marked).otherwise(bind(folders, lambda known: cut(text, known)))
        return bind(
            above,
            lambda parts: F.when(css_folder.isNotNull() & ~unlike(text, F.size(parts)), to_root(text, F.size(parts)))
            .when(css_folder.isNotNull() & ~unlike(text, F.lit(0)), to_folders(text, parts))
            .otherwise(cut_up),
        )

    return bind(css, replaced)


def without_charset(css: Column) -> Column:
    whole = lambda text: F.regexp_replace(text, fv.CSS_CHARSET, "")
    return _at_rules(css, "charset", ";", lambda head, rest: F.array(rest), whole, untouched=False)


def inlined_css(css: Column, css_path: Column, cfg: SiteConfig) -> Column:
    """A stylesheet made ready to stand inside a page."""
    moved = css_urls_to_root(without_charset(css), F.regexp_replace(css_path, "/?[^/]*$", ""))
    return rewrite_chain(font_display(moved, cfg.col("font_display")), cfg)


def without_blank_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, LINE_END), lambda row: ~is_blank(row)), "\n")


def without_feed_entries(xml: Column) -> Column:
    """A sitemap without its entries under ``/feed/``."""
    return F.regexp_replace(F.regexp_replace(xml, fv.SITEMAP_FEED_URL, ""), fv.SITEMAP_FEED_CHILD, "")


def clean_sitemap(xml: Column, cfg: SiteConfig) -> Column:
    """Drop entries under ``/feed/``, rewrite hosts, drop blank lines."""
    return without_blank_lines(rewrite_chain(without_feed_entries(xml), cfg))


def clean_robots(txt: Column, cfg: SiteConfig) -> Column:
    """Allow everything; of the old rules only the rewritten Sitemap lines remain."""
    rows = F.transform(F.split(txt, LINE_END), trimmed)
    sitemaps = F.filter(rows, lambda row: F.startswith(F.lower(row), F.lit("sitemap:")))
    header = F.array(*[F.lit(row) for row in fv.ROBOTS_HEADER])
    out = F.concat(header, F.transform(sitemaps, lambda row: rewrite_chain(row, cfg)))
    return F.concat(F.array_join(out, "\n"), F.lit("\n"))


def ads_txt_line(ads_client: Column) -> Column:
    """The ads.txt line of an account; empty without one."""
    given = trimmed(ads_client)
    account = F.regexp_replace(given, "(?i)^ca-", "")
    publisher = F.when(F.regexp_like(account, F.lit("(?i)^pub-")), account).otherwise(
        F.concat(F.lit("pub-"), F.ltrim(account, F.lit("-")))
    )
    line = F.concat(F.lit("google.com, "), publisher, F.lit(f", DIRECT, {fv.ADS_TXT_ACCOUNT}\n"))
    return F.when(given == "", "").otherwise(line)



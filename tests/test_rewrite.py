"""Golden rows of the text rewrites."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sitelake.config import SiteConfig
from sitelake.functions import rewrite as rw
from sitelake.operators.extract import EXTRACTORS

MAP = SiteConfig(source_host="admin.shop.com", target_host="www.shop.com", target_scheme="https", site_domain="shop.com")
PLAIN = SiteConfig(site_domain="shop.com")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("http://admin.shop.com/x", "https://www.shop.com/x"),
        ("//admin.shop.com/x", "//www.shop.com/x"),
        ("https:\\/\\/admin.shop.com\\/x", "https:\\/\\/www.shop.com\\/x"),
        ("mail me@admin.shop.com admin.shop.com", "mail me@www.shop.com www.shop.com"),
        ("admin.shop.com.evil.org", "admin.shop.com.evil.org"),
        ("subadmin.shop.com x.admin.shop.com", "subadmin.shop.com x.admin.shop.com"),
    ],
)
def test_rewrite_host(value, text, expected):
    assert value(lambda t: rw.rewrite_host(t, MAP), text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("https://admin.shop.co.uk/x", "https://www.shop.co.uk/x"),
        ("subadmin.shop.com", "subadmin.shop.com"),
        ("ADMIN.shop.com", "www.shop.com"),
        ("admin.local", "admin.local"),
    ],
)
def test_rewrite_staging(value, text, expected):
    assert value(lambda t: rw.rewrite_staging(t, PLAIN), text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("http://a.b.shop.com/x", "https://a.b.shop.com/x"),
        ("http:\\/\\/shop.com\\/", "https:\\/\\/shop.com\\/"),
        ("http://shop.com.evil.com/", "http://shop.com.evil.com/"),
        ("http://other.com/", "http://other.com/"),
    ],
)
def test_force_https(value, text, expected):
    assert value(lambda t: rw.force_https(t, PLAIN), text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('src="a.PNG"', 'src="a.webp"'),
        ("url(a.jpeg)", "url(a.webp)"),
        ("a.png?x", "a.webp?x"),
        ("a.png 2x", "a.png 2x"),
        ("see a.png\n", "see a.webp\n"),
        ("a.pngx", "a.pngx"),
    ],
)
def test_rewrite_image_ext(value, text, expected):
    assert value(rw.rewrite_image_ext, text) == expected


def test_rewrite_chain_is_idempotent(value):
    text = 'http://admin.shop.com/a.png" http:\\/\\/x.shop.com\\/b.jpg"'
    once = value(lambda t: rw.rewrite_chain(t, MAP), text)
    assert once == 'https://www.shop.com/a.webp" https:\\/\\/x.shop.com\\/b.webp"'
    assert value(lambda t: rw.rewrite_chain(t, MAP), once) == once


def test_rewrite_srcset_drops_empty_candidates(value):
    assert value(rw.rewrite_srcset, "a.png 1x, ,0 2x,b.gif  3x") == "a.webp 1x, b.gif 3x"


@pytest.mark.parametrize(
    ("css", "expected"),
    [
        ("@font-face{a:b}", "@font-face{a:b;font-display:swap;}"),
        ("@FONT-FACE {Font-Display:block}", "@FONT-FACE {Font-Display:block}"),
        ("p{}@font-face{}q", "p{}@font-face{;font-display:swap;}q"),
        ("p{}", "p{}"),
    ],
)
def test_font_display(value, css, expected):
    assert value(rw.font_display, css) == expected


@pytest.mark.parametrize(
    ("css", "expected"),
    [
        ("a{b:url(../i/x.png)}", "a{b:url(/i/x.png)}"),
        ("url('./y.woff') url(\"/z\") url(#q) url(data:x)", "url('/css/y.woff') url(\"/z\") url(#q) url(data:x)"),
        ("URL( ../../../w )", "URL( /w )"),
        ("url(a//b/./c/../d) url(..) url(\0../x) $1 url(a..)", "url(/css/a/b/d) url(/) url(/css/\0../x) $1 url(/css/a..)"),
        ("url(../../a/../b.png) url(./../x/) no url()", "url(/b.png) url(/x) no url()"),
    ],
)
def test_css_urls_to_root(value, css, expected):
    assert value(lambda c: rw.css_urls_to_root(c, F.lit("css")), css) == expected


def _one_by_one(css, folder):
    """Every reference by itself, segment by segment."""

    def moved(m):
        if re.match(r"(?i)data:|https?:|//|/|#", m[2]):
            return m[0]
        parts = []
        for part in f"{folder}/{m[2]}".split("/"):
            if part == "..":
                parts = parts[:-1]
            elif part not in ("", "."):
                parts.append(part)
        return f"{m[1]}/{'/'.join(parts)}{m[3]}"

    return re.sub(r"""(?i)(url\(\s*["']?)([^"')\s]+)(["']?\s*\))""", moved, css)


def _with_swap(m):
    return m[0] if "font-display" in m[0].lower() else m[0][:-1] + ";font-display:swap;}"


def test_rules_and_references_of_stylesheets_as_searched_one_by_one(spark):
    """Texts of parts in any order: unclosed rules, rules that hold others, references that climb, hold a bracket, a dot or a dollar."""
    parts = ["@charset", ' "u"', ";", "@CHARSET x;", "@font-face", " {", "{a:b", "}", "Font-Display:x", "@Font-Face {c}", "p@", "@import 'a';", "url(", "URL( '", ")", "' )", "../", "../../", "i/b.png", "./", "..",
             "/", "//c", "url(../i.png)", "url(i.png)", "url(../../../i)", "data:x", "#", "http://h", "$1", "\\", "(", "url('../a.b/.c')", "..a", "\n", " "]
    pick = random.Random(7)
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 12))) for _ in range(3000)] + ["".join(pick.choices(["url(../i.png)", "url('b/c')", "url(/x)", "p{", "url(../../y)"], k=9)) for _ in range(200)]
    rows = spark.createDataFrame([(i, t, pick.choice(("css", "", "a/$b/c", "a/./x/.."))) for i, t in enumerate([*texts, None])], "i int, css string, folder string")
    css, folder = F.col("css"), F.col("folder")
    refs = lambda source: EXTRACTORS[source](css)
    for row in rows.select("css", "folder", rw.without_charset(css).alias("plain"), rw.font_display(css).alias("fonts"), rw.css_urls_to_root(css, folder).alias("moved"), refs("css_url").alias("urls"), refs("css_import").alias("imports")).collect():
        if row.css is None:
            assert row[2:] == (None,) * 5
            continue
        assert row.plain == re.sub(r"(?i)@charset[^;]*;", "", row.css)
        assert row.fonts == re.sub(r"(?i)@font-face\s*\{[^}]*\}", _with_swap, row.css)
        assert row.moved == _one_by_one(row.css, row.folder), row.css
        assert row.urls == [u for u in re.findall(r"""(?i)url\(\s*['"]?([^'")\s]+)['"]?\s*\)""", row.css) if not u.startswith("data:")]
        assert row.imports == re.findall(r"""(?i)@import\s+["']([^"']+)["']""", row.css)


def test_long_stylesheets_take_less_than_a_search_at_each_character(spark):
    """Rules that begin with ``@`` are found faster than by one pass of a pattern; references cost a few passes, not a step each."""
    import time

    css = F.concat(F.lit('@charset "u";@font-face{a:b}'), F.repeat(F.lit("p{background:url(../i/b.png)}"), (F.col("id") + 400_000).cast("int")))
    rows = spark.range(0, 4, 1, 4).select(F.inline(F.array(F.struct(css.alias("css")))))

    def seconds(expression):
        taken = []
        for _ in range(2):
            start = time.time()
            rows.select(F.sum(F.octet_length(expression))).collect()
            taken.append(time.time() - start)
        return min(taken)

    one_pass = seconds(F.regexp_replace("css", r"(?i)\.(png|jpe?g)(?=\))", ".webp"))
    assert seconds(rw.font_display(F.col("css"))) < one_pass
    assert seconds(rw.without_charset(F.col("css"))) < one_pass
    assert seconds(F.array_join(EXTRACTORS["css_import"](F.col("css")), "")) < one_pass
    assert seconds(rw.css_urls_to_root(F.col("css"), F.lit("css"))) < 5 * one_pass


def test_css_urls_of_deep_folders_in_linear_time(value):
    import time

    css = "p{background:url(../i/b.png)}q{x:url(../../../../y)}" * 150_000
    value(lambda c: rw.css_urls_to_root(c, F.lit("a/./b/c")), "url(x)")
    start = time.time()
    assert value(lambda c: rw.css_urls_to_root(c, F.lit("a/./b/c")), css) == "p{background:url(/a/b/i/b.png)}q{x:url(/y)}" * 150_000
    assert time.time() - start < 30


def test_clean_robots(value):
    text = "User-agent: x\r\nDisallow: /\n SITEMAP: http://admin.shop.com/s.xml\r"
    assert value(lambda t: rw.clean_robots(t, MAP), text) == (
        "User-agent: *\nDisallow:\nSITEMAP: https://www.shop.com/s.xml\n"
    )


def test_clean_sitemap(value):
    xml = "<urlset>\n<url><loc>http://x/feed/</loc></url>\n\n<url><loc>http://shop.com/a</loc></url></urlset>"
    assert value(lambda t: rw.clean_sitemap(t, PLAIN), xml) == "<urlset>\n<url><loc>https://shop.com/a</loc></url></urlset>"


@pytest.mark.parametrize(
    ("client", "line"),
    [
        ("ca-pub-7", "google.com, pub-7, DIRECT, f08c47fec0942fa0\n"),
        ("-7", "google.com, pub-7, DIRECT, f08c47fec0942fa0\n"),
        (" ", ""),
    ],
)
def test_ads_txt_line(value, client, line):
    assert value(rw.ads_txt_line, client) == line

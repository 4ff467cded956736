"""Golden rows and properties of the token grammar and the cleaning steps."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelake.config import SiteConfig, with_config
from sitelake.functions import markup as mk
from sitelake.operators import clean as cl

CFG = SiteConfig()
KEEP = SiteConfig(keep_js=True)
SIZES = "map<string,struct<width:int,height:int>>"


def on_tokens(value, step, html):
    return value(lambda h: F.array_join(step(mk.tokens(h)), ""), html)


PIECES = st.sampled_from(
    ["<", ">", '"', "'", "<a href=x>", "</a>", "<!--", "-->", "<script>", "</script>", "<style x='>'>", "</style>", "<pre>", "</pre>",
     "<noscript>", "</noscript>", "text ", "\n", "é ", "<1", "<textarea", "=", "<img src=\"a>b\" alt>"]
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=20, max_size=40))
def test_tokens_give_back_the_text(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "html string")
    joined = rows.select("html", F.array_join(mk.tokens(F.col("html")), "").alias("back"))
    assert joined.filter("html <> back").count() == 0


def test_attributes_of_a_tag(value):
    tag = """<img alt="x > src=1" data-src=d src='a.png' hidden/>"""
    assert value(lambda t: mk.attr(t, "src"), tag) == "a.png"
    assert value(lambda t: mk.attr(t, "alt"), tag) == "x > src=1"
    assert value(lambda t: mk.has_attr(t, "hidden"), tag) is True
    assert value(lambda t: mk.has_attr(t, "width"), tag) is False
    assert value(lambda t: mk.rebuilt(t, mk.attributes(t)), tag) == tag


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<script>x</script>a", "a"),
        ('<script type=" Application/LD+JSON ">x</script>', '<script type=" Application/LD+JSON ">x</script>'),
        ('<script src="/FUSE.js"></script>', '<script src="/FUSE.js"></script>'),
        ("<script>new fuse(1)</script>", "<script>new fuse(1)</script>"),
        ('<script class="sfs-x">1</script>', ""),
        ('<script>var t="</p>";</script><p>', "<p>"),
        ("<script>open", ""),
    ],
)
def test_strip_scripts(value, html, expected):
    assert on_tokens(value, lambda t: cl.strip_scripts(t, CFG), html) == expected
    assert on_tokens(value, lambda t: cl.strip_scripts(t, KEEP), html) == html


@pytest.mark.parametrize(
    ("html", "stays"),
    [
        ('<link rel="modulepreload" href="/a">', False),
        ('<link rel="preload" as="script" href="/a">', False),
        ('<link rel="preload" as="font" href="/a">', True),
        ('<link rel="x" href="/a.JS?v=1">', False),
        ('<link rel="prefetch" as="script" href="/fuse.js">', True),
    ],
)
def test_strip_js_links(value, html, stays):
    assert on_tokens(value, lambda t: cl.strip_js_links(t, CFG), html) == (html if stays else "")


def test_handlers_and_javascript_refs(value):
    html = """<a OnClick="x()" href=" JavaScript:y" title="on = 1">on</a><p one="1">"""
    step = lambda t: cl.strip_js_refs(cl.strip_handlers(t, CFG), CFG)
    assert on_tokens(value, step, html) == """<a title="on = 1">on</a><p>"""
    keep = lambda t: cl.strip_js_refs(cl.strip_handlers(t, KEEP), KEEP)
    assert on_tokens(value, keep, html) == html


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ('<img data-src="a" alt>', '<img alt src="a">'),
        ('<img src="b" data-src="a">', '<img src="b">'),
        ('<img src="" data-src="" data-lazy-src="c"/>', '<img src="c"/>'),
        ("<source data-srcset='d 1x'>", '<source srcset="d 1x">'),
    ],
)
def test_promote_lazy(value, html, expected):
    assert on_tokens(value, cl.promote_lazy, html) == expected


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<noscript><b>x</b></noscript>", "<b>x</b>"),
        ("<noscript>&lt;b&gt;x&lt;/b&gt;</noscript>", "<b>x</b>"),
        ("<noscript>  </noscript>y", "y"),
        ("<noscript>a &amp; b</noscript>", "a &amp; b"),
    ],
)
def test_unwrap_noscript(value, html, expected):
    assert on_tokens(value, lambda t: cl.unwrap_noscript(t, CFG), html) == expected


def test_image_hints(spark):
    html = '<img src="/a.webp" width="1" loading="lazy"><img src="b"><img src="c" loading="eager" decoding="sync" width=2 height=3>'
    row = spark.createDataFrame([(html, {"/a.webp": (10, 20), "c": (9, 9)})], f"html string, sizes {SIZES}")
    out = row.select(F.array_join(cl.hint_images(mk.tokens(F.col("html")), F.col("sizes"), CFG), "")).first()[0]
    assert out == (
        '<img src="/a.webp" width="10" height="20" decoding="async" fetchpriority="high">'
        '<img src="b" decoding="async" loading="lazy">'
        '<img src="c" loading="eager" decoding="sync" width=2 height=3>'
    )


def test_collapse_space_spares_preformatted_text(value):
    html = "<p>a  \n b</p><pre> x  y </pre><textarea> 1  2</textarea>"
    assert value(cl.collapse_space, html) == "<p>a b</p><pre> x  y </pre><textarea> 1  2</textarea>"


@pytest.mark.parametrize("html", ["<html><head><title>t</title></head></html>", "<html lang=x><body>", "text only"])
def test_injections_are_idempotent(value, html):
    cfg = SiteConfig(analytics_id="G-1", ads_client="ca-pub-2", preload_fonts=("/f.woff2?x", "/g.ttf"))

    def whole(h):
        return cl.inject_preloads(cl.inject_csp(cl.inject_analytics(h, cfg), cfg), h, cfg)

    once = value(whole, html)
    assert once.index("preload") < once.index("Content-Security-Policy") < once.index("gtag/js") < once.index("adsbygoogle")
    assert once.count("<head>") == 1
    assert value(whole, once) == once


def test_whole_pass(spark):
    html = (
        '<html><head><link rel="stylesheet" href="s.css"><!-- c --></head><body onload="x()">\n\n'
        '<img data-src="/i/a.png">  <script>1</script>\n<a href="http://admin.shop.com/">x</a></body></html>'
    )
    pages = spark.createDataFrame([("admin.shop.com", "p/index.html", html)], "site string, page_path string, html string")
    sheets = spark.createDataFrame(
        [("admin.shop.com", "p/s.css", "p{b:url(x.png)}"), ("admin.shop.com", "p/t.css", "")], "site string, path string, body string"
    )
    dims = spark.createDataFrame([("admin.shop.com", "i/a.png", 4, 5)], "site string, path string, width int, height int")
    cfg = SiteConfig(source_host="admin.shop.com", target_host="www.shop.com", site_domain="shop.com")
    out = cl.clean_pages(pages, cfg, sheets, dims).first()["cleaned"]
    assert out == (
        '<html><head><meta http-equiv="Content-Security-Policy" content="upgrade-insecure-requests">'
        '<style>p{b:url(/p/x.webp)}</style></head><body> '
        '<img src="/i/a.webp" width="4" height="5" decoding="async" fetchpriority="high">  '
        '<a href="https://www.shop.com/">x</a></body></html>\n'
    )


def site_table(spark):
    """Pages of several sites that share stylesheets and images, one without a path, two captures of one page."""
    page = '<html><head><link rel="stylesheet" href="/a.css"><link rel=stylesheet href="b.css"></head><body><img src="/i/{0}.png"><img src="/i/x.jpg"><a href="http://{1}/">x</a></body></html>'
    data = [(f"s{i % 4}.com", f"p/{i}.html", page.format(i, f"s{i % 4}.com")) for i in range(24)]
    data += [("s1.com", None, page.format(1, "s1.com")), ("s1.com", "p/1.html", page.format(2, "s1.com")), ("s9.com", "q.html", "<p>no settings</p>"), ("s2.com", "empty.html", "")]
    pages = spark.createDataFrame(data, "site string, page_path string, html string")
    sheets = [(f"s{i}.com", path, f"p{{color:{i}}}" + path) for i in range(4) for path in ("a.css", "p/b.css", "unused.css")] + [("s3.com", "p/b.css2", "x"), ("s9.com", "a.css", "y" * 20_000)]
    dims = [(f"s{i}.com", path, i + 1, 5) for i in range(4) for path in ("i/x.jpg", "i/1.png", "i/2.png", "i/7.png")]
    config = [(f"s{i}.com", f"s{i}.com", f"www.s{i}.com" if i % 2 else "", "com", 15360 if i else 3) for i in range(4)]
    return (
        pages,
        spark.createDataFrame(sheets, "site string, path string, body string"),
        spark.createDataFrame(dims, "site string, path string, width int, height int"),
        spark.createDataFrame(config, "site string, source_host string, target_host string, site_domain string, inline_css_max_bytes int"),
    )


def test_settings_that_come_late_give_the_same_pages(spark):
    pages, sheets, dims, config = site_table(spark)
    cfg = SiteConfig.from_columns()
    columns = ["site", "page_path", "cleaned"]
    late = cl.clean_pages(pages, cfg, sheets, dims, config).select(*columns)
    early = cl.clean_pages(with_config(pages, config), cfg, with_config(sheets, config), dims).select(*columns)
    found = Counter(map(tuple, late.collect()))
    assert found == Counter(map(tuple, early.collect())) and sum(found.values()) == 28
    texts = " ".join(text for _, _, text in found)
    assert "<style>p{color:1}a.css</style>" in texts and 'width="2" height="5"' in texts and "https://www.s3.com/" in texts and "color:0" not in texts
    for late, early in (
        (cl.inlined_pages(pages, sheets, cfg, config), cl.inlined_pages(with_config(pages, config), with_config(sheets, config), cfg).select("site", "page_path", "html")),
        (cl.inline_css(pages, sheets, cfg, config), cl.inline_css(with_config(pages, config), with_config(sheets, config), cfg)),
        (cl.image_dims(pages, dims, cfg, config), cl.image_dims(with_config(pages, config), dims, cfg)),
    ):
        assert Counter(map(tuple, late.collect())) == Counter(map(tuple, early.collect()))


def test_images_in_escaped_noscript_get_their_sizes(spark):
    html = '<body><noscript>&lt;img src="/i/a.png" alt="a"&gt;</noscript><noscript><b>&lt;img src="/i/b.png"&gt;</b></noscript></body>'
    pages = spark.createDataFrame([("s.com", "p.html", html)], "site string, page_path string, html string")
    dims = spark.createDataFrame([("s.com", f"i/{n}.png", 4, 5) for n in "ab"], "site string, path string, width int, height int")
    cfg = SiteConfig(source_host="s.com", inline_css=False)
    assert [tuple(r) for r in cl.image_dims(pages, dims, cfg).collect()] == [("s.com", "p.html", "/i/a.webp", 4, 5)]
    out = cl.clean_pages(pages, cfg, None, dims).first()["cleaned"]
    assert 'src="/i/a.webp" alt="a" width="4" height="5"' in out and '<b>&lt;img src="/i/b.' in out


def nodes_of(plan):
    yield plan
    name = plan.nodeName()
    inner = plan.initialPlan() if name == "AdaptiveSparkPlan" else None
    children = [inner] if inner is not None else [plan.children().apply(i) for i in range(plan.children().length())]
    for child in children:
        yield from nodes_of(child)


def test_page_texts_and_stylesheets_move_once(spark):
    """Broadcasts off: a page's text is in one exchange, stylesheets are gathered by set and not by page."""
    pages, sheets, dims, config = site_table(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = cl.clean_pages(pages, SiteConfig.from_columns(), sheets, dims, config)
        nodes = list(nodes_of(rows._jdf.queryExecution().executedPlan()))
        columns = [(n.nodeName(), {n.output().apply(i).name() for i in range(n.output().length())}) for n in nodes]
        exchanges = [names for kind, names in columns if kind == "Exchange"]
        assert sum("html" in names for names in exchanges) == 1 and sum("body" in names for names in exchanges) == 1
        assert not any("Aggregate" in kind and names & {"html", "page_path"} and names & {"css", "styles", "html"} for kind, names in columns)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_of_stylesheets_are_never_broadcast(spark):
    """Bodies made of a short column: Spark takes them for short and would send them to the driver."""
    pages, sheets, dims, config = site_table(spark)
    sheets = sheets.withColumn("body", F.concat("body", F.repeat(F.lit(" "), F.length("path"))))
    cfg = SiteConfig.from_columns()
    for rows in (
        cl.inline_css(pages, sheets, cfg, config),
        cl.inlined_pages(pages, sheets, cfg, config),
        cl.clean_pages(pages, cfg, sheets, dims, config),
        cl.inline_css(with_config(pages, config), with_config(sheets, config), cfg),
    ):
        nodes = list(nodes_of(rows._jdf.queryExecution().executedPlan()))
        sent = [{n.output().apply(i).name() for i in range(n.output().length())} for n in nodes if n.nodeName() == "BroadcastExchange"]
        assert not any(names & {"body", "css", "styles"} for names in sent)


def test_texts_of_stylesheets_are_made_once(spark):
    """Those above the limit, too: sizes, names and texts come from one pass."""
    pages, sheets, dims, config = site_table(spark)
    cfg = SiteConfig.from_columns()
    for run in (
        lambda made: cl.inline_css(pages, made, cfg, config),
        lambda made: cl.inlined_pages(pages, made, cfg, config),
        lambda made: cl.clean_pages(pages, cfg, made, dims, config),
        lambda made: cl.inline_css(with_config(pages, config), with_config(made, config), cfg),
    ):
        calls = spark.sparkContext.accumulator(0)

        @F.udf("string")
        def text(body, calls=calls):
            calls.add(1)
            return body

        run(sheets.withColumn("body", text("body"))).collect()
        assert calls.value == sheets.count()


# --- pages as found in the wild


MANY = "<img " + " ".join(f'a{i}="{i}"' for i in range(100_000)) + " src='x.png' alt onerror=\"x()\">"


def test_tags_with_very_many_attributes(value):
    assert value(lambda t: mk.attr(t, "src"), MANY) == "x.png" and value(lambda t: mk.attr(t, "none"), MANY) == ""
    assert value(lambda t: mk.has_attr(t, "alt"), MANY) is True and value(lambda t: mk.has_attr(t, "none"), MANY) is False
    for cut in (mk.tokens, mk.tags, lambda t: mk.tags(t, "img")):
        assert value(cut, MANY) == [MANY]
    assert value(mk.visible_markup, MANY) == MANY
    assert value(lambda t: F.size(mk.attributes(t)), MANY) == 100_003
    assert "onerror" not in on_tokens(value, lambda t: cl.strip_handlers(t, CFG), MANY)


@pytest.mark.parametrize("part", ["<a ", "<a '", '<a ="', "<script x ", "<noscript ", "<!--", "<a \"'>", "<", "</"])
def test_unclosed_tags_take_linear_time(value, part):
    import time

    def seconds(n):
        start = time.time()
        assert value(lambda t: F.array_join(mk.tokens(t), ""), part * n) == part * n
        value(lambda t: F.size(mk.tags(mk.visible_markup(t))), part * n)
        return time.time() - start

    seconds(10)
    assert seconds(800_000) < 60  # squared, the smaller half of it took hours


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ('<img/src="a.png"/onerror="x()">', '<img/src="a.png">'),
        ('<a href="x"onclick="go()">', '<a href="x">'),
        ("<a title=' on' href=x>", "<a title=' on' href=x>"),
    ],
)
def test_handlers_without_white_space_before(value, html, expected):
    assert on_tokens(value, lambda t: cl.strip_handlers(t, CFG), html) == expected


def test_a_tag_that_the_text_ends_in_is_none(value):
    assert value(mk.tags, "<p>a<b c='>") == ["<p>"] and value(mk.tokens, "<p>a<b c='>") == ["<p>", "a", "<b c='>"]
    assert value(mk.tags, """<a " href=x><b>""") == ["""<a " href=x>""", "<b>"]


def test_policy_is_not_put_into_a_comment(value):
    page = "<!-- <head> --><script>'<head>'</script><html><head><title>t</title></head>"
    out = value(lambda h: cl.inject_csp(h, CFG), page)
    assert out.startswith("<!-- <head> --><script>'<head>'</script><html><head><meta ") and out.endswith("<title>t</title></head>")

"""Golden rows of the URL rules and their traps."""

import pytest
from pyspark.sql import functions as F

from sitelake.config import SiteConfig
from sitelake.functions import urls
from sitelake.functions.text import entity_decode
from sitelake.functions.urls import internal_href_path, is_crawlable, is_sitemap

BASE = "https://h.com"


@pytest.mark.parametrize(
    ("ref", "page", "expected"),
    [
        ("a.png", "https://h.com/x/y", "https://h.com/x/a.png"),
        ("../a/", "https://h.com/x/y/z", "https://h.com/x/a/"),
        ("../../../a", "https://h.com/x/y", "https://h.com/a"),
        ("./b?c=d/../e", "https://h.com/x/", "https://h.com/x/e"),
        ("./", "https://h.com/x", "https://h.com//"),
        ("#a", "https://h.com/", None),
        (" /p#frag ", "https://h.com/", "https://h.com/p"),
        ("/a/../b", "https://h.com/", "https://h.com/a/../b"),
        ("//cdn.com/x", "https://h.com/", "https://cdn.com/x"),
        ("HTTP://O.com/x", "https://h.com/", "HTTP://O.com/x"),
        ("MailTo:x@y", "https://h.com/", None),
        ("x", "https://h.com", "https://h.com/x"),
    ],
)
def test_resolve_ref(value, ref, page, expected):
    assert value(lambda r, p, b: urls.resolve_ref(r, p, b), ref, page, BASE) == expected


@pytest.mark.parametrize(
    ("url", "kind", "expected"),
    [
        ("https://h.com", "", "index.html"),
        ("https://h.com/", "", "index.html"),
        ("https://h.com/page/", "", "page/index.html"),
        ("https://h.com/page?x=1", "text/html", "page/index.html"),
        ("https://h.com/img/a.png", "image/png", "img/a.png"),
        ("https://h.com/api/data", "application/json", "api/data"),
        ("https://h.com/a%20b+c/", "", "a b+c/index.html"),
        ("https://h.com/100%", "", "100%/index.html"),
        ("https://h.com/%zz%41", "", "%zzA/index.html"),
        ("https://h.com/%2e%2e/x", "", None),
        ("https://h.com/v1.2/x", "", "v1.2/x/index.html"),
        ("https://h.com/a|b c", "", "a|b c/index.html"),
    ],
)
def test_url_to_path(value, url, kind, expected):
    assert value(lambda u, k: urls.url_to_path(u, k), url, kind) == expected


@pytest.mark.parametrize(
    ("link", "page", "expected"),
    [
        ("/", "a/index.html", "index.html"),
        ("x", "index.html", "x"),
        ("x/", "a/b.html", "a/x/"),
        ("../x?y#z", "a/b/c.html", "a/x"),
        ("https://h.com/x", "a.html", None),
        ("?only", "a.html", None),
        ("\\a\\b", "p/q.html", "p/a/b"),
        ("/a%2Fb", "q.html", "a/b"),
        ("../", "a/b.html", "index.html"),
    ],
)
def test_audit_target(value, link, page, expected):
    assert value(lambda r, p: urls.audit_target(r, p), link, page) == expected


def test_audit_target_strict_keeps_the_empty_path(value):
    assert value(lambda r, p: urls.audit_target(r, p, strict=True), "/", "a.html") == ""


@pytest.mark.parametrize(
    ("href", "expected"),
    [
        ("//h.com/a/../b.css?v=1", "b.css"),
        ("https://new.com/c.css", "c.css"),
        ("https://other.com/c.css", None),
        ("d.css", "p/d.css"),
        ("/", None),
        ("&#039;x&amp;y.css", "p/'x&y.css"),
        ("data:text/css,x", None),
    ],
)
def test_internal_href_path(value, href, expected):
    cfg = SiteConfig(source_host="h.com", target_host="new.com")
    assert value(lambda h, p: urls.internal_href_path(h, p, cfg), href, "p/index.html") == expected


@pytest.mark.parametrize(
    ("url", "ok"),
    [
        ("https://h.com/a", True),
        ("https://H.com:8080/a", True),
        ("https://o.com/a", False),
        ("https://h.com/cartoon", False),
        ("https://h.com/Cart", True),
        ("https://h.com/x/FEED/", False),
        ("https://h.com/feeds", True),
        ("https://h.com/list?page=2", False),
        ("https://h.com/list?0", True),
        ("https://h.com/a.PDF?x=1", True),
        ("https://h.com/private/x", False),
    ],
)
def test_crawlable(value, url, ok):
    def test(u):
        p = urls.url_parts(u)
        return urls.is_crawlable(p["host"], p["path"], p["query"], F.lit("h.com"), F.array(F.lit("/private")))

    assert value(test, url) is ok


@pytest.mark.parametrize(
    ("host", "target", "staging", "expected"),
    [
        ("admin.shop.co.uk", "", "admin", "shop.co.uk"),
        ("www.shop.com", "", "admin", "shop.com"),
        ("blog.shop.com", "", "admin", "shop.com"),
        ("shop.com", "", "admin", "shop.com"),
        ("x.org", "www.new.com", "admin", "new.com"),
        ("x.org", "new.com", "admin", "new.com"),
    ],
)
def test_registrable_domain(value, host, target, staging, expected):
    assert value(urls.registrable_domain, host, target, staging) == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("", ""),
        ("www.Site.com/x", "https://www.site.com"),
        (" HTTP://Site.com:80/ ", "http://site.com"),
        ("//site.com", "https://site.com"),
    ],
)
def test_normalize_site_url(value, raw, expected):
    assert value(urls.normalize_site_url, raw) == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("CA-PUB-12", "ca-pub-12"), ("pub-12", "ca-pub-12"), (" 12 ", "ca-pub-12"), ("x12", "x12"), ("", "")],
)
def test_normalize_ads_client(value, raw, expected):
    assert value(urls.normalize_ads_client, raw) == expected


def test_slug_list(value):
    assert value(urls.slug_list, "EN, /pt-BR/;xyz en\tde") == ["en", "pt-br", "de"]


def test_exclude_prefixes(value):
    assert value(urls.exclude_prefixes, "a/b/\r\n\r\n/\n /c ") == ["/a/b", "/c"]


@pytest.mark.parametrize(
    ("url", "expected"),
    [("/en/x", "en"), ("https://h.com/PT-br", "pt-br"), ("https://o.com/en/", None), ("/eng/", None), ("", None)],
)
def test_lang_slug(value, url, expected):
    assert value(lambda u: urls.lang_slug(u, F.lit("h.com")), url) == expected


def test_sitemap_is_recognised_in_the_first_part_only(value):
    assert value(urls.is_sitemap, "<?xml?><UrlSet>") is True
    assert value(urls.is_sitemap, " " * 2048 + "<urlset>") is False


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("/tom-&#038;-jerry.html", "/tom-&-jerry.html"),
        ("&#x26;&#X26;&#38;", "&&&"),
        ("/a&eacute;.html &lt;&gt;&quot;&#039;", "/aé.html <>\"'"),
        ("&amp;amp; &amp;#38; &#38;lt;", "&amp; &#38; &lt;"),
        ("&#128512;&#x1F600;", "😀😀"),
        ("&#0; &#xD800; &#x110000; &#150; &nosuch; &amp &; &#; &#x;", "&#0; &#xD800; &#x110000; &#150; &nosuch; &amp &; &#; &#x;"),
    ],
)
def test_entities_are_decoded_once(value, text, expected):
    assert value(entity_decode, text) == expected


def test_links_with_entities_find_their_files(value):
    assert value(lambda h: internal_href_path(h, F.lit("p/index.html"), SiteConfig()), "/tom-&#038;-jerry.html") == "tom-&-jerry.html"


def test_sitemap_head_is_counted_in_bytes(value):
    assert value(is_sitemap, "é" * 1020 + "<urlset>") is True
    assert value(is_sitemap, "é" * 1021 + "<urlset>") is False


def test_blank_entries_allow_no_script(value):
    from sitelake.operators.files import allowed_script

    assert value(lambda t: allowed_script(t, SiteConfig(script_allowlist=("", " "))), "a.js") is False
    assert value(lambda t: allowed_script(t, SiteConfig(script_allowlist=("", "FUSE"))), "fuse.js") is True


def test_urls_that_leave_the_site_are_not_crawlable(value):
    ok = lambda path: value(lambda p: is_crawlable(F.lit("h"), p, F.lit(""), F.lit("h")), path)
    assert ok("/a/b") is True and ok("/a/%2e%2e/b") is False

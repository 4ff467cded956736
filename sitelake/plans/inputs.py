"""Inputs derived from the given tables, in SQL that Spark and an oracle read alike.

``[[name]]`` names a given table or another derived input. Every derived input reads its whole table.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"

INPUTS = {
    # Captured pages with their site and path on the site.
    "sited": f"select page_id, url, html, {_HOST} as site, {_PATH} as url_path from [[pages]]",
    # Fetch results with failures and empty bodies.
    "captures": """
        select page_id, site, url, case when page_id % 13 = 0 then 404 when page_id % 17 = 0 then 500 else 200 end as status,
               case when page_id % 19 = 0 then 'timeout' end as error, case when page_id % 23 = 0 then '' else html end as body,
               'text/html; charset=utf-8' as content_type
        from [[sited]]""",
    # The pages enriched with heads that pass and fail each check, images, lazy loading, scripts and all kinds of links.
    "rich": """
        select page_id, url, site, url_path,
               concat(replace(replace(html, '</head>', concat(head, '</head>')), '</article>', concat(body, '</article>')),
                      chr(10), chr(10), ' ', chr(9), chr(10), case when page_id % 9 = 0 then chr(10) else '' end) as html
        from (
          select *, concat(
            case when page_id % 3 = 0 then '' else '<meta name="Description" content="d">' end,
            case when page_id % 4 = 0 then '' when page_id % 4 = 1 then '<link rel="canonical" href=" ">' else concat('<link rel="Canonical" href="', url, '">') end,
            '<link rel="stylesheet" media="print" href="/css/', page_id % 7, '.css"><link rel=''stylesheet'' href="/css/big.css?v=1">',
            '<link rel="modulepreload" href="/js/m.js"><link rel="preload" as="script" href="/js/p"><link rel="prefetch" href="/js/fuse.js">',
            '<link rel="alternate" hreflang="fr" href="https://', site, '/fr/"><link rel="alternate" hreflang="x" href="/pt-br/x">',
            '<script type="application/ld+json">{"url":"http:', chr(92), '/', chr(92), '/', site, chr(92), '/a.png"}</script>',
            '<script id="sfs-box">run("<a onclick=x>")</script><script src="/js/a.js"></script>',
            '<style>@font-face{font-family:f}@import "/css/x.css";p{background:url(/i/bg.png)}i{background:url(data:x)}</style>',
            '<meta property="og:image" content="https://', site, '/og/', page_id, '.jpg">',
            case when page_id % 5 = 0 then '<link href="https://fonts.googleapis.com/css?family=A" rel="stylesheet">' else '' end,
            case when page_id % 10 = 0 then '<meta http-equiv="Content-Security-Policy" content="default-src *">' else '' end) as head,
          concat(
            '<img src="/img/', page_id, '.png"', case when page_id % 2 = 0 then ' alt=""' else '' end, '>',
            '<img data-src="/img/', page_id % 50, '.jpg" alt="l" loading="eager"><img width="3" srcset="/img/s.jpg 1x,/img/x.jpeg  2x" alt="s">',
            '<img data-lazy-srcset="/img/l.png 1x" src="" data-lazy-src="img/r.png" alt="z">',
            '<a href="javascript:go()" onclick="go(1)" class=''k''>j</a><a href="mailto:a@b.c">m</a><a href="http://', site, '/q?x=1">q</a>',
            '<a href="//', site, '/cdn/x.zip">c</a><a href="https://other.example.org/">o</a><a href="', url_path, '">self</a>',
            '<a href="./rel.html#f">r</a><a href="../../up/">u</a><a href="/cart/1">1</a><a href="/cartoon">2</a><a href="/x/feed/">f</a>',
            '<a href="/list?page=2">p</a><a href="/doc.pdf?dl=1">d</a><a href="/">home</a><a href="/a%20b/c+d">e</a><a href="/w/', page_id, '.webp">w</a>',
            '<a href="/de/', page_id, '">l</a><a href="/de/">l</a><a href="', chr(92), 'back', chr(92), 'slash">b</a><a href="#top">t</a>',
            '<noscript><img src="/img/n.png" alt="n"></noscript><noscript>&lt;b&gt;t&lt;/b&gt;</noscript><noscript> </noscript>',
            '<video poster="/v/p.jpeg" src="v.mp4"></video><textarea> a  <i onclick="n"> b </textarea><pre> x  y </pre>', chr(160), ' ', chr(160), 'z',
            '<p>', case when page_id % 8 = 0 then concat('https://admin.', site, '/s') else '' end, '</p>',
            case when page_id % 6 = 0 then '<h1>second</h1>' else '' end, chr(10), chr(10), ' ', chr(13), chr(10), 'end') as body
          from [[untitled]]) t""",
    # The enriched pages; the first of each site is its home page, and one site in three has links to one language there only once.
    "homed": """
        select r.page_id, r.site, case when r.page_id = f.first_id then concat('https://', r.site, '/') else r.url end as url,
               case when r.page_id = f.first_id and f.first_id % 3 = 0 then replace(r.html, '<a href="/de/">l</a>', '') else r.html end as html
        from [[rich]] r join (select site, min(page_id) as first_id from [[sited]] group by site) f on f.site = r.site""",
    # Some pages without a title, a language or a main heading.
    "untitled": """
        select page_id, url, site, url_path,
               case when page_id % 14 = 3 then replace(html, '<title>', '<title> </title><title>') when page_id % 15 = 4 then replace(html, '<html lang', '<html data-lang')
                    when page_id % 16 = 5 then replace(html, '<h1', '<h4') else html end as html
        from [[sited]]""",
    # Three sites of linked pages: page i links to 2i+1 and 2i+2; pages below every eleventh are cut off.
    "linked": """
        select page_id, concat('s', page_id % 3, '.example.com') as site, cast(floor(page_id / 3) as bigint) as i,
               concat('https://s', page_id % 3, '.example.com/p/', cast(floor(page_id / 3) as bigint), '/') as url,
               concat(html, case when cast(floor(page_id / 3) as bigint) % 11 = 3 then '' else concat(
                 '<a href="/p/', cast(floor(page_id / 3) as bigint) * 2 + 1, '/">a</a><a href="../', cast(floor(page_id / 3) as bigint) * 2 + 2, '/#x">b</a>',
                 '<a href="/p/0/?q=1">q</a><a href="/cart/p/1/">c</a>') end) as html
        from [[pages]]""",
    # Files of the export of each page, and an earlier snapshot with new, changed, moved, removed and unchanged files.
    "exported": """
        select site, concat('p/', page_id % 10, '/', page_id, '/index.html') as path, html as body from [[sited]]
        union all
        select 'shop.example.com' as site, concat('img/', p_brand, '/', p_partkey, '.png') as path, p_type as body from [[part]]""",
    "baseline": """
        select site, case when page_id % 7 = 0 then concat('gone/', page_id, '.html') else concat('p/', page_id % 10, '/', page_id, '/index.html') end as path,
               case when page_id % 5 = 0 then concat(html, '<!-- old -->') else html end as body, '100644' as mode
        from [[sited]]
        union all
        select distinct site, 'readme.MD' as path, 'keep' as body, '100755' as mode from [[sited]]
        union all
        select 'shop.example.com' as site, concat('img/', p_brand, '/', p_partkey, '.png') as path, p_type as body, '100644' as mode from [[part]]""",
    # Export runs per site.
    "runs": """
        select o_orderkey as run_id, concat('site', o_custkey % 50) as site, o_orderdate as started, cast(floor(o_totalprice) as bigint) as size_bytes,
               case o_orderstatus when 'O' then 'running' when 'F' then 'done' else 'error' end as status
        from [[orders]]""",
    # Log lines per run.
    "logs": """
        select user_id as run_id, event_id as line, ts, case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' else 'INFO' end as level, event_type as message
        from [[events]]""",
    # Known image sizes.
    "img_dims": """
        select site, concat('img/', page_id, '.png') as path, cast(page_id % 40 * 10 as int) as width, cast(page_id % 30 * 5 as int) as height from [[sited]]
        union all
        select distinct site, 'img/n.png' as path, 7 as width, 8 as height from [[sited]]
        union all
        select 'shop.example.com' as site, concat('img/', p_partkey, '.png') as path, p_size * 10 as width, p_size * 5 as height from [[part]]""",
    # Stylesheets around the size limit for inlining.
    "stylesheets": """
        select site, concat('css/', n, '.css') as path, concat('@charset "utf-8";@font-face{font-family:f', n, '}p{background:url(../i/b', n, '.png)}') as body
        from (select distinct site, page_id % 7 as n from [[sited]]) t
        union all
        select site, 'css/big.css' as path, repeat('p{background:url(../i/b.png)}', 600) as body from (select distinct site from [[sited]]) t
        union all
        select 'shop.example.com' as site, concat('css/', s_suppkey, '.css') as path,
               concat('@charset "utf-8";@font-face{font-family:f}', repeat('p{background:url(../i/b.png)}', cast(s_suppkey * 10 as int))) as body
        from [[supplier]]""",
    # One sitemap per site, some entries under /feed/.
    "sitemaps": """
        select site, concat('<?xml version="1.0"?><?xml-stylesheet type="text/xsl" href="/main-sitemap.xsl"?>', chr(10), '<urlset>', chr(10), entries, '</urlset>') as xml
        from (
          select site, concat('<url><loc>', replace(url, '&', '&amp;'), case when page_id % 9 = 0 then '/feed/' else '' end, '</loc>',
                 '<image:image><image:loc>https://', site, '/img/', page_id, '.png</image:loc></image:image>',
                 '<xhtml:link rel="alternate" hreflang="de" href="https://', site, '/de/', page_id, '?a=1&amp;b=2"/></url>', chr(10), ' ', chr(10)) as entries
          from [[sited]]) t""",
    # A robots file per page, as its site would serve it.
    "robots": """
        select page_id, site, concat('User-agent: *', chr(10), 'Disallow: /x', page_id, chr(13), chr(10), ' sitemap: http://', site, '/sm-', page_id, '.xml ', chr(10),
               'Sitemap:https://', site, '/og/', page_id, '.png', chr(13), 'sitemap:') as txt
        from [[sited]]""",
    # Settings of every site: half of them map their host.
    "site_config": """
        select site, site as source_host,
               case when n % 2 = 0 then concat('www.new-', site) else '' end as target_host, case when n % 4 = 0 then 'http' else 'https' end as target_scheme,
               'example.com' as site_domain, case when n % 3 = 0 then '' else 'G-1' end as analytics_id,
               case when n % 5 = 0 then '' else concat('ca-pub-', n) end as ads_client, n % 7 <> 0 as ads_txt
        from (select site, min(page_id) as n from [[sited]] group by site) t""",
}

_NAME = re.compile(r"\[\[(\w+)\]\]")


def _with_clause(sql: str, table) -> str:
    """Turn the names in ``sql`` into common table expressions; ``table`` renders a given table."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in INPUTS and name not in order:
                visit(INPUTS[name])
                order.append(name)

    def render(text: str) -> str:
        return _NAME.sub(lambda m: m[1] if m[1] in INPUTS else table(m[1]), text)

    visit(sql)
    if not order:
        return render(sql)
    ctes = ", ".join(f"{name} as ({render(INPUTS[name])})" for name in order)
    if sql.lstrip().lower().startswith("with recursive "):
        return f"with recursive {ctes}, {render(sql.lstrip()[len('with recursive '):])}"
    if sql.lstrip().lower().startswith("with "):
        return f"with {ctes}, {render(sql.lstrip()[len('with '):])}"
    return f"with {ctes} {render(sql)}"


#: Given tables with short rows, which fit few splits, of which derived inputs make long texts and many files; and those of them of which a row makes a text of
#: megabytes, with the rows a task may get. File writers look at the bytes they hold only every hundred rows or so.
_DEALT = ("part", "supplier")
_LONG = {"supplier": 4}


def _dealt(rows: DataFrame, most: int | None = None) -> DataFrame:
    """The rows dealt out evenly, so that what is made of them is made by all tasks and not by the few that scan a small file; with ``most``, so many rows a task
    or fewer, which are counted first.

    A generator keeps the optimizer from moving a filter on a text that is made of a row to the scan, before the rows are dealt out.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if most is not None:
        parts = max(parts, -(-rows.count() // most))
    return rows.repartition(parts).select(F.inline(F.array(F.struct("*"))))


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table or a derived input as DataFrame."""
    if name not in INPUTS:
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
        return _dealt(rows, _LONG.get(name)) if name in _DEALT else rows

    def view(table: str) -> str:
        key = f"given_{table}_{zlib.crc32(folder.encode()):08x}"
        load(spark, folder, table).createOrReplaceTempView(key)
        return key

    return spark.sql(_with_clause(f"select * from [[{name}]]", view))


def oracle(sql: str) -> str:
    """SQL over the names above as one statement over the given tables."""
    return _with_clause(sql, lambda t: t)

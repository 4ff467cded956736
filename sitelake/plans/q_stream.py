"""Streaming queries: each runs over the whole pages table as a stream and returns what it stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake import fixed_values as fv
from sitelake.config import SiteConfig
from sitelake.plans import duck as d
from sitelake.plans.catalog import ORACLES, QUERIES
from sitelake.plans.inputs import oracle
from sitelake.plans.q_audit import _finding
from sitelake.session import new_folder
from sitelake.sources.tables import PAGES
from sitelake.streaming import pages as st


def _register(name, sql):
    def decorate(fn):
        QUERIES[name] = fn
        ORACLES[name] = oracle(sql)
        return fn

    return decorate


def _stream(spark, folder):
    # The table is a file or a folder of files; Spark's stream takes a single file by a pattern only.
    return st.stream_pages(spark, f"{folder}/page[s].parquet")


def _arrivals(spark, folder, parts=4):
    """The pages table in parts by page_id, as they may arrive one after the other."""
    pages = spark.read.schema(PAGES).parquet(f"{folder}/pages.parquet")
    least, most = pages.agg(F.min("page_id"), F.max("page_id")).first()
    width = ((most or 0) - (least or 0)) // parts + 1
    part = F.coalesce(F.floor((F.col("page_id") - (least or 0)) / width), F.lit(0))
    return [pages.filter(part == k) for k in range(parts)]


@_register(
    "stream_ingest",
    f"select site, md5('https://' || site || {d.or_slash('url_path')}) as url_key, min(page_id) as page_id from [[sited]] group by 1, 2",
)
def stream_ingest(spark, folder):
    root = new_folder(spark, "ingest")
    # A pass and a batch for each part, whose files are as many as tasks wrote them, with a restart between passes.
    for part in _arrivals(spark, folder):
        part.write.mode("append").parquet(f"{root}/pages")
        st.run_once(st.ingest_new(st.stream_pages(spark, f"{root}/pages"), f"{root}/seen", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/seen").select("site", "url_key", "page_id")


_CODES = ("TITLE", "META", "CANONICAL", "H1", "LANG", "ALT", "DOMINIO", "HTTPS")


@_register(
    "stream_audit",
    f"with seen_text as (select site, page_id, url, html, {d.shown('html')} as s from [[sited]]) "
    + " union all ".join(_finding(code) for code in _CODES),
)
def stream_audit(spark, folder):
    root = new_folder(spark, "audit")
    cfg = SiteConfig(source_host=F.col("site"), target_host="www.new.example", site_domain=F.col("site"))
    st.run_once(st.audit_stream(_stream(spark, folder), cfg, f"{root}/findings", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/findings")


_SLUG = f"lower(regexp_extract({d.path_of('ref')}, '^/*([^/]*)', 1))"


@_register(
    "stream_links_total",
    f"with links as (select site, unnest(regexp_extract_all(html, {d.q(fv.HREF_ATTRIBUTE)}, 1)) as ref from [[sited]]) "
    f"select site, {_SLUG} as slug, 0 as declared, count(*) as links from links "
    f"where regexp_matches({_SLUG}, '^[a-z]{{2}}(?:-[a-z]{{2}})?$') group by 1, 2",
)
def stream_links_total(spark, folder):
    root = new_folder(spark, "tally")
    st.run_once(st.tally_stream(_stream(spark, folder), f"{root}/tally", f"{root}/checkpoint"))
    return st.tally_total(spark, f"{root}/tally")

"""Language sections of sites, found in their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake import fixed_values as fv
from sitelake.functions.urls import lang_slug


def hreflang_refs(html: Column) -> Column:
    """The href of each ``<link hreflang=...>`` tag."""
    tags = F.regexp_extract_all(html, F.lit(fv.HREFLANG_TAG), F.lit(0))
    hrefs = F.transform(tags, lambda tag: F.regexp_extract(tag, fv.HREF_ATTRIBUTE, 1))
    return F.filter(hrefs, lambda ref: ref != "")


def href_refs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(fv.HREF_ATTRIBUTE), F.lit(1))


def slug_tally(pages: DataFrame, *keys: str) -> DataFrame:
    """Occurrences per (site, slug), and further columns ``keys`` of the pages: in hreflang tags and in links. Counts are combined before the shuffle."""

    def slugs(refs: Column, declared: bool) -> Column:
        return F.transform(
            refs,
            lambda ref: F.struct(
                lang_slug(ref, F.col("site")).alias("slug"), F.lit(declared).alias("is_declared")
            ),
        )

    html = F.col("html")
    refs = F.concat(slugs(hreflang_refs(html), True), slugs(href_refs(html), False))
    rows = pages.select("site", *keys, F.inline(refs)).filter("slug is not null")
    return rows.groupBy("site", *keys, "slug").agg(
        F.count_if("is_declared").alias("declared"), F.count_if(~F.col("is_declared")).alias("links")
    )


def slugs_of(tally: DataFrame) -> DataFrame:
    """Slugs declared by a tag, or linked at least twice."""
    return tally.filter((F.col("declared") > 0) | (F.col("links") >= fv.LANGUAGE_MIN_LINKS)).select("site", "slug")


def site_languages(pages: DataFrame) -> DataFrame:
    """Pages (site, html) to the languages of each site: (site, slug)."""
    return slugs_of(slug_tally(pages))


def home_languages(pages: DataFrame) -> DataFrame:
    """Languages of each site by its home page alone: (site, slug), from pages (site, page_path, page_id, html).

    Menus and the language switch stand there; two links to ``/de/`` somewhere on a large site make no language. Each capture of
    the home page is judged by itself.
    """
    home = pages.filter(F.col("page_path") == fv.HOME_PAGE)
    return slugs_of(slug_tally(home, "page_id")).select("site", "slug").distinct()


def all_languages(configured: DataFrame, sniffed: DataFrame) -> DataFrame:
    """Configured and sniffed slugs, each once."""
    return configured.select("site", "slug").unionByName(sniffed.select("site", "slug")).distinct()

"""Link and SEO audit of exported pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake import fixed_values as fv
from sitelake.config import SiteConfig
from sitelake.functions import markup
from sitelake.functions.rewrite import bare_host_pattern, insecure_pattern, staging_pattern
from sitelake.functions.text import is_blank
from sitelake.functions.urls import audit_target
from sitelake.operators.extract import audit_refs

# The codes of the findings.
CODES = ("TITLE", "META", "CANONICAL", "H1", "LANG", "ALT", "DOMINIO", "STAGING", "HTTPS")
DETAILS = {
    "TITLE": "title missing or blank",
    "META": "meta description missing or blank",
    "CANONICAL": "canonical link missing",
    "LANG": "no lang on html",
    "STAGING": "staging host left",
}
COUNTED_DETAILS = {
    "H1": " h1 elements",
    "ALT": " images without alt",
    "DOMINIO": " mentions of the source host",
    "HTTPS": " internal http URLs",
}


# --- one check each: the finding's n, or NULL if the page passes -----------------------------------


def _flag(missing: Column) -> Column:
    return F.when(missing, F.lit(1).cast("long"))


def _positive(n: Column) -> Column:
    return F.nullif(n.cast("long"), F.lit(0).cast("long"))


def title_check(shown: Column) -> Column:
    title = F.regexp_extract(shown, r"(?is)<title(?:\s[^>]*)?>(.*?)(?:</title|\z)", 1)
    return _flag(is_blank(title))


def description_check(shown: Column) -> Column:
    named = F.filter(markup.tags(shown, "meta"), lambda t: F.lower(markup.attr(t, "name")) == "description")
    return _flag(is_blank(F.coalesce(markup.attr(F.get(named, F.lit(0)), "content"), F.lit(""))))


def canonical_check(shown: Column) -> Column:
    links = F.filter(markup.tags(shown, "link"), lambda t: F.lower(markup.attr(t, "rel")).contains("canonical"))
    return _flag(is_blank(F.coalesce(markup.attr(F.get(links, F.lit(0)), "href"), F.lit(""))))


def h1_check(shown: Column) -> Column:
    n = F.regexp_count(shown, F.lit(r"(?i)<h1[\s/>]"))
    return F.when(n != 1, n.cast("long"))


def lang_check(shown: Column) -> Column:
    first = F.get(markup.tags(shown, "html"), F.lit(0))
    return _flag(is_blank(F.coalesce(markup.attr(first, "lang"), F.lit(""))))


def alt_check(shown: Column) -> Column:
    return _positive(F.size(F.filter(markup.tags(shown, "img"), lambda t: ~markup.has_attr(t, "alt"))))


def host_check(html: Column, cfg: SiteConfig) -> Column:
    """Mentions of the source host in the whole text, where hosts are mapped."""
    return F.when(cfg.has_host_map(), _positive(F.regexp_count(html, bare_host_pattern(cfg.col("source_host")))))


def staging_check(html: Column, cfg: SiteConfig) -> Column:
    """Any staging URL in the whole text, where hosts are not mapped."""
    return F.when(~cfg.has_host_map(), _flag(F.regexp_like(html, staging_pattern(cfg.col("staging_label")))))


def http_check(html: Column, cfg: SiteConfig) -> Column:
    domain = cfg.col("site_domain")
    return F.when(
        cfg.col("force_https") & (domain != ""), _positive(F.regexp_count(html, insecure_pattern(domain)))
    )


def page_checks(shown: Column, html: Column, cfg: SiteConfig) -> dict[str, Column]:
    """All checks by code. ``shown`` is the page without comments, scripts and styles."""
    return {
        "TITLE": title_check(shown),
        "META": description_check(shown),
        "CANONICAL": canonical_check(shown),
        "H1": h1_check(shown),
        "LANG": lang_check(shown),
        "ALT": alt_check(shown),
        "DOMINIO": host_check(html, cfg),
        "STAGING": staging_check(html, cfg),
        "HTTPS": http_check(html, cfg),
    }


def _detail(code: Column, n: Column) -> Column:
    text = F.lit(None).cast("string")
    for name, words in DETAILS.items():
        text = F.when(code == name, words).otherwise(text)
    for name, words in COUNTED_DETAILS.items():
        text = F.when(code == name, F.concat(n.cast("string"), F.lit(words))).otherwise(text)
    return text


def page_findings(pages: DataFrame, cfg: SiteConfig, codes: tuple[str, ...] = CODES) -> DataFrame:
    """Pages (site, page_path, html and the columns ``cfg`` reads) to findings(site, page_path, code, n, detail).

    One pass and no shuffle: the shown part of a page is computed once for all its checks.
    """
    shown = pages.withColumn("shown", markup.visible_markup(F.col("html")))
    checks = page_checks(F.col("shown"), F.col("html"), cfg)
    checked = shown.select("site", "page_path", *[checks[code].alias(code) for code in codes])
    found = F.array(*[F.struct(F.lit(code).alias("code"), F.col(code).alias("n")) for code in codes])
    rows = checked.select("site", "page_path", F.inline(found)).filter("n is not null")
    return rows.withColumn("detail", _detail(F.col("code"), F.col("n")))


# --- links ----------------------------------------------------------------------------------------


def present_targets(files: DataFrame) -> DataFrame:
    """Everything a link may name and find: each file, and each folder with an index.html, with or without slash.

    With both spellings in one key set, finding a target is a single equality join.
    """
    folder = F.regexp_extract("path", "^(.+)/index[.]html$", 1)
    names = F.when(folder == "", F.array("path")).otherwise(
        F.array("path", folder, F.concat(folder, F.lit("/")))
    )
    return files.select("site", F.explode(names).alias("target"))


def page_targets(pages: DataFrame, strict: bool = False) -> DataFrame:
    """Distinct checked links of each page: (site, page_path, ref, target)."""
    target = audit_target(F.col("ref"), F.col("page_path"), strict)
    return audit_refs(pages).select("site", "page_path", "ref", target.alias("target")).filter("target is not null")


def missing_targets(targets: DataFrame, files: DataFrame) -> DataFrame:
    """Links (site, page_path, ref, target) whose target is no file of the site.

    A target linked from every page is a hot key of the anti join; adaptive execution splits its
    partition on the link side, as nothing after the join relies on that partitioning. Duplicates go last.
    """
    lost = targets.join(present_targets(files), ["site", "target"], "left_anti")
    return lost.select("site", "page_path", "ref", "target").distinct()


def broken_links(pages: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """Pages (site, page_id, page_path, html) against files(site, path): (site, page_path, ref)."""
    return missing_targets(page_targets(pages, strict), files).select("site", "page_path", "ref")


def orphan_webp(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Broken ``.webp`` links whose original image exists: its conversion failed."""
    lost = missing_targets(page_targets(pages), files).filter(F.col("target").rlike(r"(?i)\.webp$"))
    originals = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*fv.IMAGE_EXTENSIONS)).select(
        "site", F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(".")).alias("stem")
    )
    return (
        lost.withColumn("stem", F.regexp_replace("target", r"(?i)webp$", ""))
        .join(originals, ["site", "stem"], "left_semi")
        .select("site", "page_path", "ref")
    )


def site_audit(pages: DataFrame, files: DataFrame, cfg: SiteConfig, strict: bool = False) -> DataFrame:
    """Per site and code: number of findings and sum of their n; broken links have the code LINK."""
    seo = page_findings(pages, cfg).select("site", "code", "n")
    links = broken_links(pages, files, strict).select("site", F.lit("LINK").alias("code"), F.lit(1).cast("long").alias("n"))
    return seo.unionByName(links).groupBy("site", "code").agg(
        F.count("*").alias("findings"), F.sum("n").alias("total")
    )

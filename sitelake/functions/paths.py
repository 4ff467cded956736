"""Path expressions: folding, percent-decoding, extensions, file classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelake import fixed_values as fv

_NEEDS_FOLDING = r"(^|/)\.{0,2}(/|$)"


def folded(path: Column) -> Column:
    """Drop empty and ``.`` segments, let ``..`` remove the segment before it, and drop outer slashes."""
    plain = F.btrim(path, F.lit("/"))
    walk = F.aggregate(
        F.split(plain, "/"),
        F.array().cast("array<string>"),
        lambda seen, part: F.when(part.isin("", "."), seen)
        .when(part == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0))))
        .otherwise(F.concat(seen, F.array(part))),
    )
    # Most paths are plain already; the walk runs only where a pattern says it could matter.
    return F.when(F.regexp_like(plain, F.lit(_NEEDS_FOLDING)), F.array_join(walk, "/")).otherwise(plain)


def folder_prefix(path: Column) -> Column:
    """Everything up to and including the last slash."""
    return F.regexp_replace(path, "[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def percent_decoded(text: Column) -> Column:
    """Decode ``%XX`` only: ``+`` stays, and a percent sign without two hex digits stays."""
    safe = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.try_url_decode(F.replace(safe, F.lit("+"), F.lit("%2B")))
    return F.when(text.contains("%"), F.coalesce(decoded, text)).otherwise(text)


def extension(path: Column) -> Column:
    """Lower-case extension of the last segment, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def file_class(path: Column) -> Column:
    """js / image / text / other, by extension."""
    ext = extension(path)
    return (
        F.when(ext == "js", "js")
        .when(ext.isin(*fv.IMAGE_EXTENSIONS), "image")
        .when(ext.isin(*fv.TEXT_EXTENSIONS), "text")
        .otherwise("other")
    )


def webp_path(path: Column) -> Column:
    return F.regexp_replace(path, fv.IMAGE_EXTENSION_AT_END, ".webp")

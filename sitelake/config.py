"""Per-site settings.

Every field takes a plain Python value (one setting for all rows) or a Column (a setting
per row, after the rows were joined with a ``site_config`` table).
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelake import fixed_values as fv

Setting = str | bool | int | tuple | Column | None


@dataclass(frozen=True)
class SiteConfig:
    source_host: Setting = ""
    target_host: Setting = ""
    target_scheme: Setting = "https"
    staging_label: Setting = "admin"
    production_label: Setting = "www"
    site_domain: Setting = ""
    force_https: Setting = True
    keep_js: Setting = False
    script_allowlist: Setting = fv.SCRIPT_ALLOWLIST
    inline_css: Setting = True
    #: Stylesheets with more bytes stay linked.
    inline_css_max_bytes: Setting = fv.INLINE_CSS_MAX_BYTES
    font_display: Setting = True
    image_hints: Setting = True
    preload_fonts: Setting = ()
    analytics_id: Setting = ""
    ads_client: Setting = ""
    ads_txt: Setting = True
    language_slugs: Setting = ()
    extra_urls: Setting = ()
    exclude_paths: Setting = ()
    preserve_files: Setting = fv.PRESERVED_FILES
    keep_exports: Setting = fv.EXPORTS_KEPT

    def col(self, name: str) -> Column:
        """The setting as a Column; lists become array<string>."""
        value = getattr(self, name)
        if isinstance(value, Column):
            return value
        if isinstance(value, tuple | list):
            return F.array(*[F.lit(v) for v in value]).cast("array<string>")
        return F.lit(value)

    def has_host_map(self) -> Column:
        source, target = self.col("source_host"), self.col("target_host")
        return (target != "") & (source != "") & (target != source)

    @classmethod
    def from_columns(cls, prefix: str = "") -> SiteConfig:
        """Read every setting from the row (see ``with_config``)."""
        return cls(**{f.name: F.col(f"{prefix}{f.name}") for f in fields(cls)})


_LISTS = ("script_allowlist", "preload_fonts", "language_slugs", "extra_urls", "exclude_paths", "preserve_files")
_FLAGS = ("force_https", "keep_js", "inline_css", "font_display", "image_hints", "ads_txt")


def _type_of(name: str) -> T.DataType:
    if name in _LISTS:
        return T.ArrayType(T.StringType())
    if name in _FLAGS:
        return T.BooleanType()
    return T.IntegerType() if name in ("keep_exports", "inline_css_max_bytes") else T.StringType()


SITE_CONFIG_SCHEMA = T.StructType(
    [T.StructField("site", T.StringType(), False)]
    + [T.StructField(f.name, _type_of(f.name)) for f in fields(SiteConfig)]
)


def complete_config(config: DataFrame) -> DataFrame:
    """Give a partial ``site_config`` table every column; absent or NULL settings take their default."""
    defaults = SiteConfig()
    filled = [
        F.coalesce(F.col(f.name), defaults.col(f.name)).alias(f.name)
        if f.name in config.columns
        else defaults.col(f.name).alias(f.name)
        for f in fields(SiteConfig)
    ]
    return config.select("site", *filled)


#: A site with more than one in so many rows, for each shuffle partition, is heavy. Fewer sites than that number can be.
_SHARES = 16


def heavy_sites(rows: DataFrame) -> DataFrame:
    """(site, parts): how many parts each heavy site's rows are dealt out to, so that a part is a small share of a partition.

    With s = 16 * shuffle partitions, a site is heavy if it has more than one in s rows. So there are fewer than s heavy sites, of at most s parts each
    and fewer than 2 * s in all; the rows are counted without their texts, combined before the shuffle.
    """
    shares = _SHARES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).withColumn("one", F.lit(1))
    shared = counts.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").filter(F.col("n") * shares > F.col("total"))
    return shared.select("site", F.ceil(F.col("n") * shares / F.col("total")).alias("parts"))


def with_config(rows: DataFrame, config: DataFrame, *spread: str, heavy: DataFrame | None = None) -> DataFrame:
    """Every row sees its site's settings; rows of unknown sites get the defaults.

    No broadcast hint: Spark broadcasts the table when its measured size is below
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise joins by shuffle, where adaptive
    execution splits the partition of a dominant site on the row side.

    With ``spread``, columns that tell a site's rows apart, no partition depends on that: the rows of heavy sites are dealt out to parts by these
    columns, and the settings of such a site are repeated for each of its parts. ``heavy`` may give the heavy sites, where they were found before (see ``heavy_sites``).
    """
    defaults = SiteConfig()
    settings, wide, keys = complete_config(config), rows, ["site"]
    if spread:
        heavy = F.broadcast((heavy_sites(rows) if heavy is None else heavy).withColumnRenamed("parts", "_parts"))
        part = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")), F.lit(0))
        wide = rows.join(heavy, "site", "left").withColumn("_part", part).drop("_parts")
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))
        settings, keys = settings.join(heavy, "site", "left").withColumn("_part", copies).drop("_parts"), ["site", "_part"]
    joined = wide.join(settings, keys, "left")
    return joined.select(
        *rows.columns,
        *[F.coalesce(F.col(f.name), defaults.col(f.name)).alias(f.name) for f in fields(SiteConfig)],
    )


def with_config_by_key(
    rows: DataFrame, config: DataFrame, *keys: str, heavy: DataFrame | None = None, beside: DataFrame | None = None
) -> DataFrame:
    """As ``with_config`` for rows with long texts, told apart by site and ``keys``: the settings come to the narrow keys first.

    Then the texts move once, to the unique key, where no site is heavy. ``beside`` may hold more columns per site and keys,
    which come along in the same join; they may be long, so they are never broadcast. Null keys count as equal.
    """
    named = ["site", *keys]
    narrow = with_config(rows.select(*named).distinct(), config, *keys, heavy=heavy)
    if beside is not None:
        narrow = narrow.join(beside.hint("merge"), named, "left").hint("merge")
    renamed = narrow.withColumnsRenamed({name: f"_{name}" for name in named})
    met = [rows[name].eqNullSafe(renamed[f"_{name}"]) for name in named]
    return rows.join(renamed, met, "left").drop(*[f"_{name}" for name in named])

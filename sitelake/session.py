"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# What the engine relies on: adaptive plans split the partition of a hot key at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int = 8, partitions: int | None = None, **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("sitelake")
    settings = SETTINGS | {
        "spark.sql.shuffle.partitions": str(partitions or cores),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (settings | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session, which has no other machine, may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="sitelake-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as a table in the shared folder and read them back.

    The result survives lost executors, and later plans start from the files.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class BucketedTable:
    """Rows kept in the session's catalog by buckets of a join key: joins on this key move only the other side.

    Appended rows go to the same buckets, so the table stays so placed as it grows. There are as many buckets as shuffle partitions were set when the table was
    made. Files lie in the shared folder, one partition per value of ``part``; ``drop`` takes the table out of the catalog and leaves the files.
    """

    def __init__(self, spark: SparkSession, name: str, *keys: str, part: str | None = None) -> None:
        self.spark, self.keys, self.part = spark, keys, part
        self.table = f"sitelake_{uuid.uuid4().hex}"
        self.folder = new_folder(spark, name)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def append(self, df: DataFrame) -> DataFrame:
        """Add rows, already dealt out by the key or not, and return the whole table."""
        writer = df.write.mode("append").bucketBy(self.buckets, *self.keys).option("path", self.folder)
        if self.part:
            writer = writer.partitionBy(self.part)
        writer.saveAsTable(self.table)
        return self.rows()

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.table}")


def bucketed(df: DataFrame, name: str, *keys: str) -> BucketedTable:
    """The rows written as a new bucketed table."""
    table = BucketedTable(df.sparkSession, name, *keys)
    table.append(df.repartition(table.buckets, *keys))
    return table

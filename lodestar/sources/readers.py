"""Readers of files (S5-S12): text corpora, sitemaps, lists, snapshots. All are lazy plans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from ..functions import text as T

PAGE = StructType(
    [
        StructField("page", StringType()), StructField("url", StringType()), StructField("clicks", LongType()),
        StructField("impressions", LongType()), StructField("ctr", DoubleType()), StructField("position", DoubleType())
    ]
)
BASELINE = StructType(
    [
        StructField("created", StringType()), StructField("site", StringType()),
        StructField("window", StructType([StructField("startDate", StringType()), StructField("endDate", StringType()), StructField("days", LongType())])),
        StructField("pages", ArrayType(PAGE))
    ]
)
FACT = "date date, page string, query string, clicks bigint, impressions bigint, position_x10 bigint"


def fact(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet fact; where it is partitioned by date, date ranges prune folders."""
    return spark.read.schema(FACT).parquet(path)


def files(spark: SparkSession, path: str, *, extensions: tuple[str, ...] = (), skip_dot_folders: bool = False) -> DataFrame:
    """(path, slug, ext, raw, mtime) of all text files below path, each whole."""
    read = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    if extensions:
        read = read.option("pathGlobFilter", "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}")
    rows = read.load(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("mtime")
    )
    rows = rows.select("path", T.file_slug(F.col("path")).alias("slug"), F.regexp_extract("path", "(\\.[^./]+)\\z", 1).alias("ext"), "raw", "mtime")
    if not skip_dot_folders:
        return rows
    # Folders below the root only: the root itself may lie anywhere.
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    below = F.element_at(F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), re.escape(root.rstrip("/")) + "/", 2), -1)
    return rows.where(~below.rlike("(^|/)(\\.[^/]+|node_modules)/"))


def list_file(spark: SparkSession, path: str) -> DataFrame:
    """Items of a list file."""
    from ..operators.network import list_items

    return list_items(spark.read.text(path))


def comma_list(spark: SparkSession, items: str) -> DataFrame:
    """S8."""
    return spark.range(1).select(F.explode(F.split(F.lit(items), ",")).alias("item")).select(F.trim("item").alias("item")).where("item <> ''")


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(sitemap_url, url) of sitemap files."""
    from ..operators.network import sitemap_urls

    return sitemap_urls(spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("sitemap_url"), F.col("value").alias("xml")))


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """The pages of a baseline snapshot, as rewrite_impact reads them."""
    rows = spark.read.schema(BASELINE).option("multiLine", True).json(path)
    return rows.select(F.inline("pages")).select("page", "clicks", "impressions", F.col("ctr").alias("ctr_pct"), "position")

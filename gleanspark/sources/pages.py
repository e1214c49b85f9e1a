"""Pages in, by table or by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import host


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of pages."""
    return spark.read.parquet(path)


def scan_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Raw page files, one page per file; the file name is the URL."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def route_by_host(pages: DataFrame, names_by_host: dict[str, str]) -> DataFrame:
    """Add the profile that reads each page, by the host of its URL; null for unknown hosts."""
    return pages.withColumn("site", site_of(F.col("url"), names_by_host))


def site_of(url: Column, names_by_host: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names_by_host.items() for x in pair])
    return F.try_element_at(table, host(url))


def first_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("page_num") == 1)

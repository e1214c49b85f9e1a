"""The same extraction over pages that keep arriving.

Reading a page needs nothing but the page, so listings are extracted from a stream without state or
watermark. Detail pages are joined per micro-batch; what was read from them is kept by URL, so each of them is parsed once,
however many batches look it up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.urls import without_fragment
from ..plans import listings
from ..plans.profiles import SiteProfile

PAGE_SCHEMA = "page_id bigint, site string, page_num int, url string, html string"


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(PAGE_SCHEMA).parquet(folder)


def listing_stream(pages: DataFrame, profiles: list[SiteProfile], as_of: str) -> DataFrame:
    """Finished listings with the contact defaults of their sites; links that only a detail page would make a listing are left out."""
    return listings.extract(pages, profiles, as_of)


def kept_facts(folder: str, batch_id: int) -> listings.Keep:
    """The facts of detail pages in a table, to which a batch adds those of pages that no batch before it has read.

    A batch writes its own folder and replaces it when it is run again. A URL without a page is looked for again by the next batch.
    """

    def keep(read: Callable[[DataFrame], DataFrame], wanted: DataFrame) -> DataFrame:
        spark = wanted.sparkSession
        known = _table(spark, folder, "detail_url string, batch int").where(F.col("batch") < batch_id)
        urls = wanted.where("url IS NOT NULL").select(without_fragment(F.col("url")).alias("url")).distinct()
        facts = read(urls.join(known.select(F.col("detail_url").alias("url")), "url", "left_anti"))
        facts.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in facts.schema.fields)
        return _table(spark, folder, f"{fields}, batch int").where(F.col("batch") <= batch_id).drop("batch")

    return keep


def _table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The table in a folder; empty where there is none yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def append_listings(
    pages: DataFrame,
    details: DataFrame,
    profiles: list[SiteProfile],
    as_of: str,
    out: str,
    checkpoint: str,
    facts: str | None = None,
) -> StreamingQuery:
    """Append the listings of each micro-batch, joined to detail pages, to a Parquet table.

    A batch writes its own folder and replaces it when it is run again, so no row is written twice. ``facts`` is the folder of what was
    read from detail pages; it lies beside the checkpoint if not given.
    """
    facts = facts or f"{checkpoint.rstrip('/')}-facts"

    def write(batch: DataFrame, batch_id: int) -> None:
        found = listings.extract(batch, profiles, as_of, details, kept_facts(facts, batch_id))
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

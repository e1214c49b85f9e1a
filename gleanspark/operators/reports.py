"""Counts and rates over listings."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed


def count_by(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows per value, most frequent first, ties in value order; optionally the first few only."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
    return counts if top is None else counts.limit(top)


def run_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_jobs"))


def rate(part, total):
    """Percentage, 0 for nothing."""
    return F.when(total > 0, part * F.lit(100.0) / total).otherwise(F.lit(0.0))


def email_rate(df: DataFrame) -> DataFrame:
    """Share of listings with any contact, and with a real address."""
    email = F.coalesce(F.col("apply_email"), F.lit(fixed.MISSING))
    counted = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(email != fixed.MISSING).alias("with_email"),
        F.count_if(F.contains(email, F.lit("@"))).alias("with_valid_email"),
    )
    return counted.select(
        "*",
        rate(F.col("with_email"), F.col("total")).alias("email_rate"),
        rate(F.col("with_valid_email"), F.col("total")).alias("valid_email_rate"),
    )


def expired_per_page(df: DataFrame, as_of: str) -> DataFrame:
    """Listings per page that are expired, or whose expiry cannot be read."""
    current = F.coalesce(F.col("expiry_date") >= F.lit(as_of).cast("date"), F.lit(False))
    return df.groupBy("page_id").agg(F.count_if(~current).alias("expired"))


def records_per_page(df: DataFrame) -> DataFrame:
    return df.groupBy("source_site", "page_num").agg(F.count(F.lit(1)).alias("n"))


def split_bad(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all required values, and the rejected rest, so that one bad row stops nothing."""
    complete = reduce(and_, [F.col(c).isNotNull() for c in required])
    return df.filter(complete), df.filter(~complete)

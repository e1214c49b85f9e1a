"""Listings joined to the facts of their detail pages.

Detail pages are read where they lie and reduced to a few short columns before anything is
shuffled, so no HTML crosses the network. Listings are stored first, so that a filter over their URLs can tell
which pages are wanted at all, and by which finder. One row per URL is kept, and repeats are dropped before the
shuffle too. The join itself is a plain equi join: with adaptive execution Spark broadcasts a side only
after measuring it, and splits the partition of a URL that very many listings share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.urls import without_fragment
from ..sources.stored import stored
from .extract import record_finder
from .nodes import shred
from .parts import Finder, read_details
from .wanted import uses_of


Contact = Callable[[Column], Column]


def detail_facts(
    details: DataFrame,
    contacts: dict[str, Contact],
    with_record: bool = False,
    limits: dict[str, int] | None = None,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """``(detail_url, detail)`` with one row per URL (the lowest page id of several), fragments dropped.

    Each detail page is read once, however many profiles look it up: ``detail`` has a column per
    entry of ``contacts`` and, if asked for, the fields of a whole listing as ``record``. With ``wanted``, rows ``(url, use)``, only
    pages of these URLs are parsed, and a page is searched only by the finders that it is looked up for: use n is the n-th of
    ``contacts``, and one more number stands for the record. Without a column ``use`` pages are searched by all finders.
    """
    nodes = F.col("nodes")
    finders = dict(contacts)
    if with_record:
        finders["record"] = record_finder(limits)
    order = ["page_id"] if "page_id" in details.columns else []
    pages = details.select(*order, "url", "html")
    # finders that name the values they read get them from the worker, and the nodes stay there
    by_value = all(isinstance(find, Finder) for find in finders.values())
    found = {name: find.from_values() if by_value else find(nodes) for name, find in finders.items()}
    if wanted is None:
        fields = found
    else:
        if "use" not in wanted.columns:
            wanted = wanted.select("url", F.explode(F.array(*[F.lit(n) for n in range(len(finders))])).alias("use"))
        pages = pages.withColumn("_uses", uses_of(wanted, F.col("url"), len(finders))).filter("_uses <> 0")
        fields = {name: F.when(F.col("_uses").bitwiseAND(1 << n) != 0, value) for n, (name, value) in enumerate(found.items())}
    facts = (
        (read_details(pages, list(finders.values())) if by_value else shred(pages))
        .filter(F.col("url").isNotNull() & F.col("parse_error").isNull())
        .select(
            without_fragment(F.col("url")).alias("detail_url"),
            *order,
            F.struct(*[c.alias(name) for name, c in fields.items()]).alias("detail"),
        )
    )
    # a rank of one is cut off on both sides of the shuffle
    ranked = W.partitionBy("detail_url").orderBy(*(order or ["detail"]))
    return facts.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").select("detail_url", "detail")


def lookup(listings: DataFrame, facts: DataFrame, how: str = "left") -> DataFrame:
    """Listings with ``detail``, matched on ``detail_url`` without its fragment.

    Listings without a URL find nothing; they get keys of their own, so that they spread over all
    partitions instead of meeting in the one for null. The key is a new value on both sides, so the join
    has shuffles of its own and Spark can split a partition of them: it cannot split one that is already
    dealt out for something else.
    """
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("page_id", "pos"), F.lit(4096)))
    key = F.concat(F.lit("@"), without_fragment(F.col("detail_url")))
    keyed = listings.withColumn("_key", key if how == "inner" else F.coalesce(key, spread))
    facts = facts.select(F.concat(F.lit("@"), "detail_url").alias("_key"), "detail")
    return keyed.join(facts, "_key", how).drop("_key")


def enrich(
    listings: DataFrame,
    details: DataFrame,
    contact: Contact,
    how: str = "left",
    default: str | None = None,
    top_n: int | None = None,
) -> DataFrame:
    """Join listings to their detail pages on ``detail_url``, adding ``apply_email``.

    A left join keeps every listing and uses the default where no address is found; an inner join
    drops listings without a detail page and adds the fields of that page as ``detail.record``. With
    ``top_n`` only listings of that rank within their page (column ``rank``) are looked up, and only their pages read.
    """
    if top_n is not None:
        looked_up = F.when(F.col("rank") <= top_n, F.col("detail_url"))
        listings = listings.withColumn("detail_url", looked_up)
    listings = stored(listings)
    whole = how == "inner"
    uses = F.array(F.lit(0), F.lit(1)) if whole else F.array(F.lit(0))
    wanted = listings.select(F.col("detail_url").alias("url"), F.explode(uses).alias("use"))
    facts = detail_facts(details, {"apply_email": contact}, with_record=whole, wanted=wanted)
    email = F.coalesce(F.col("detail.apply_email"), F.lit(default))
    found = lookup(listings, facts, how).withColumn("apply_email", email)
    return found if how == "inner" else found.drop("detail")


def without_hits(pages: DataFrame, hits: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages for which nothing was found; only keys of the hits are shuffled."""
    return pages.join(hits.select(key).distinct(), key, "left_anti")


def site_counts(listings: DataFrame, sites: list[str]) -> DataFrame:
    """Listings per site, zero for sites without any."""
    spark = listings.sparkSession
    counts = listings.groupBy("source_site").agg(F.count(F.lit(1)).alias("n"))
    table = spark.createDataFrame([(s,) for s in dict.fromkeys(sites)], "source_site string")
    return table.join(counts, "source_site", "left").fillna({"n": 0})

"""From pages to listings: the whole run as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.dates import is_current
from ..functions.text import clean_text, cut
from ..functions.urls import last_to_fetch, page_key, page_of
from ..operators import enrich
from ..operators.classify import CLASSIFIERS
from ..operators.extract import FIELDS, REJECT, ROW, as_parts, reject
from ..operators.nodes import shred
from ..operators.parts import PART_FIELDS, read_listings
from ..sources.pages import first_pages
from ..sources.stored import stored
from .profiles import Registry, SiteProfile

COLUMNS = [
    "id",
    "title",
    "company",
    "location",
    "category",
    "expiry_text",
    "description",
    "source_site",
    "apply_email",
    "expiry_date",
    "page_id",
    "page_num",
    "pos",
    "job_url",
]


def record_id(prefix: str | Column, page_num: Column, pos: Column, as_of: str) -> Column:
    """``PP_ppp_iii_yyyymmdd`` from prefix, page, position in the page (from 1) and day."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    day = F.date_format(F.lit(as_of).cast("date"), "yyyyMMdd")
    return F.format_string("%s_%03d_%03d_%s", prefix, page_num, pos, day)


def _by_site(profiles: list[SiteProfile], value) -> Column:
    """A value that depends on the profile named by ``site``; null for other sites."""
    chosen = F.lit(None)
    for profile in profiles:
        branch = value(profile)
        branch = branch if isinstance(branch, Column) else F.lit(branch)
        chosen = F.when(F.col("site") == profile.name, branch).otherwise(chosen)
    return chosen


def _rows(p: SiteProfile, as_of: str | None, undated: bool = False) -> Column:
    """The listings of a page; with ``as_of`` those that ``current_only`` drops need not be among them, ``undated`` ones are."""
    nodes = F.col("nodes")
    if as_of is None or not p.filter_current or p.current_rows is None:
        return p.rows(nodes)
    return p.current_rows(nodes, lambda day: is_current(day, as_of, "keep" if undated else p.on_unparsed))


def listings(shredded: DataFrame, profiles: list[SiteProfile], as_of: str | None = None) -> DataFrame:
    """Raw listings of shredded pages, before filtering: positions have no gaps. With ``as_of`` expired ones may be left out."""
    rows = _by_site(profiles, lambda p: _rows(p, as_of))
    return shredded.select("page_id", "site", "page_num", F.inline(rows))


def listings_of(pages: DataFrame, profiles: list[SiteProfile], as_of: str | None = None) -> DataFrame:
    """As ``listings``, of pages with their ``html``: those of a profile with ``parts`` are read without their nodes leaving the worker."""
    by_parts = {p.name: p for p in profiles if p.parts}
    if not by_parts:
        return listings(shred(pages), profiles, as_of)
    found = read_listings(pages, {name: p.parts for name, p in by_parts.items()}, with_nodes=len(by_parts) < len({p.name for p in profiles}))
    items = _by_site(profiles, lambda p: p.parts.arrange(F.col("items")) if p.parts else as_parts(_rows(p, as_of)))
    rows = found.select("page_id", "site", "page_num", F.inline(items))
    fields = {name: F.col(name) for name in FIELDS}
    part = F.struct(*[F.col(name) for name in PART_FIELDS])
    for name, p in by_parts.items():
        for target, value in p.parts.finish(part).items():
            fields[target] = F.when(F.col("site") == name, value).otherwise(fields[target])
    return rows.select("page_id", "site", "page_num", *[c.alias(name) for name, c in fields.items()])


def current_only(df: DataFrame, profiles: list[SiteProfile], as_of: str) -> DataFrame:
    """Drop expired listings of the profiles that do so."""

    def keep(p: SiteProfile) -> Column:
        if not p.filter_current:
            return F.lit(True)
        return is_current(F.col("expiry_date"), as_of, p.on_unparsed)

    return df.filter(_by_site(profiles, keep))


#: Makes the facts of wanted detail pages, rows (url, use), given the function that reads them from the pages.
Keep = Callable[[Callable[[DataFrame], DataFrame], DataFrame], DataFrame]


def with_details(
    raw: DataFrame, profiles: list[SiteProfile], details: DataFrame | None, is_stored: bool = False, keep: Keep | None = None
) -> DataFrame:
    """Add addresses, and the whole listing where the detail page makes it.

    One join serves all profiles. Links without a detail page are dropped, other listings stay. The listings are stored first:
    detail pages that none of them looks up are not parsed. ``keep`` may take the facts of pages from where they are kept already.
    """
    default = _by_site(profiles, lambda p: p.default_contact)
    found_by = list(dict.fromkeys(p.contact for p in profiles if p.contact))
    if details is None or not found_by:
        made = [p.name for p in profiles if p.detail_record]
        return raw.filter(~F.col("site").isin(*made)).withColumn("apply_email", default)
    names = {contact: f"contact_{i}" for i, contact in enumerate(found_by)}
    from_detail = [p for p in profiles if p.detail_record]
    raw = raw if is_stored else stored(raw)

    def uses(p: SiteProfile) -> Column:
        own = [found_by.index(p.contact)] if p.contact else []
        return F.array(*map(F.lit, [*own, *([len(found_by)] if p.detail_record and p.contact else [])])).cast("array<int>")

    wanted = raw.select(F.col("detail_url").alias("url"), F.explode(_by_site(profiles, uses)).alias("use"))

    def read(urls: DataFrame) -> DataFrame:
        limits = from_detail[0].limits if from_detail else None
        return enrich.detail_facts(details, {name: contact for contact, name in names.items()}, bool(from_detail), limits, urls)

    facts = keep(read, wanted) if keep else read(wanted)
    # the URL is only a key for profiles that look their listings up
    key = _by_site(profiles, lambda p: F.col("detail_url") if p.contact else F.lit(None))
    joined = enrich.lookup(raw.withColumn("detail_url", key.cast("string")), facts)
    email = _by_site(
        profiles, lambda p: F.col(f"detail.{names[p.contact]}") if p.contact else F.lit(None)
    )
    joined = joined.withColumn("apply_email", F.coalesce(email, default))
    if not from_detail:
        return joined.drop("detail")
    is_record = F.col("site").isin(*[p.name for p in from_detail])
    text = F.nullif(F.col("title"), F.lit(""))
    made = {name: F.col(f"detail.record.{name}") for name in ("company", "location", "expiry_text", "expiry_date")}
    made["title"] = F.coalesce("detail.record.title", text, F.lit(fixed.DETAIL_TITLE))
    made["description"] = F.coalesce("detail.record.description", text, F.lit(fixed.DETAIL_DESCRIPTION))
    return (
        joined.filter(~is_record | F.col("detail").isNotNull())
        .withColumns({n: F.when(is_record, c).otherwise(F.col(n)) for n, c in made.items()})
        .drop("detail")
    )


def finish(raw: DataFrame, profiles: list[SiteProfile], as_of: str) -> DataFrame:
    """Classify the texts as found, clean and cut them, number the rows and name the columns."""
    texts = ["title", "company", "location", "expiry_text", "description"]
    raw = raw.withColumns({c: F.coalesce(F.col(c), F.lit(fixed.MISSING)) for c in texts})
    title, description, company = F.col("title"), F.col("description"), F.col("company")
    classifiers = {
        mode: choose(title, description, company)
        for mode, choose in CLASSIFIERS.items()
        if any(p.classifier == mode for p in profiles)
    }
    category = _by_site(profiles, lambda p: classifiers[p.classifier])
    prefix = _by_site(profiles, lambda p: p.id_prefix)

    def cut_by_site(name: str) -> Column:
        if name != "description" or not any(p.limits.get(name) for p in profiles):
            return F.col(name)
        return _by_site(profiles, lambda p: cut(F.col(name), p.limits.get(name)))

    return raw.select(
        record_id(prefix, F.col("page_num"), F.col("pos"), as_of).alias("id"),
        *[clean_text(cut_by_site(c)).alias(c) for c in texts],
        F.coalesce(F.col("category"), category).alias("category"),
        _by_site(profiles, lambda p: p.site).alias("source_site"),
        "apply_email",
        "expiry_date",
        "page_id",
        "page_num",
        "pos",
        "job_url",
    ).select(*COLUMNS)


def extract(
    pages: DataFrame,
    profiles: list[SiteProfile],
    as_of: str,
    details: DataFrame | None = None,
    keep: Keep | None = None,
) -> DataFrame:
    """Finished listings of any number of sites, read in one pass.

    ``pages`` has ``page_id, site, page_num, html`` with the profile name as ``site``; ``details``
    has ``url, html``. Listings are filtered before they are joined, classified on the text as
    found, and cleaned last. The join is the only shuffle of listings.
    """
    wanted = pages.filter(F.col("site").isin(*[p.name for p in profiles]))
    raw = current_only(listings_of(wanted.select("page_id", "site", "page_num", "html"), profiles, as_of), profiles, as_of)
    return finish(with_details(raw, profiles, details, keep=keep), profiles, as_of)


def tagged(shredded: DataFrame, profiles: list[SiteProfile], as_of: str | None = None) -> DataFrame:
    """What each page holds, as ``listing`` or, where it cannot be read, as ``reject``; the other one is null.

    Rejects are the page itself, parts that a profile's ``rejects`` names, and listings whose date decides whether they are kept
    but cannot be read. With ``as_of`` expired listings may be left out.
    """
    nodes, none = F.col("nodes"), F.array().cast(f"array<{REJECT}>")
    rows = _by_site(profiles, lambda p: _rows(p, as_of, undated=True))
    parts = _by_site(profiles, lambda p: p.rejects(nodes) if p.rejects else none)
    page = F.when(F.col("parse_error").isNotNull(), F.array(reject("page", F.col("parse_error")))).otherwise(none)
    items = F.concat(
        F.transform(rows, lambda r: F.struct(r.alias("listing"), F.lit(None).cast(REJECT).alias("reject"))),
        F.transform(F.concat(page, parts), lambda r: F.struct(F.lit(None).cast(ROW).alias("listing"), r.alias("reject"))),
    )
    found = shredded.select("page_id", "site", "page_num", "url", F.inline(items))
    dated = [p.name for p in profiles if p.filter_current and p.on_unparsed == "drop"]
    listing = F.col("listing")
    undated = listing.isNotNull() & F.col("site").isin(*dated) & listing["expiry_date"].isNull()
    late = reject("row", "date not read", listing["pos"], listing["expiry_text"])
    return found.withColumns({"reject": F.when(undated, late).otherwise(F.col("reject")), "listing": F.when(~undated, listing)})


def extract_with_rejects(
    pages: DataFrame, profiles: list[SiteProfile], as_of: str, details: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Finished listings, and what could not be read as ``(page_id, url, site, page_num, part, pos, reason, text)``.

    Pages are read once: listings and rejects are written together and split when they are read again.
    """
    wanted = pages.filter(F.col("site").isin(*[p.name for p in profiles]))
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    both = stored(tagged(shred(wanted.select("page_id", "site", "page_num", url.alias("url"), "html")), profiles, as_of))
    raw = both.filter("listing IS NOT NULL").select("page_id", "site", "page_num", "listing.*")
    found = with_details(current_only(raw, profiles, as_of), profiles, details, is_stored=True)
    rejects = both.filter("reject IS NOT NULL").select("page_id", "url", "site", "page_num", "reject.*")
    return finish(found, profiles, as_of), rejects


def run(
    pages: DataFrame,
    details: DataFrame | None,
    as_of: str,
    registry: Registry | None = None,
    profiles: list[str] | None = None,
    first_page_only: bool = False,
) -> DataFrame:
    """All sites in one plan; optionally only the first page of each.

    ``pages`` has ``url, html``. What it lacks of ``page_id``, ``site`` and ``page_num`` is filled in: a hash of
    the URL, the profile that reads it, and the page number that it names.
    """
    registry = registry or Registry()
    chosen = [registry[n] for n in profiles] if profiles else registry.current()
    pages = routed(pages, registry, chosen)
    return extract(first_pages(pages) if first_page_only else pages, chosen, as_of, details)


def run_with_rejects(
    pages: DataFrame, details: DataFrame | None, as_of: str, registry: Registry | None = None, profiles: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """As ``run``, and beside the listings everything that could not be read."""
    registry = registry or Registry()
    chosen = [registry[n] for n in profiles] if profiles else registry.current()
    return extract_with_rejects(routed(pages, registry, chosen), chosen, as_of, details)


def routed(pages: DataFrame, registry: Registry, profiles: list[SiteProfile]) -> DataFrame:
    """Pages with ``page_id, site, page_num``; those that are there stay."""
    url = F.col("url")
    filled = {
        "page_id": lambda: F.xxhash64(url),
        "site": lambda: registry.of_url(url, profiles),
        "page_num": lambda: page_of(url),
    }
    return pages.withColumns({n: make() for n, make in filled.items() if n not in pages.columns})


def rejected(pages: DataFrame) -> DataFrame:
    """Pages that cannot be read, listing or detail pages, with the reason: ``(page_id, url, parse_error)``."""
    found = shred(pages.select("page_id", "url", "html"))
    return found.filter(F.col("parse_error").isNotNull()).select("page_id", "url", "parse_error")


def frontier(pages: DataFrame, profile: SiteProfile, held: DataFrame | None = None) -> DataFrame:
    """Pages still to fetch, from the first listing page of a site: ``(page_id, page_num, url)``.

    With ``held``, a table with the ``url`` of pages that are there, pages that it has in any form of their URL are left out.
    """
    n, url = F.col("_n"), profile.page_url(F.lit(profile.base_url), F.col("_n"))
    last = last_to_fetch(profile.total_pages(F.col("nodes")), profile.limits.get("pages"), profile.limits.get("last_page"))
    lasts = shred(pages.select("page_id", "html")).select("page_id", last.cast("bigint").alias("_last")).where("_last >= 2")
    if held is not None:
        lasts = stored(lasts)
    found = lasts.select("page_id", F.explode(F.sequence(F.lit(2).cast("bigint"), "_last")).alias("_n"))
    if held is not None:
        # a page's URL follows from its number alone, so each number is looked up once, however many pages lead to it
        most = lasts.agg(F.max("_last")).first()[0] or 1
        there = held.select(page_key(F.col("url")).alias("_key")).where("_key IS NOT NULL").distinct()
        numbers = lasts.sparkSession.range(2, most + 1).withColumnRenamed("id", "_n")
        found = found.join(numbers.withColumn("_key", page_key(url)).join(there, "_key", "left_semi").select("_n"), "_n", "left_anti")
    return found.select("page_id", n.cast("int").alias("page_num"), url.alias("url"))


def max_page(pages: DataFrame, profile: SiteProfile) -> DataFrame:
    """Number of pages each listing page points to."""
    total = profile.total_pages(F.col("nodes"))
    return shred(pages.select("page_id", "html")).select("page_id", total.alias("total_pages"))


def quarantine(pages: DataFrame, profile: SiteProfile, most: int = 1) -> DataFrame:
    """Pages with hardly any usable link, with their HTML, to be looked at.

    Only the numbers of the few pages found are joined back to the pages.
    """
    counted = shred(pages.select("page_id", "html")).select("page_id", F.size(profile.rows(F.col("nodes"))).alias("n_links"))
    few = counted.filter(F.col("n_links") <= most).groupBy("page_id").agg(F.min("n_links").alias("n_links"))
    return pages.select("page_id", "url", "html").join(few, "page_id")

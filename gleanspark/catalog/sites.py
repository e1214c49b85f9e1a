"""Listings of every layout, joins to detail pages, page counts, reports and sinks."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..operators import enrich, reports
from ..operators import extract as X
from ..operators import nodes as N
from ..plans import listings as L
from ..plans.profiles import Registry, builtin_profiles
from ..sources import sinks
from ..sources.pages import first_pages
from .base import AS_OF, query, quote, table
from .rendered import CANDIDATES, DETAILS, PAGING, PAGING_LIMITED, POSTS, detail_pages, expected, listing_pages, paging_pages

col = F.col

OUTPUT = [
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
    "page_num",
]


def listed(spark, sf, *sites):
    """Finished listings of the given layouts, in one plan."""
    with_details = {s.removesuffix("_lenient") for s in sites} & set(DETAILS)
    details = detail_pages(spark, sf, *sorted(with_details)) if with_details else None
    found = listing_pages(spark, sf, *sites)
    return L.run(found, details, AS_OF, Registry(), list(sites)).select(*OUTPUT)


def _listing_query(name, site):
    @query(name, expected(site))
    def _(spark, sf):
        return listed(spark, sf, site)


_listing_query("extract_cards", "cards")
_listing_query("extract_headings", "headings")
_listing_query("extract_jsonld", "jsonld")
_listing_query("extract_candidates", "candidates")
_listing_query("extract_link_detail", "link_detail")
_listing_query("extract_cards_alt", "cards_alt")
_listing_query("extract_cards_alt_second", "cards_alt_second")


_listing_query("extract_cards_lenient", "cards_lenient")

SITES = ["cards", "headings", "jsonld", "candidates", "link_detail"]
_UNION = " UNION ALL ".join(f"(SELECT * FROM ({expected(s)}))" for s in SITES)


@query("union_sites", _UNION)
def _(spark, sf):
    return listed(spark, sf, *SITES)


@query(
    "placeholder_rows",
    f"""WITH {POSTS} SELECT DISTINCT page_id, {quote(fixed.PLACEHOLDER['title'])} AS title, 'General' AS category
        FROM posts WHERE page_id % 4 = 0""",
)
def _(spark, sf):
    raw = L.listings(N.shred(listing_pages(spark, sf, "jsonld").drop("url")), [Registry()["jsonld"]])
    return raw.filter(col("category").isNotNull()).select("page_id", "title", "category")


@query(
    "extract_link_fallback",
    f"""WITH {POSTS} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k, i) AS INT) AS pos,
        CASE k % 4 WHEN 2 THEN 'QA' ELSE CASE i WHEN 1 THEN 'again ' || k ELSE title || ' ' || k END END AS title,
        'https://vacancybox.co.zw/job/' || k AS job_url
        FROM posts, unnest([0, 1]) AS r(i) WHERE k % 4 < 3 AND (i = 0 OR k % 4 = 1)""",
)
def _(spark, sf):
    rows = X.link_fallback(col("nodes"), fixed.SITES["candidates"])
    found = N.shred(listing_pages(spark, sf, "candidates").select("page_id", "html"))
    return found.select("page_id", F.inline(rows)).select("page_id", "pos", "title", "job_url")


@query(
    "dedup_snippet",
    f"WITH {POSTS}, {CANDIDATES} SELECT page_id, pos, text AS snippet FROM placed",
)
def _(spark, sf):
    rows = F.transform(
        X.unique_candidates(col("nodes")),
        lambda c, i: F.struct((i + 1).alias("pos"), c["text"].alias("snippet")),
    )
    found = N.shred(listing_pages(spark, sf, "candidates").select("page_id", "html"))
    return found.select("page_id", F.inline(rows))


@query(
    "company_heuristic",
    f"""WITH {POSTS}, {CANDIDATES} SELECT page_id, pos, coalesce(company, 'VacancyBox Employer') AS company
        FROM placed""",
)
def _(spark, sf):
    rows = F.transform(
        X.unique_candidates(col("nodes")),
        lambda c, i: F.struct(
            (i + 1).alias("pos"),
            X.company_near(col("nodes"), c["node"], fixed.SITES["candidates"]["company"]).alias("company"),
        ),
    )
    found = N.shred(listing_pages(spark, sf, "candidates").select("page_id", "html"))
    return found.select("page_id", F.inline(rows))


@query(
    "jsonld_postings",
    f"""WITH {POSTS} SELECT page_id, pos, CASE WHEN k % 5 = 4 THEN 'Organization' ELSE 'JobPosting' END AS type, title
        FROM posts WHERE page_id % 4 <> 0""",
)
def _(spark, sf):
    rows = F.transform(
        X.json_values(col("nodes")),
        lambda v, i: F.struct(
            (i + 1).alias("pos"),
            F.try_variant_get(v, "$['@type']", "string").alias("type"),
            F.try_variant_get(v, "$.title", "string").alias("title"),
        ),
    )
    found = N.shred(listing_pages(spark, sf, "jsonld").select("page_id", "html"))
    return found.select("page_id", F.inline(rows))


# --- links to detail pages --------------------------------------------------------------------------

_BASE = fixed.SITES["link_detail"]["base_url"]
_HOST = _BASE.removesuffix("/careers/")


@query(
    "second_pass_links",
    f"""WITH {POSTS} SELECT page_id, '{_HOST}/x/' || k AS url, title AS text FROM posts
        WHERE page_id % 4 <> 0 AND k % 5 <> 4 AND k % 9 <> 2""",
)
def _(spark, sf):
    found = N.shred(listing_pages(spark, sf, "jsonld").select("page_id", "html"))
    return found.select("page_id", F.inline(X.second_pass_links(col("nodes"), _BASE)))


@query(
    "third_pass_links",
    f"""WITH {POSTS} SELECT page_id, CASE WHEN k % 10 = 0 THEN '{_HOST}/jobs/' || k ELSE '{_HOST}/about/job-' || k END AS url,
        CASE WHEN k % 10 = 0 THEN 'one' ELSE 'Read about ' || k END AS text
        FROM posts WHERE page_id % 3 = 0 OR page_id % 3 = 1 AND k % 10 < 3 OR k % 10 = 0""",
)
def _(spark, sf):
    found = N.shred(listing_pages(spark, sf, "few_links").select("page_id", "html"))
    return found.select("page_id", F.inline(X.harvest_links(col("nodes"), fixed.SITES["link_detail"])))


@query(
    "quarantine_pages",
    f"""WITH {POSTS} SELECT page_id, 1 AS n_links, string_agg(CASE WHEN k % 10 > 0 THEN
        '<p><b><i><a href="/z">z</a></i></b></p>' ELSE '<a href="/jobs/' || k || '">one</a>' END, chr(10) ORDER BY k) AS html
        FROM posts WHERE page_id % 3 = 2 GROUP BY page_id""",
)
def _(spark, sf):
    found = L.quarantine(listing_pages(spark, sf, "few_links"), Registry()["link_detail"])
    return found.select("page_id", "n_links", "html")


@query(
    "rejected_pages",
    "SELECT page_id, url, 'no html' AS parse_error FROM pages WHERE page_id % 7 = 3",
)
def _(spark, sf):
    damaged = table(spark, sf, "pages").withColumn("html", F.when(col("page_id") % 7 != 3, col("html")))
    return L.rejected(damaged)


@query(
    "extract_generic",
    f"""WITH {POSTS} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INT) AS pos,
        title || company AS title, title || company || chr(10) || 'Vacancy ' || k AS description FROM posts WHERE k % 5 <> 4""",
)
def _(spark, sf):
    rows = X.generic(col("nodes"), fixed.SITES["jsonld"])
    found = N.shred(listing_pages(spark, sf, "generic").select("page_id", "html"))
    return found.select("page_id", F.inline(rows)).select("page_id", "pos", "title", "description")


@query(
    "raw_pages",
    f"SELECT * FROM ({expected('cards')})",
)
def _(spark, sf):
    """Pages as fetched: the profile and the page number come from the URL."""
    number = F.when(col("page_num") > 1, F.concat(F.lit("&page="), col("page_num"))).otherwise(F.lit(""))
    url = F.concat(F.lit(Registry()["cards"].base_url), number)
    found = listing_pages(spark, sf, "cards").select("page_id", url.alias("url"), "html")
    return L.run(found, detail_pages(spark, sf, "cards"), AS_OF).select(*OUTPUT)


@query(
    "cap_per_page",
    f"""WITH {POSTS} SELECT page_id, pos, job_url FROM (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k, i)
        AS INT) AS pos, 'https://vacancybox.co.zw/job/' || k AS job_url
        FROM posts, unnest([0, 1]) AS r(i) WHERE k % 4 < 3 AND (i = 0 OR k % 4 = 1)) WHERE pos <= 3""",
)
def _(spark, sf):
    rows = X.link_fallback(col("nodes"), {**fixed.SITES["candidates"], "limits": {"links": 3}})
    found = N.shred(listing_pages(spark, sf, "candidates").select("page_id", "html"))
    return found.select("page_id", F.inline(rows)).select("page_id", "pos", "job_url")


@query(
    "mailto_email",
    f"""WITH {POSTS} SELECT k AS page_id, CASE WHEN k % 3 = 2 THEN replace(email, '.example.com', '.example') ELSE email END
        AS email FROM posts WHERE has_detail""",
)
def _(spark, sf):
    details = detail_pages(spark, sf, "link_detail").select("page_id", "html")
    email = Registry()["link_detail"].contact(col("nodes"))
    return N.shred(details).select("page_id", email.alias("email"))


# --- joins ------------------------------------------------------------------------------------------


def _raw(spark, sf, site):
    found = listing_pages(spark, sf, site).drop("url")
    return L.listings(N.shred(found), [Registry()[site]])


@query(
    "join_detail_left",
    f"WITH {POSTS} SELECT page_id, pos, CASE WHEN has_detail THEN email ELSE 'none' END AS apply_email FROM posts",
)
def _(spark, sf):
    contact = Registry()["cards"].contact
    rows = _raw(spark, sf, "cards")
    found = enrich.enrich(rows, detail_pages(spark, sf, "cards"), contact, default="none")
    return found.select("page_id", "pos", "apply_email")


@query(
    "join_detail_inner",
    f"WITH {POSTS} SELECT page_id, pos, title FROM posts WHERE has_detail",
)
def _(spark, sf):
    contact = Registry()["link_detail"].contact
    rows = _raw(spark, sf, "link_detail").select("page_id", "pos", "detail_url")
    found = enrich.enrich(rows, detail_pages(spark, sf, "link_detail"), contact, how="inner")
    return found.select("page_id", "pos", "detail.record.title")


@query(
    "join_detail_top5",
    f"""WITH {POSTS} SELECT page_id, pos, CASE WHEN has_detail AND pos <= 5 THEN email ELSE 'none' END AS apply_email
        FROM posts""",
)
def _(spark, sf):
    contact = Registry()["cards"].contact
    rows = _raw(spark, sf, "cards").withColumn("rank", col("pos"))
    details = detail_pages(spark, sf, "cards")
    found = enrich.enrich(rows, details, contact, default="none", top_n=5)
    return found.select("page_id", "pos", "apply_email")


# --- page counts ------------------------------------------------------------------------------------


_PAGE_IDS = "p AS (SELECT DISTINCT o_orderkey // 10 AS page_id FROM orders)"


def _max_page_query(site):
    @query(
        "max_page" if site == "cards" else f"max_page_{site}",
        f"WITH {_PAGE_IDS} SELECT page_id, CAST({PAGING[site][1]} AS BIGINT) AS total_pages FROM p",
    )
    def _(spark, sf):
        return L.max_page(paging_pages(spark, sf, site), Registry()[site])


for _site in PAGING:
    _max_page_query(_site)

_URLS = {
    "cards": "'https://vacancymail.co.zw/jobs/?ordering=later&page=' || n",
    "headings": "'https://jobszimbabwe.co.zw/page/' || n || '/'",
    "jsonld": "'https://zimbojobs.com/?page=' || n",
    "candidates": "'https://vacancybox.co.zw/page/' || n || '/'",
    "link_detail": f"'{_BASE}?paged=' || n",
    "cards_alt": "'https://jobszimbabwe.co.zw/?start=' || (10 * (n - 1))",
}


def _frontier_sql(site: str, limits: dict) -> str:
    total = PAGING_LIMITED[site] if limits and site in PAGING_LIMITED else PAGING[site][1]
    most = min([limits.get("pages", 10**9), limits.get("last_page", 10**9)])
    return f"""SELECT '{site}' AS site, page_id, CAST(n AS INT) AS page_num, {_URLS[site]} AS url FROM (SELECT page_id,
        unnest(range(2, least({total}, {most}) + 1)) AS n FROM p)"""


def _frontiers(spark, sf, limits):
    registry = Registry(builtin_profiles(limits))
    parts = [L.frontier(paging_pages(spark, sf, site), registry[site]).withColumn("site", F.lit(site)) for site in PAGING]
    return reduce(DataFrame.unionByName, parts)


@query("frontier_urls", f"WITH {_PAGE_IDS} " + " UNION ALL ".join(_frontier_sql(s, {}) for s in PAGING))
def _(spark, sf):
    return _frontiers(spark, sf, None)


@query("frontier_limited", f"WITH {_PAGE_IDS} " + " UNION ALL ".join(_frontier_sql(s, fixed.LIMITS[s]) for s in PAGING))
def _(spark, sf):
    return _frontiers(spark, sf, fixed.LIMITS)


_HELD = {"cards": "https://VacancyMail.co.zw/jobs/?page={n}&ordering=later#top", "headings": "https://jobszimbabwe.co.zw/page/{n}", "link_detail": f"{_BASE.rstrip('/')}?&paged={{n}}"}


@query(
    "frontier_open",
    f"WITH {_PAGE_IDS} SELECT * FROM (" + " UNION ALL ".join(_frontier_sql(s, {}) for s in _HELD) + ") WHERE page_num % 2 = 1",
)
def _(spark, sf):
    """Pages to fetch where every second page is there, in another form of its URL."""
    numbers = table(spark, sf, "orders").selectExpr("CAST(o_orderkey % 600 * 2 AS STRING) AS n").distinct()
    parts = []
    for site, form in _HELD.items():
        before, after = form.split("{n}")
        held = numbers.select(F.concat(F.lit(before), col("n"), F.lit(after)).alias("url"))
        parts.append(L.frontier(paging_pages(spark, sf, site), Registry()[site], held).withColumn("site", F.lit(site)))
    return reduce(DataFrame.unionByName, parts)


@query("first_page_only", f"WITH {POSTS} SELECT DISTINCT page_id FROM posts WHERE page_num = 1")
def _(spark, sf):
    return first_pages(listing_pages(spark, sf, "cards")).select("page_id")


# --- reports ----------------------------------------------------------------------------------------


def _report(spark, sf):
    return listed(spark, sf, *SITES)


_BY = {"expiry": "expiry_text", "location": "location", "category": "category", "source": "source_site"}

for _name, _column in _BY.items():
    query(
        f"count_by_{_name}", f"SELECT {_column}, count(*) AS n FROM ({_UNION}) GROUP BY {_column}"
    )(lambda spark, sf, c=_column: reports.count_by(_report(spark, sf), c))
    if _name != "source":
        query(
            f"top5_{_name}",
            f"SELECT {_column}, count(*) AS n FROM ({_UNION}) GROUP BY {_column} ORDER BY n DESC, {_column} LIMIT 5",
        )(lambda spark, sf, c=_column: reports.count_by(_report(spark, sf), c, top=5))


@query("run_totals", f"SELECT count(*) AS total_jobs FROM ({_UNION})")
def _(spark, sf):
    return reports.run_totals(_report(spark, sf))


@query(
    "site_counts",
    f"""SELECT site AS source_site, count(id) AS n FROM (VALUES ('VacancyMail'), ('Jobs Zimbabwe'), ('ZimboJobs'),
        ('VacancyBox'), ('RecruitmentMatters')) AS s(site) LEFT JOIN ({_UNION}) ON source_site = site GROUP BY site""",
)
def _(spark, sf):
    return enrich.site_counts(_report(spark, sf), [p.site for p in Registry().current()])


@query(
    "email_rate",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE apply_email <> 'N/A') AS with_email,
        count(*) FILTER (WHERE contains(apply_email, '@')) AS with_valid_email,
        with_email * 100.0::DOUBLE / total AS email_rate, with_valid_email * 100.0::DOUBLE / total AS valid_email_rate
        FROM ({_UNION})""",
)
def _(spark, sf):
    return reports.email_rate(_report(spark, sf))


@query(
    "expired_count",
    f"""WITH {POSTS} SELECT page_id, count(*) FILTER (WHERE strict_day IS NULL OR strict_day < DATE '{AS_OF}') AS expired
        FROM posts GROUP BY page_id""",
)
def _(spark, sf):
    return reports.expired_per_page(_raw(spark, sf, "cards"), AS_OF)


@query("records_per_page", f"SELECT source_site, page_num, count(*) AS n FROM ({_UNION}) GROUP BY ALL")
def _(spark, sf):
    return reports.records_per_page(_report(spark, sf))


# --- outputs ----------------------------------------------------------------------------------------


def _renamed(names):
    return ", ".join(f'{c} AS "{n}"' for c, n in names.items())


_CSV = f"SELECT {_renamed(fixed.CSV_NAMES)} FROM ({expected('cards')})"
_JSON = f"SELECT {_renamed(fixed.JSON_NAMES)} FROM ({expected('cards')})"


@query("project_csv", _CSV)
def _(spark, sf):
    return sinks.project_csv(listed(spark, sf, "cards"))


@query("project_json", _JSON)
def _(spark, sf):
    return sinks.project_json(listed(spark, sf, "cards"))


@query(
    "fill_na",
    f"""WITH {POSTS} SELECT page_id, pos, CASE WHEN form = 7 THEN 'N/A' ELSE expiry_text END AS expiry_text
        FROM posts""",
)
def _(spark, sf):
    raw = _raw(spark, sf, "cards").select("page_id", "pos", "expiry_text")
    return sinks.fill_missing(raw)


def _folder(spark, name):
    """A folder of its own in the one that all executors share; a temporary one where a test has none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='gleanspark-')}/{name}-{uuid.uuid4().hex}"


@query("sink_csv_roundtrip", _CSV)
def _(spark, sf):
    folder = _folder(spark, "csv")
    sinks.write_csv(listed(spark, sf, "cards"), folder)
    return sinks.read_csv(spark, folder)


@query("sink_json_roundtrip", _JSON)
def _(spark, sf):
    folder = _folder(spark, "json")
    sinks.write_json(listed(spark, sf, "cards"), folder)
    return sinks.read_json(spark, folder)


@query("sink_snapshot_latest", _JSON)
def _(spark, sf):
    folder = _folder(spark, "snapshot")
    sinks.write_snapshot(listed(spark, sf, "cards"), folder, "19980101_000000", f"{folder}/scratch")
    return sinks.read_json(spark, f"{folder}/json/latest")


@query("sink_empty_run_keeps_latest", _JSON)
def _(spark, sf):
    """A run without listings leaves the snapshot before it as the latest."""
    folder = _folder(spark, "snapshot")
    found = listed(spark, sf, "cards")
    sinks.write_snapshot(found, folder, "19980101_000000", f"{folder}/scratch")
    sinks.write_snapshot(found.where("page_id < 0"), folder, "19980102_000000", f"{folder}/scratch")
    return sinks.read_json(spark, f"{folder}/json/latest")


@query("top3_company", f"SELECT company, count(*) AS n FROM ({_UNION}) GROUP BY company ORDER BY n DESC, company LIMIT 3")
def _(spark, sf):
    """A report of the caller's own column and length."""
    return reports.count_by(_report(spark, sf), "company", top=3)


def _damaged(spark, sf):
    """Cards and JSON-LD pages: some without HTML, some with a script more that is no JSON."""
    found = listing_pages(spark, sf, "cards", "jsonld")
    script = F.lit('<script type="application/ld+json">{"@type":</script>')
    html = F.when(col("site") == "jsonld", F.concat(col("html"), F.when(col("page_id") % 6 == 1, script).otherwise(F.lit("")))).otherwise(col("html"))
    return found.withColumn("html", F.when(col("page_id") % 7 != 3, html))


@query(
    "rejected_rows",
    f"""WITH {POSTS}, n AS (SELECT page_id, max(pos) AS most FROM posts GROUP BY page_id)
        SELECT page_id, site, 'page' AS part, CAST(NULL AS INT) AS pos, 'no html' AS reason, CAST(NULL AS VARCHAR) AS text
        FROM n, (VALUES ('cards'), ('jsonld')) AS s(site) WHERE page_id % 7 = 3
        UNION ALL SELECT page_id, 'cards', 'row', pos, 'date not read', nullif(expiry_text, 'N/A') FROM posts WHERE page_id % 7 <> 3 AND strict_day IS NULL
        UNION ALL SELECT page_id, 'jsonld', 'script', pos, 'field of an unexpected type', NULL FROM posts
        WHERE page_id % 7 <> 3 AND page_id % 4 <> 0 AND k % 5 = 3
        UNION ALL SELECT page_id, 'jsonld', 'script', CAST(CASE WHEN page_id % 4 = 0 THEN 1 ELSE most + 1 END AS INT), 'no json', NULL
        FROM n WHERE page_id % 7 <> 3 AND page_id % 6 = 1""",
)
def _(spark, sf):
    _, rejects = L.run_with_rejects(_damaged(spark, sf), None, AS_OF, Registry(), ["cards", "jsonld"])
    shown = F.when(col("part") == "row", col("text")).alias("text")
    return rejects.select("page_id", "site", "part", "pos", "reason", shown)


@query("listings_beside_rejects", expected("cards"))
def _(spark, sf):
    """The listings of a run that also keeps what it could not read."""
    found, _ = L.run_with_rejects(listing_pages(spark, sf, "cards"), detail_pages(spark, sf, "cards"), AS_OF, Registry(), ["cards"])
    return found.select(*OUTPUT)

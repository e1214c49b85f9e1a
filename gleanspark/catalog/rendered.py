"""Listing pages of every layout, written by Spark from orders, customers and nations.

The page table of the test data has no listings, so these pages carry the star schema through the
extractors: what comes out must equal plain SQL over the source tables, at any scale.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from .base import CATEGORIES, DAY, FIRST_CATEGORIES, FORMS, SPARK_EXPIRY_TEXT, quote, sql_list, table

TITLES = ["Registered Nurse", "Accountant", "Software Engineer", "IT Officer", "HR Manager", "Clerk", "Coordinator", "Project Coordinator", "Clinical Data Analyst", "Welder", "Truck Driver", "Cashier"]
TASKS = ["Ward duty, paid weekly.", "Balances accounts daily.", "Drives a truck.", "Looks after customers.", "Teaches maths at school."]
TOWNS = [*fixed.PLACES, "Elsewhere"]
HOST = {name: "https://" + site["base_url"].split("/")[2] for name, site in fixed.SITES.items()}


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job post per order, ten to a page."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")

    def pick(values: list[str], index: str) -> str:
        array = ", ".join(quote(v).replace("''", "\\'") for v in values)
        return f"element_at(array({array}), CAST(1 + {index} % {len(values)} AS INT))"

    return orders.join(customer, orders.o_custkey == customer.c_custkey).selectExpr(
        "o_orderkey AS k",
        "o_orderkey div 10 AS page_id",
        "CAST((o_orderkey div 10) % 30 + 1 AS INT) AS page_num",
        f"{pick(TITLES, 'o_custkey')} AS title",
        "c_name AS company",
        f"{pick(TOWNS, 'c_nationkey')} AS town",
        f"concat({pick(TASKS, 'o_orderkey')}, ' (', o_orderpriority, ')') AS description",
        "CAST(o_orderdate AS DATE) AS day",
        f"{SPARK_EXPIRY_TEXT} AS expiry_text",
        "concat('apply', o_custkey, '@firm', o_orderkey % 50, '.example.com') AS email",
    )


POSTS = f"""{FORMS},
posts AS (
  SELECT k, k // 10 AS page_id, CAST((k // 10) % 30 + 1 AS INT) AS page_num,
    CAST(row_number() OVER (PARTITION BY k // 10 ORDER BY k) AS INT) AS pos,
    {sql_list(TITLES)}[1 + o_custkey % {len(TITLES)}] AS title, c_name AS company,
    {sql_list(TOWNS)}[1 + c_nationkey % {len(TOWNS)}] AS town,
    {sql_list(TASKS)}[1 + k % {len(TASKS)}] || ' (' || o_orderpriority || ')' AS description,
    day, form, expiry_text, strict_day, lenient_day,
    'apply' || o_custkey || '@firm' || (k % 50) || '.example.com' AS email, k % 10 <> 7 AS has_detail
  FROM dated JOIN orders ON k = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key before pages are written from them: into as many parts as a shuffle has, since what follows is work for
    each row, and adaptive execution would merge parts by the few bytes that they have here."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _as_pages(items: DataFrame, sites: dict[str, str]) -> DataFrame:
    """Pages of each site made of the items of ten posts in key order, after a common beginning, in an expression by site.

    The items of a page are collected once for all sites; each has its text for every site, in a column of that name.
    """
    grouped = items.groupBy("page_id", "page_num").agg(F.collect_list(F.struct("k", *sites)).alias("items"))

    def page(site: str, before: str) -> Column:
        own = F.array_sort(F.transform("items", lambda i: F.struct(i["k"].alias("k"), i[site].alias("html"))))
        body = F.array_join(F.transform(own, lambda i: i["html"]), "\n")
        return F.struct(F.lit(site).alias("site"), F.concat(F.expr(before), body).alias("html"))

    pages = grouped.select("page_id", "page_num", F.inline(F.array(*[page(site, before) for site, before in sites.items()])))
    return pages.select(
        "page_id",
        "site",
        "page_num",
        F.concat(F.lit("https://site.example/"), "site", F.lit("/"), F.col("page_id")).alias("url"),
        "html",
    )


LONG = "date_format(day, 'MMMM d, yyyy')"
SHORT = "date_format(day, 'MMM d yyyy')"

PAGINATION = """concat('<ul class="pagination"><li><a href="?page=2">2</a></li><li><a href="?page=',
    page_id % 40 + 1, '">Last</a></li></ul>')"""

ITEMS = {
    "cards": """concat('<a class="big job-listing" href="/jobs/', k, CASE WHEN k % 7 = 3 THEN '#apply' ELSE '' END, '"><h3 class="job-listing-title">', title,
        '</h3><h4 class="job-listing-company"> ', company, '</h4>\n<p class="job-listing-text">', description,
        '</p><div class="job-listing-footer"><ul><li><i class="icon-material-outline-location-on"></i> ', town,
        '</li>', CASE WHEN expiry_text = 'N/A' THEN '' ELSE concat(
        '<li><i class="icon-material-outline-access-time"></i> ', expiry_text, '</li>') END, '</ul></div></a>')""",
    "headings": f"""concat('<div><h3><a href="/j/', k, '">', title, CASE WHEN k % 3 = 0 THEN '' ELSE
        concat(' – ', company) END, '</a></h3><p>', CASE k % 4 WHEN 0 THEN concat('Posted on ', {LONG})
        WHEN 1 THEN {LONG} WHEN 2 THEN 'no date' ELSE concat('posted on ', {SHORT}) END, ' in ', town,
        '</p></div><div><h3>Menu</h3></div>')""",
    "jsonld": """CASE WHEN page_id % 4 = 0 THEN '<p>nothing here</p>' ELSE concat(
        '<script type="application/ld+json">{"@type":"', CASE WHEN k % 5 = 4 THEN 'Organization' ELSE 'JobPosting' END,
        CASE WHEN k % 6 = 1 THEN '","title":"Old Title' ELSE '' END, '","title":"', title, '","hiringOrganization":', CASE k % 5 WHEN 3 THEN concat('"', company, '"')
        WHEN 2 THEN '{}' ELSE concat('{"name":"', company, '"}') END, ',"jobLocation":{"address":{"addressLocality":"',
        town, '"}},"description":"', description, CASE WHEN k % 11 = 5 THEN concat(repeat(' x', 300), ' nurse midwife')
        ELSE '' END, CASE WHEN k % 9 = 2 THEN '","sameAs":["https://a.example/1"]' ELSE concat('","url":"/x/', k, '"') END,
        '}</script>') END""",
    "candidates": f"""CASE k % 4
        WHEN 0 THEN concat('<article><a href="/job/', k, '">', title, ' ', k, '</a><small>', company, '</small> ', town,
            '. Posted on ', {LONG}, '</article>')
        WHEN 1 THEN concat('<div class="job-listing"><a href="/job/', k, '">', title, ' ', k, '</a><p>', company,
            '</p><p>Posted ', {LONG}, '</p></div><div class="post"><a href="/job/', k, '">again ', k, '</a></div>')
        WHEN 2 THEN concat('<div class="job"><a href="/job/', k, '">QA</a></div>')
        ELSE concat('<li class="job"><h3>', title, ' ', k, '</h3> <span class="company">', company, '</span> ', town,
            '</li>') END""",
    "link_detail": """concat('<div class="results"><a href="/careers/job/', k, CASE WHEN k % 7 = 3 THEN '#apply' ELSE '' END, '">', title, '</a></div>',
        '<a href="mailto:x', k, '@y.example">mail</a> <a href="#top">Top</a>')""",
    "few_links": """CASE WHEN page_id % 3 > 0 AND k % 10 > 2 OR page_id % 3 = 2 AND k % 10 > 0
        THEN '<p><b><i><a href="/z">z</a></i></b></p>'
        WHEN k % 10 = 0 THEN concat('<a href="/jobs/', k, '">one</a>')
        ELSE concat('<a href="/about/job-', k, '">Read about ', k, '</a>') END""",
    "generic": """concat('<div class="item card"><b>', title, '</b>\n', company, '\n', CASE WHEN k % 5 = 4 THEN 'Nothing to see here'
        ELSE concat('Vacancy ', k) END, '</div>')""",
    "cards_alt": """CASE WHEN k % 2 = 0 THEN concat('<div class="job_seen_beacon"><h2 class="title">', title,
        '</h2><span class="company">', company, '</span><div class="recJobLoc">', town, '</div><div class="summary">',
        description, '</div></div>') ELSE concat('<div class="job_seen_beacon"><a data-jk="1">', title,
        '</a><a class="turnstileLink">', company, '</a></div>') END""",
}
ITEMS["cards_lenient"], ITEMS["cards_alt_second"] = ITEMS["cards"], ITEMS["cards_alt"]

_N = "(page_id % 40 + 2)"
#: Page links of each layout, and the number of pages that they tell.
PAGING = {
    "cards": (PAGINATION, "greatest(2, page_id % 40 + 1)"),
    "headings": (
        f"""concat('<a href="/page/', {_N}, '/">next</a><a href="/x">1 <b>2</b></a>',
        CASE WHEN page_id % 5 = 0 THEN '<p>Page 1,050</p>' ELSE '' END)""",
        f"CASE WHEN page_id % 5 = 0 THEN 1050 ELSE {_N} END",
    ),
    "jsonld": (f"""concat('<a href="?page=', {_N}, '">next</a><a href="/x">1 <b>2</b></a>')""", f"greatest(12, {_N})"),
    "candidates": (
        f"""concat('<a href="/page/', {_N}, '/">on</a><div class="Pagination"><a href="/z">', {_N} + 3, '</a></div>',
        CASE WHEN page_id % 3 = 0 THEN concat('<p> next ', {_N} + 107, ' </p>') ELSE '<p> 9000 </p>' END)""",
        f"{_N} + CASE WHEN page_id % 3 = 0 THEN 107 ELSE 3 END",
    ),
    "link_detail": (f"""concat('<a href="?paged=', {_N}, '">on</a><a href="/page/', {_N} + 1, '/">on</a>')""", f"{_N} + 1"),
    "cards_alt": (f"""concat('<nav class="np"><a>', {_N}, '</a><a>1 <b>99</b></a></nav><a>500</a>')""", _N),
}
#: What differs where numbers near paging words count up to 100 only.
PAGING_LIMITED = {"candidates": f"{_N} + 3"}


def paging_pages(spark: SparkSession, sf_dir: str, site: str) -> DataFrame:
    """``(page_id, html)`` with nothing but the page links of a layout."""
    numbers = _dealt(table(spark, sf_dir, "orders").selectExpr("o_orderkey div 10 AS page_id"), "page_id").distinct()
    return numbers.select("page_id", F.expr(PAGING[site][0]).alias("html"))

DETAILS = {
    "cards": ("/jobs/", "concat('<p>Write to ', email, ' or later@y.example</p>')"),
    "headings": ("/j/", "concat('<p>Write to ', email, '</p>')"),
    "candidates": ("/job/", "concat('<p>noreply@y.example</p><p>Please apply: ', email, '</p>')"),
    "link_detail": (
        "/careers/job/",
        f"""concat('<meta ', CASE WHEN k % 2 = 0
        THEN 'property="og:site_name" content="Portal ' ELSE 'name="author" content="Desk of ' END, town, '"><h1>', title, '</h1>', CASE WHEN k % 3 = 1 THEN ''
        ELSE concat('<p>Company: ', company, '</p>') END, '<p>Location: ', town, '</p><p>', {LONG},
        '</p><div class="entry-content">', description, '</div>', CASE WHEN k % 3 = 2
        THEN concat('<p>', replace(replace(email, '@', ' [at] '), '.example.com', ' [dot] example'), '</p>')
        ELSE concat('<a href="mailto:', upper(email), '?subject=x">mail</a>') END)""",
    ),
}


def listing_pages(spark: SparkSession, sf_dir: str, *sites: str) -> DataFrame:
    """``(page_id, site, page_num, url, html)`` of the given layouts."""
    found = _dealt(posts(spark, sf_dir), "page_id")
    items = found.select("page_id", "page_num", "k", *[F.expr(ITEMS[site]).alias(site) for site in dict.fromkeys(sites)])
    return _as_pages(items, {site: PAGINATION if site.startswith("cards") else "''" for site in sites})


def detail_pages(spark: SparkSession, sf_dir: str, *sites: str) -> DataFrame:
    """``(page_id, url, html)`` for nine of ten posts."""
    found = _dealt(posts(spark, sf_dir).filter("k % 10 <> 7"), "k")
    parts = []
    for site in sites:
        if site in DETAILS:
            path, html = DETAILS[site]
            url = F.concat(F.lit(HOST[site] + path), F.col("k"))
            parts.append(found.select(F.col("k").alias("page_id"), url.alias("url"), F.expr(html).alias("html")))
    return reduce(DataFrame.unionByName, parts)


# --- what must come out -----------------------------------------------------------------------------

_LONG = "strftime(day, '%B %-d, %Y')"
_EXPIRES_LATER = "'Expires ' || strftime(day + 30, '%B %d, %Y')"
_TOWN_OR_DEFAULT = f"CASE WHEN town = 'Elsewhere' THEN '{fixed.DEFAULT_PLACE}' ELSE town END"


def _src(rows: str) -> str:
    return f"""rows AS ({rows}), src AS (SELECT row_number() OVER () AS id, * FROM
    (SELECT DISTINCT title, description, company FROM rows))"""


def _finished(site: str, rows: str, categories: str = CATEGORIES) -> str:
    """Rows (page_num, pos, title, company, location, expiry_text, expiry_date, description, apply_email)."""
    values = fixed.SITES[site.replace("_lenient", "")]
    return f"""{_src(rows)}, {categories}
    SELECT printf('{values['id_prefix']}_%03d_%03d_{DAY}', page_num, pos) AS id, title, company, location,
      category, expiry_text, description, {quote(values['site'])} AS source_site, apply_email, expiry_date, page_num
    FROM rows JOIN src USING (title, description, company) JOIN categories USING (id)"""


def _contact(site: str, condition: str = "has_detail") -> str:
    return f"CASE WHEN {condition} THEN email ELSE {quote(fixed.SITES[site]['contact'])} END AS apply_email"


CANDIDATES = f"""found AS (
  SELECT page_id, page_num, k, CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS sel,
    title || ' ' || k AS title, company, town, day, email, has_detail,
    title || ' ' || k || ' ' || company || CASE k % 4 WHEN 0 THEN ' ' || town || '. Posted on ' || {_LONG}
      WHEN 1 THEN ' Posted ' || {_LONG} ELSE ' ' || town END AS text
  FROM posts WHERE k % 4 <> 2
  UNION ALL SELECT page_id, any_value(page_num), min(k), 3, 'QA', NULL, NULL, NULL, NULL, NULL, 'QA'
  FROM posts WHERE k % 4 = 2 GROUP BY page_id
  UNION ALL SELECT page_id, page_num, k, 5, 'again ' || k, NULL, NULL, NULL, NULL, NULL, 'again ' || k
  FROM posts WHERE k % 4 = 1),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY sel, k) AS INT) AS pos FROM found),
kept AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM placed WHERE sel IN (1, 2, 4))"""

PORTAL = "CASE WHEN k % 2 = 0 THEN 'Portal ' ELSE 'Desk of ' END || town"

ROWS = {
    "cards": f"""SELECT page_id, page_num, pos, title, company, town AS location, description, expiry_text,
        strict_day AS expiry_date, {_contact('cards')} FROM posts WHERE strict_day >= DATE '1998-01-01'""",
    "cards_lenient": f"""SELECT page_id, page_num, pos, title, company, town AS location, description, expiry_text,
        lenient_day AS expiry_date, {_contact('cards')} FROM posts
        WHERE lenient_day IS NULL OR lenient_day >= DATE '1998-01-01'""",
    "headings": f"""SELECT page_id, page_num, pos, title, company, location, description,
        'Expires ' || strftime(expiry_date, '%B %d, %Y') AS expiry_text, expiry_date, apply_email FROM (
        SELECT page_id, page_num, 2 * pos - 1 AS pos, title, CASE WHEN k % 3 = 0 THEN 'N/A' ELSE company END AS company,
        {_TOWN_OR_DEFAULT} AS location, {quote(fixed.HEADINGS_DESCRIPTION)} AS description,
        CASE k % 4 WHEN 1 THEN day WHEN 2 THEN NULL ELSE day + 30 END AS expiry_date, {_contact('headings')}
        FROM posts) WHERE expiry_date >= DATE '1998-01-01'""",
    "jsonld": f"""SELECT page_id, page_num, 1 AS pos, title, CASE WHEN k % 5 = 2 THEN
        {quote(fixed.SITES['jsonld']['company'])} ELSE company END AS company, town AS location,
        description || CASE WHEN k % 11 = 5 THEN repeat(' x', 300) || ' nurse midwife' ELSE '' END AS description,
        'N/A' AS expiry_text, CAST(NULL AS DATE) AS expiry_date, {quote(fixed.SITES['jsonld']['contact'])} AS apply_email
        FROM posts WHERE page_id % 4 <> 0 AND k % 5 < 3""",
    "candidates": f"""SELECT page_id, page_num, pos, title, company, CASE WHEN sel = 2 THEN
        '{fixed.DEFAULT_PLACE}' ELSE {_TOWN_OR_DEFAULT} END AS location, text AS description,
        CASE WHEN sel = 4 THEN 'N/A' ELSE {_EXPIRES_LATER} END AS expiry_text,
        CASE WHEN sel <> 4 THEN day + 30 END AS expiry_date,
        {_contact('candidates', 'has_detail AND sel <> 4')} FROM kept""",
    "link_detail": f"""SELECT page_id, page_num, pos, title, CASE WHEN k % 3 = 1 THEN {PORTAL} ELSE company END AS company,
        town AS location, description, {_EXPIRES_LATER} AS expiry_text, day + 30 AS expiry_date,
        CASE WHEN k % 3 = 2 THEN replace(email, '.example.com', '.example') ELSE email END AS apply_email
        FROM posts WHERE has_detail""",
    "cards_alt": f"""SELECT page_id, page_num, pos, title, company,
        CASE WHEN k % 2 = 0 THEN town ELSE 'Zimbabwe' END AS location,
        CASE WHEN k % 2 = 0 THEN description ELSE {quote(fixed.ALT_DESCRIPTION)} END AS description,
        'N/A' AS expiry_text, CAST(NULL AS DATE) AS expiry_date,
        {quote(fixed.SITES['cards_alt']['contact'])} AS apply_email FROM posts""",
}
ROWS["cards_alt_second"] = ROWS["cards_alt"].replace(quote(fixed.SITES["cards_alt"]["contact"]), quote(fixed.SITES["cards_alt_second"]["contact"]))

_P = fixed.PLACEHOLDER
PLACEHOLDERS = f"""SELECT printf('ZJ_%03d_001_{DAY}', page_num) AS id, {quote(_P['title'])} AS title,
    {quote(_P['company'])} AS company, {quote(_P['location'])} AS location, {quote(_P['category'])} AS category,
    'N/A' AS expiry_text, {quote(_P['description'])} AS description, 'ZimboJobs' AS source_site,
    'Apply on ZimboJobs' AS apply_email, CAST(NULL AS DATE) AS expiry_date, page_num
    FROM (SELECT DISTINCT page_id, page_num FROM posts WHERE page_id % 4 = 0)"""


def expected(site: str) -> str:
    """A query for the finished listings of one layout, without its WITH."""
    categories = FIRST_CATEGORIES if site in ("cards_lenient", "cards_alt", "cards_alt_second") else CATEGORIES
    ctes = f"{POSTS}, {CANDIDATES}" if site == "candidates" else POSTS
    rows = _finished(site, ROWS[site], categories)
    if site == "jsonld":
        rows = f"{rows} UNION ALL {PLACEHOLDERS}"
    return f"WITH {ctes}, {rows}"

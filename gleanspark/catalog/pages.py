"""Selection, text and links of the page table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import urls
from ..functions.arrays import first, first_by, let
from ..functions.text import lines
from ..operators import enrich
from ..operators import extract as X
from ..operators import nodes as N
from ..operators.css import select_css
from ..operators import pagination
from ..operators.reports import count_by
from ..plans import listings as L
from ..plans.profiles import Registry, SiteProfile
from .base import (
    ARTICLE,
    AS_OF,
    CATEGORIES,
    LINKS,
    VISIBLE,
    pages,
    query,
    sql_any,
    sql_clean,
    sql_joined,
    sql_pieces,
    sql_strip,
    sql_unescape,
    table,
)
from .rendered import PORTAL, POSTS, detail_pages, listing_pages

col = F.col


def shredded(spark, sf):
    return N.shred(pages(spark, sf).select("page_id", "html"))


@query("scan_pages", "SELECT page_id, url, CAST(length(html) AS INT) AS n_chars FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", F.length("html").alias("n_chars"))


@query(
    "html_nodes",
    r"""SELECT page_id, tag, count(*) AS n FROM (SELECT page_id,
        unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL""",
)
def _(spark, sf):
    tags = F.transform(F.filter(col("nodes"), lambda n: N.is_element(n)), lambda n: n["tag"])
    return (
        shredded(spark, sf)
        .select("page_id", F.explode(tags).alias("tag"))
        .groupBy("page_id", "tag")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "select_tag_class",
    f"""SELECT page_id, {sql_strip(sql_unescape("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)"))} AS ad
        FROM pages""",
)
def _(spark, sf):
    ad = N.trimmed_text(col("nodes"), first(N.select(col("nodes"), "div", "ad")))
    return shredded(spark, sf).select("page_id", ad.alias("ad"))


@query(
    "select_tag",
    """SELECT page_id, CAST(len(regexp_extract_all(html, '<p>')) AS INT) AS paragraphs,
       CAST(len(regexp_extract_all(html, '<(b|br|h1)>')) AS INT) AS marks FROM pages""",
)
def _(spark, sf):
    return shredded(spark, sf).select(
        "page_id",
        F.size(N.select(col("nodes"), "p")).alias("paragraphs"),
        F.size(N.select(col("nodes"), ["b", "br", "h1"])).alias("marks"),
    )


@query(
    "select_attr",
    """SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=')) AS INT) AS linked,
       CAST(len(regexp_extract_all(html, '<meta charset="utf-8">')) AS INT) AS utf8, CAST(len(regexp_extract_all(html, '<a href="/the">')) AS INT) AS to_the FROM pages""",
)
def _(spark, sf):
    return shredded(spark, sf).select(
        "page_id",
        F.size(N.select(col("nodes"), "a", has="href")).alias("linked"),
        F.size(N.select(col("nodes"), equals={"charset": "utf-8"})).alias("utf8"),
        F.size(N.select(col("nodes"), "a", equals={"href": "/the"})).alias("to_the"),
    )


@query(
    "select_attr_regex",
    f"""WITH {LINKS} SELECT p.page_id, CAST(count(l.pos) AS INT) AS n FROM pages p LEFT JOIN links l
        ON p.page_id = l.page_id AND regexp_matches(l.href, '(?i)^/[a-m]|st') GROUP BY ALL""",
)
def _(spark, sf):
    found = N.select(col("nodes"), "a", matches={"href": "(?i)^/[a-m]|st"})
    return shredded(spark, sf).select("page_id", F.size(found).alias("n"))


@query(
    "select_css_union",
    f"""WITH {POSTS} SELECT page_id, CAST(sum(CASE k % 4 WHEN 1 THEN 4 WHEN 3 THEN 1 ELSE 2 END) AS INT) AS found,
        CAST(sum(CASE k % 4 WHEN 1 THEN 2 ELSE 1 END) AS INT) AS elements FROM posts GROUP BY page_id""",
)
def _(spark, sf):
    found = X.candidate_nodes(col("nodes"))
    distinct = F.array_distinct(F.transform(found, lambda n: n["pre"]))
    return N.shred(listing_pages(spark, sf, "candidates").select("page_id", "html")).select(
        "page_id", F.size(found).alias("found"), F.size(distinct).alias("elements")
    )


@query(
    "select_css",
    f"""WITH {POSTS}, each AS (SELECT page_id, unnest(CASE k % 4 WHEN 0 THEN ['article'] WHEN 1 THEN ['div.job-listing', 'div.post']
        WHEN 2 THEN ['div.job'] ELSE ['li.job'] END) AS selector FROM posts)
        SELECT page_id, selector, CAST(count(*) AS INT) AS n FROM each GROUP BY ALL""",
)
def _(spark, sf):
    """Elements found by each of ten selectors, all given as strings."""
    counts = [
        F.struct(F.lit(s).alias("selector"), F.size(select_css(col("nodes"), s)).alias("n")) for s in fixed.CANDIDATE_SELECTORS
    ]
    found = N.shred(listing_pages(spark, sf, "candidates").select("page_id", "html"))
    return found.select("page_id", F.inline(F.array(*counts))).where("n > 0")


@query(
    "select_css_paths",
    f"""WITH {LINKS}, a AS (SELECT page_id, count(*) AS links FROM links GROUP BY page_id),
        p AS (SELECT page_id, {ARTICLE} AS article FROM pages)
        SELECT page_id, CAST(len(regexp_extract_all(article, '<p>')) AS INT) AS paragraphs,
        CAST(len(regexp_extract_all(article, '<h1>')) AS INT) AS titles, CAST(coalesce(links, 0) AS INT) AS links
        FROM p LEFT JOIN a USING (page_id)""",
)
def _(spark, sf):
    """Elements below the article and right below it, and links wherever they are."""
    wanted = {"paragraphs": "html body article p", "titles": "article > h1", "links": "body a[href], head > a"}
    sizes = [F.size(select_css(col("nodes"), selector)).alias(name) for name, selector in wanted.items()]
    return N.shred(pages(spark, sf).select("page_id", "html")).select("page_id", *sizes)


@query(
    "first_alternative",
    f"WITH {POSTS} SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'p' ELSE 'script' END AS tag FROM posts",
)
def _(spark, sf):
    found = X.first_alternative(
        N.select(col("nodes"), "section"), N.select(col("nodes"), "script"), N.select(col("nodes"), "p")
    )
    return N.shred(listing_pages(spark, sf, "jsonld").select("page_id", "html")).select(
        "page_id", F.explode(F.transform(found, lambda n: n["tag"])).alias("tag")
    )


@query(
    "nearest_ancestor",
    f"WITH {LINKS} SELECT page_id, pos, {sql_strip('text')} AS item FROM links",
)
def _(spark, sf):
    found = F.transform(
        N.select(col("nodes"), "a"),
        lambda a, i: F.struct(
            (i + 1).alias("pos"),
            N.trimmed_text(col("nodes"), N.ancestor(col("nodes"), a, "li")).alias("item"),
        ),
    )
    return shredded(spark, sf).select("page_id", F.inline(found))


@query(
    "ancestor_or_none",
    f"""WITH {POSTS} SELECT page_id, CAST(pos AS INT) AS pos, CASE WHEN page_id % 3 > 0 AND k % 10 > 2 OR page_id % 3 = 2 AND k % 10 > 0
        THEN 'p' END AS block FROM posts""",
)
def _(spark, sf):
    found = F.transform(
        N.select(col("nodes"), "a"),
        lambda a, i: F.struct((i + 1).alias("pos"), N.ancestor(col("nodes"), a, "p")["tag"].alias("block")),
    )
    return N.shred(listing_pages(spark, sf, "few_links").select("page_id", "html")).select("page_id", F.inline(found))


@query("min_title", f"WITH {LINKS} SELECT page_id, pos, {sql_strip('text')} AS title FROM links WHERE length({sql_strip('text')}) >= 4")
def _(spark, sf):
    titled = F.transform(N.anchors(col("nodes")), lambda a: F.struct(a["pos"], a["text"].alias("title")))
    return shredded(spark, sf).select("page_id", F.inline(X.min_title(titled, 4)))


@query(
    "parent_of",
    """SELECT page_id, tag, parent_tag, CAST(n AS BIGINT) AS n FROM (
       SELECT page_id, len(regexp_extract_all(html, '<a ')) AS n, 'a' AS tag, 'li' AS parent_tag FROM pages UNION ALL
       SELECT page_id, len(regexp_extract_all(html, '<li>')), 'li', 'ul' FROM pages UNION ALL
       SELECT page_id, 1, 'h1', 'article' FROM pages UNION ALL SELECT page_id, 1, 'article', 'body' FROM pages UNION ALL
       SELECT page_id, 1, 'title', 'head' FROM pages UNION ALL SELECT page_id, 1, 'head', 'html' FROM pages UNION ALL
       SELECT page_id, 1, 'html', '#document' FROM pages)""",
)
def _(spark, sf):
    tags = ["a", "li", "h1", "article", "title", "head", "html"]
    found = F.transform(
        N.select(col("nodes"), tags),
        lambda n: F.struct(n["tag"], N.parent(col("nodes"), n)["tag"].alias("parent_tag")),
    )
    return (
        shredded(spark, sf)
        .select("page_id", F.inline(found))
        .groupBy("page_id", "tag", "parent_tag")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "ancestor_hint",
    f"""WITH {POSTS} SELECT page_id, CAST(3 * pos - 2 + i AS INT) AS pos, i = 0 AS hinted FROM posts,
        unnest([0, 1, 2]) AS r(i)""",
)
def _(spark, sf):
    pattern = "|".join(fixed.ANCESTOR_HINTS)
    found = F.transform(
        N.select(col("nodes"), "a"),
        lambda a, i: F.struct((i + 1).alias("pos"), N.ancestor_hint(col("nodes"), a, pattern).alias("hinted")),
    )
    linked = listing_pages(spark, sf, "link_detail").select("page_id", "html")
    return N.shred(linked).select("page_id", F.inline(found))


_H1 = "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"


@query("element_text", f"SELECT page_id, {sql_strip(sql_unescape(_H1))} AS title FROM pages")
def _(spark, sf):
    title = N.trimmed_text(col("nodes"), first(N.select(col("nodes"), "h1")))
    return shredded(spark, sf).select("page_id", title.alias("title"))


@query(
    "element_text_joined",
    f"SELECT page_id, {sql_joined(ARTICLE)} AS spaced, {sql_joined(ARTICLE, '')} AS dense FROM pages",
)
def _(spark, sf):
    article = first(N.select(col("nodes"), "article"))
    return shredded(spark, sf).select(
        "page_id",
        N.joined_text(col("nodes"), article, " ").alias("spaced"),
        N.joined_text(col("nodes"), article, "").alias("dense"),
    )


@query(
    "page_text",
    f"SELECT page_id, {sql_unescape(rf'''regexp_replace({VISIBLE}, '<[^>]+>', '', 'g')''')} AS text FROM pages",
)
def _(spark, sf):
    return shredded(spark, sf).select("page_id", N.page_text(col("nodes")).alias("text"))


@query(
    "text_lines",
    f"""SELECT page_id, CAST(len({sql_pieces(ARTICLE)}) AS INT) AS n, {sql_joined(ARTICLE, ' / ')} AS text
        FROM pages""",
)
def _(spark, sf):
    text = N.joined_text(col("nodes"), first(N.select(col("nodes"), "article")), "\n")
    parts = lines(text, "\n")
    return shredded(spark, sf).select(
        "page_id", F.size(parts).alias("n"), F.array_join(parts, " / ").alias("text")
    )


@query("page_links", f"WITH {LINKS} SELECT page_id, pos, href, {sql_strip('text')} AS text FROM links")
def _(spark, sf):
    found = F.transform(N.anchors(col("nodes")), lambda a: F.struct(a["pos"], a["href"], a["text"]))
    return shredded(spark, sf).select("page_id", F.inline(found))


@query("links_per_page", f"WITH {LINKS} SELECT page_id, CAST(count(*) AS INT) AS n_links FROM links GROUP BY page_id")
def _(spark, sf):
    n_links = F.size(N.select(col("nodes"), "a", has="href"))
    return shredded(spark, sf).select("page_id", n_links.alias("n_links")).filter("n_links > 0")


@query("meta_content", f"WITH {POSTS} SELECT k AS page_id, {PORTAL} AS site FROM posts WHERE has_detail")
def _(spark, sf):
    site = N.meta_content(col("nodes"), [("property", "og:site_name"), ("name", "author")])
    details = detail_pages(spark, sf, "link_detail").select("page_id", "html")
    return N.shred(details).select("page_id", site.alias("site"))


@query("content_block", f"SELECT page_id, {sql_joined(ARTICLE)} AS content FROM pages")
def _(spark, sf):
    content = N.joined_text(col("nodes"), X.content_block(col("nodes")), " ")
    return shredded(spark, sf).select("page_id", content.alias("content"))


# --- links ------------------------------------------------------------------------------------------

_LIKELY = f"""({sql_any('lower(href)', fixed.LINK_HREF_HINTS)} OR {sql_any('lower(text)', fixed.LINK_TEXT_HINTS)}
    OR length({sql_strip('text')}) >= 25)"""
_ORIGIN = "(SELECT page_id, regexp_extract(url, '^https?://[^/]+', 0) AS origin FROM pages) o"


@query("likely_job_link", f"WITH {LINKS} SELECT page_id, pos, {_LIKELY} AS likely FROM links")
def _(spark, sf):
    found = let(
        N.anchors(col("nodes")),
        lambda links: F.transform(
            links, lambda a: F.struct(a["pos"], X.likely_job_link(col("nodes"), a).alias("likely"))
        ),
    )
    return shredded(spark, sf).select("page_id", F.inline(found))


@query(
    "pages_without_hits",
    f"WITH {LINKS} SELECT page_id FROM pages WHERE page_id NOT IN (SELECT page_id FROM links WHERE length(href) > 9)",
)
def _(spark, sf):
    long_links = F.filter(N.anchors(col("nodes")), lambda a: F.length(a["href"]) > 9)
    hits = shredded(spark, sf).select("page_id", F.explode(long_links))
    return enrich.without_hits(table(spark, sf, "pages").select("page_id"), hits)


@query(
    "dedup_url",
    f"""WITH {LINKS} SELECT page_id, pos, url FROM (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS r
        FROM (SELECT l.page_id, l.pos, o.origin || l.href AS url FROM links l JOIN {_ORIGIN} ON l.page_id = o.page_id)) WHERE r = 1""",
)
def _(spark, sf):
    linked = F.transform(
        N.anchors(col("nodes")), lambda a: F.struct(a["pos"], urls.resolve_url(col("url"), a["href"]).alias("url"))
    )
    found = first_by(linked, lambda a: a["url"])
    return N.shred(pages(spark, sf).select("page_id", "url", "html")).select("page_id", F.inline(found))


# --- a new site is a new profile --------------------------------------------------------------------


def article_profile() -> SiteProfile:
    """Every page is one listing: heading, host-independent defaults, and the article's text."""

    def rows(nodes):
        article = first(N.select(nodes, "article"))
        return F.array(
            X.row(
                pos=F.lit(1),
                title=N.trimmed_text(nodes, first(N.select(nodes, "h1"))),
                description=N.joined_text(nodes, article, " "),
            )
        )

    return SiteProfile(
        name="articles",
        site="Articles",
        base_url="https://h.example/",
        id_prefix="AR",
        rows=rows,
        total_pages=pagination.in_links,
        page_url=urls.parameter_url,
    )


_TITLE = sql_strip(sql_unescape(_H1))
ARTICLES = f"""raw AS (SELECT page_id AS id, {_TITLE} AS title, {sql_joined(ARTICLE)} AS description,
    'N/A' AS company FROM pages), src AS (SELECT * FROM raw)"""


def articles(spark, sf):
    """Listings of the page table, by a profile added to the registry."""
    registry = Registry()
    registry.add(article_profile())
    found = pages(spark, sf).select(
        "page_id", F.lit("articles").alias("site"), F.lit(1).alias("page_num"), "html"
    )
    return L.run(found, None, AS_OF, registry, ["articles"])


@query(
    "site_profiles",
    f"""WITH {ARTICLES}, {CATEGORIES} SELECT id AS page_id, printf('AR_001_001_%s', '{AS_OF.replace('-', '')}') AS id,
        {sql_clean('title')} AS title, {sql_clean('description')} AS description, category, 'Articles' AS source_site
        FROM src JOIN categories USING (id)""",
)
def _(spark, sf):
    return articles(spark, sf).select("page_id", "id", "title", "description", "category", "source_site")


@query(
    "page_categories",
    f"""WITH {ARTICLES}, {CATEGORIES} SELECT category, count(*) AS n FROM categories GROUP BY category
        ORDER BY n DESC, category LIMIT 5""",
)
def page_categories(spark, sf):
    """Flagship: titles and texts of raw pages, classified, and the five largest categories."""
    return count_by(articles(spark, sf), "category", top=5)

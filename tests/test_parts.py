"""What the worker finds in a page is what the expressions over its nodes find."""

import random

import pytest
from pyspark.sql import functions as F

from gleanspark import fixed
from gleanspark.operators import enrich
from gleanspark.operators.extract import record_finder
from gleanspark.operators.nodes import shred
from gleanspark.operators.parts import read_details
from gleanspark.plans import listings as L
from gleanspark.plans.profiles import Registry, builtin_profiles

AS_OF = "2000-01-01"
SCHEMA = "page_id int, site string, page_num int, html string"

_LINKS = [
    f'<a {attrs}href="{href}">'
    for attrs in ("", 'class="big job-listing" ')
    for href in ("/job/1", "/job/1#x", "/jobs/2", " /job/1 ", "job/3", "//h.example/careers/", "http://h.example/x", "mailto:a@b.example", "#top", "")
]
_CLASSES = ["job", "job-listing", "job-listing-title", "x job-listing-footer\ny", "icon-material-outline-access-time", "job-listing ", "COMPANY",
            "icon-material-outline-location-on", "post-content", "no-job", "jobs", "row job", "Career list", "content"]
_OPEN = ["<a>", "<p>", "<ul>", "<li>", "<h1>", "<h3>", "<h4>", "<article>", "<small>", "<span>", "<div>", "<i>", "<pre>", '<div itemtype="x/JobPosting">', '<ul class="jobs">']
_OPEN += [f'<{tag} {name}="{value}">' for tag in ("div", "li", "h3", "h4", "i", "span", "p") for name in ("class", "id") for value in _CLASSES]
_ENDS = [f"</{tag}>" for tag in ("a", "p", "ul", "li", "h1", "h3", "h4", "div", "div", "article", "span", "i", "pre", "small")]
_TEXTS = ["Nurse", "QA", "Nurse – Clinic", " ", "\n", "\xa0Clerk ", "Apply now", "Posted on May 5, 2001", "Expires 3 Jun 2002", "Harare", "a b c", "Company: Acme", "x@y.example",
          "z [at] y [dot] example", "a long text of a link to a position", "&amp;", "&", "Posted", "İ job"]
_ODD = ['<script type="application/ld+json">{"@type":"JobPosting","title":"T","url":"/x/1"}</script>', '<script type="application/ld+json">[{"@type":"JobPosting","sameAs":"/y"}]</script>',
        '<script type="application/ld+json"></script>', "<script>job</script>", '<meta name="author" content="Desk">', '<meta property="og:site_name">', "<br>", "<!--job-->", "<br/>",
        "<![CDATA[]]>", '<a href>', '<a href="/job/7" href="/job/8">', "<title>t</title>"]


def made(count):
    pick = random.Random(11)
    some = lambda: pick.choice(pick.choice([_LINKS, _OPEN, _OPEN, _ENDS, _ENDS, _TEXTS, _TEXTS, _ODD if pick.random() < 0.3 else _TEXTS]))
    return ["".join(some() for _ in range(pick.randint(0, 40))) for _ in range(count)] + [None, "", "text"]


@pytest.mark.parametrize("limits", [None, fixed.LIMITS])
def test_listings_are_those_of_the_nodes(spark, limits):
    registry, pages = Registry(builtin_profiles(limits)), made(400)
    for names in (["cards", "headings", "jsonld", "candidates", "link_detail"], ["cards_lenient"]):
        profiles = [registry[n] for n in names]
        table = spark.createDataFrame([(i, n, 1, html) for i, html in enumerate(pages) for n in names], SCHEMA).repartition(8).cache()
        for as_of in (None, AS_OF):
            one = L.listings_of(table, profiles, as_of)
            other = L.listings(shred(table), profiles, as_of)
            if as_of:
                one, other = (L.current_only(df, profiles, as_of) for df in (one, other))
            got, expected = (sorted(map(repr, map(tuple, df.select(other.columns).collect()))) for df in (one, other))
            assert got == expected and len(got) > 100


def test_links_stand_in_where_no_candidate_is_kept(spark):
    site = Registry()["candidates"]
    html = ['<div class="job"><a href="/job/1">QA</a></div><p><a href="/job/2">Nurse</a></p>', '<div class="job"><a href="/job/1">QA</a></div><p><a href="/x">y</a><a href="/job/1#">x</a></p>',
            '<article><a href="/job/1">QA</a></article><div class="job"><a href="/job/1">Nurse</a></div>', '<article>AB</article><a href="http://o.example/job/"> </a>']
    table = spark.createDataFrame([(i, "candidates", 1, h) for i, h in enumerate(html)], SCHEMA)
    one, other = L.listings_of(table, [site]), L.listings(shred(table), [site])
    assert sorted(map(repr, one.collect())) == sorted(map(repr, other.select(one.columns).collect()))
    # a page each of candidates, of plain links, of links since the URL's first candidate is short, of links since titles are short
    assert sorted({(r.page_id, r.description == fixed.LINK_DESCRIPTION) for r in one.collect()}) == [(0, False), (1, True), (2, True), (3, True)]


def test_details_are_those_of_the_nodes(spark):
    registry = Registry()
    finders = {n: registry[n].contact for n in ("cards", "candidates", "link_detail")} | {"record": record_finder(), "limited": record_finder(fixed.LIMITS["link_detail"])}
    table = spark.createDataFrame([(i, html) for i, html in enumerate(made(600))], "page_id int, html string").repartition(4).cache()
    other = shred(table).select("page_id", "parse_error", *[f(F.col("nodes")).alias(n) for n, f in finders.items()]).collect()
    one = read_details(table, list(finders.values())).select("page_id", "parse_error", *[f.from_values().alias(n) for n, f in finders.items()]).collect()
    read = [sorted((repr(tuple(r)) for r in rows if r.parse_error is None)) for rows in (one, other)]
    assert read[0] == read[1] and len(read[0]) > 500
    assert sorted(map(repr, ((r.page_id, r.parse_error) for r in one))) == sorted(map(repr, ((r.page_id, r.parse_error) for r in other)))


def test_nodes_stay_in_the_worker(spark):
    """Neither the listings nor the details of the built-in layouts move nodes, but for JSON-LD pages; a finder of one's own still gets them."""
    registry = Registry()
    pages = spark.createDataFrame([(1, "cards", 1, "<p>")], SCHEMA)
    schema = lambda df: df._jdf.queryExecution().analyzed().toString()
    for name in ("cards", "headings", "candidates", "link_detail", "cards_lenient"):
        assert "nodes#" not in schema(L.listings_of(pages, [registry[name]]))
    details = spark.createDataFrame([(1, "u", "<p>a@x.example</p>")], "page_id int, url string, html string")
    contact = registry["cards"].contact
    assert "nodes#" not in schema(enrich.detail_facts(details, {"e": contact}, with_record=True))
    (row,) = enrich.detail_facts(details, {"e": lambda nodes: contact(nodes)}).collect()
    assert row.detail.e == "a@x.example"
    # a profile with rows of its own is not read by the parts of another
    assert registry["cards"].with_(rows=registry["cards"].rows).parts is None

"""Whole listings from small pages of every layout."""

import pytest
from pyspark.sql import functions as F

from gleanspark import fixed
from gleanspark.operators import extract as X
from gleanspark.operators.nodes import shred
from gleanspark.plans import listings as L
from gleanspark.plans.profiles import Registry, builtin_profiles

AS_OF = "1998-01-01"

CARDS = """<ul class="pagination"><li><a href="?page=2">2</a></li><li><a href="?page=7">Last</a></li></ul>
<a class="job-listing" href="/jobs/11"><h3 class="job-listing-title">Registered Nurse</h3>
 <h4 class="job-listing-company">City Clinic</h4><p class="job-listing-text">Ward duty, paid weekly.</p>
 <div class="job-listing-footer"><ul><li><i class="icon-material-outline-location-on"></i> Harare</li>
 <li><i class="icon-material-outline-access-time"></i> Expires 24 Aug 1998</li></ul></div></a>
<a class="job-listing" href="/jobs/12"><h3 class="job-listing-title">Old Post</h3>
 <div class="job-listing-footer"><ul><li><i class="icon-material-outline-access-time"></i> Expires 24 Aug 1997</li></ul></div></a>
<a class="job-listing" href="/jobs/13"><h3 class="job-listing-title">HR Manager</h3></a>"""

HEADINGS = """<div><h3><a href="/j/1">Driver – Acme Ltd</a></h3><p>Posted on December 20, 1997 in Gweru, near Harare</p></div>
<div><h3><a href="/j/2">Cashier</a></h3><p>December 20, 1997</p></div>
<div><h3>Menu</h3></div>
<div><h3><a href="/j/3">Welder</a></h3><p>no date</p></div>"""

POSTING = """<script type="application/ld+json">%s</script>"""
FULL = (
    '{"@type":"JobPosting","title":"Data Analyst","hiringOrganization":{"name":"Acme Ltd"},'
    '"jobLocation":{"address":{"addressLocality":"Mutare"}},"description":"Builds SQL reports"}'
)

CANDIDATES = """<article><a href="/job/5">Legal Officer</a><small>Acme Ltd</small> Harare. Posted on December 20, 1997</article>
<div class="post"><a href="/job/5">Legal Officer (again)</a></div>
<div class="job"><a href="/job/6">QA</a></div>
<div class="job-listing"><a href="/job/7">Farm Hand</a><p>Green Farm</p><p>Posted Dec 20, 1997</p></div>"""

LINKS = """<a href="/careers/job/8">Engineer</a> <a href="mailto:a@b.c">apply</a> <a href="#top">Top</a>"""
DETAIL = """<meta property="og:site_name" content="Portal"><h1>Civil Engineer</h1>
 <p>Company: Acme Ltd</p><p>Location: Mutare</p><p>December 20, 1997</p>
 <div class="entry-content">Roads and bridges.</div><a href="mailto:HR@acme.example?subject=x">mail</a>"""

ALT = """<div class="job_seen_beacon"><a data-jk="1">Tester</a><span class="company">Acme</span>
<div class="companyLocation">Harare</div></div><div class="job_seen_beacon"><h2 class="title">Nurse</h2>
<a class="turnstileLink">Ward</a><div class="summary">Nights</div></div>"""


@pytest.fixture(scope="module")
def registry():
    return Registry()


def listed(spark, registry, name, *pages, details=()):
    table = spark.createDataFrame(
        [(i, name, 2, html) for i, html in enumerate(pages)],
        "page_id long, site string, page_num int, html string",
    )
    found = spark.createDataFrame(list(details), "url string, html string")
    rows = L.run(table, found, AS_OF, registry, [name]).orderBy("page_id", "pos").collect()
    return rows


def test_cards(spark, registry):
    details = [("https://vacancymail.co.zw/jobs/11", "<p>Send to hr@firm.example</p>")]
    (row,) = listed(spark, registry, "cards", CARDS, details=details)
    assert (row.id, row.title, row.company) == ("VM_002_001_19980101", "Registered Nurse", "City Clinic")
    assert (row.location, row.expiry_text) == ("Harare", "Expires 24 Aug 1998")
    assert (row.category, row.apply_email) == ("Healthcare", "hr@firm.example")
    lenient = listed(spark, registry, "cards_lenient", CARDS)
    assert [(r.pos, r.title, r.company, r.apply_email) for r in lenient] == [
        (1, "Registered Nurse", "City Clinic", "N/A"),
        (3, "HR Manager", "N/A", "N/A"),
    ]
    assert lenient[1].category == "Management"


def test_headings(spark, registry):
    (row,) = listed(spark, registry, "headings", HEADINGS)
    assert (row.pos, row.title, row.company, row.location) == (1, "Driver", "Acme Ltd", "Harare")
    assert row.expiry_text == "Expires January 19, 1998"
    assert (row.source_site, row.apply_email) == ("Jobs Zimbabwe", "Apply on Jobs Zimbabwe")


def test_jsonld(spark, registry):
    variants = [
        FULL,
        FULL.replace('"hiringOrganization":{"name":"Acme Ltd"},', ""),
        FULL.replace('{"name":"Acme Ltd"}', '"Acme Ltd"'),
        f"[{FULL}]",
        '{"@type":"Organization"}',
        "{broken",
        FULL.replace('"Data Analyst"', "7"),
        FULL.replace('"Mutare"', "null"),
    ]
    rows = listed(spark, registry, "jsonld", *[POSTING % v for v in variants])
    found = {r.page_id: (r.title, r.company, r.location, r.category) for r in rows}
    placeholder = (
        "Jobs Available - Visit ZimboJobs.com",
        "Various Employers",
        "Zimbabwe",
        "General",
    )
    assert len(rows) == len(variants)
    assert found[0] == ("Data Analyst", "Acme Ltd", "Mutare", "IT & Technology")
    assert found[1][1] == "ZimboJobs Employer"
    assert [found[i] for i in (2, 3, 4, 5, 6)] == [placeholder] * 5
    assert found[7][2] == "N/A"


def test_generic_elements(spark, registry):
    page = "<div class='card'>Great job offer\nApply by mail today\nThird</div><li>work\nshort</li>"
    (row,) = listed(spark, registry, "jsonld", page)
    assert (row.title, row.description) == ("Great job offer", "Great job offer Apply by mail today Third")


def test_candidates(spark, registry):
    details = [("https://vacancybox.co.zw/job/5", "noreply@x.com then vacancies@x.com")]
    rows = listed(spark, registry, "candidates", CANDIDATES, details=details)
    assert [(r.pos, r.title, r.company, r.location, r.expiry_text, r.apply_email) for r in rows] == [
        (1, "Legal Officer", "Acme Ltd", "Harare", "Expires January 19, 1998", "vacancies@x.com"),
        (2, "Farm Hand", "Green Farm", "Zimbabwe", "N/A", "Apply on VacancyBox"),
    ]
    assert rows[0].category == "Legal"


def test_candidates_are_limited_on_request_only(spark, registry):
    page = "".join(f"<article><a href='/job/{i}'>Post number {i}</a></article>" for i in range(60))
    details = [(f"https://vacancybox.co.zw/job/{i}", f"p{i}@x.com") for i in range(60)]
    rows = listed(spark, registry, "candidates", page, details=details)
    assert [r.pos for r in rows] == list(range(1, 61)) and all("@" in r.apply_email for r in rows)
    rows = listed(spark, Registry(builtin_profiles(fixed.LIMITS)), "candidates", page, details=details)
    assert [r.pos for r in rows] == list(range(1, 51)) and sum("@" in r.apply_email for r in rows) == 5


def test_link_fallback(spark, registry):
    # the two-letter title is no candidate, so the page falls back to its job links
    rows = listed(spark, registry, "candidates", "<div><a href='/job/6'>QA</a></div>")
    assert [(r.title, r.company, r.expiry_text) for r in rows] == [("QA", "VacancyBox Employer", "N/A")]


def test_link_detail(spark, registry):
    url = "https://www.recruitmentmattersafrica.com/careers/job/8"
    (row,) = listed(spark, registry, "link_detail", LINKS, details=[(url, DETAIL)])
    assert (row.title, row.company, row.location) == ("Civil Engineer", "Acme Ltd", "Mutare")
    assert (row.expiry_text, row.description) == ("Expires January 19, 1998", "Roads and bridges.")
    assert (row.apply_email, row.job_url) == ("hr@acme.example", url)
    assert listed(spark, registry, "link_detail", LINKS) == []


def test_link_passes(spark, registry):
    link = '{"@type":"JobPosting","sameAs":"/x/1","title":"One"}'
    pages = [
        POSTING % link,
        POSTING % f"[{link}, 3, {link.replace('/x/1', '/x/2')}]",
        "<a href='/about/job-board'>Long enough one</a><a href='/z'>z</a>",
        "<div id='post-1'><p><b><a href='/deep'>x</a></b></p></div><p><b><i><a href='/deeper'>x</a></i></b></p>",
    ]
    table = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    harvested = X.harvest_links(F.col("nodes"), {"base_url": "https://h.example/"})
    rows = {r.page_id: [tuple(a) for a in r.links] for r in shred(table).select("page_id", harvested.alias("links")).collect()}
    assert rows[0] == [("https://h.example/x/1", "One")]
    assert rows[1] == [("https://h.example/x/1", "One"), ("https://h.example/x/2", "One")]
    assert rows[2] == [("https://h.example/about/job-board", "Long enough one")]
    assert rows[3] == [("https://h.example/deep", "x")]


def test_quarantine(spark, registry):
    pages = spark.createDataFrame(
        [(0, "u0", LINKS), (1, "u1", LINKS + "<a href='/jobs/9'>Nine</a>")],
        "page_id long, url string, html string",
    )
    (row,) = L.quarantine(pages, registry["link_detail"]).collect()
    assert (row.page_id, row.n_links, row.html) == (0, 1, LINKS)


def test_alt_cards(spark, registry):
    rows = listed(spark, registry, "cards_alt", ALT)
    assert [(r.title, r.company, r.location, r.description) for r in rows] == [
        ("Tester", "Acme", "Harare", "See full description on Indeed"),
        ("Nurse", "Ward", "Zimbabwe", "Nights"),
    ]


def test_all_sites_in_one_plan(spark, registry):
    pages = [("cards", CARDS), ("headings", HEADINGS), ("jsonld", POSTING % FULL), ("candidates", CANDIDATES), ("link_detail", LINKS)]
    table = spark.createDataFrame(
        [(i, s, 1, h) for i, (s, h) in enumerate(pages)],
        "page_id long, site string, page_num int, html string",
    )
    url = "https://www.recruitmentmattersafrica.com/careers/job/8"
    details = spark.createDataFrame([(url, DETAIL)], "url string, html string")
    run = L.run(table, details, AS_OF, registry)
    counts = {r.source_site: r["count"] for r in run.groupBy("source_site").count().collect()}
    assert counts == {
        "VacancyMail": 1,
        "Jobs Zimbabwe": 1,
        "ZimboJobs": 1,
        "VacancyBox": 2,
        "RecruitmentMatters": 1,
    }
    plan = run._jdf.queryExecution().executedPlan().toString()
    # the pages were read when the listings were stored; the details are read once, after the filter on their URLs
    assert plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython") == 1


def test_page_counts(spark, registry):
    pages = {
        "cards": CARDS,
        "headings": "<a href='/page/4/'>x</a><a href='#'>3</a><p>Page 1,2</p>",
        "jsonld": "<a href='?page=44'>x</a>",
        "candidates": "<p>see page 7 of the list</p>" + "x" * 80 + " 55 " + "y" * 80,
        "link_detail": "<a href='?paged=6'>x</a>",
        "cards_alt": "<div class='np'><a>9</a></div><a>12</a>",
    }
    expected = {"cards": 7, "headings": 12, "jsonld": 44, "candidates": 7, "link_detail": 6, "cards_alt": 9}
    for name, html in pages.items():
        table = spark.createDataFrame([(1, html)], "page_id long, html string")
        assert L.max_page(table, registry[name]).first().total_pages == expected[name], name
    table = spark.createDataFrame([(1, CARDS)], "page_id long, html string")
    urls = [r.url for r in L.frontier(table, registry["cards"]).collect()]
    assert urls[0] == "https://vacancymail.co.zw/jobs/?ordering=later&page=2" and len(urls) == 6

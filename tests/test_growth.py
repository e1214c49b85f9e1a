"""What must not grow faster than the input: repeats that meet, pages that are read whole, columns that are read again."""

import random

import pytest
from pyspark.sql import functions as F

from gleanspark.catalog import rendered
from gleanspark.functions import dates, emails, urls
from gleanspark.operators import classify, keywords, nodes, places
from gleanspark.operators.shredder import NodeReader
from gleanspark.plans import listings as L
from gleanspark.plans.profiles import Registry
from gleanspark.sources.stored import stored

CARD = '<a class="big job-listing" href="/jobs/{n}"><h3 class="job-listing-title">Nurse</h3><div class="job-listing-footer"><ul><li>' \
    '<i class="icon-material-outline-access-time"></i> {date}</li></ul></div></a>'


@pytest.mark.parametrize("whole_word", [True, False])
def test_repeated_places_meet_a_text_once(spark, monkeypatch, whole_word):
    seen = []
    if whole_word:
        search = places._whole_names
        monkeypatch.setattr(places, "_whole_names", lambda texts, names: seen.append(names.count()) or search(texts, names))
    else:
        search = keywords.search
        monkeypatch.setattr(keywords, "search", lambda texts, rules, *more: seen.append(rules.count()) or search(texts, rules, *more))
    table = spark.range(600).selectExpr("600 - id AS position", "concat(CASE id % 2 WHEN 0 THEN 'Bay ' ELSE 'BAY ' END, id % 3) AS place")
    texts = spark.createDataFrame([(1, "at bay 2, bay 1"), (2, "nowhere"), (None, None)], "k int, text string")
    got = places.place_by_table(texts, table, "k", whole_word=whole_word).collect()
    assert seen == [3]
    # names by position from the end: 599 is "BAY 2", 598 "Bay 1"
    assert {r.k: r.place for r in got} == {1: "BAY 2", 2: None, None: None} and len(got) == 3


class Parsed(NodeReader):
    def _read_plain(self, html):
        return False


def _both(html):
    found = []
    for reader in (NodeReader(), Parsed()):
        reader.read(html)
        found.append((reader.arrow().to_pylist(), reader.errors))
    return found


def test_plain_markup_is_read_as_the_parser_reads_it():
    bits = ['<a href="/x">', "</a>", "<p>", "</p>", '<div class="a b">', "</div>", "<br>", "text", "  ", " \n", "&amp;", "&#1;", "& ", "<!--c-->",
            "<!DOCTYPE html>", '<script type="x">', "</script>", '{"a":1}', "<title>", "</title>", "<li>", "</li>", "<", ">", "<pre>", "</pre>",
            "<a b=c>", "</br>", "<BR>", '<a b="1" b="2">', '<a b="">', "<style>", "</style>", "&copy", "<br/>", "<p >", '<b\n x="1">', "<template>", "é"]
    pick = random.Random(7)
    for n in range(4000):
        one, other = _both("".join(pick.choice(bits[:22] if n % 2 else bits) for _ in range(pick.randint(0, 12))))
        assert one == other


def test_cards_and_scripts_are_plain_markup():
    for html, plain in ((CARD, True), ('<!DOCTYPE html><title>a &amp; b</title><script type="x">{"a": "&amp;"}</script> t', True), ("<pre> </pre>", False), ("a<b", False)):
        reader = NodeReader()
        reader.reset()
        reader.start = 0
        assert reader._read_plain(html) is plain


def test_stored_rows_are_read_by_column(spark):
    found = stored(spark.range(5).selectExpr("id AS a", "concat('x', id) AS b", "named_struct('c', id) AS s"))
    assert "ReadSchema: struct<a:bigint>" in found.select("a")._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.select("a", "b", "s.c").collect())) == [(i, f"x{i}", i) for i in range(5)]


def test_rendered_pages_keep_their_parts(spark):
    for df in (rendered.listing_pages(spark, "/root/testdata/sf0.001", "cards"), rendered.detail_pages(spark, "/root/testdata/sf0.001", "cards"),
               rendered.paging_pages(spark, "/root/testdata/sf0.001", "cards")):
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_only_current_cards_are_read_whole(spark):
    html = "".join(CARD.format(n=n, date=f"Expires {d}") for n, d in enumerate(["1 Jan 1990", "1 Jan 2030", "soon", "2 Jan 2030"]))
    shredded = nodes.shred(spark.createDataFrame([(1, "cards", 1, html)], "page_id int, site string, page_num int, html string"))
    profile = Registry()["cards"]
    assert [r.pos for r in L.listings(shredded, [profile], "2000-01-01").collect()] == [2, 4]
    assert [r.pos for r in L.listings(shredded, [profile]).collect()] == [1, 2, 3, 4]
    lenient = Registry()["cards_lenient"].with_(name="cards")
    assert [r.pos for r in L.listings(shredded, [lenient], "2000-01-01").collect()] == [2, 3, 4]
    # a profile with rows of its own is not read by those of another
    assert profile.with_(rows=profile.rows).current_rows is None


def test_held_numbers_are_looked_up_once_each(spark):
    pages = spark.createDataFrame([(i, '<ul class="pagination"><a href="?page=5">5</a></ul>') for i in (1, 2, None)], "page_id int, html string")
    profile = Registry()["cards"]
    held = spark.createDataFrame([(profile.base_url + "&page=3#x",), (None,), (profile.base_url + "&page=99",)], "url string")
    found = L.frontier(pages, profile, held)
    assert "Range (2" in found._jdf.queryExecution().toString()
    got = sorted(((r.page_id or 0), r.page_num, r.url) for r in found.collect())
    assert got == [(i, n, f"{profile.base_url}&page={n}") for i in (0, 1, 2) for n in (2, 4, 5)]


def test_addresses_without_their_sign_are_not_sought(spark):
    df = spark.createDataFrame([("a@b.example",), ("x [AT] y [DOT] example",), ("no address",), (None,)], "t string")
    got = df.select(emails.first_email(F.col("t")), emails.all_emails(F.col("t")), emails.link_or_text_email(F.array().cast("array<string>"), F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("a@b.example", ["a@b.example"] * 2, "a@b.example"), (None, ["x [AT] y [DOT] example"], "x[at]y[dot]example"), (None, [], None), (None, None, None)]


def test_plain_paths_follow_the_host(spark, monkeypatch):
    base = "HTTPS://Host.example/a/b?x=1"
    given = ["/", "/j/1", "/j//1/", "/j/1\n", "//other/x", "/./a", "/a/../b", "/.x", "/a.b/c.d", "/a?b=1", "/a#b", "/a/.", "/é x", "j/1", "", "mailto:x"]
    rows = spark.createDataFrame([(x, base) for x in given], "h string, b string")
    got = rows.select("h", urls.resolve_url(base, F.col("h")).alias("one"), urls.resolve_url(F.col("b"), F.col("h")).alias("other")).collect()
    assert all(r.one == r.other for r in got)
    assert [r.one for r in got][:6] == ["https://Host.example" + x for x in ("/", "/j/1", "/j//1/", "/j/1\n")] + ["https://other/x", "https://Host.example/a"]
    slow = spark.createDataFrame([(x,) for x in given], "h string").select("h", urls._join_path(F.lit("/a/b"), F.col("h")).alias("p")).collect()
    plain = [x for x in given if x.startswith("/") and not any(c in x for c in "?#") and not x.startswith("//")]
    assert {r.h: "https://Host.example" + r.p for r in slow if r.h in plain} == {r.h: r.one for r in got if r.h in plain}
    # such a path is not taken apart: it is there where taking apart fails
    monkeypatch.setattr(urls, "_join_path", lambda *_: F.raise_error(F.lit("taken apart")).cast("string"))
    assert spark.createDataFrame([("/j/1",)], "h string").select(urls.resolve_url(base, F.col("h"))).first()[0] == "https://Host.example/j/1"


def test_a_search_is_made_once(spark, monkeypatch):
    """Reading a date or an address does not search a text a second time to tell whether something was found."""
    searches = []
    search, replace = F.regexp_extract, F.regexp_replace
    monkeypatch.setattr(F, "regexp_extract", lambda *a: searches.append(a) or search(*a))
    df = spark.createDataFrame([("May 5, 2001",), ("June 31, 2001",), ("May 5, 0000",), ("june 3 1970",), ("Jun 3 1970",), ("soon",), (None,)], "t string")
    found = df.select(dates.month_day_year(F.col("t"), full_names_only=True).alias("d"))
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.lower().count("regexp_extract(") == len(searches) == 3
    assert [r.d and str(r.d) for r in found.collect()] == ["2001-05-05", None, None, "1970-06-03", None, None, None]
    monkeypatch.setattr(F, "regexp_replace", lambda *a: searches.append(a) or replace(*a))
    searches.clear()
    links = spark.createDataFrame([("MAILTO: A@b.example ?x",), ("mailto:noreply@b.example",), ("mailto:",), ("/a",), (None,)], "h string")
    found = links.select(emails.mailto_address(F.col("h")).alias("e"))
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_replace(") == len(searches) == 1
    assert [r.e for r in found.collect()] == ["a@b.example", None, None, None, None]


def test_scores_are_summed_for_categories_with_a_hit_only(spark):
    """The points of a category are added up where one of its rules applies, and not for all others."""
    rules = [classify.Rule(f"c{i}", i, "primary", f"word{i}") for i in range(40)]
    scores = classify.category_scores(F.lit("word3 and word7"), F.lit("word3"), F.lit(""), rules)
    df = spark.range(1).select(scores.alias("s"))
    assert [(r.category, r.score) for r in df.first().s] == [("c3", 10), ("c7", 10)]
    assert "exists(" in df._jdf.queryExecution().analyzed().toString()


def test_items_of_rendered_pages_are_collected_once(spark):
    """Pages of several layouts come from one aggregation, and each page is as it is alone."""
    names = ["cards", "headings", "jsonld", "candidates", "link_detail"]
    together = rendered.listing_pages(spark, "/root/testdata/sf0.001", *names)
    assert together._jdf.queryExecution().optimizedPlan().toString().count("collect_list(") == 1
    for name in names:
        alone = rendered.listing_pages(spark, "/root/testdata/sf0.001", name)
        assert sorted(map(tuple, together.where(F.col("site") == name).collect())) == sorted(map(tuple, alone.collect()))

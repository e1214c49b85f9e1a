"""Nodes, selection and text of single pages, with awkward markup."""

import re

from pyspark.sql import functions as F

from gleanspark.operators import nodes as N
from gleanspark.operators.extract import candidate_nodes

col = F.col


def read(spark, html, *columns):
    table = spark.createDataFrame([(1, html)], "page_id long, html string")
    return tuple(N.shred(table).select(*columns).first())


def tags(spark, html):
    (found,) = read(spark, html, F.transform("nodes", lambda n: F.struct(n["tag"], n["depth"], n["text"])))
    return [tuple(n) for n in found]


def test_nesting(spark):
    # no implied end tags; an end tag closes the nearest open tag, or nothing
    assert tags(spark, "<p>a<p>b</i></p>c<br>d<x/>e") == [
        ("#document", 0, None),
        ("p", 1, None),
        ("#text", 2, "a"),
        ("p", 2, None),
        ("#text", 3, "b"),
        ("#text", 2, "c"),
        ("br", 2, None),
        ("#text", 2, "d"),
        ("x", 2, None),
        ("#text", 2, "e"),
    ]


def test_text_kinds(spark):
    html = "<script>var t='</p>';</script><style>p{}</style>a&amp;b<!-- no -->c \n <pre> \n </pre>  <b> </b>"
    texts = [n for n in tags(spark, html) if n[2] is not None]
    assert [(t, x) for t, _, x in texts] == [
        ("#script", "var t='</p>';"),
        ("#style", "p{}"),
        ("#text", "a&b"),
        ("#text", "c \n "),
        ("#text", " \n "),
        ("#text", " "),
        ("#text", " "),
    ]


def test_attributes(spark):
    html = "<a HREF='/x' class='big\n job' class=second data-y href=\"&lt;\">t</a>"
    (found,) = read(spark, html, F.transform(N.select(col("nodes"), "a"), lambda n: n["attrs"]))
    assert found == [{"href": "<", "class": "second", "data-y": ""}]


def test_unreadable_pages(spark):
    rows = [(1, None), (2, ""), (3, "<p>x")]
    table = spark.createDataFrame(rows, "page_id long, html string")
    got = N.shred(table).select("page_id", F.size("nodes"), "parse_error").collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, "no html"), (2, 1, None), (3, 3, None)]


def test_intervals(spark):
    """Subtree slices, parents and depths agree with a walk over the parents."""
    html = "<a><b>1<c></c></b><d>2<e><f>3</f></e></d></a><g>4</g>" * 3
    (found,) = read(
        spark, html, F.transform("nodes", lambda n: F.struct(n, N.descendants(col("nodes"), n).alias("d")))
    )
    parents = {n[0].pre: n[0].parent for n in found}

    def above(pre):
        while (pre := parents[pre]) >= 0:
            yield pre

    for node, below in found:
        assert [d.pre for d in below] == [p for p in parents if node.pre in above(p)]
        assert node.depth == len(list(above(node.pre)))


def test_batches_are_cut(spark):
    """Pages larger than one output batch keep their rows and columns together."""
    rows = [(i, "<p>x</p>" * (60_000 if i % 2 else 3)) for i in range(6)]
    table = spark.createDataFrame(rows, "page_id long, html string").coalesce(1)
    got = N.shred(table).select("page_id", F.size(N.select(col("nodes"), "p"))).collect()
    assert [tuple(r) for r in got] == [(i, 60_000 if i % 2 else 3) for i in range(6)]


def test_text(spark):
    html = "<div> a <b>b</b>\n<i> </i>c </div>"
    div = F.get(N.select(col("nodes"), "div"), 0)
    got = read(
        spark,
        html,
        N.raw_text(col("nodes"), div),
        N.trimmed_text(col("nodes"), div),
        N.joined_text(col("nodes"), div, "|"),
        N.page_text(col("nodes"), "/"),
        N.joined_text(col("nodes"), F.get(N.select(col("nodes"), "h1"), 0)),
    )
    assert got == (" a b\n c ", "a b\n c", "a|b|c", " a /b/\n/ /c ", None)


def test_selection(spark):
    html = (
        "<ul class=jobs><li>1</li><li class='x job'>2</li></ul><li>3</li><div class='row job'>4</div>"
        "<div class=jobs>5</div><div itemtype='http://s/JobPosting'>6</div><article>7</article><div class=post>8</div>"
        "<a href='/JOBS/9'>9</a>"
    )
    (found,) = read(spark, html, F.transform(candidate_nodes(col("nodes")), lambda n: N.joined_text(col("nodes"), n)))
    everything = re.sub("<[^>]*>", "", html)
    assert found == ["7", "4", "2", "1", "2", "4", "8", "6", everything]


def test_ancestors(spark):
    html = "<li id=o>x<div class='Search-Box'><span><p><i>y</i></p></span></div></li>"
    i = F.get(N.select(col("nodes"), "i"), 0)
    got = read(
        spark,
        html,
        N.ancestor(col("nodes"), i, "li")["attrs"]["id"],
        N.ancestor(col("nodes"), i, "ul")["tag"],
        N.ancestor_hint(col("nodes"), i, "search"),
        N.ancestor_hint(col("nodes"), N.parent(col("nodes"), N.parent(col("nodes"), N.parent(col("nodes"), i))), "search|box"),
    )
    assert got == ("o", None, True, False)


def test_meta(spark):
    html = "<meta name=author content=A><meta property='og:site_name' content=' P '>"
    names = [("property", "og:site_name"), ("name", "author")]
    assert read(spark, html, N.meta_content(col("nodes"), names)) == (" P ",)
    assert read(spark, html[:31], N.meta_content(col("nodes"), names)) == ("A",)

"""CSS selectors given as strings."""

import pytest
from pyspark.sql import functions as F

from gleanspark import fixed
from gleanspark.operators import css
from gleanspark.operators import nodes as N

PAGE = """<html><body id="top"><ul class="jobs x"><li class="job a">1</li><li>2<ul><li id="in">3</li></ul></li></ul>
<div class="row job" data-kind="a-b"><p>4</p><div><p class="p q">5</p></div></div><li class="jobs">6</li>
<div itemtype="http://schema.org/JobPosting" title=""><span><p>7</p></span></div><article><a href="/X.PDF">8</a><a>9</a></article></body></html>"""


@pytest.fixture(scope="module")
def shredded(spark):
    return N.shred(spark.createDataFrame([(PAGE,)], "html string")).cache()


def texts(df, selector):
    found = F.transform(css.select_css(F.col("nodes"), selector), lambda n: N.joined_text(F.col("nodes"), n))
    return df.select(found.alias("t")).first().t


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("li", ["1", "23", "3", "6"]),
        ("ul.jobs li", ["1", "23", "3"]),
        ("ul.jobs > li", ["1", "23"]),
        ("li.job", ["1"]),
        ("div.row.job", ["45"]),
        ("div p", ["4", "5", "7"]),
        ("div > p", ["4", "5"]),
        ("div.row > div > p.q", ["5"]),
        ("body > div span p", ["7"]),
        ("div div p, article a", ["5", "8", "9"]),
        ("#in", ["3"]),
        ("li#in, li", ["1", "23", "3", "6"]),
        ("[href]", ["8"]),
        ("a[href$='.PDF']", ["8"]),
        ("a[href$='.pdf']", []),
        ("a[href$='.pdf' i]", ["8"]),
        ("div[itemtype*='JobPosting']", ["7"]),
        ('div[data-kind|="a"]', ["45"]),
        ("div[data-kind^=a]", ["45"]),
        ("[class~='x']", ["123"]),
        ("[title*='']", []),
        ("[title='']", ["7"]),
        ("body#top > * > a", ["8", "9"]),
        ("ul ul li", ["3"]),
        ("ul > ul > li", []),
    ],
)
def test_selectors(shredded, selector, want):
    assert texts(shredded, selector) == want


@pytest.mark.parametrize("selector", ["", "li,", ", li", "> li", "li >", "li + li", "li ~ li", "li:first-child", "li[", "ul > > li"])
def test_what_is_not_supported_is_refused(selector):
    with pytest.raises(ValueError, match="selector"):
        css.parse(selector)


def test_built_in_selectors(shredded):
    found = [texts(shredded, s) for s in fixed.CANDIDATE_SELECTORS]
    assert found == [["89"], [], ["45"], ["1"], [], [], ["1", "23", "3"], ["45"], [], ["7"]]

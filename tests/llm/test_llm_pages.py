"""Main text of pages."""

import html as entities
import re

from plain import tables

from gleanspark.llm import html_text, queries

FOLDER = "/root/testdata/sf0.001"

CASES = {
    "": "",
    "plain text": "plain text",
    '<div class="menu">m</div><div id=x><p>One.<p>Two <b>bold</b> text&amp;<br>more<div class="comments"><p>c</div></div><aside>a</aside>': "One.\n\nTwo bold text& more",
    '<header>H</header><nav>n<article><h1>T</h1><p>Para <span class="ad">x <b>y</b></span>here</p><section class="reader-comments"><article class="comment"><p>bad</article></section></article><footer>f': "T\n\nPara here",
    '<body><div class="cookie-notice">We use</div><main><article><header><h1>Title</h1></header><p>A&nbsp;b &lt;c&gt;<ul><li>i1<li>i2</ul><table><tr><td>a<td>b<tr><td>c</table><form><input>q</form></article></main><script>x</script><style>y</style>': "Title\n\nA b <c>\n\ni1\n\ni2\n\na b\n\nc",
    '<p>unclosed <script>alert("<p>")': "unclosed",
    "<title>t</title><p>x": "x",
    '<div id="sideBar">s</div><div class="post-header"><h1>Head</h1></div><div class="story"><p>text of the story</p></div><div style="display: none">h</div><p hidden>h</p>': "Head\n\ntext of the story",
    "<!-- c --><article><p>a  \n b</p></article>": "a b",
}


def test_cases():
    for page, text in CASES.items():
        assert html_text.main_text(page) == text, page


def test_lines_choose_sections():
    """Long lines beside articles and short parts of a split article stay; lines far below the others go."""
    one, two = "first " * 60, "second " * 40
    page = f"<main><p>Intro.</p><article><p>{one}</p></article><section><p>After.</p></section></main>"
    assert html_text.main_text(page) == f"Intro.\n\n{one.strip()}\n\nAfter."
    links = "".join(f"<li><a href=x><b>l{n}</b></a>" for n in range(20))
    page = f"<div><ul>{links}</ul></div><article><p>{one}</p></article><div><p>{two}</p></div>"
    text = html_text.main_text(page)
    assert text.endswith(f"{one.strip()}\n\n{two.strip()}") and "l3" not in text
    paragraph = "<p>" + "words " * 50 + "</p>"
    page = f"<div><ul>{links}</ul></div><div>{paragraph * 7}</div><div>{paragraph}</div>"
    assert html_text.main_text(page).count("words") == 400 and "l3" not in html_text.main_text(page)


def test_marks_speak_of_the_part_itself():
    """Words about the layout, beside a name of the article, or on what holds most of the text leave nothing out."""
    text = "words of the text " * 20
    for name in ("post no-sidebar", "content with-sidebar", "entry-content share", "has-sidebar"):
        assert html_text.main_text(f'<div class="{name}"><p>{text}</p></div>') == text.strip(), name
    assert html_text.main_text(f'<h2>Title</h2><section id="discussion"><p>{text}</p><nav>n</nav></section>').endswith(text.strip())
    assert html_text.main_text(f'<article><p>Short.</p></article><section id="discussion"><p>{text}</p></section>') == "Short."
    assert html_text.main_text(f'<div class="story"><p>{text}</p></div><div class="post-comments"><p>c</p></div>') == text.strip()
    assert html_text.main_text('<p>Text.</p><div class="menu">' + "<li><a href=x>link</a>" * 9 + "</div>") == "Text."


def test_long_and_deep_pages():
    assert html_text.main_text("<article>" + "<p>word</p>" * 5000 + "</article>").count("word") == 5000
    assert html_text.main_text("<div>" * 3000 + "<article><p>deep</p>") == "deep"


def test_rows(spark):
    """Null and empty pages, repeated rows and clashing columns."""
    rows = [(1, "u", "<article><p>é</p></article>", "t"), (1, "u", "<article><p>é</p></article>", "t"), (2, None, None, "t"), (None, "v", "", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in html_text.extract(df).collect()), key=str)
    assert got == [(1, "u", "é", 1), (1, "u", "é", 1), (2, None, "", 0), (None, "v", "", 0)]
    assert html_text.extract(df.limit(0)).collect() == []


def test_query_over_pages(spark):
    """The pages of the test data have one article each, whose blocks are known."""
    (pages,) = tables(spark, FOLDER, "pages")
    got = {r.page_id: r for r in queries.op2_html(spark, FOLDER).collect()}
    for page_id, url, page in pages.select("page_id", "url", "html").collect():
        found = re.search(r"<article>(.*)</article>|<article>(.*?)<footer>", page, re.S)
        blocks = re.split(r"<p>|</p>|</?h1>", found[1] or found[2])
        blocks = [" ".join(entities.unescape(re.sub(r"<br>", " ", re.sub(r"<(?!br>)[^>]*>", "", b))).split()) for b in blocks]
        text = "\n\n".join(b for b in blocks if b)
        assert tuple(got[page_id])[:4] == (page_id, url, text, len(text))

"""Main text of HTML pages from a streaming parser's events and the text-to-tag ratio of their lines.

The standard library's parser reports tags and text; every block of a page becomes a line with its text, its number of
tags and the section it stands in. The ratios of text to tags are smoothed by a Gaussian, lines above the deviation of
all ratios are the content cluster, and the sections that hold this cluster are kept whole, so that a short
paragraph between long ones stays; so is what the page itself marks as article or main. Menus, notices, adverts and the like are left out by what their elements say of themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleanspark.llm.common import slices

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody tfoot thead title tr ul caption".split()
)
_SECTIONS = frozenset("article body div html main section table td blockquote center".split())
_DROPPED = frozenset(
    "applet aside audio button canvas datalist dialog embed footer form frameset head iframe map menu nav noscript object option script select style svg "
    "template textarea title video".split()
)
_BROKEN = frozenset(("nav", "header", "footer", "aside", "menu"))  # left open by mistake, an article ends them
#: Words in class, id or role that mark a part as no article text, unless it is named as the article; the second set counts unless any word
#: speaks of the article.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr popup "
    "modal overlay newsletter subscribe subscription signup sidebar rail menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments "
    "commentlist reply replies discussion disqus respond responses share sharing social related recommended recommendations pagination pager copyright login paywall "
    "contentinfo complementary".split()
)
_WEAK_MARKS = frozenset("header banner notice notices side form alert widget search toolbar topbar skip disclaimer".split())
_ARTICLE = frozenset("article post entry story content main body text".split())
#: Names like no-sidebar and with-sidebar tell the layout around a part, not what the part is.
_LAYOUT = frozenset("no not with without has hide".split())
_WORD = re.compile("[a-z]+|[A-Z][a-z]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Lines(HTMLParser):
    """Collects lines (text, tags, section) of one page, without the parts that are left out."""

    def __init__(self, allowed: frozenset[int] = frozenset()) -> None:
        """allowed: elements, by the number of their start tag, that stay whatever words mark them."""
        super().__init__(convert_charrefs=True)
        self.allowed, self.started = allowed, 0
        self.aside: dict[int, int] = {}  # characters, without links, of each element that is left out by a word
        self.lines: list[tuple[str, int, int]] = []
        self.sections: list[tuple[int, str]] = [(-1, "html")]  # parent, tag
        self.open: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, left out (by the word of that element, or -1), section
        self.heads: set[int] = set()  # lines that are headings of the first rank
        self.words: list[str] = []
        self.tags = 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not used

    def _end_line(self) -> None:
        text = " ".join("".join(self.words).split()) if self.words else ""
        if text:
            if any(x[0] == "h1" for x in self.open[-3:]):
                self.heads.add(len(self.lines))
            self.lines.append((text, self.tags, self.open[-1][2]))
            self.tags = 0
        self.words = []

    def _close(self, at: int) -> None:
        self._end_line()
        del self.open[at:]

    def _ends(self, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        """An element of these tags that is still open ends here, unless one of within was opened in it."""
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] in tags:
                return self._close(at)
            if self.open[at][0] in within:
                return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        self.started += 1
        if tag not in _BLOCKS:
            if tag in _VOID or tag == "td" or tag == "th":
                self.words.append(" ")
                return
        else:
            self._end_line()
            if tag == "li":
                self._ends(("li",), ("ul", "ol", "menu"))
            elif tag == "tr":
                self._ends(("tr",), ("table",))
            elif tag == "dt" or tag == "dd":
                self._ends(("dt", "dd"), ("dl",))
            self._ends(("p",), ("article", "section", "main", "div", "td", "li", "blockquote", "button"))
            if tag in _VOID:
                return
        _, out, section = self.open[-1]
        if out and (tag == "article" or tag == "main") and (broken := [n for n, x in enumerate(self.open) if x[1]]) and self.open[broken[0]][0] in _BROKEN:
            self._close(broken[0])
            _, out, section = self.open[-1]
        if out >= 0:
            if tag in _DROPPED or tag == "header" and not self._in_article(section):
                out = -1
            elif attrs and (marked := self._marked(tag, attrs)):
                if marked == "hidden":
                    out = -1
                elif not out and self.started not in self.allowed:
                    out = self.started
        if tag in _SECTIONS and not out:
            self.sections.append((section, tag))
            section = len(self.sections) - 1
        self.open.append((tag, out, section))

    def _in_article(self, section: int) -> bool:
        while section >= 0:
            section, tag = self.sections[section]
            if tag == "article" or tag == "main":
                return True
        return False

    @staticmethod
    def _marked(tag: str, attrs: list) -> str | None:
        """Whether the element is hidden, or words mark it as no article text."""
        if tag == "html" or tag == "body" or tag == "main":
            return None
        said: set[str] = set()
        article = False
        for name, value in attrs:
            if name == "hidden":
                return "hidden"
            if value and name in ("class", "id", "role"):
                for part in value.split():
                    found = [x.lower() for x in _WORD.findall(part)]
                    if found and found[0] not in _LAYOUT:
                        said.update(found)
                        article = article or _ARTICLE.issuperset(found)
            elif value and name == "style" and _HIDDEN.search(value):
                return "hidden"
        if article:
            return None
        return "word" if said & _MARKS or said & _WEAK_MARKS and not said & _ARTICLE else None

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _VOID or tag == "td" or tag == "th":
            return
        section = tag in _SECTIONS
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at][0]
            if name == tag:
                if tag in _BLOCKS:
                    self._end_line()
                del self.open[at:]
                return
            if name in _SECTIONS and not section:
                return  # an end tag without its start

    def handle_data(self, data: str) -> None:
        out = self.open[-1][1]
        if not out:
            self.words.append(data)
        elif out > 0 and not any(x[0] == "a" for x in self.open[-4:]):
            self.aside[out] = self.aside.get(out, 0) + len(data.strip())


def _smooth(ratio: np.ndarray, deviation: float) -> np.ndarray:
    reach = max(1, int(np.ceil(2 * deviation)))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * deviation**2))
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), "valid")


def main_text(html: str, deviation: float = 1.0, threshold: float = 1.0) -> str:
    """The article of one page, its blocks joined by an empty line."""
    allowed: frozenset[int] = frozenset()
    while True:
        parser = _Lines(allowed)
        parser.feed(html)
        parser.close()
        parser._end_line()
        # a marked element that holds most of the page's text, where the page names no article, is no part beside the text
        rest = sum(parser.aside.values()) + sum(len(text) for text, _, _ in parser.lines)
        most = max(parser.aside, key=parser.aside.get, default=0)
        if not most or 2 * parser.aside[most] <= rest or any(parser._in_article(section) for _, _, section in parser.lines):
            break
        allowed |= {most}
    lines, sections = parser.lines, parser.sections
    if not lines:
        return ""
    ratio = np.array([len(text) / max(tags, 1) for text, tags, _ in lines])
    smooth = _smooth(ratio, deviation)
    content = smooth >= threshold * smooth.std()
    # a section is kept whole where a line of the content cluster is so by itself, and where the page calls it article or main part;
    # of other sections, the lines that the cluster reaches
    whole = content & (ratio >= threshold * smooth.std())
    kept = [tag in ("article", "main") for _, tag in sections]
    for (_, _, section), chosen in zip(lines, whole, strict=True):
        kept[section] = kept[section] or bool(chosen)
    for n in range(1, len(sections)):
        kept[n] = kept[n] or kept[sections[n][0]]
    return "\n\n".join(text for k, (text, _, section) in enumerate(lines) if kept[section] or content[k] or k in parser.heads)


def extract(df: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Main text of every whole page: (key, *keep, text, n_chars), n_chars in code points.

    A null or empty page, and one without article text, has an empty text. Repeated rows are extracted each; other columns are not
    read. One map over the rows: a page is parsed where it lies and nothing is shuffled.
    """
    fields = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, begin in slices(batch, "html"):
                raw = data.tobytes()
                texts = [main_text(raw[a:b].decode()) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(fields)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*rows.schema.names[: len(fields)], "text", "n_chars"])

    names = [f"c{n}" for n in range(len(fields))]
    schema = ", ".join(f"{n} {df.schema[f].dataType.simpleString()}" for n, f in zip(names, fields, strict=True))
    found = df.select(*[df[f].alias(n) for n, f in zip(names, fields, strict=True)], df[html].alias("html")).mapInArrow(run, f"{schema}, text string, n_chars long")
    return found.toDF(*fields, "text", "n_chars")

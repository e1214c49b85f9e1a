"""The Python side of reading pages into what listings are made of. Runs in Arrow batches on the executors.

A page's nodes are looked through where they are made, so only the texts that an extractor asks for leave the worker, not the nodes.
Each function here finds what the extractor of that name in ``extract.py`` finds; dates, places and URLs are read from the texts later.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle

from .shredder import _NODES_PER_BATCH, OPAQUE_TAGS, TEXT, NodeReader, Page

# Ship this module inside the task, as the one that makes the nodes.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What is kept of an item of a page: the fields of a listing as far as they are known, what the item is, and the text to read others from.
PART = {
    "pos": pa.int32(),
    "title": pa.string(),
    "company": pa.string(),
    "location": pa.string(),
    "category": pa.string(),
    "expiry_text": pa.string(),
    "expiry_date": pa.date32(),
    "description": pa.string(),
    "job_url": pa.string(),
    "detail_url": pa.string(),
    "kind": pa.int32(),
    "text": pa.string(),
}
_GIVEN = ("pos", "title", "company", "location", "expiry_text", "description", "job_url", "kind", "text")
#: Kinds of items: a listing or one that may be one, a plain link, bits of a link that the first and the third pass take, a script.
LISTING, LINK, FIRST_PASS, THIRD_PASS, SCRIPT = 0, 1, 1, 2, 4

_OPAQUE = frozenset(f"#{tag}" for tag in OPAQUE_TAGS)
# what Java's \s and $ stand for
_BLANK, _AT_END = r"[ \t\n\x0b\f\r]", r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"
_LINE_END = re.compile("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
_TOKENS: dict[str, re.Pattern] = {}

Item = tuple


def _item(pos=None, title=None, company=None, location=None, expiry_text=None, description=None, job_url=None, kind=LISTING, text=None) -> Item:
    return pos, title, company, location, expiry_text, description, job_url, kind, text


def _attr(given, name: str) -> str | None:
    """An attribute's value, the last of several, or None where it is absent."""
    value = None
    for key, found in given:
        if key == name:
            value = found or ""
    return value


def _has_token(value: str | None, token: str) -> bool:
    if value == token:
        return True
    if value is None or token not in value:
        return False
    found = _TOKENS.get(token)
    if found is None:
        found = _TOKENS[token] = re.compile(rf"(?:^|{_BLANK}){re.escape(token)}(?:{_BLANK}|{_AT_END})")
    return found.search(value) is not None


def _first(page: Page, start: int, end: int, tag: str, fits: Callable | None = None) -> int | None:
    """The first node of that name from ``start`` up to before ``end`` whose attributes fit."""
    try:
        at = page.tags.index(tag, start, end)
        while fits is not None and not fits(page.attrs[at]):
            at = page.tags.index(tag, at + 1, end)
    except ValueError:
        return None
    return at


def _places(page: Page, tag: str) -> list[int]:
    return [i for i, name in enumerate(page.tags) if name == tag]


def _of_class(token: str) -> Callable:
    return lambda given: bool(given) and _has_token(_attr(given, "class"), token)


def _with_href(given) -> bool:
    return bool(given) and _attr(given, "href") is not None


def _strings(page: Page) -> list:
    """The page text of each node, None for all that is none."""
    if _OPAQUE.isdisjoint(page.tags):
        return page.texts
    return [text if tag == TEXT else None for tag, text in zip(page.tags, page.texts, strict=True)]


def _stripped(strings: list) -> list:
    return [text and text.strip() for text in strings]


def _joined(pieces: list, page: Page, node: int | None, sep: str = "") -> str | None:
    """The pieces below a node, which are stripped already, with ``sep`` between those that are not blank."""
    return None if node is None else sep.join(filter(None, pieces[node + 1 : page.ends[node] + 1]))


def _scripts(page: Page) -> list[str]:
    """Texts of the embedded JSON-LD scripts."""
    texts = []
    for node in _places(page, "script"):
        if _attr(page.attrs[node], "type") == "application/ld+json":
            inner = _first(page, node + 1, page.ends[node] + 1, "#script")
            if inner is not None:
                texts.append(page.texts[inner])
    return texts


_TITLE, _COMPANY, _TEXT, _FOOTER = map(_of_class, ("job-listing-title", "job-listing-company", "job-listing-text", "job-listing-footer"))
_TIME, _PLACE = map(_of_class, ("icon-material-outline-access-time", "icon-material-outline-location-on"))
_CARD = _of_class("job-listing")


def cards(page: Page, site: dict) -> list[Item]:
    tags, parents, ends, strings = page.tags, page.parents, page.ends, _strings(page)
    items = []

    def text(node: int | None) -> str | None:
        return None if node is None else "".join(filter(None, strings[node + 1 : ends[node] + 1])).strip()

    def beside(footer: int | None, fits: Callable) -> str | None:
        mark = None if footer is None else _first(page, footer + 1, ends[footer] + 1, "i", fits)
        if mark is None:
            return None
        at = parents[mark]
        while at >= 0 and tags[at] != "li":
            at = parents[at]
        return text(at) if at >= 0 else None

    for card in _places(page, "a"):
        if not _CARD(page.attrs[card]):
            continue
        start, end = card + 1, ends[card] + 1
        footer = _first(page, start, end, "div", _FOOTER)
        items.append(
            _item(
                pos=len(items) + 1,
                title=text(_first(page, start, end, "h3", _TITLE)),
                company=text(_first(page, start, end, "h4", _COMPANY)),
                location=beside(footer, _PLACE),
                expiry_text=beside(footer, _TIME),
                description=text(_first(page, start, end, "p", _TEXT)),
                job_url=_attr(page.attrs[card], "href") or None,
            )
        )
    return items


def headings(page: Page, site: dict) -> list[Item]:
    pieces, items, around = _stripped(_strings(page)), [], {}
    for pos, node in enumerate(_places(page, "h3"), start=1):
        title = _joined(pieces, page, node)
        if len(title) < 5:
            continue
        link, parent = _first(page, node + 1, page.ends[node] + 1, "a"), page.parents[node]
        if parent not in around:
            around[parent] = _joined(pieces, page, parent, " ")
        href = None if link is None else _attr(page.attrs[link], "href") or None
        items.append(_item(pos=pos, title=title, job_url=href, text=around[parent]))
    return items


def _compound_fits(tag: str | None, classes: list, attributes: list, name: str, given) -> bool:
    if name.startswith("#") if tag is None else name != tag:
        return False
    for token in classes:
        if not _has_token(_attr(given, "class"), token):
            return False
    for key, op, wanted, fold in attributes:
        value = _attr(given, key)
        if value is None:
            return False
        if op is None:
            continue
        if fold:
            value, wanted = value.lower(), wanted.lower()
        if op == "=":
            fits = value == wanted
        elif op == "|=":
            fits = value == wanted or value.startswith(f"{wanted}-")
        elif not wanted:
            fits = False
        elif op == "~=":
            fits = not re.search(r"\s", wanted) and _has_token(value, wanted)
        else:
            fits = {"^=": value.startswith, "$=": value.endswith, "*=": value.__contains__}[op](wanted)
        if not fits:
            return False
    return True


def _chain_fits(page: Page, node: int, chain: list, last: int) -> bool:
    """The node is what the ``last`` compound of the chain says, and above it is what those before it say."""
    combinator, *compound = chain[last]
    if not _compound_fits(*compound, page.tags[node], page.attrs[node]):
        return False
    if last == 0:
        return True
    at = page.parents[node]
    if combinator == ">":
        return at >= 0 and _chain_fits(page, at, chain, last - 1)
    while at >= 0:
        if _chain_fits(page, at, chain, last - 1):
            return True
        at = page.parents[at]
    return False


def _selected(page: Page, by_tag: dict, chains: list) -> list[int]:
    """Nodes that one of the chains of a selector names, in document order."""
    found = []
    for chain in chains:
        tag = chain[-1][1]
        among = range(len(page.tags)) if tag is None else by_tag.get(tag, ())
        found.extend(node for node in among if _chain_fits(page, node, chain, len(chain) - 1))
    return found if len(chains) == 1 else sorted(set(found))


def candidates(page: Page, site: dict) -> list[Item]:
    """Candidates, each text once, and, where it may be that none of them is kept, the plain job links."""
    pieces, items, seen, read, by_tag = _stripped(_strings(page)), [], set(), set(), {}
    for node, tag in enumerate(page.tags):
        by_tag.setdefault(tag, []).append(node)
    links = [(a, _attr(page.attrs[a], "href")) for a in by_tag.get("a", ()) if _with_href(page.attrs[a])]
    nodes = [node for chains in site["selectors"] for node in _selected(page, by_tag, chains)]
    for a, href in links:
        lowered = href.lower()
        if any(hint in lowered for hint in site["href_hints"]):
            nodes.append(page.parents[a])
    of_company = re.compile(site["company_class"], re.A)

    def in_company_class(given) -> bool:
        value = _attr(given, "class")
        return value is not None and of_company.search(value) is not None

    def company(node: int) -> str:
        start, end = node + 1, page.ends[node] + 1
        tag = _first(page, start, end, "small")
        if tag is None:
            tag = _first(page, start, end, "span", in_company_class)
        named = _joined(pieces, page, tag)
        if named:
            return named
        lines = [line for part in _LINE_END.split(_joined(pieces, page, node, "\n")) if (line := part.strip())]
        usable = len(lines) > 1 and len(lines[1]) < 120 and not lines[1].lower().startswith("posted")
        return lines[1] if usable else site["company"]

    for node in nodes:
        if node in seen:
            continue
        seen.add(node)
        text = _joined(pieces, page, node, " ")
        if text == "" or text in read:
            continue
        read.add(text)
        start, end = node + 1, page.ends[node] + 1
        link = _first(page, start, end, "a", _with_href)
        if link is not None:
            title, href = _joined(pieces, page, link, " "), _attr(page.attrs[link], "href").strip()
        else:
            heading = min((h for h in (_first(page, start, end, tag) for tag in ("h1", "h2", "h3", "h4")) if h is not None), default=None)
            title, href = _joined(pieces, page, heading, " "), None
            if title is None:
                title = text if site["title"] is None else text[: site["title"]]
        kept = len(title) >= 3
        items.append(_item(pos=len(items) + 1, title=title, company=company(node) if kept else None, job_url=href, text=text))
    # the first candidate is the first of its URL, so it is kept if its title is long enough
    if not items or len(items[0][1]) < 3 or site["rows"] == 0:
        for a, href in links:
            if "/job/" in href:
                items.append(_item(title=_joined(pieces, page, a), job_url=href, kind=LINK))
    return items


def harvested(page: Page, site: dict) -> list[Item]:
    """Links that the first or third pass takes, and, where the first may find none, the JSON-LD scripts."""
    pieces, items, surely = _stripped(_strings(page)), [], False

    def hinted(node: int) -> bool:
        for _ in range(3):
            node = page.parents[node]
            if node < 0:
                return False
            given = page.attrs[node]
            if given:
                label = " ".join(v for v in (_attr(given, "id"), _attr(given, "class")) if v is not None).lower()
                if any(hint in label for hint in site["ancestor_hints"]):
                    return True
        return False

    for node in _places(page, "a"):
        href = _attr(page.attrs[node], "href")
        if href is None:
            continue
        text = _joined(pieces, page, node, " ")
        low_href, low_text = href.lower(), text.lower()
        likely = (
            any(hint in low_href for hint in site["href_hints"])
            or any(hint in low_text for hint in site["text_hints"])
            or len(text) >= 25
            or hinted(node)
        )
        third = len(text) >= 12 and ("job" in low_href or "careers" in low_href or "vacancy" in low_text or "apply" in low_text)
        if likely or third:
            items.append(_item(title=text, job_url=href, kind=FIRST_PASS * likely + THIRD_PASS * third))
            surely = surely or likely and (href.startswith(("http://", "https://")) or href.startswith("/") and site["on_http"])
    if not surely:
        items.extend(_item(kind=SCRIPT, text=text) for text in _scripts(page))
    return items


def _parts(pages: list[list[Item] | None]) -> pa.ListArray:
    """The items of each page; null for a page that was not read this way."""
    ends, items = [0], []
    for found in pages:
        items.extend(found or ())
        ends.append(len(items))
    columns = dict(zip(_GIVEN, zip(*items, strict=True), strict=True)) if items else {}
    arrays = [pa.array(columns[name], kind) if name in columns else pa.nulls(len(items), kind) for name, kind in PART.items()]
    found = pa.StructArray.from_arrays(arrays, names=list(PART))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)


def listing_batches(readers: dict[str, tuple[Callable, dict]], with_nodes: bool) -> Callable:
    """Pages with their ``items``, by the reader of their ``site``; pages of other sites with their nodes, if those are asked for."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, whole = NodeReader(), NodeReader()
        for batch in batches:
            kept = batch.drop_columns(["html"])
            done, size, found = 0, 0, []
            for row, (site, html) in enumerate(zip(batch.column("site").to_pylist(), batch.column("html"), strict=True), start=1):
                reader = readers.get(site)
                if reader is not None:
                    page, error = own.page(html.as_py())
                    found.append([] if page is None else reader[0](page, reader[1]))
                    size += 0 if page is None else len(page.tags)
                    whole.skip(error)
                else:
                    found.append(None)
                    before = len(whole.pre)
                    whole.read(html.as_py() if with_nodes else None)
                    size += len(whole.pre) - before
                if size >= _NODES_PER_BATCH or row == batch.num_rows:
                    columns, names = [_parts(found)], ["items"]
                    if with_nodes:
                        columns, names = [*columns, whole.arrow()], [*names, "nodes"]
                    yield pa.RecordBatch.from_arrays([*kept.slice(done, row - done).columns, *columns], names=[*kept.schema.names, *names])
                    whole.clear()
                    done, size, found = row, 0, []

    return read


#: What contact finders and whole listings read of a detail page, by name.
VALUES = {name: pa.string() for name in ("text", "spaced", "lined", "heading", "meta", "content")} | {"hrefs": pa.list_(pa.string())}


def _value(page: Page, name: str, strings: list, site: dict):
    if name == "text":
        return "".join(filter(None, strings))
    if name in ("spaced", "lined"):
        return (" " if name == "spaced" else "\n").join([text for text in strings if text is not None])
    if name == "hrefs":
        found = (_attr(page.attrs[a], "href") for a in _places(page, "a"))
        return [href for href in found if href is not None]
    if name == "meta":
        for key, wanted in site["meta"]:
            node = _first(page, 1, len(page.tags), "meta", lambda given: _attr(given, key) == wanted)
            if node is not None:
                return _attr(page.attrs[node], "content")
        return None
    if name == "heading":
        node = next((i for i, tag in enumerate(page.tags) if tag in ("h1", "h2", "h3")), None)
        return _joined(_stripped(strings), page, node)

    def matching(key: str, pattern: str) -> Callable:
        wanted = re.compile(pattern, re.A)
        return lambda given: (value := _attr(given, key)) is not None and wanted.search(value) is not None

    node = _first(page, 1, len(page.tags), "div", matching("class", site["content_class"]))
    if node is None:
        node = _first(page, 1, len(page.tags), "article")
    if node is None:
        node = _first(page, 1, len(page.tags), "div", matching("id", site["content_id"]))
    return _joined(_stripped(strings), page, node, " ")


def detail_batches(needs: list[list[str]], site: dict) -> Callable:
    """Detail pages with the values that the finders named by the bits of ``_uses`` need, all finders where there is no such column."""
    names = list(dict.fromkeys(name for some in needs for name in some))

    def needed(uses: int | None) -> list[str]:
        return [n for n in names if uses is None or any(uses >> bit & 1 and n in some for bit, some in enumerate(needs))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = NodeReader(), {}
        for batch in batches:
            kept = batch.drop_columns(["html"])
            uses = kept.column("_uses").to_pylist() if "_uses" in kept.schema.names else [None] * batch.num_rows
            done, size, errors, columns = 0, 0, [], {name: [] for name in names}
            for row, (use, html) in enumerate(zip(uses, batch.column("html"), strict=True), start=1):
                page, error = reader.page(html.as_py())
                errors.append(error)
                if use not in known:
                    known[use] = needed(use)
                strings = None if page is None else _strings(page)
                for name, column in columns.items():
                    column.append(_value(page, name, strings, site) if page is not None and name in known[use] else None)
                size += 0 if page is None else len(page.tags)
                if size >= _NODES_PER_BATCH or row == batch.num_rows:
                    arrays = [pa.array(column, VALUES[name]) for name, column in columns.items()]
                    yield pa.RecordBatch.from_arrays(
                        [*kept.slice(done, row - done).columns, *arrays, pa.array(errors, pa.string())],
                        names=[*kept.schema.names, *[f"_{name}" for name in names], "parse_error"],
                    )
                    done, size, errors, columns = row, 0, [], {name: [] for name in names}

    return read

"""The Python side of ``shred``: one page in, its nodes out. Runs in Arrow batches on the executors."""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle

# Ship this module inside the task, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOCUMENT = "#document"
TEXT = "#text"

# Elements without an end tag, elements whose text is not page text, and elements
# that keep blank text as it is.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link"
    " menuitem meta nextid param source spacer track wbr".split()
)
OPAQUE_TAGS = frozenset(["script", "style", "template", "rt", "rp"])
KEEP_BLANK_TAGS = frozenset(["pre", "textarea"])
SPECIAL_TAGS = OPAQUE_TAGS | KEEP_BLANK_TAGS

_NODES_PER_BATCH = 100_000

# Plain markup: a tag with quoted attributes, or a declaration or comment without odd characters, up to the next ">".
_ATTRIBUTE = r'[ \n]+{}[a-z][a-z0-9:-]*{}="{}[^"&<>]*{}"'
_TAG = re.compile(rf"""(/?)([a-z][a-z0-9]*)((?:{_ATTRIBUTE.format("", "", "", "")})*)""")
_ASIDE = re.compile(r"!DOCTYPE html|!--[^<>-]*--")
_ATTRIBUTES = re.compile(_ATTRIBUTE.format("(", ")", "(", ")"))
# Elements that are plain only if their end tag follows their text, and elements that never are.
_WHOLE_TAGS = frozenset(["script", "style", "title"])
_ODD_TAGS = (SPECIAL_TAGS - _WHOLE_TAGS) | frozenset("iframe noembed noframes noscript plaintext xmp".split())
_START, _VOID, _END, _BESIDE = range(4)
_KNOWN: dict[str, tuple | None] = {}
_MOST_KNOWN, _LONGEST_KNOWN = 20_000, 200


def _read_tag(inner: str) -> tuple | None:
    """Kind, name and attributes of what is between "<" and ">"; None where it is not plain."""
    found = _TAG.fullmatch(inner)
    if not found:
        return (_BESIDE, None, ()) if _ASIDE.fullmatch(inner) else None
    slash, tag, given = found.groups()
    if slash:
        return None if given else (_END, tag, ())
    if tag in _ODD_TAGS:
        return None
    return (_VOID if tag in VOID_TAGS else _START, tag, tuple(_ATTRIBUTES.findall(given)) if given else ())


def _tag(inner: str) -> tuple | None:
    """As ``_read_tag``; the last tags are kept, since most tags of a site are alike."""
    entry = _read_tag(inner)
    if len(inner) <= _LONGEST_KNOWN:
        if len(_KNOWN) >= _MOST_KNOWN:
            _KNOWN.clear()
        _KNOWN[inner] = entry
    return entry


class Page:
    """The nodes of one page as lists: name, parent, last node below, attributes and text of each."""

    __slots__ = ("tags", "parents", "ends", "attrs", "texts")

    def __init__(self, tags: list, parents: list, ends: list, attrs: list, texts: list) -> None:
        self.tags, self.parents, self.ends, self.attrs, self.texts = tags, parents, ends, attrs, texts


def plain_page(html: str) -> Page | None:
    """The nodes of a page of plain markup, in a fraction of the parser's time; None where it holds anything else."""
    tags, parents, ends, attrs, texts = [DOCUMENT], [-1], [-1], [()], [None]
    opened, names = [0], [DOCUMENT]  # open elements by place and name
    inside, whole, size = 0, None, 1
    text, *pieces = html.split("<")
    at, last = 0, len(pieces)
    while True:
        if text:
            name = TEXT if whole is None or whole not in OPAQUE_TAGS else f"#{whole}"
            if "&" in text and name == TEXT:
                text = unescape(text)
            if text:
                if text < "!" and not text.strip(" \n\t\f\r"):
                    text = "\n" if "\n" in text else " "
                tags.append(name)
                parents.append(inside)
                ends.append(size)
                attrs.append(())
                texts.append(text)
                size += 1
        if at == last:
            break
        inner, closed, text = pieces[at].partition(">")
        at += 1
        if not closed:
            return None
        entry = _KNOWN.get(inner) or _tag(inner)
        if entry is None:
            return None
        kind, tag, given = entry
        if whole and not (kind == _END and tag == whole):
            return None
        if kind == _END:
            whole = None
            if tag == names[-1] or tag in names:
                name = None
                while name != tag:
                    name = names.pop()
                    ends[opened.pop()] = size - 1
                inside = opened[-1]
        elif kind != _BESIDE:
            tags.append(tag)
            parents.append(inside)
            ends.append(size)
            attrs.append(given)
            texts.append(None)
            if kind == _START:
                inside = size
                opened.append(size)
                names.append(tag)
                whole = tag if tag in _WHOLE_TAGS else None
            size += 1
    if whole:
        return None
    for place in opened:
        ends[place] = size - 1
    return Page(tags, parents, ends, attrs, texts)


class NodeReader(HTMLParser):
    """Reads pages into growing node columns. End tags close to the nearest open tag of that name."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.clear()

    def clear(self) -> None:
        self.page_ends, self.errors = [0], []
        self.pre, self.post, self.parent, self.depth = (array("i") for _ in range(4))
        self.tag, self.text, self.attrs = [], [], []

    def read(self, html: str | None) -> None:
        """Add the nodes of one page, or none and the reason why it could not be read."""
        self.reset()
        self.start, self.open, self.pending, self.closed = len(self.pre), [], [], 0
        self.special = 0  # open elements that change how text is kept
        error = None if html is not None else "no html"
        if html is not None and not self._read_plain(html):
            for column in self.columns():
                del column[self.start :]
            try:
                self._open(DOCUMENT, ())
                self.feed(html)
                self.close()
                self._flush()
                while self.open:
                    self._close()
            except (AssertionError, ValueError) as failure:
                error = str(failure) or type(failure).__name__
                for column in self.columns():
                    del column[self.start :]
        self.page_ends.append(len(self.pre))
        self.errors.append(error)

    def _read_plain(self, html: str) -> bool:
        """Add the nodes of a page of plain markup; False where it holds anything else."""
        page = plain_page(html)
        if page is None:
            return False
        depths = []
        for parent in page.parents:
            depths.append(depths[parent] + 1 if depths else 0)
        self.pre.fromlist(list(range(len(depths))))
        self.parent.fromlist(page.parents)
        self.depth.fromlist(depths)
        # closed before a node are the nodes up to its last one, without those that are open around it
        self.post.fromlist([end - depth for end, depth in zip(page.ends, depths, strict=True)])
        for column, values in ((self.tag, page.tags), (self.attrs, page.attrs), (self.text, page.texts)):
            column.extend(values)
        return True

    def skip(self, error: str | None = None) -> None:
        """Add a page without nodes."""
        self.page_ends.append(len(self.pre))
        self.errors.append(error)

    def page(self, html: str | None) -> tuple[Page | None, str | None]:
        """The nodes of one page on their own, or the reason why it could not be read."""
        found = None if html is None else plain_page(html)
        if found is not None:
            return found, None
        self.clear()
        self.read(html)
        if self.errors[0] is not None:
            return None, self.errors[0]
        ends = [post + depth for post, depth in zip(self.post, self.depth, strict=True)]
        return Page(self.tag, self.parent.tolist(), ends, self.attrs, self.text), None

    def columns(self) -> list:
        return [self.pre, self.post, self.parent, self.depth, self.tag, self.attrs, self.text]

    def arrow(self) -> pa.ListArray:
        attr_ends, names, values = [0], [], []
        for attrs in self.attrs:
            if attrs:
                # the last of several attributes with one name counts
                for name, value in dict(attrs).items() if len(attrs) > 1 else attrs:
                    names.append(name)
                    values.append(value or "")
            attr_ends.append(len(names))
        maps = pa.MapArray.from_arrays(
            pa.array(attr_ends, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string())
        )
        ints = [
            pa.Array.from_buffers(pa.int32(), len(c), [None, pa.py_buffer(c)])
            for c in (self.pre, self.post, self.parent, self.depth)
        ]
        columns = [*ints, pa.array(self.tag, pa.string()), maps, pa.array(self.text, pa.string())]
        nodes = pa.StructArray.from_arrays(
            columns, names=["pre", "post", "parent", "depth", "tag", "attrs", "text"]
        )
        return pa.ListArray.from_arrays(pa.array(self.page_ends, pa.int32()), nodes)

    def _open(self, tag: str, attrs, text: str | None = None) -> None:
        index = len(self.pre) - self.start
        self.pre.append(index)
        self.post.append(-1)
        self.parent.append(self.open[-1][0] if self.open else -1)
        self.depth.append(len(self.open))
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        self.open.append((index, tag))
        self.special += tag in SPECIAL_TAGS

    def _close(self) -> None:
        index, tag = self.open.pop()
        self.post[self.start + index] = self.closed
        self.closed += 1
        self.special -= tag in SPECIAL_TAGS

    def _flush(self) -> None:
        if not self.pending:
            return
        text = "".join(self.pending)
        self.pending.clear()
        names = [tag for _, tag in self.open] if self.special else []
        if not text.strip(" \n\t\f\r") and KEEP_BLANK_TAGS.isdisjoint(names):
            text = "\n" if "\n" in text else " "
        opaque = next((name for name in reversed(names) if name in OPAQUE_TAGS), None)
        self._open(f"#{opaque}" if opaque else TEXT, (), text)
        self._close()

    def handle_starttag(self, tag, attrs):
        self._flush()
        self._open(tag, attrs)
        if tag in VOID_TAGS:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self._flush()
        self._open(tag, attrs)
        self._close()

    def handle_endtag(self, tag):
        self._flush()
        if self.open[-1][1] == tag:
            self._close()
        elif any(name == tag for _, name in self.open):
            while self.open[-1][1] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if data:
            self.pending.append(data)

    def updatepos(self, i, j):
        # line numbers are not needed
        return j

    def _split_text(self, _):
        self._flush()

    def unknown_decl(self, data):
        """A marked section: the text of CDATA is page text, as a string of its own."""
        self._flush()
        if data[:6].upper() == "CDATA[":
            self.pending.append(data[6:])
            self._flush()

    handle_comment = handle_decl = handle_pi = _split_text


def shred_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = NodeReader()
    for batch in batches:
        kept = batch.drop_columns(["html"])
        done = 0
        for row, html in enumerate(batch.column("html"), start=1):
            reader.read(html.as_py())
            if len(reader.pre) >= _NODES_PER_BATCH or row == batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        *kept.slice(done, row - done).columns,
                        reader.arrow(),
                        pa.array(reader.errors, pa.string()),
                    ],
                    names=[*kept.schema.names, "nodes", "parse_error"],
                )
                reader.clear()
                done = row

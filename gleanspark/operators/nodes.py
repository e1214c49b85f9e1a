"""HTML pages as arrays of nodes, and selection over those arrays.

``shred`` is the only step that runs in Python workers. It turns each page into one array of nodes
in document order; everything after it is a native expression over that array. A page never leaves
its row, so selecting, walking up, reading text, de-duplicating and capping need no shuffle.

Node 0 is the document. ``pre`` is the index of a node in the array and ``post`` its rank by closing
order, so a node has ``post - pre + depth`` descendants and they follow it directly: a subtree is a
``slice``. Text nodes carry the tag ``#text``, or ``#`` plus the container's name inside elements
whose text is not page text (``#script``, ``#style``, ...).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import first, let
from ..functions.text import py_strip
from .shredder import TEXT, shred_batches

NODE_TYPE = (
    "array<struct<pre:int,post:int,parent:int,depth:int,tag:string,"
    "attrs:map<string,string>,text:string>>"
)


def shred(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by ``nodes`` and ``parse_error``; all other columns pass through.

    Select only the columns needed later: they all cross to the Python worker and back. Results are
    cut into batches by node count, so a batch of very large pages cannot grow without bound.
    Variants read from the nodes later keep the last of repeated JSON keys (a session setting).
    """
    pages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    kept = [f for f in pages.schema.fields if f.name != "html"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    schema = ", ".join([*fields, f"nodes {NODE_TYPE}", "parse_error string"])
    return pages.mapInArrow(shred_batches, schema)


# ---------------------------------------------------------------------------------------------
# Selection
# ---------------------------------------------------------------------------------------------


def has_class(node: Column, token: str) -> Column:
    """The token is among the node's classes; null for a node without classes."""
    return node["attrs"]["class"].rlike(rf"(^|\s){re.escape(token)}(\s|$)")


def is_element(node: Column, *tags: str) -> Column:
    if not tags:
        return ~node["tag"].startswith("#")
    return node["tag"] == tags[0] if len(tags) == 1 else node["tag"].isin(*tags)


def attr(node: Column, name: str) -> Column:
    """Attribute value, or null where the attribute is absent."""
    return node["attrs"][name]


def select(
    nodes: Column,
    tag: str | list[str] | None = None,
    cls: str | list[str] | None = None,
    has: str | None = None,
    equals: dict[str, str] | None = None,
    matches: dict[str, str] | None = None,
) -> Column:
    """Elements in document order: by tag(s), class token(s), attribute presence, value or regex."""
    tags = [tag] if isinstance(tag, str) else list(tag or [])
    classes = [cls] if isinstance(cls, str) else list(cls or [])

    def wanted(n: Column) -> Column:
        # a test of an absent attribute is null, which drops the node
        test = is_element(n, *tags)
        for token in classes:
            test = test & has_class(n, token)
        if has:
            test = test & attr(n, has).isNotNull()
        for name, value in (equals or {}).items():
            test = test & (attr(n, name) == value)
        for name, pattern in (matches or {}).items():
            test = test & attr(n, name).rlike(pattern)
        return test

    return F.filter(nodes, wanted)


def descendants(nodes: Column, node: Column) -> Column:
    """Nodes below ``node`` in document order (``nodes`` is the whole page)."""
    return let(
        node, lambda n: F.slice(nodes, n["pre"] + 2, n["post"] - n["pre"] + n["depth"])
    )


def parent(nodes: Column, node: Column) -> Column:
    return F.get(nodes, node["parent"])


def ancestor(nodes: Column, node: Column, tag: str, cls: str | None = None) -> Column:
    """Nearest element of that tag (and class) above ``node``, or null. Takes as many steps as the node is deep."""

    def fits(a: Column) -> Column:
        test = a["tag"] == tag
        return test if cls is None else test & F.coalesce(has_class(a, cls), F.lit(False))

    def nearest(n: Column) -> Column:
        # up the parents, and no further once the tag is found
        def up(at: Column, _: Column) -> Column:
            return F.when(at.isNull() | fits(at), at).otherwise(parent(nodes, at))

        steps = F.sequence(F.lit(1), F.greatest(n["depth"], F.lit(1)))
        found = F.aggregate(steps, parent(nodes, n), up)
        return F.when(fits(found), found)

    return let(node, nearest)


def inside(node: Column, outer: Column) -> Column:
    """``node`` is below ``outer``."""
    return (outer["pre"] < node["pre"]) & (outer["post"] > node["post"])


def ancestor_hint(nodes: Column, node: Column, pattern: str, hops: int = 3) -> Column:
    """The id or class of one of the nearest ``hops`` ancestors matches ``pattern``."""

    def label(n: Column) -> Column:
        return F.lower(F.concat_ws(" ", attr(n, "id"), attr(n, "class")))

    found, at = F.lit(False), node
    for _ in range(hops):
        at = parent(nodes, at)
        found = found | F.coalesce(label(at).rlike(pattern), F.lit(False))
    return found


# ---------------------------------------------------------------------------------------------
# Text
# ---------------------------------------------------------------------------------------------


def strings(nodes: Column, node: Column) -> Column:
    """The page-text pieces below ``node``, which is bound already."""
    texts = F.filter(
        F.slice(nodes, node["pre"] + 2, node["post"] - node["pre"] + node["depth"]),
        lambda d: d["tag"] == TEXT,
    )
    return F.transform(texts, lambda d: d["text"])


def raw_text(nodes: Column, node: Column, sep: str = "") -> Column:
    """Pieces as they are, joined; null if there is no such node."""
    return let(node, lambda n: F.when(n.isNotNull(), F.array_join(strings(nodes, n), sep)))


def trimmed_text(nodes: Column, node: Column) -> Column:
    """Pieces joined without separator, then the ends stripped."""
    return py_strip(raw_text(nodes, node))


def joined_text(nodes: Column, node: Column, sep: str = "") -> Column:
    """Each piece stripped, blanks dropped, joined with ``sep``; null if there is no such node."""

    def join(n: Column) -> Column:
        pieces = F.filter(F.transform(strings(nodes, n), py_strip), lambda t: t != "")
        return F.when(n.isNotNull(), F.array_join(pieces, sep))

    return let(node, join)


def document(nodes: Column) -> Column:
    return first(nodes)


def page_text(nodes: Column, sep: str = "") -> Column:
    """Text of the whole page with pieces as they are."""
    texts = F.filter(nodes, lambda n: n["tag"] == TEXT)
    return F.array_join(F.transform(texts, lambda n: n["text"]), sep)


def script_text(nodes: Column, script: Column) -> Column:
    """Content of a script element."""
    inner = F.filter(descendants(nodes, script), lambda d: d["tag"] == "#script")
    return first(F.transform(inner, lambda d: d["text"]))


def anchors(nodes: Column, sep: str = " ") -> Column:
    """Links as ``array<struct<pos, pre, parent, href, text>>`` in document order."""
    return F.transform(
        select(nodes, tag="a", has="href"),
        lambda a, i: F.struct(
            (i + 1).alias("pos"),
            a["pre"].alias("pre"),
            a["parent"].alias("parent"),
            attr(a, "href").alias("href"),
            joined_text(nodes, a, sep).alias("text"),
        ),
    )


def meta_content(nodes: Column, names: list[tuple[str, str]]) -> Column:
    """Content of the first kind of ``meta`` present, tried in order of (attribute, value)."""
    kinds = [first(select(nodes, tag="meta", equals={a: v})) for a, v in names]
    return attr(F.coalesce(*kinds), "content")


def json_ld(nodes: Column) -> Column:
    """Texts of the embedded JSON-LD scripts, in document order."""
    scripts = select(nodes, tag="script", equals={"type": "application/ld+json"})
    return F.transform(scripts, lambda s: script_text(nodes, s))

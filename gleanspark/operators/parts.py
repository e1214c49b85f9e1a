"""Pages read into the parts of listings and detail facts where their nodes are made.

The texts that an extractor asks for are found in the Python worker, and only they leave it: the nodes of a page are neither
copied to the JVM nor walked by expressions there. What is read from the texts is native and works on rows, not on arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from . import reader
from .nodes import NODE_TYPE

KIND = "kind"
_TYPES = {"int32": "int", "date32[day]": "date", "string": "string", "list<item: string>": "array<string>"}
PART_FIELDS = {name: _TYPES[str(kind)] for name, kind in reader.PART.items()}


@dataclass(frozen=True)
class Parts:
    """How listings are made of what the worker finds: ``read`` names its reader, which gets ``given``.

    ``arrange`` chooses among the items of a page, ``finish`` gives the fields that are read from a row's other fields.
    """

    read: str
    finish: Callable[[Column], dict[str, Column]]
    given: dict = field(default_factory=dict)
    arrange: Callable[[Column], Column] = lambda items: items


class Finder:
    """Something read of a detail page, from some of its values: called with nodes, it reads those from them.

    The sources are named as in ``reader.VALUES``, which the worker gives without nodes.
    """

    def __init__(self, sources: dict[str, Callable[[Column], Column]], find: Callable[..., Column]) -> None:
        self.sources, self.find = sources, find

    def __call__(self, nodes: Column) -> Column:
        return self.find(**{name: source(nodes) for name, source in self.sources.items()})

    def from_values(self) -> Column:
        return self.find(**{name: F.col(f"_{name}") for name in self.sources})


def _schema(pages: DataFrame, more: list[str]) -> str:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != "html"]
    return ", ".join([*kept, *more])


def read_listings(pages: DataFrame, parts: dict[str, Parts], with_nodes: bool) -> DataFrame:
    """Replace ``html`` by ``items``, by the parts of each ``site``; pages of other sites get ``nodes`` if those are asked for."""
    pages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    readers = {site: (getattr(reader, p.read), p.given) for site, p in parts.items()}
    item = ",".join(f"{name}:{kind}" for name, kind in PART_FIELDS.items())
    more = [f"items array<struct<{item}>>", *([f"nodes {NODE_TYPE}"] if with_nodes else [])]
    return pages.mapInArrow(reader.listing_batches(readers, with_nodes), _schema(pages, more))


def read_details(pages: DataFrame, finders: list[Finder]) -> DataFrame:
    """Replace ``html`` by the values that the finders read, those that ``_uses`` asks for, and ``parse_error``."""
    needs = [list(f.sources) for f in finders]
    site = {"meta": fixed.NAME_METAS, "content_class": fixed.CONTENT_CLASS, "content_id": fixed.CONTENT_ID}
    names = dict.fromkeys(name for some in needs for name in some)
    more = [*[f"_{name} {_TYPES[str(reader.VALUES[name])]}" for name in names], "parse_error string"]
    return pages.mapInArrow(reader.detail_batches(needs, site), _schema(pages, more))

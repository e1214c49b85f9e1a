"""CSS selectors, given as strings, as predicates over the node array of a page.

A selector is read once, while the plan is built. What it tests of an element is a native expression; a combinator is a step
to the parent, or a walk up the parents, so a page takes as many steps as its nodes are deep.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import nodes as N

_NAME = r"-?[A-Za-z_][\w-]*"
_PART = re.compile(
    rf"(?P<tag>\*|{_NAME})|\#(?P<id>[\w-]+)|\.(?P<cls>{_NAME})"
    rf"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\s\]\"']+))\s*(?P<fold>[iI])?\s*)?\]"
)
_COMBINATOR = re.compile(r"\s*([>])\s*|\s+")


@dataclass
class Compound:
    """Tests of one element."""

    tag: str | None = None
    classes: list[str] = field(default_factory=list)
    attributes: list[tuple[str, str | None, str, bool]] = field(default_factory=list)

    def test(self, n: Column) -> Column:
        tests = [N.is_element(n, *([self.tag] if self.tag else []))]
        tests += [F.coalesce(N.has_class(n, token), F.lit(False)) for token in self.classes]
        tests += [F.coalesce(_attribute(N.attr(n, name), *rest), F.lit(False)) for name, *rest in self.attributes]
        return reduce(Column.__and__, tests)


def _attribute(value: Column, op: str | None, wanted: str, fold: bool) -> Column:
    if op is None:
        return value.isNotNull()
    value, text = (F.lower(value), wanted.lower()) if fold else (value, wanted)
    if op == "=":
        return value == text
    if op == "~=":
        return F.lit(bool(text) and not re.search(r"\s", text)) & value.rlike(rf"(^|\s){re.escape(text)}(\s|$)")
    if op == "|=":
        return (value == text) | F.startswith(value, F.lit(f"{text}-"))
    # an empty value matches nothing with the other three
    find = {"^=": F.startswith, "$=": F.endswith, "*=": F.contains}[op]
    return F.lit(bool(text)) & find(value, F.lit(text))


def parse(selector: str) -> list[list[tuple[str, Compound]]]:
    """The alternatives of a selector: each a list of (combinator before it, compound), the first combinator being empty."""
    alternatives, chain, compound, at = [], [], None, 0
    combinator, text = "", selector.strip()

    def end_compound() -> None:
        nonlocal compound
        if compound is None:
            raise ValueError(f"no element before position {at} of selector {selector!r}")
        chain.append((combinator, compound))
        compound = None

    while at < len(text):
        comma, found, between = re.compile(r"\s*,\s*").match(text, at), _PART.match(text, at), _COMBINATOR.match(text, at)
        if comma:
            end_compound()
            alternatives.append(chain)
            chain, combinator, at = [], "", comma.end()
        elif found and not (found["tag"] and compound is not None):
            compound = compound or Compound()
            if found["tag"]:
                compound.tag = None if found["tag"] == "*" else found["tag"].lower()
            elif found["cls"]:
                compound.classes.append(found["cls"])
            elif found["id"]:
                compound.attributes.append(("id", "=", found["id"], False))
            else:
                value = next((v for v in (found["dq"], found["sq"], found["bare"]) if v is not None), "")
                compound.attributes.append((found["attr"].lower(), found["op"], value, bool(found["fold"])))
            at = found.end()
        elif between:
            end_compound()
            combinator, at = between[1] or " ", between.end()
        else:
            raise ValueError(f"position {at} of selector {selector!r} is not supported")
    end_compound()
    return [*alternatives, chain]


def _matches(nodes: Column, n: Column, chain: list[tuple[str, Compound]]) -> Column:
    """The element is what the last compound says, and above it is what the others say."""
    combinator, last = chain[-1]
    test = last.test(n)
    if len(chain) == 1:
        return test

    def above(at: Column) -> Column:
        return F.coalesce(_matches(nodes, at, chain[:-1]), F.lit(False))

    if combinator == ">":
        return test & above(N.parent(nodes, n))

    # up the parents, and no further once one fits
    def up(state: Column, _: Column) -> Column:
        at = state["at"]
        there = F.struct(at.alias("at"), above(at).alias("found"))
        return F.when(state["found"] | at.isNull(), state).otherwise(
            F.when(there["found"], there).otherwise(F.struct(N.parent(nodes, at).alias("at"), F.lit(False).alias("found")))
        )

    start = F.struct(N.parent(nodes, n).alias("at"), F.lit(False).alias("found"))
    steps = F.sequence(F.lit(1), F.greatest(n["depth"], F.lit(1)))
    return F.when(test, F.aggregate(steps, start, up, lambda s: s["found"])).otherwise(F.lit(False))


def select_css(nodes: Column, selector: str) -> Column:
    """Elements that a selector names, in document order, each once.

    Supported are tags and ``*``, ``#id``, ``.class``, attributes (present, ``= ~= |= ^= $= *=``, with ``i``), descendants, children (``>``) and
    lists; anything else raises ``ValueError`` while the plan is built.
    """
    alternatives = parse(selector)
    return F.filter(nodes, lambda n: reduce(Column.__or__, [_matches(nodes, n, chain) for chain in alternatives]))

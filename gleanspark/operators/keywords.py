"""Keyword rules of any number, found in texts by an automaton.

The rules become an Aho-Corasick automaton that is built once and sent to the executors while its size allows; more rules are
dealt out to several automata of that size, each of which reads the texts in a pass of its own. A text meets all keywords of an
automaton in one walk over its characters, in Arrow batches, and only what was found leaves the worker: no text is shuffled,
and rows need no key.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..sources.stored import stored

# Ship this module inside the task, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of the keywords of one automaton, which takes up to 32 bytes for each, and what a rule counts beside its keyword.
CHARACTERS, RULE = 2_000_000, 8
TITLE, DESCRIPTION, COMPANY = 1, 2, 4
FIELDS = ("category", "ord", "tier", "keyword")

#: What a row's rules are reduced to: all of them, points by category, or the first category.
HIT = "struct<category:string,ord:int,tier:string,keyword:string,points:int>"
SCORE = "struct<category:string,ord:int,score:bigint>"
FIRST = "struct<ord:int,category:string>"


class Keywords(NamedTuple):
    """An automaton that gives the number of a keyword, and the keywords' lengths and rules (category, ord, tier)."""

    automaton: ahocorasick.Automaton
    keywords: list[str]
    rules: list[list[tuple[str, int, str]]]

    def places(self, title: str, description: str, company: str) -> dict[int, int]:
        """The keywords in the three texts as one, with the texts that hold them whole; none for one across a border."""
        second = len(title) + 1
        third = second + len(description) + 1
        found: dict[int, int] = {}
        for end, n in self.automaton.iter(f"{title} {description} {company}"):
            start = end - len(self.keywords[n]) + 1
            if end < second - 1:
                at = TITLE
            elif start >= second and end < third - 1:
                at = DESCRIPTION
            else:
                at = COMPANY if start >= third else 0
            found[n] = found.get(n, 0) | at
        return found


def points(tier: str, places: int) -> int | None:
    """Points of a rule whose keyword is in these texts; None where none of them counts for its tier."""
    for place, table in ((TITLE, fixed.TITLE_POINTS), (DESCRIPTION, fixed.DESCRIPTION_POINTS), (COMPANY, fixed.COMPANY_POINTS)):
        if places & place and tier in table:
            return table[tier]
    return fixed.EXCLUSION_POINTS if tier == "exclusion" else None


def build(rows: list[tuple]) -> Keywords | None:
    """The automaton of rules (category, ord, tier, keyword); None without rules."""
    numbers: dict[str, int] = {}
    rules: list[list[tuple[str, int, str]]] = []
    for category, ord_, tier, keyword in rows:
        if keyword not in numbers:
            numbers[keyword] = len(rules)
            rules.append([])
        rules[numbers[keyword]].append((category, ord_, tier))
    if not numbers:
        return None
    automaton = ahocorasick.Automaton()
    for keyword, n in numbers.items():
        automaton.add_word(keyword, n)
    automaton.make_automaton()
    return Keywords(automaton, list(numbers), rules)


def _weighed(known: Keywords, places: dict[int, int], titles: dict) -> Iterator[tuple[str, int, str, int, int]]:
    for n, at in places.items():
        for category, ord_, tier in known.rules[n]:
            if (tier, at) not in titles:
                titles[tier, at] = points(tier, at)
            if titles[tier, at] is not None:
                yield category, ord_, tier, n, titles[tier, at]


def hits(known: Keywords, places: dict[int, int], cache: dict) -> list[dict]:
    return [
        {"category": c, "ord": o, "tier": t, "keyword": known.keywords[n], "points": p} for c, o, t, n, p in _weighed(known, places, cache)
    ]


def scores(known: Keywords, places: dict[int, int], cache: dict) -> list[dict]:
    total: dict[tuple[str, int], int] = {}
    for category, ord_, _, _, p in _weighed(known, places, cache):
        total[category, ord_] = total.get((category, ord_), 0) + p
    return [{"category": c, "ord": o, "score": s} for (c, o), s in total.items()]


def firsts(known: Keywords, places: dict[int, int], cache: dict) -> list[dict]:
    """The category of least order that has a keyword whole in a text."""
    named = {(o, c) for n, at in places.items() if at for c, o, _ in known.rules[n]}
    best = min(named, key=lambda x: ((x[0] is not None, x[0]), (x[1] is not None, x[1])), default=None)
    return [] if best is None else [{"ord": best[0], "category": best[1]}]


Reduce = Callable[[Keywords, dict[int, int], dict], list[dict]]
_KINDS = {hits: HIT, scores: SCORE, firsts: FIRST}
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}


def _searched(texts: DataFrame, known: Keywords, reduce: Reduce) -> DataFrame:
    """``found`` in place of the three texts."""
    sent = texts.sparkSession.sparkContext.broadcast(tuple(known))
    struct = pa.struct([(f.split(":")[0], _ARROW[f.split(":")[1]]) for f in _KINDS[reduce][len("struct<") : -1].split(",")])
    kept = [f for f in texts.schema.fields if f.name not in ("title", "description", "company")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cache = Keywords(*sent.value), {}
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("title", "description", "company")]
            found = [reduce(known, known.places(*row), cache) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(found, pa.list_(struct))], [*[f.name for f in kept], "found"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return texts.mapInArrow(run, ", ".join([*fields, f"found array<{_KINDS[reduce]}>"]))


def search(texts: DataFrame, rules: DataFrame, reduce: Reduce, characters: int = CHARACTERS) -> list[DataFrame]:
    """``texts`` with ``found`` for ``title, description, company``: one table, or one for each automaton if there are several.

    The texts are in lower case and not null; rules are ``(category, ord, tier, keyword)``, null and empty keywords left out, repeated rules
    taken once. Several tables have a ``row`` number that is the same in all of them.
    """
    rules = rules.select(*FIELDS).where("keyword <> ''").distinct()
    size = rules.agg(F.sum(F.length("keyword") + RULE)).first()[0] or 0
    parts = max(1, -(-size // characters))
    if parts == 1:
        known = build([tuple(r) for r in rules.collect()])
        empty = F.array().cast(f"array<{_KINDS[reduce]}>")
        return [texts.drop("title", "description", "company").withColumn("found", empty) if known is None else _searched(texts, known, reduce)]
    rules, texts = stored(rules), stored(texts.withColumn("row", F.monotonically_increasing_id()))
    tables = []
    for part in range(parts):
        known = build([tuple(r) for r in rules.where(F.pmod(F.xxhash64(*FIELDS), F.lit(parts)) == part).collect()])
        if known is not None:
            tables.append(_searched(texts, known, reduce))
    return tables

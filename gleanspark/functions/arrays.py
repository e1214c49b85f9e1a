"""Small tools for expressions over arrays."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first(items: Column) -> Column:
    """First element, null for an empty array."""
    return F.get(items, F.lit(0))


def unless(value: Column, blank: Column) -> Column:
    """The value, null where it is ``blank``. ``nullif`` may compute a value twice, which counts where it is searched for."""
    return F.get(F.array_remove(F.array(value), blank), F.lit(0))


def first_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """Keep the first element per key, in array order. Sort based, so not quadratic."""

    def keep(keyed: Column) -> Column:
        is_first = F.filter(
            keyed, lambda e, i: (i == 0) | ~e["k"].eqNullSafe(F.get(keyed, i - 1)["k"])
        )
        return F.array_sort(F.transform(is_first, lambda e: e["i"]))

    def pick(source: Column) -> Column:
        keyed = F.array_sort(
            F.transform(source, lambda x, i: F.struct(key(x).alias("k"), i.alias("i")))
        )
        return F.transform(let(keyed, keep), lambda i: F.get(source, i))

    return let(items, pick)


def any_of(text: Column, words: list[str]) -> Column:
    """The text contains one of a few words."""
    return text.rlike("|".join(re.escape(word) for word in words))


def constant(value: list, schema: str) -> Column:
    """A constant array, folded into one literal when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)


def words(values: list[str]) -> Column:
    return constant(values, "array<string>")

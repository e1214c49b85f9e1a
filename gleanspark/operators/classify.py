"""Listing categories from keyword rules.

Scoring needs no join and no shuffle: the rules are a small literal, each row is searched once for
all keywords, and only the few keywords found are weighed. Keywords match as plain substrings.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.arrays import any_of, constant, first, let, words
from . import keywords

RULES_TYPE = "array<struct<category:string,ord:int,tier:string,keyword:string>>"


class Rule(NamedTuple):
    category: str
    ord: int
    tier: str
    keyword: str


def weighted_rules() -> list[Rule]:
    tiers = {
        "primary": fixed.PRIMARY,
        "secondary": fixed.SECONDARY,
        "company": fixed.COMPANY,
        "exclusion": fixed.EXCLUSIONS,
    }
    return [
        Rule(category, ord, tier, keyword)
        for ord, category in enumerate(fixed.PRIMARY)
        for tier, table in tiers.items()
        for keyword in table.get(category, [])
    ]


def first_match_rules() -> list[Rule]:
    return [
        Rule(category, ord, "any", keyword)
        for ord, (category, keywords) in enumerate(fixed.FIRST_MATCH.items())
        for keyword in keywords
    ]


def rules_from(table: DataFrame, most: int = 5000) -> list[Rule]:
    """Rules of a table ``(category, ord, tier, keyword)`` that travel inside the plan.

    Meant for rules that people wrote; a table with over ``most`` is refused, one of any size goes to ``classify_by_table``.
    """
    rows = table.select(*Rule._fields).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rules do not fit in a plan; use classify_by_table")
    return sorted((Rule(*row) for row in rows), key=lambda r: r.ord)


def _prepared(rules: list[Rule], fold_keywords: bool) -> list[Rule]:
    rules = [r for r in rules if r.keyword]
    if fold_keywords:
        return [r._replace(keyword=r.keyword.lower()) for r in rules]
    # texts are compared in lower case, so other keywords can never be found
    return [r for r in rules if r.keyword == r.keyword.lower()]


def _lower(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def _texts(title: Column, description: Column, company: Column) -> Column:
    return F.struct(
        _lower(title).alias("title"),
        _lower(description).alias("description"),
        _lower(company).alias("company"),
        F.concat_ws(" ", _lower(title), _lower(description), _lower(company)).alias("all"),
    )


def _prefix_pattern(words: list[str]) -> str:
    """Pattern for the longest of some words, sharing common beginnings."""
    branches = [
        re.escape(letter) + _prefix_pattern([w[1:] for w in words if w[:1] == letter])
        for letter in sorted({w[0] for w in words if w})
    ]
    if not branches:
        return ""
    return f"(?:{'|'.join(branches)}){'?' if '' in words else ''}"


def _found_rules(rules: list[Rule], texts: Column) -> Column:
    """Rules whose keyword is somewhere in the texts.

    One pass finds the longest keyword at every position; the other keywords starting there are its
    beginnings, so each keyword stands for its own rules and those of the keywords it starts with.
    """
    known = sorted({r.keyword for r in rules})
    standing_for = constant(
        [[r._asdict() for r in rules if k.startswith(r.keyword)] for k in known],
        f"array<{RULES_TYPE}>",
    )
    pattern = f"(?=({_prefix_pattern(known)}))"
    found = F.array_distinct(F.regexp_extract_all(texts["all"], F.lit(pattern), F.lit(1)))
    groups = F.transform(
        found,
        lambda k: F.get(standing_for, F.array_position(words(known), k).cast("int") - 1),
    )
    return F.array_distinct(F.flatten(groups))


def _points(rule: Column, texts: Column) -> Column:
    """Points of one rule; null where its keyword is not in a text that counts for its tier."""

    def table(points: dict[str, int]) -> Column:
        value = F.lit(None).cast("int")
        for tier, n in points.items():
            value = F.when(rule["tier"] == tier, F.lit(n)).otherwise(value)
        return value

    def found(name: str, points: dict[str, int]) -> Column:
        return F.when(F.contains(texts[name], rule["keyword"]), table(points))

    exclusion = F.when(rule["tier"] == "exclusion", F.lit(fixed.EXCLUSION_POINTS))
    return F.coalesce(
        found("title", fixed.TITLE_POINTS),
        found("description", fixed.DESCRIPTION_POINTS),
        found("company", fixed.COMPANY_POINTS),
        exclusion,
    )


def keyword_hits(
    title: Column,
    description: Column,
    company: Column,
    rules: list[Rule] | None = None,
    fold_keywords: bool = False,
) -> Column:
    """Rules that apply, as ``array<struct<category, ord, tier, keyword, points>>``."""
    rules = _prepared(weighted_rules() if rules is None else rules, fold_keywords)

    def weigh(texts: Column) -> Column:
        weighed = F.transform(
            _found_rules(rules, texts), lambda r: r.withField("points", _points(r, texts))
        )
        return F.filter(weighed, lambda r: r["points"].isNotNull())

    return let(_texts(title, description, company), weigh)


def category_scores(
    title: Column,
    description: Column,
    company: Column,
    rules: list[Rule] | None = None,
    fold_keywords: bool = False,
) -> Column:
    """Points of every category with a hit, as ``array<struct<category, ord, score>>``."""
    rules = weighted_rules() if rules is None else rules
    categories = dict.fromkeys((r.category, r.ord) for r in rules)
    table = constant(
        [{"category": c, "ord": o} for c, o in categories], "array<struct<category:string,ord:int>>"
    )

    def total(hits: Column) -> Column:
        def own(category: Column) -> Callable[[Column], Column]:
            return lambda h: (h["ord"] == category["ord"]) & (h["category"] == category["category"])

        def of(category: Column) -> Column:
            return category.withField("score", F.aggregate(F.filter(hits, own(category)), F.lit(0), lambda s, h: s + h["points"]))

        return F.transform(F.filter(table, lambda c: F.exists(hits, own(c))), of)

    return let(keyword_hits(title, description, company, rules, fold_keywords), total)


def _fallback(texts: Column) -> Column:
    title, everything = texts["title"], texts["all"]
    choice = F.lit(fixed.FALLBACK_ROLE_CATEGORY)
    for category, words in reversed(fixed.FALLBACK_CONTEXT):
        choice = F.when(any_of(everything, words), F.lit(category)).otherwise(choice)
    choice = F.when(any_of(title, fixed.FALLBACK_ROLES), choice).otherwise(F.lit(fixed.NO_CATEGORY))
    for category, words in reversed(fixed.FALLBACK_TITLE):
        choice = F.when(any_of(title, words), F.lit(category)).otherwise(choice)
    return choice


def weighted_category(
    title: Column,
    description: Column,
    company: Column,
    rules: list[Rule] | None = None,
    fold_keywords: bool = False,
) -> Column:
    """Category with the most points, the earliest of equals; a fallback where none has any."""
    scores = category_scores(title, description, company, rules, fold_keywords)
    ranked = F.array_sort(
        F.transform(
            F.filter(scores, lambda c: c["score"] > 0),
            lambda c: F.struct((-c["score"]).alias("rank"), c["ord"], c["category"]),
        )
    )
    fallback = let(_texts(title, description, company), _fallback)
    return F.coalesce(first(ranked)["category"], fallback)


def first_match_category(
    title: Column,
    description: Column,
    company: Column,
    rules: list[Rule] | None = None,
    fold_keywords: bool = False,
) -> Column:
    """First category, in rule order, with a keyword in any of the three texts."""
    rules = _prepared(first_match_rules() if rules is None else rules, fold_keywords)

    def earliest(texts: Column) -> Column:
        in_one_text = F.filter(
            _found_rules(rules, texts),
            lambda r: F.contains(texts["title"], r["keyword"])
            | F.contains(texts["description"], r["keyword"])
            | F.contains(texts["company"], r["keyword"]),
        )
        order = F.array_min(F.transform(in_one_text, lambda r: F.struct(r["ord"], r["category"])))
        return F.coalesce(order["category"], F.lit(fixed.NO_CATEGORY))

    return let(_texts(title, description, company), earliest)


CLASSIFIERS = {"weighted": weighted_category, "first": first_match_category}


def classify(
    df: DataFrame,
    mode: str = "weighted",
    rules: list[Rule] | None = None,
    fold_keywords: bool = False,
) -> DataFrame:
    """Add ``category`` from ``title``, ``description`` and ``company``; one already set is kept."""
    category = CLASSIFIERS[mode](F.col("title"), F.col("description"), F.col("company"), rules, fold_keywords)
    if "category" in df.columns:
        category = F.coalesce(F.col("category"), category)
    return df.withColumn("category", category)


def _rules_and_texts(df: DataFrame, rules: DataFrame, key: str, fold_keywords: bool) -> tuple[DataFrame, DataFrame]:
    """Rules with keywords that can be found, and ``(key, title, description, company)`` in lower case."""
    lowered = F.lower("keyword")
    rules = rules.withColumn("keyword", lowered) if fold_keywords else rules.filter(F.col("keyword") == lowered)
    texts = [_lower(F.col(name)).alias(name) for name in ("title", "description", "company")]
    return rules, df.select(df[key].alias("key"), *texts)


def hits_by_table(df: DataFrame, rules: DataFrame, key: str, fold_keywords: bool = False, characters: int = keywords.CHARACTERS) -> DataFrame:
    """``(key, category, ord, tier, keyword, points)``: the rules of a table of any size that apply to each row."""
    rules, texts = _rules_and_texts(df, rules, key, fold_keywords)
    parts = [t.select(F.col("key").alias(key), F.inline("found")) for t in keywords.search(texts, rules, keywords.hits, characters)]
    return reduce(DataFrame.unionByName, parts)


def classify_by_table(
    df: DataFrame, rules: DataFrame, key: str, fold_keywords: bool = False, mode: str = "weighted", characters: int = keywords.CHARACTERS
) -> DataFrame:
    """``(key, category, score)`` for every row by a table of rules of any size; null without a category.

    By mode ``weighted`` it is the category with the most points, the earliest of equals; by ``first`` the one of least order with a keyword in
    any of the three texts, and the score is null. Keys may be null or repeated: each row is classified by itself. Where the rules
    fit in one automaton, nothing is shuffled; else points by category and row are, and no text. ``characters`` bounds an automaton.
    """
    rules, texts = _rules_and_texts(df, rules, key, fold_keywords)
    weighted = mode == "weighted"
    parts = keywords.search(texts, rules, keywords.scores if weighted else keywords.firsts, characters)

    def best(found: Column) -> Column:
        if not weighted:
            return F.array_min(found)
        ranked = F.transform(F.filter(found, lambda s: s["score"] > 0), lambda s: F.struct((-s["score"]).alias("rank"), s["ord"], s["category"]))
        return F.array_min(ranked)

    if len(parts) == 1:
        table = parts[0].select("key", best(F.col("found")).alias("best"))
    else:
        rows = reduce(DataFrame.unionByName, parts)
        if weighted:
            each = rows.select("row", F.inline("found")).groupBy("row", "category", "ord").agg(F.sum("score").alias("score"))
            found = F.struct((-F.col("score")).alias("rank"), "ord", "category")
            each = each.where("score > 0").groupBy("row").agg(F.min(found).alias("best"))
        else:
            each = rows.select("row", F.inline("found")).groupBy("row").agg(F.min(F.struct("ord", "category")).alias("best"))
        table = parts[0].select("key", "row").join(each, "row", "left")
    score = -F.col("best.rank") if weighted else F.lit(None).cast("bigint")
    return table.select(F.col("key").alias(key), F.col("best.category").alias("category"), score.alias("score"))

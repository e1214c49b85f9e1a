"""Contact addresses in page text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .arrays import any_of, first, let
from .dates import extract_or_null
from .text import py_strip

#: A character that every match of a pattern holds: a text without it, which is quickly told, is not searched.
_SIGNS = {p: "[" if r"\[" in p else "@" for p in (fixed.PLAIN_EMAIL, fixed.SPACED_EMAIL, fixed.MASKED_EMAIL, fixed.PLAIN_EMAIL_STRICT, fixed.MASKED_EMAIL_STRICT)}
PATTERNS = [fixed.PLAIN_EMAIL, fixed.SPACED_EMAIL, fixed.MASKED_EMAIL]


def _first(text: Column, pattern: str, flags: str) -> Column:
    """First match of one of the patterns, null without one."""
    return F.when(F.contains(text, F.lit(_SIGNS[pattern])), extract_or_null(text, f"{flags}{pattern}"))


def first_email(text: Column) -> Column:
    """First plain address, null without one."""
    return let(text, lambda t: _first(t, fixed.PLAIN_EMAIL, "(?U)"))


def all_emails(text: Column, patterns: list[str] = PATTERNS) -> Column:
    """All addresses, pattern by pattern: plain, with blanks, with ``[at]`` and ``[dot]``."""

    def found(pattern: str) -> Column:
        matches = F.regexp_extract_all(text, F.lit(f"(?iU){pattern}"), F.lit(0))
        if pattern not in _SIGNS:
            return matches
        return F.when(~F.contains(text, F.lit(_SIGNS[pattern])), F.array().cast("array<string>")).otherwise(matches)

    return F.concat(*map(found, patterns))


def unmask(email: Column) -> Column:
    at = F.replace(email, F.lit("[at]"), F.lit("@"))
    return F.replace(at, F.lit("[dot]"), F.lit("."))


def drop_spaces(email: Column) -> Column:
    return F.replace(email, F.lit(" "), F.lit(""))


def normalize_email(email: Column) -> Column:
    """Without spaces, in lower case, unmasked."""
    return unmask(F.lower(drop_spaces(email)))


def is_wanted(email: Column, unwanted: list[str] = fixed.UNWANTED_EMAILS) -> Column:
    """Not an automatic or administrative address; tested before unmasking."""
    return ~any_of(F.lower(drop_spaces(email)), unwanted)


def candidate_emails(text: Column) -> Column:
    """Wanted addresses, normalised, in order of first appearance."""
    wanted = F.filter(all_emails(text), lambda e: is_wanted(e))
    return F.array_distinct(F.transform(wanted, normalize_email))


def pick_email(text: Column, emails: Column, window: int = 100) -> Column:
    """First address with an application word nearby in the text, else the first address."""

    def pick(v: Column) -> Column:
        def applies(email: Column) -> Column:
            at = F.instr(F.lower(v["text"]), email) - 1
            start = F.greatest(at - window, F.lit(0))
            around = F.substring(v["text"], start + 1, at + F.length(email) + window - start)
            return (at >= 0) & any_of(F.lower(around), fixed.APPLY_WORDS)

        return F.coalesce(first(F.filter(v["emails"], applies)), first(v["emails"]))

    return let(F.struct(text.alias("text"), emails.alias("emails")), pick)


def contextual_email(text: Column) -> Column:
    return let(text, lambda t: pick_email(t, candidate_emails(t)))


def mailto_address(href: Column) -> Column:
    """Address of a ``mailto:`` link in lower case; null for other links and ``noreply``."""
    target = F.regexp_replace(href, "(?i)^mailto:", "")
    address = F.lower(py_strip(F.substring_index(target, "?", 1)))
    usable = let(address, lambda a: F.when((a != "") & ~F.contains(a, F.lit("noreply")), a))
    return F.when(href.rlike("(?i)^mailto:"), usable)


def link_or_text_email(hrefs: Column, text: Column) -> Column:
    """First usable ``mailto:`` link, else the first hit of each text pattern in turn."""
    linked = first(F.filter(F.transform(hrefs, mailto_address), lambda e: e.isNotNull()))

    def from_text(pattern: str) -> Column:
        hit = let(text, lambda t: _first(t, pattern, "(?iU)"))
        return let(F.lower(unmask(drop_spaces(hit))), lambda a: F.when(~any_of(a, fixed.UNWANTED_SENDERS), a))

    return F.coalesce(
        linked, from_text(fixed.PLAIN_EMAIL_STRICT), from_text(fixed.MASKED_EMAIL_STRICT)
    )

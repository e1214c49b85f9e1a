"""Expiry and posting dates in listing texts, as column expressions. "Today" is always a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .arrays import let, unless, words
from .text import collapse_blanks, py_strip

MONTHS = [dt.date(2000, m, 1).strftime("%B").lower() for m in range(1, 13)]
SHORT_MONTHS = [m[:3] for m in MONTHS]


def extract_or_null(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of a pattern, null without one."""
    return unless(F.regexp_extract(text, pattern, group), F.lit(""))


def _month_number(name: Column, full_names_only: bool) -> Column:
    number = unless(F.array_position(words(MONTHS), F.lower(name)), F.lit(0).cast("bigint"))
    if full_names_only:
        return number
    short = unless(F.array_position(words(SHORT_MONTHS), F.lower(name)), F.lit(0).cast("bigint"))
    return F.coalesce(number, short)


def _to_date(year: Column, month: Column, day: Column) -> Column:
    # there is no year 0
    text = F.concat(unless(year, F.lit("0000")), F.lit("-"), month.cast("string"), F.lit("-"), day)
    return text.try_cast("date")


def _parse(text: Column, pattern: str, order: str, full_names_only: bool = False) -> Column:
    """Parse a whole text by a pattern whose three groups are named by ``order`` (m, n, d, y)."""
    part = {key: extract_or_null(text, pattern, i) for i, key in enumerate(order, start=1)}
    month = part["n"].cast("int") if "n" in part else _month_number(part["m"], full_names_only)
    return F.when(text.rlike(pattern), _to_date(part["y"], month, part["d"]))


def _without_commas(text: Column) -> Column:
    return collapse_blanks(py_strip(F.replace(text, F.lit(","), F.lit(""))))


def month_day_year(text: Column, full_names_only: bool = False) -> Column:
    """``August 5, 2025`` or ``Aug 5 2025``; the text must hold nothing else."""
    pattern = r"^([A-Za-z]+) (\d{1,2}) (\d{4})$"
    return let(_without_commas(text), lambda t: _parse(t, pattern, "mdy", full_names_only))


def parse_date(text: Column) -> Column:
    """First format that fits the whole text: month first, day first, or year-month-day."""

    def by_format(plain: Column) -> Column:
        return F.coalesce(
            _parse(plain, r"^([A-Za-z]+) (\d{1,2}) (\d{4})$", "mdy"),
            _parse(plain, r"^(\d{1,2}) ([A-Za-z]+) (\d{4})$", "dmy"),
            _parse(plain, r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "ynd"),
        )

    return let(_without_commas(text), by_format)


def strip_expiry_prefix(text: Column) -> Column:
    return py_strip(F.regexp_replace(py_strip(text), fixed.EXPIRY_PREFIX, ""))


def first_date_text(text: Column) -> Column:
    """First ``Month D, YYYY`` in the text, null without one."""
    return extract_or_null(text, f"(?U){fixed.MONTH_DAY_YEAR}")


def after_posting(posted: Column) -> Column:
    return F.date_add(posted, fixed.POSTED_VALID_DAYS)


def parse_expiry(text: Column, mode: str = "strict") -> Column:
    """Expiry date of a text, null where none can be read.

    ``strict`` reads many formats and takes a posting date plus 30 days; ``lenient`` only reads
    day-first dates after the word "expires".
    """
    return _strict(text) if mode == "strict" else _lenient(text)


def _strict(text: Column) -> Column:
    def read(t: Column) -> Column:
        whole = parse_date(F.regexp_replace(t, r"(?U)[^\w\s\-,]", ""))
        posted = t.rlike("(?iU)posted")
        # not bound once: it is only read where a posting date or no whole date asks for it
        found = month_day_year(first_date_text(t))
        return F.coalesce(F.when(posted, after_posting(found)), whole, found)

    return let(strip_expiry_prefix(text), read)


def _lenient(text: Column) -> Column:
    def read(t: Column) -> Column:
        plain = collapse_blanks(t)
        year = extract_or_null(plain, r"^\d{1,2} [a-z]+ (\d{2})$", 1)
        century = F.when(year >= "69", F.lit("19")).otherwise(F.lit("20"))
        long_form = F.when(
            year.isNotNull(), F.concat(F.substring_index(plain, " ", 2), F.lit(" "), century, year)
        ).otherwise(plain)
        name = extract_or_null(long_form, r"^\d{1,2} ([a-z]+) \d{4}$", 1)
        month = F.nullif(F.array_position(words(SHORT_MONTHS), name), F.lit(0))
        day = extract_or_null(long_form, r"^(\d{1,2}) [a-z]+ \d{4}$", 1)
        return _to_date(extract_or_null(long_form, r" (\d{4})$", 1), month, day)

    lowered = F.lower(text)
    rest = py_strip(F.replace(lowered, F.lit("expires"), F.lit("")))
    return F.when(F.contains(lowered, F.lit("expires")), let(rest, read))


def expiry_label(day: Column) -> Column:
    return F.date_format(day, "'Expires' MMMM dd, yyyy")


def posted_text(text: Column) -> Column:
    """Date after "Posted on", else after "Posted"."""
    return F.coalesce(
        extract_or_null(text, f"(?iU)Posted on{fixed.POSTED_DATE}", 1),
        extract_or_null(text, f"(?iU)Posted{fixed.POSTED_DATE}", 1),
    )


def listed_date_text(text: Column) -> Column:
    """``Posted on <date>`` with its words, else the first bare date."""
    return F.coalesce(
        extract_or_null(text, rf"(?iU)Posted on\s+({fixed.MONTH_DAY_YEAR})"), first_date_text(text)
    )


def detail_date_text(text: Column) -> Column:
    """First capitalised ``Month D, YYYY`` on a detail page."""
    return extract_or_null(text, fixed.DETAIL_DATE)


def posted_expiry(posted: Column) -> Column:
    """Expiry of a listing posted on a date with a full month name."""
    return after_posting(month_day_year(posted, full_names_only=True))


def is_current(expiry: Column, as_of: str | dt.date, on_unparsed: str = "drop") -> Column:
    """The listing has not expired; unread dates are dropped (strict) or kept (lenient)."""
    current = expiry >= F.lit(str(as_of)).cast("date")
    return F.coalesce(current, F.lit(on_unparsed == "keep"))

"""URLs and page numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .arrays import any_of, let
from .dates import extract_or_null


def host(url: Column) -> Column:
    return F.lower(extract_or_null(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """The path of a URL, a slash where there is none."""
    found = extract_or_null(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.coalesce(found, F.lit("/"))


def page_of(url: Column, step: int = 10) -> Column:
    """The number of a listing page, from any form of its URL; 1 where the URL names none."""
    offset = page_number(url, r"[?&]start=(\d+)")
    found = F.coalesce(page_number(url, r"[?&]paged?=(\d+)"), page_number(url, fixed.PAGE_IN_PATH), F.floor(offset / step) + 1)
    return F.coalesce(found, F.lit(1)).cast("int")


def absolute_url(url: Column, origin: str) -> Column:
    """Host prefix for paths that start with a slash."""
    return F.when(url.startswith("/"), F.concat(F.lit(origin), url)).otherwise(url)


def _split_url(url: Column) -> Column:
    def part(pattern: str) -> Column:
        return F.regexp_extract(url, pattern, 1)

    scheme = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?"
    return F.struct(
        F.lower(part(r"^([A-Za-z][A-Za-z0-9+.-]*):")).alias("scheme"),
        part(scheme + r"//([^/?#]*)").alias("host"),
        part(scheme + r"(?://[^/?#]*)?([^?#]*)").alias("path"),
        part(r"^[^?#]*\?([^#]*)").alias("query"),
        part(r"^[^#]*#(.*)$").alias("fragment"),
    )


def _join_path(base_path: Column, path: Column) -> Column:
    """Path of a reference against the base path, dot segments resolved."""
    absolute = F.split(path, "/", -1)
    # the last segment of the base is replaced; blank segments in between are dropped
    joined = F.split(F.concat(F.regexp_replace(base_path, "[^/]*$", ""), path), "/", -1)
    tidy = F.filter(joined, lambda s, i: (s != "") | (i == 0) | (i == F.size(joined) - 1))

    def resolve(segments: Column) -> Column:
        kept = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda done, s: F.when(
                s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
            )
            .when(s == ".", done)
            .otherwise(F.array_append(done, s)),
        )
        last = F.try_element_at(segments, F.lit(-1))
        ends_open = last.isin(".", "..")
        return F.concat(F.array_join(kept, "/"), F.when(ends_open, F.lit("/")).otherwise(F.lit("")))

    merged = let(F.when(path.startswith("/"), absolute).otherwise(tidy), resolve)
    return F.when(merged.startswith("/"), merged).otherwise(F.concat(F.lit("/"), merged))


def resolve_url(base: str | Column, href: Column) -> Column:
    """The URL a reference points to on the page at ``base``; other schemes are left as they are."""
    base = F.lit(base) if isinstance(base, str) else base

    def join(ref: Column, b: Column) -> Column:
        path = (
            F.when(ref["host"] != "", ref["path"])
            .when(ref["path"] == "", b["path"])
            .otherwise(_join_path(b["path"], ref["path"]))
        )
        own_query = (ref["host"] != "") | (ref["path"] != "") | (ref["query"] != "")
        query = F.when(own_query, ref["query"]).otherwise(b["query"])
        return F.concat(
            b["scheme"],
            F.lit("://"),
            F.when(ref["host"] != "", ref["host"]).otherwise(b["host"]),
            path,
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
            F.when(ref["fragment"] != "", F.concat(F.lit("#"), ref["fragment"])).otherwise(F.lit("")),
        )

    def choose(h: Column, parts: Column) -> Column:
        ref, b = parts["ref"], parts["base"]
        foreign = (ref["scheme"] != "") & (ref["scheme"] != b["scheme"])
        return F.when(foreign, h).when(h == "", base).otherwise(join(ref, b))

    def whole(h: Column) -> Column:
        return let(F.struct(_split_url(h).alias("ref"), _split_url(base).alias("base")), lambda parts: choose(h, parts))

    def quick(h: Column) -> Column:
        # a path from the root without dot segments, parameters and fragment follows the host as it is
        b = _split_url(base)
        origin = F.concat(b["scheme"], F.lit("://"), b["host"])
        return F.when(h.rlike(r"^/(?![/.])[^?#]*\z") & ~F.contains(h, F.lit("/.")), F.concat(origin, h)).otherwise(whole(h))

    return let(href, quick)


def without_fragment(url: Column) -> Column:
    """The URL that a fetch asks for."""
    return F.regexp_replace(url, "#.*$", "")


def page_key(url: Column) -> Column:
    """One form for all URLs of a listing page, as a key to compare them by.

    Scheme and host are in lower case, parameters in order, and what asks for the first page is left out, as are the fragment, blank
    parameters and the slash at the end of the path.
    """

    def key(p: Column) -> Column:
        path = F.regexp_replace(F.regexp_replace(p["path"], fixed.FIRST_PAGE_PATH, "/"), "/+$", "")
        named = F.filter(F.split(p["query"], "&"), lambda q: (q != "") & ~q.rlike(fixed.FIRST_PAGE_PARAMETER))
        return F.concat(p["scheme"], F.lit("://"), F.lower(p["host"]), path, F.lit("?"), F.array_join(F.array_sort(named), "&"))

    return let(_split_url(url), key)


def is_http(url: Column) -> Column:
    return url.rlike("^https?://")


def href_hint(href: Column) -> Column:
    """The link target looks like a listing."""
    return any_of(F.lower(href), fixed.CANDIDATE_HREF_HINTS)


# --- page numbers -------------------------------------------------------------------------------


def number(text: Column) -> Column:
    """Whole number of an all-digit text, else null."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def page_number(href: Column, pattern: str) -> Column:
    """Page number in a link target, by a pattern with one group."""
    return F.regexp_extract(href, pattern, 1).try_cast("bigint")


def page_label(text: Column) -> Column:
    """Number of the first ``Page 1,234`` in the text."""
    label = F.regexp_extract(text, fixed.PAGE_LABEL, 0)
    return number(F.replace(F.replace(label, F.lit("Page "), F.lit("")), F.lit(","), F.lit("")))


def page_number_near_words(text: Column, reach: int = 50, most: int | None = None) -> Column:
    """Largest number from 2, to ``most`` if given, whose first occurrence has a paging word nearby."""

    def largest(t: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?U)\b(\d+)\b"), F.lit(1)))
        value = lambda n: n.try_cast("bigint")
        in_range = F.filter(found, lambda n: (value(n) >= 2) & (F.lit(True) if most is None else value(n) <= most))

        def near(n: Column) -> Column:
            at = F.instr(t, n) - 1
            start = F.greatest(at - reach, F.lit(0))
            return any_of(F.lower(F.substring(t, start + 1, at + reach - start)), fixed.PAGE_WORDS)

        return F.array_max(F.transform(F.filter(in_range, near), lambda n: n.cast("bigint")))

    return let(text, largest)


def last_to_fetch(total: Column, cap: int | None = None, last_page: int | None = None) -> Column:
    """The last page to fetch of so many, within the limits."""
    limits = [F.lit(x).cast("bigint") for x in (cap, last_page) if x is not None]
    return F.least(total, *limits) if limits else total


def frontier(total: Column, make_url, cap: int | None = None, last_page: int | None = None) -> Column:
    """Pages still to fetch as ``array<struct<page_num, url>>``; empty if there is only one page."""
    bound = last_to_fetch(total, cap, last_page)
    return F.transform(
        F.when(bound >= 2, F.sequence(F.lit(2).cast("bigint"), bound)).otherwise(
            F.array().cast("array<bigint>")
        ),
        lambda n: F.struct(n.cast("int").alias("page_num"), make_url(n).alias("url")),
    )


def parameter_url(base: Column, n: Column, name: str = "page") -> Column:
    """``?page=n``, or ``&page=n`` if the URL has parameters already."""
    separator = F.when(F.contains(base, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.concat(base, separator, F.lit(f"{name}="), n.cast("string"))


def query_url(base: Column, n: Column, name: str = "page") -> Column:
    """``?page=n`` without looking at the URL."""
    return F.concat(base, F.lit(f"?{name}="), n.cast("string"))


def path_url(base: Column, n: Column) -> Column:
    """``page/n/`` below the URL."""
    return F.concat(base, F.lit("page/"), n.cast("string"), F.lit("/"))


def offset_url(base: Column, n: Column, step: int = 10) -> Column:
    """``?start=`` with the number of listings before the page."""
    return F.concat(base, F.lit("?start="), (F.lit(step) * (n - 1)).cast("string"))

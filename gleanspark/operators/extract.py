"""Listings of a page, as arrays of structs computed inside the page's own row.

Every extractor maps the node array of a page to ``array<struct<ROW>>``. Positions are numbered
before rows are dropped, and no step needs a shuffle. A page gives all its listings and whole texts;
limits are settings of a site (``site["limits"]``, none by default) and are counted after rows are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..functions import dates
from ..functions.arrays import any_of, first, first_by, let
from ..functions.text import cut, lead_lines, lines, or_default, py_strip, split_title
from ..functions.urls import href_hint, is_http, resolve_url
from . import nodes as N
from .css import parse, select_css
from .parts import KIND, Finder, Parts
from .reader import FIRST_PASS, LINK, LISTING, SCRIPT, THIRD_PASS

FIELDS = {
    "pos": "int",
    "title": "string",
    "company": "string",
    "location": "string",
    "category": "string",
    "expiry_text": "string",
    "expiry_date": "date",
    "description": "string",
    "job_url": "string",
    "detail_url": "string",
}
ROW = "struct<" + ",".join(f"{name}:{kind}" for name, kind in FIELDS.items()) + ">"


def row(**values: Column) -> Column:
    """One listing; fields that are not given are null."""
    fields = [
        values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in FIELDS.items()
    ]
    return F.struct(*fields)


def limit(site: dict, name: str) -> int | None:
    """A limit that the site sets; None where it sets none."""
    return site.get("limits", {}).get(name)


def _first_rows(rows: Column, most: int | None) -> Column:
    return rows if most is None else F.slice(rows, 1, most)


def none() -> Column:
    return F.array().cast(f"array<{ROW}>")


def _or(found: Column, otherwise: Column) -> Column:
    """The second array where the first is empty."""
    return F.when(F.size(found) > 0, found).otherwise(otherwise)


def first_alternative(*choices: Column) -> Column:
    """First array that is not empty."""
    head, *rest = choices
    return let(head, lambda c: _or(c, first_alternative(*rest))) if rest else head


def place(text: Column, places: list[str] = fixed.PLACES, whole_word: bool = True) -> Column:
    """First place of the list, in list order, that the text names; null without one."""
    if whole_word:
        named = [F.when(text.rlike(rf"(?iU)\b{re.escape(p)}\b"), F.lit(p)) for p in places]
        return F.coalesce(*named)
    return let(
        F.lower(text),
        lambda t: F.coalesce(*[F.when(F.contains(t, F.lit(p.lower())), F.lit(p)) for p in places]),
    )


def labelled_field(text: Column, labels: list[str], most: int | None = None) -> Column:
    """Value after ``Label:`` on the same line, cut at ``most`` characters if given; null without one."""
    longest = "" if most is None else most
    pattern = rf"(?iU)(?:{'|'.join(labels)})\s*[:\-]\s*([^\n\r]{{2,{longest}}})"
    return py_strip(dates.extract_or_null(text, pattern, 1))


def looks_like_job(text: Column) -> Column:
    """Long enough, with a job word, on at least two lines."""
    enough = (F.length(text) >= 20) & (F.size(lines(text, "\n")) >= 2)
    return enough & any_of(F.lower(text), fixed.JOB_TEXT_WORDS)


# --- cards --------------------------------------------------------------------------------------


Keep = Callable[[Column], Column]


def _dated(rows: Column, date: Callable[[Column], Column], keep: Keep | None) -> Column:
    """What is read of each row first, with its ``day``; the rest is read of those only whose day is kept."""
    dated = F.transform(rows, lambda r: r.withField("day", date(r)))
    return dated if keep is None else F.filter(dated, lambda r: keep(r["day"]))


def cards(nodes: Column, site: dict, keep: Keep | None = None) -> Column:
    """Linked cards with title, company, description and a footer of icons; all, or those whose expiry date is to be kept."""

    def footer_text(card: Column, icon: str) -> Column:
        footer = first(N.select(N.descendants(nodes, card), "div", "job-listing-footer"))
        mark = first(N.select(N.descendants(nodes, footer), "i", icon))
        return N.trimmed_text(nodes, N.ancestor(nodes, mark, "li"))

    def part(card: Column, tag: str, cls: str) -> Column:
        return N.trimmed_text(nodes, first(N.select(N.descendants(nodes, card), tag, cls)))

    def read(card: Column, i: Column) -> Column:
        return F.struct(
            (i + 1).alias("pos"),
            card.alias("card"),
            footer_text(card, "icon-material-outline-access-time").alias("expiry"),
        )

    def finish(c: Column) -> Column:
        href = F.nullif(N.attr(c["card"], "href"), F.lit(""))
        return row(
            pos=c["pos"],
            title=part(c["card"], "h3", "job-listing-title"),
            company=part(c["card"], "h4", "job-listing-company"),
            location=footer_text(c["card"], "icon-material-outline-location-on"),
            expiry_text=c["expiry"],
            expiry_date=c["day"],
            description=part(c["card"], "p", "job-listing-text"),
            job_url=href,
            detail_url=resolve_url(site["base_url"], href),
        )

    found = F.transform(N.select(nodes, "a", "job-listing"), read)
    return F.transform(_dated(found, lambda c: dates.parse_expiry(c["expiry"], site.get("expiry_mode", "strict")), keep), finish)


def card_parts(site: dict) -> Parts:
    """``cards`` from the texts that the worker finds."""

    def finish(c: Column) -> dict[str, Column]:
        return {
            "expiry_date": dates.parse_expiry(c["expiry_text"], site.get("expiry_mode", "strict")),
            "detail_url": resolve_url(site["base_url"], c["job_url"]),
        }

    return Parts("cards", finish)


def cards_alt(nodes: Column, site: dict) -> Column:
    """Cards of the earlier layout: every field has two alternatives, none has an expiry."""

    def part(card: Column, *choices: dict) -> Column:
        below = N.descendants(nodes, card)
        found = [first(N.select(below, **choice)) for choice in choices]
        return N.trimmed_text(nodes, F.coalesce(*found))

    def read(card: Column, i: Column) -> Column:
        company = part(card, dict(tag="span", cls="company"), dict(tag="a", cls="turnstileLink"))
        location = part(
            card, dict(tag="div", cls="recJobLoc"), dict(tag="div", cls="companyLocation")
        )
        description = part(card, dict(tag="div", cls="summary"))
        return row(
            pos=i + 1,
            title=part(card, dict(tag="h2", cls="title"), dict(tag="a", has="data-jk")),
            company=company,
            location=F.coalesce(location, F.lit(site["location"])),
            description=F.coalesce(description, F.lit(fixed.ALT_DESCRIPTION)),
        )

    found = first_alternative(
        N.select(nodes, "div", "jobsearch-SerpJobCard"), N.select(nodes, "div", "job_seen_beacon")
    )
    return F.transform(found, read)


# --- headings -----------------------------------------------------------------------------------


def headings(nodes: Column, site: dict, keep: Keep | None = None) -> Column:
    """Every ``h3`` with its parent's text as the source of date and place; all, or those whose expiry date is to be kept."""

    def read(h: Column, i: Column) -> Column:
        link = first(N.select(N.descendants(nodes, h), "a"))
        around = N.joined_text(nodes, N.parent(nodes, h), " ")
        return F.struct(
            (i + 1).alias("pos"),
            N.joined_text(nodes, h).alias("title"),
            F.nullif(N.attr(link, "href"), F.lit("")).alias("href"),
            around.alias("around"),
        )

    def finish(h: Column) -> Column:
        title, company = split_title(h["title"])
        return row(
            pos=h["pos"],
            title=title,
            company=company,
            location=F.coalesce(place(h["around"]), F.lit(site["location"])),
            expiry_text=dates.expiry_label(h["day"]),
            expiry_date=h["day"],
            description=F.lit(fixed.HEADINGS_DESCRIPTION),
            job_url=h["href"],
            detail_url=resolve_url(site["base_url"], h["href"]),
        )

    found = F.filter(
        F.transform(N.select(nodes, "h3"), read), lambda h: F.length(h["title"]) >= 5
    )
    return F.transform(_dated(found, lambda h: dates.parse_expiry(dates.listed_date_text(h["around"])), keep), finish)


def heading_parts(site: dict) -> Parts:
    """``headings`` from the texts that the worker finds."""

    def finish(h: Column) -> dict[str, Column]:
        title, company = split_title(h["title"])
        day = dates.parse_expiry(dates.listed_date_text(h["text"]))
        return {
            "title": title,
            "company": company,
            "location": F.coalesce(place(h["text"]), F.lit(site["location"])),
            "expiry_text": dates.expiry_label(day),
            "expiry_date": day,
            "description": F.lit(fixed.HEADINGS_DESCRIPTION),
            "detail_url": resolve_url(site["base_url"], h["job_url"]),
        }

    return Parts("headings", finish)


# --- JSON-LD ------------------------------------------------------------------------------------


def _variant(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def _is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _is_posting(value: Column) -> Column:
    return F.coalesce(_variant(value, "$['@type']", "string") == "JobPosting", F.lit(False))


def json_values(nodes: Column) -> Column:
    """Embedded JSON-LD scripts as variants; null where a script is not valid JSON.

    Of a repeated key the last value counts, by the session setting that ``shred`` makes.
    """
    return F.transform(N.json_ld(nodes), lambda t: F.try_parse_json(t))


def _posting(v: Column, site: dict) -> Column:
    """The listing of a ``JobPosting`` object; null where a field has an unexpected type."""

    def string_or(value: Column, path: str, default: str) -> Column:
        """Default where absent, null where present but not a string."""
        found = _variant(value, path)
        return F.when(found.isNull(), F.lit(default)).when(
            _is_string(found), _variant(value, path, "string")
        )

    def below(value: Column, path: str) -> Column:
        """The field is absent or an object."""
        return let(_variant(value, path), lambda v: v.isNull() | _is_object(v))

    locality = _variant(v, "$.jobLocation.address.addressLocality")
    whole = (
        below(v, "$.hiringOrganization")
        & below(v, "$.jobLocation")
        & below(v, "$.jobLocation.address")
    )
    found = F.when(
        whole,
        row(
            pos=F.lit(1),
            title=string_or(v, "$.title", fixed.JSONLD_TITLE),
            company=string_or(v, "$.hiringOrganization.name", site["company"]),
            location=F.when(locality.isNull(), F.lit(site["location"])).otherwise(
                _variant(v, "$.jobLocation.address.addressLocality", "string")
            ),
            description=string_or(v, "$.description", fixed.JSONLD_DESCRIPTION),
        ),
    )
    return let(
        found,
        lambda r: F.when(r["title"].isNotNull() & r["company"].isNotNull() & r["description"].isNotNull(), r),
    )


def jsonld(nodes: Column, site: dict) -> Column:
    """``JobPosting`` objects, one per script. Fields of an unexpected type drop the posting."""
    postings = F.filter(json_values(nodes), lambda v: _is_object(v) & _is_posting(v))
    return F.filter(F.transform(postings, lambda v: _posting(v, site)), lambda r: r.isNotNull())


REJECT = "struct<part:string,pos:int,reason:string,text:string>"


def reject(part: str, reason: str | Column, pos: Column | None = None, text: Column | None = None) -> Column:
    """What could not be read: a ``page``, a ``script`` or a ``row``, its place in the page, why, and its text."""
    reason = F.lit(reason) if isinstance(reason, str) else reason
    values = {"part": F.lit(part), "pos": F.lit(None) if pos is None else pos, "reason": reason, "text": F.lit(None) if text is None else text}
    return F.struct(*[v.cast("int" if n == "pos" else "string").alias(n) for n, v in values.items()])


def script_rejects(nodes: Column, site: dict) -> Column:
    """JSON-LD scripts that are no JSON, and postings that are dropped for a field's type, as ``array<struct<REJECT>>``."""

    def read(text: Column, i: Column) -> Column:
        def judge(v: Column) -> Column:
            odd = _is_object(v) & _is_posting(v) & _posting(v, site).isNull()
            return F.when(v.isNull(), F.lit("no json")).when(odd, F.lit("field of an unexpected type"))

        return reject("script", let(F.try_parse_json(text), judge), i + 1, text)

    return F.filter(F.transform(N.json_ld(nodes), read), lambda r: r["reason"].isNotNull())


def generic(nodes: Column, site: dict) -> Column:
    """Any element that looks like a job: first line as title, no expiry."""
    kinds = [
        N.select(nodes, tag, has=has, matches=matches) for tag, has, matches in fixed.GENERIC_ELEMENTS
    ]
    texts = F.transform(F.concat(*kinds), lambda n: N.joined_text(nodes, n))
    kept = _first_rows(F.filter(texts, looks_like_job), limit(site, "generic"))

    def read(t: Column, i: Column) -> Column:
        return row(
            pos=i + 1,
            title=first(lines(t, "\n")),
            company=F.lit(site["company"]),
            location=F.lit(site["location"]),
            description=lead_lines(t),
        )

    return F.transform(kept, read)


def placeholder() -> Column:
    """The constant row of a page without any listing; its category is given."""
    values = {name: F.lit(value) for name, value in fixed.PLACEHOLDER.items()}
    return F.array(row(pos=F.lit(1), **values))


def jsonld_or_placeholder(nodes: Column, site: dict) -> Column:
    """JSON-LD postings, else job-like elements, else one placeholder per readable page."""
    rows = first_alternative(jsonld(nodes, site), generic(nodes, site), placeholder())
    return F.when(F.size(nodes) > 0, rows).otherwise(none())


# --- candidates ---------------------------------------------------------------------------------


def candidate_nodes(nodes: Column, selectors: list[str] = fixed.CANDIDATE_SELECTORS) -> Column:
    """Elements found by CSS selectors in selector order, then parents of job-like links."""
    linked = F.filter(N.select(nodes, "a", has="href"), lambda a: href_hint(N.attr(a, "href")))
    found = [select_css(nodes, selector) for selector in selectors]
    return F.concat(*found, F.transform(linked, lambda a: N.parent(nodes, a)))


def unique_candidates(nodes: Column, selectors: list[str] = fixed.CANDIDATE_SELECTORS) -> Column:
    """Candidates with text, the first for each text: ``struct<node, text>``."""
    # an element found twice has the same text, so dropping repeats first saves reading it again
    elements = first_by(candidate_nodes(nodes, selectors), lambda n: n["pre"])
    read = F.transform(
        elements, lambda n: F.struct(n.alias("node"), N.joined_text(nodes, n, " ").alias("text"))
    )
    return first_by(F.filter(read, lambda c: c["text"] != ""), lambda c: c["text"])


def company_near(nodes: Column, element: Column, default: str) -> Column:
    """Company from ``small`` or a company class, else the second line, else the default."""
    below = N.descendants(nodes, element)
    tag = F.coalesce(
        first(N.select(below, "small")),
        first(N.select(below, "span", matches={"class": fixed.COMPANY_CLASS})),
    )

    def second_line(found: Column) -> Column:
        line = F.get(found, F.lit(1))
        usable = (F.length(line) < 120) & ~F.lower(line).startswith("posted")
        return F.when(usable, line)

    return F.coalesce(
        F.nullif(N.joined_text(nodes, tag), F.lit("")),
        let(lines(N.joined_text(nodes, element, "\n")), second_line),
        F.lit(default),
    )


def candidates(nodes: Column, site: dict) -> Column:
    """Job-like elements, all of them looked up unless the site limits that.

    Limits: ``title`` characters of a text that stands for a title, ``candidates`` rows, ``looked_up`` rows.
    """
    title_most, looked_up = limit(site, "title"), limit(site, "looked_up")

    def locate(c: Column, i: Column) -> Column:
        link = first(N.select(N.descendants(nodes, c["node"]), "a", has="href"))
        return F.struct(
            (i + 1).alias("pos"),
            c["node"].alias("node"),
            c["text"].alias("text"),
            link.alias("link"),
        )

    def name(c: Column) -> Column:
        heading = first(
            N.select(N.descendants(nodes, c["node"]), ["h1", "h2", "h3", "h4"])
        )
        title = F.when(c["link"].isNotNull(), N.joined_text(nodes, c["link"], " ")).otherwise(
            F.coalesce(N.joined_text(nodes, heading, " "), cut(c["text"], title_most))
        )
        url = F.when(
            c["link"].isNotNull(),
            resolve_url(site["base_url"], py_strip(N.attr(c["link"], "href"))),
        )
        return F.struct(
            c["pos"], c["node"], c["text"], title.alias("title"), url.alias("url")
        )

    def finish(c: Column, i: Column) -> Column:
        expiry = dates.posted_expiry(dates.posted_text(c["text"]))
        return row(
            pos=c["pos"],
            title=c["title"],
            company=company_near(nodes, c["node"], site["company"]),
            location=F.coalesce(place(c["text"], whole_word=False), F.lit(site["location"])),
            expiry_text=dates.expiry_label(expiry),
            expiry_date=expiry,
            description=c["text"],
            job_url=c["url"],
            detail_url=c["url"] if looked_up is None else F.when(i < looked_up, c["url"]),
        )

    named = F.transform(F.transform(unique_candidates(nodes, site.get("selectors", fixed.CANDIDATE_SELECTORS)), locate), name)
    # one row per URL before short titles are dropped; rows without a URL all stay
    by_url = first_by(named, lambda c: F.coalesce(c["url"], F.concat(F.lit("#"), c["pos"])))
    kept = _first_rows(min_title(by_url), limit(site, "candidates"))
    return F.transform(kept, finish)


def min_title(rows: Column, least: int = 3) -> Column:
    """Rows whose title has at least ``least`` characters."""
    return F.filter(rows, lambda c: F.length(c["title"]) >= least)


def link_fallback(nodes: Column, site: dict) -> Column:
    """The job links of a page, with constants for all other fields."""
    links = F.filter(
        N.select(nodes, "a", has="href"), lambda a: F.contains(N.attr(a, "href"), F.lit("/job/"))
    )

    def read(a: Column, i: Column) -> Column:
        return row(
            pos=i + 1,
            title=or_default(N.joined_text(nodes, a), fixed.LINK_TITLE),
            company=F.lit(site["company"]),
            location=F.lit(site["location"]),
            description=F.lit(fixed.LINK_DESCRIPTION),
            job_url=resolve_url(site["base_url"], N.attr(a, "href")),
        )

    return F.transform(_first_rows(links, limit(site, "links")), read)


def candidates_or_links(nodes: Column, site: dict) -> Column:
    return first_alternative(candidates(nodes, site), link_fallback(nodes, site))


def candidate_parts(site: dict) -> Parts:
    """``candidates_or_links`` from the texts that the worker finds: URLs are compared here, so rows are chosen here."""
    looked_up = limit(site, "looked_up")

    def arrange(items: Column) -> Column:
        def of_kind(kind: int) -> Column:
            return F.filter(items, lambda c: c[KIND] == kind)

        def with_url(c: Column) -> Column:
            return c.withField("job_url", resolve_url(site["base_url"], c["job_url"]))

        def placed(c: Column, i: Column) -> Column:
            return c.withField("detail_url", c["job_url"] if looked_up is None else F.when(i < looked_up, c["job_url"]))

        by_url = first_by(F.transform(of_kind(LISTING), with_url), lambda c: F.coalesce(c["job_url"], F.concat(F.lit("#"), c["pos"])))
        kept = F.transform(_first_rows(min_title(by_url), limit(site, "candidates")), placed)
        links = F.transform(_first_rows(of_kind(LINK), limit(site, "links")), lambda c, i: with_url(c).withField("pos", i + 1))
        return first_alternative(kept, links)

    def finish(c: Column) -> dict[str, Column]:
        is_link = c[KIND] == LINK
        expiry = F.when(~is_link, dates.posted_expiry(dates.posted_text(c["text"])))
        return {
            "title": F.when(is_link, or_default(c["title"], fixed.LINK_TITLE)).otherwise(c["title"]),
            "company": F.when(is_link, F.lit(site["company"])).otherwise(c["company"]),
            "location": F.coalesce(F.when(~is_link, place(c["text"], whole_word=False)), F.lit(site["location"])),
            "expiry_text": dates.expiry_label(expiry),
            "expiry_date": expiry,
            "description": F.when(is_link, F.lit(fixed.LINK_DESCRIPTION)).otherwise(c["text"]),
        }

    selectors = [
        [[(combinator, c.tag, c.classes, c.attributes) for combinator, c in chain] for chain in parse(selector)]
        for selector in site.get("selectors", fixed.CANDIDATE_SELECTORS)
    ]
    given = {
        "selectors": selectors,
        "href_hints": fixed.CANDIDATE_HREF_HINTS,
        "company_class": fixed.COMPANY_CLASS,
        "company": site["company"],
        "title": limit(site, "title"),
        "rows": limit(site, "candidates"),
    }
    return Parts("candidates", finish, given, arrange)


# --- links to detail pages ----------------------------------------------------------------------


def likely_job_link(nodes: Column, link: Column) -> Column:
    """Link target, link text or a near ancestor hints at a job, or the text is long."""
    text = link["text"]
    return (
        any_of(F.lower(link["href"]), fixed.LINK_HREF_HINTS)
        | any_of(F.lower(text), fixed.LINK_TEXT_HINTS)
        | (F.length(text) >= 25)
        | N.ancestor_hint(nodes, link, "|".join(fixed.ANCESTOR_HINTS))
    )


def _links(base: str, links: Column) -> Column:
    found = F.transform(
        links,
        lambda a: F.struct(resolve_url(base, a["href"]).alias("url"), a["text"].alias("text")),
    )
    return F.filter(found, lambda a: is_http(a["url"]))


def first_pass_links(nodes: Column, anchors: Column, base: str) -> Column:
    return _links(base, F.filter(anchors, lambda a: likely_job_link(nodes, a)))


def second_pass_links(nodes: Column, base: str) -> Column:
    """URLs of JSON-LD postings, single or in a list."""
    return _posting_links(json_values(nodes), base)


def _posting_links(values: Column, base: str) -> Column:

    def of(v: Column, *names: str) -> Column:
        values = [F.nullif(F.when(_is_string(_variant(v, f"$.{n}")), _variant(v, f"$.{n}", "string")), F.lit("")) for n in names]
        title = F.nullif(_variant(v, "$.title", "string"), F.lit(""))
        return F.when(
            _is_object(v) & _is_posting(v),
            F.struct(
                F.coalesce(*values).alias("url"),
                F.coalesce(title, F.lit(fixed.JSONLD_LINK_TEXT)).alias("text"),
            ),
        )

    def of_script(v: Column) -> Column:
        several = _variant(v, "$", "array<variant>")
        single = F.array(of(v, "url", "sameAs", "link"))
        return F.when(_is_object(v), single).when(
            several.isNotNull(), F.transform(several, lambda item: of(item, "url", "sameAs"))
        )

    scripts = F.filter(F.transform(values, of_script), lambda s: s.isNotNull())
    found = F.filter(F.flatten(scripts), lambda s: s["url"].isNotNull())
    return F.transform(found, lambda s: s.withField("url", resolve_url(base, s["url"])))


def third_pass_links(anchors: Column, base: str) -> Column:
    """Longer link texts with a job word in target or text."""

    def fits(a: Column) -> Column:
        href, text = F.lower(a["href"]), F.lower(a["text"])
        named = any_of(href, ["job", "careers"]) | any_of(text, ["vacancy", "apply"])
        return (F.length(a["text"]) >= 12) & named

    return _links(base, F.filter(anchors, fits))


def harvest_links(nodes: Column, site: dict, few: int = 5) -> Column:
    """Links to detail pages in three passes, as ``array<struct<url, text>>``, first per URL."""
    base = site["base_url"]

    def passes(anchors: Column) -> Column:
        return _three_passes(
            first_pass_links(nodes, anchors, base), second_pass_links(nodes, base), third_pass_links(anchors, base), few
        )

    found = let(N.anchors(nodes), passes)
    return _first_rows(first_by(found, lambda a: a["url"]), limit(site, "harvested"))


def _three_passes(one: Column, two: Column, three: Column, few: int) -> Column:
    """What the first pass finds, else the second, with the third's where that is few."""

    def add_third(found: Column) -> Column:
        return F.coalesce(F.when(F.size(found) < few, F.concat(found, three)), found)

    return let(first_alternative(first_by(one, lambda a: a["url"]), first_by(two, lambda a: a["url"])), add_third)


def harvested(nodes: Column, site: dict) -> Column:
    """Harvested links as listings that only have a title and a detail page so far."""
    return F.transform(
        harvest_links(nodes, site),
        lambda a, i: row(pos=i + 1, title=a["text"], job_url=a["url"], detail_url=a["url"]),
    )


def harvested_parts(site: dict, few: int = 5) -> Parts:
    """``harvested`` from the links and scripts that the worker finds."""
    base = site["base_url"]

    def arrange(items: Column) -> Column:
        def taken(bit: int) -> Column:
            links = F.filter(items, lambda a: (a[KIND] != SCRIPT) & (a[KIND].bitwiseAND(bit) != 0))
            return _links(base, F.transform(links, lambda a: F.struct(a["job_url"].alias("href"), a["title"].alias("text"))))

        scripts = F.transform(F.filter(items, lambda a: a[KIND] == SCRIPT), lambda a: F.try_parse_json(a["text"]))
        found = _three_passes(taken(FIRST_PASS), _posting_links(scripts, base), taken(THIRD_PASS), few)
        kept = _first_rows(first_by(found, lambda a: a["url"]), limit(site, "harvested"))
        listed = F.transform(kept, lambda a, i: row(pos=i + 1, title=a["text"], job_url=a["url"], detail_url=a["url"]))
        return as_parts(listed)

    given = {
        "href_hints": fixed.LINK_HREF_HINTS,
        "text_hints": fixed.LINK_TEXT_HINTS,
        "ancestor_hints": fixed.ANCESTOR_HINTS,
        "on_http": bool(re.match("(?i)https?://", base)),
    }
    return Parts("harvested", lambda a: {}, given, arrange)


def as_parts(rows: Column) -> Column:
    """Listings that are read already, as parts that nothing is to be added to."""
    more = [F.lit(LISTING).alias(KIND), F.lit(None).cast("string").alias("text")]
    return F.transform(rows, lambda r: F.struct(*[r[name].alias(name) for name in FIELDS], *more))


def _heading(nodes: Column) -> Column:
    return N.joined_text(nodes, first(N.select(nodes, ["h1", "h2", "h3"])))


def _meta(nodes: Column) -> Column:
    return N.meta_content(nodes, fixed.NAME_METAS)


def _content(nodes: Column) -> Column:
    return N.joined_text(nodes, content_block(nodes), " ")


def detail_record(nodes: Column, limits: dict[str, int] | None = None) -> Column:
    """Title, company, location, expiry and description of a detail page; null where not found."""
    return record_finder(limits)(nodes)


def record_finder(limits: dict[str, int] | None = None) -> Finder:
    """``detail_record`` as a finder."""
    sources = {"heading": _heading, "meta": _meta, "lined": lambda nodes: N.page_text(nodes, "\n"), "content": _content}
    return Finder(sources, lambda heading, meta, lined, content: _record(heading, meta, lined, content, limits or {}))


def _record(heading: Column, meta: Column, lined: Column, content: Column, limits: dict[str, int]) -> Column:

    def labelled(text: Column) -> Column:
        return F.struct(
            labelled_field(text, fixed.COMPANY_LABELS, limits.get("company")).alias("company"),
            labelled_field(text, fixed.LOCATION_LABELS, limits.get("location")).alias("location"),
            dates.posted_expiry(dates.detail_date_text(text)).alias("expiry_date"),
        )

    def finish(found: Column) -> Column:
        company = F.coalesce(found["company"], py_strip(F.nullif(meta, F.lit(""))))
        return F.struct(
            F.nullif(heading, F.lit("")).alias("title"),
            company.alias("company"),
            found["location"],
            dates.expiry_label(found["expiry_date"]).alias("expiry_text"),
            found["expiry_date"],
            content.alias("description"),
        )

    return let(let(lined, labelled), finish)


def content_block(nodes: Column) -> Column:
    """Element that holds the main text of a detail page."""
    return F.coalesce(
        first(N.select(nodes, "div", matches={"class": fixed.CONTENT_CLASS})),
        first(N.select(nodes, "article")),
        first(N.select(nodes, "div", matches={"id": fixed.CONTENT_ID})),
    )


Extractor = Callable[[Column, dict], Column]

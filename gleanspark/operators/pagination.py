"""How many pages a site has, read from the links and the text of one page. A cap is a site's choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..functions.arrays import first, let
from ..functions.urls import number, page_label, page_number, page_number_near_words
from . import nodes as N


def _largest(*numbers: Column, cap: int | None = None) -> Column:
    largest = F.greatest(F.lit(1).cast("bigint"), *numbers)
    return largest if cap is None else F.least(largest, F.lit(cap).cast("bigint"))


def _link_numbers(nodes: Column, links: Column, patterns: list[str], read=N.joined_text) -> Column:
    """Largest number in texts and targets of links; ``read`` gives the text of a link."""

    def of(a: Column) -> Column:
        found = [number(read(nodes, a))]
        found += [page_number(N.attr(a, "href"), p) for p in patterns]
        return F.array_max(F.array(*found))

    return F.array_max(F.transform(links, of))


def in_pagination(nodes: Column, cap: int | None = None) -> Column:
    """Links of the pagination block only: number, else a "last" link, else ``page=``."""
    block = F.coalesce(*[first(N.select(nodes, tag, "pagination")) for tag in ("ul", "div", "nav")])

    def of(a: Column) -> Column:
        text, href = N.joined_text(nodes, a), N.attr(a, "href")
        named_last = F.contains(F.lower(text), F.lit("last")) & (F.coalesce(href, F.lit("")) != "")
        return (
            F.when(text.rlike("^[0-9]+$"), number(text))
            .when(named_last, page_number(href, fixed.PAGE_OF_LAST))
            .otherwise(page_number(href, fixed.PAGE_PARAMETER))
        )

    links = let(block, lambda b: N.select(N.descendants(nodes, b), "a"))
    return _largest(F.array_max(F.transform(links, of)), cap=cap)


def in_links_and_label(nodes: Column, cap: int | None = None) -> Column:
    """All links by text or ``/page/n/``, and a ``Page 1,234`` label."""
    links = N.select(nodes, "a", has="href")
    return _largest(
        _link_numbers(nodes, links, [fixed.PAGE_IN_PATH], N.trimmed_text), page_label(N.page_text(nodes)), cap=cap
    )


def in_links(nodes: Column, cap: int | None = None) -> Column:
    """All links by text or ``page=``."""
    links = N.select(nodes, "a", has="href")
    return _largest(_link_numbers(nodes, links, [fixed.PAGE_PARAMETER]), cap=cap)


def in_links_and_text(nodes: Column, cap: int | None = None, near_words: int | None = None) -> Column:
    """All links by text or ``/page/n/``, a pagination block, and numbers near paging words."""
    links = N.select(nodes, "a", has="href")
    block = first(N.select(nodes, "div", matches={"class": "(?i)pagination"}))
    in_block = let(block, lambda b: N.select(N.descendants(nodes, b), "a"))
    return _largest(
        _link_numbers(nodes, links, [fixed.PAGE_IN_PATH]),
        _link_numbers(nodes, in_block, []),
        page_number_near_words(N.page_text(nodes), most=near_words),
        cap=cap,
    )


def in_links_by_path_or_parameter(nodes: Column, cap: int | None = None) -> Column:
    """All links by text, ``/page/n/``, ``page=`` or ``paged=``."""
    links = N.select(nodes, "a", has="href")
    return _largest(
        _link_numbers(nodes, links, [fixed.PAGE_IN_PATH, fixed.PAGE_OR_PAGED]), cap=cap
    )


def in_np_block(nodes: Column, cap: int | None = None) -> Column:
    """Numbered links of the ``np`` block."""
    block = F.coalesce(*[first(N.select(nodes, tag, "np")) for tag in ("nav", "div")])
    links = let(block, lambda b: N.select(N.descendants(nodes, b), "a"))
    return _largest(_link_numbers(nodes, links, [], N.trimmed_text), cap=cap)

"""Site profiles: adding a site is adding a profile."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..functions import emails, urls
from ..operators import extract, pagination
from ..operators import nodes as N
from ..operators.parts import Finder, Parts


@dataclass(frozen=True)
class SiteProfile:
    """How the pages of one site are read.

    ``rows`` maps the nodes of a listing page to listings, ``total_pages`` to the number of pages,
    and ``contact`` maps the nodes of a detail page to an address. Without ``contact`` no detail page
    is looked up; with ``detail_record`` the detail page makes the whole listing. ``limits`` cut rows,
    characters and page numbers (``fixed.LIMITS`` has those of the built-in sites); without them all are kept. ``rejects`` maps the
    nodes of a listing page to the parts of it that ``rows`` cannot read. ``current_rows`` gives the rows whose expiry date passes a
    test, without reading the others whole; it goes with ``rows``, and ``filter_current`` holds without it too. ``parts`` gives the same
    rows from what the worker finds, without nodes; it goes with ``rows`` too.
    """

    name: str
    site: str
    base_url: str
    id_prefix: str
    rows: Callable[[Column], Column]
    total_pages: Callable[[Column], Column]
    page_url: Callable[[Column, Column], Column]
    contact: Callable[[Column], Column] | None = None
    default_contact: str = fixed.MISSING
    detail_record: bool = False
    filter_current: bool = False
    on_unparsed: str = "drop"
    classifier: str = "weighted"
    limits: dict[str, int] = field(default_factory=dict)
    rejects: Callable[[Column], Column] | None = None
    current_rows: Callable[[Column, Callable[[Column], Column]], Column] | None = None
    parts: Parts | None = None

    @property
    def host(self) -> str:
        return self.base_url.split("/")[2]

    @property
    def base_path(self) -> str:
        return "/" + self.base_url.split("?")[0].split("/", 3)[3].rstrip("/")

    def with_(self, **changes) -> SiteProfile:
        if "rows" in changes:
            changes.setdefault("current_rows", None)
            changes.setdefault("parts", None)
        return replace(self, **changes)


def _hrefs(nodes: Column) -> Column:
    return F.transform(N.select(nodes, "a", has="href"), lambda a: N.attr(a, "href"))


_plain = Finder({"text": N.page_text}, lambda text: emails.first_email(text))
_in_context = Finder({"text": N.page_text}, lambda text: emails.contextual_email(text))
_linked = Finder(
    {"hrefs": _hrefs, "spaced": lambda nodes: N.page_text(nodes, " ")},
    lambda hrefs, spaced: emails.link_or_text_email(hrefs, spaced),
)


def _profile(
    limits: dict, name: str, rows: extract.Extractor, site: dict | None = None, parts: Callable[[dict], Parts] | None = None, **options
) -> SiteProfile:
    values = {**(site or fixed.SITES[name]), "limits": limits.get(name, {})}
    return SiteProfile(
        name=name,
        site=values["site"],
        base_url=values["base_url"],
        id_prefix=values["id_prefix"],
        default_contact=values["contact"],
        limits=values["limits"],
        rows=lambda nodes: rows(nodes, values),
        current_rows=(lambda nodes, keep: rows(nodes, values, keep)) if options.get("filter_current") else None,
        parts=parts(values) if parts else None,
        **options,
    )


def builtin_profiles(limits: dict[str, dict[str, int]] | None = None) -> dict[str, SiteProfile]:
    """The five current profiles and the three earlier ones; ``limits`` by profile, such as ``fixed.LIMITS``."""
    limits = limits or {}
    make = partial(_profile, limits)
    early = dict(classifier="first")
    in_text = partial(pagination.in_links_and_text, near_words=limits.get("candidates", {}).get("near_words"))
    early_cards = {**fixed.SITES["cards"], "expiry_mode": "lenient"}
    alt = dict(
        total_pages=pagination.in_np_block,
        page_url=urls.offset_url,
        **early,
    )
    profiles = [
        make(
            "cards",
            extract.cards,
            parts=extract.card_parts,
            total_pages=pagination.in_pagination,
            page_url=urls.parameter_url,
            contact=_plain,
            filter_current=True,
        ),
        make(
            "headings",
            extract.headings,
            parts=extract.heading_parts,
            total_pages=pagination.in_links_and_label,
            page_url=urls.path_url,
            contact=_plain,
            filter_current=True,
        ),
        make(
            "jsonld",
            extract.jsonld_or_placeholder,
            total_pages=pagination.in_links,
            page_url=urls.query_url,
            rejects=lambda nodes: extract.script_rejects(nodes, fixed.SITES["jsonld"]),
        ),
        make(
            "candidates",
            extract.candidates_or_links,
            parts=extract.candidate_parts,
            total_pages=in_text,
            page_url=urls.path_url,
            contact=_in_context,
        ),
        make(
            "link_detail",
            extract.harvested,
            parts=extract.harvested_parts,
            total_pages=pagination.in_links_by_path_or_parameter,
            page_url=lambda base, n: urls.query_url(base, n, "paged"),
            contact=_linked,
            detail_record=True,
        ),
        make(
            "cards_lenient",
            extract.cards,
            early_cards,
            parts=extract.card_parts,
            total_pages=pagination.in_pagination,
            page_url=urls.parameter_url,
            contact=_plain,
            filter_current=True,
            on_unparsed="keep",
            **early,
        ),
        make("cards_alt", extract.cards_alt, **alt),
        make("cards_alt_second", extract.cards_alt, **alt),
    ]
    return {p.name: p for p in profiles}


CURRENT = ("cards", "headings", "jsonld", "candidates", "link_detail")


class Registry:
    """Profiles by name; unknown sites can be added, and built-in ones replaced."""

    def __init__(self, profiles: dict[str, SiteProfile] | None = None) -> None:
        self._profiles = dict(builtin_profiles() if profiles is None else profiles)

    def add(self, profile: SiteProfile) -> None:
        self._profiles[profile.name] = profile

    def __getitem__(self, name: str) -> SiteProfile:
        return self._profiles[name]

    def __iter__(self):
        return iter(self._profiles.values())

    def of_url(self, url: Column, profiles: list[SiteProfile]) -> Column:
        """The profile that reads a page: its host, then the longest base path the URL begins with; null for none."""
        chosen = F.lit(None).cast("string")
        for profile in sorted(reversed(profiles), key=lambda p: len(p.base_path)):
            fits = (urls.host(url) == profile.host) & F.startswith(urls.path(url), F.lit(profile.base_path))
            chosen = F.when(fits, F.lit(profile.name)).otherwise(chosen)
        return chosen

    def current(self) -> list[SiteProfile]:
        return [self._profiles[name] for name in CURRENT if name in self._profiles]

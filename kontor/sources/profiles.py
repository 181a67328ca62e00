"""Directory page layouts as data.

A profile says where entries and their fields sit in the page.  A rule is
(tags, attribute, pattern); several rules are tried in order.  New directories are
added with ``register``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

Rule = tuple


@dataclass(frozen=True)
class Profile:
    source: str
    base_url: str
    entries: list[Rule]
    name: list[Rule]
    street: list[Rule] = field(default_factory=list)
    postal_code: list[Rule] = field(default_factory=list)
    city: list[Rule] = field(default_factory=list)
    place: list[Rule] = field(default_factory=list)  # "70173 Stuttgart" in one element
    address_box: list[Rule] = field(default_factory=list)  # the address is searched in here
    phone: list[Rule] = field(default_factory=lambda: [("a", "href", "tel:")])
    website: list[Rule] = field(default_factory=list)
    email: list[Rule] = field(default_factory=lambda: [("a", "href", "mailto:")])
    description: list[Rule] = field(default_factory=list)
    detail: list[Rule] = field(default_factory=list)
    # how the found strings are finished
    own_host: str | None = None  # links to this host are tracking links
    redirects: str = "keep"  # keep | drop | unwrap
    phone_from_text: bool = False  # fall back to a number pattern in the entry text
    phone_symbols_only: bool = False
    email_text: bool = False  # an element without a link may hold the address
    description_limit: int | None = None
    partial_place: bool = True  # the address may show only the postal code or only the city
    root_links_only: bool = False  # a relative detail link must start with "/"
    strip_search_prefix: str | None = None
    detail_by_name: str | None = None  # attribute that repeats the company name on the detail link
    fields_if_present: bool = False  # list only filled fields as provenance
    search_url: str = ""  # {what} and {where} are replaced
    page_param: str = "&page="


def _word(name: str) -> str:
    return rf"(?:^|\s){name}(?:\s|$)"


_ANY_CASE = "(?i)"

REGISTRY: dict[str, Profile] = {}


def register(key: str, profile: Profile) -> None:
    REGISTRY[key] = profile


# The layouts of the five directories.
register(
    "a",
    Profile(
        source="11880",
        base_url="https://www.11880.com",
        entries=[("li", "class", _word("result-list-entry"))],
        name=[("h2", "class", _word("result-list-entry-title__headline"))],
        street=[("span", "class", _word("js-street-address"))],
        postal_code=[("span", "class", _word("js-postal-code"))],
        city=[("span", "class", _word("js-address-locality"))],
        website=[("a", "class", "website|homepage")],
        description=[("div", "class", "description|category")],
        detail=[("a", "href", "/branchenbuch/")],
        own_host="11880.com",
        phone_from_text=True,
        strip_search_prefix="/suche/branchenbuch/",
        search_url="https://www.11880.com/suche?what={what}&where={where}&firmen=1&personen=0",
    ),
)
register(
    "b",
    Profile(
        source="gelbe_seiten",
        base_url="https://www.gelbeseiten.de",
        entries=[("article", "class", "mod-Treffer|gs-result"), ("div", "data-wipe-name")],
        name=[("h2",), ("a", "data-wipe-name")],
        street=[("span", "itemprop", "^streetAddress$")],
        postal_code=[("span", "itemprop", "^postalCode$")],
        city=[("span", "itemprop", "^addressLocality$")],
        website=[("a", "itemprop", "^url$"), ("a", "data-wipe-name", "^Homepage$"), ("a", "class", "website|homepage")],
        detail=[("a", "href", "/branchenbuch/")],
        own_host="gelbeseiten.de",
        redirects="unwrap",
        detail_by_name="data-wipe-name",
        search_url="https://www.gelbeseiten.de/Suche/{what}/{where}",
        page_param="?seite=",
    ),
)
register(
    "c",
    Profile(
        source="das_oertliche",
        base_url="https://www.dasoertliche.de",
        entries=[("article", "class", _ANY_CASE + "hit"), ("div", "class", _ANY_CASE + "entry")],
        name=[("h2",), ("a", "class", _ANY_CASE + "name")],
        street=[("span", "class", _ANY_CASE + "street")],
        place=[("span", "class", _ANY_CASE + "city|ort")],
        website=[("a", "class", _ANY_CASE + "website|homepage")],
        detail=[("a", "href", "/Themen/")],
        own_host="dasoertliche.de",
        redirects="drop",
        partial_place=False,
        search_url="https://www.dasoertliche.de/Themen/{what}/{where}.html",
        page_param="?page=",
    ),
)
register(
    "d",
    Profile(
        source="goyellow",
        base_url="https://www.goyellow.de",
        entries=[("article", "class", _ANY_CASE + "result"), ("div", "class", _ANY_CASE + "company")],
        name=[("h2",), ("h3",), ("a", "class", _ANY_CASE + "title")],
        street=[("span", "class", _ANY_CASE + "street")],
        place=[("span", "class", _ANY_CASE + "city")],
        address_box=[("div", "class", _ANY_CASE + "address")],
        website=[("a", "class", _ANY_CASE + "website"), ("a", "title", _ANY_CASE + "website|homepage")],
        detail=[("a", "href", "/unternehmen/")],
        own_host="goyellow.de",
        redirects="drop",
        partial_place=False,
        search_url="https://www.goyellow.de/suche/{what}/{where}",
        page_param="?page=",
    ),
)
register(
    "e",
    Profile(
        source="unternehmensverzeichnis",
        base_url="https://www.unternehmensverzeichnis.org",
        entries=[
            ("div", "class", "company-entry|result-item|listing"),
            ("article", "class", "company|business"),
            ("div", "data-company-id"),
        ],
        name=[("h2|h3|h4", "class", "company-name|title|name"), ("a", "class", "company|business")],
        street=[("span|div", "class", "street|address-line"), ("span", "itemprop", "^streetAddress$")],
        postal_code=[("span|div", "class", "postal|zip|plz"), ("span", "itemprop", "^postalCode$")],
        city=[("span|div", "class", "city|locality"), ("span", "itemprop", "^addressLocality$")],
        phone=[("a", "href", "tel:"), ("span|div", "class", "phone|tel")],
        website=[("a", "class", "website|homepage|url"), ("a", "itemprop", "^url$")],
        email=[("a", "href", "mailto:"), ("span|div", "class", "email|mail")],
        description=[("div|p", "class", "description|about|info")],
        detail=[("a", "href", "/unternehmen/|/firma/|/company/"), ("a", "class", "detail|more|read-more")],
        own_host="unternehmensverzeichnis.org",
        redirects="drop",
        phone_symbols_only=True,
        email_text=True,
        description_limit=500,
        root_links_only=True,
        fields_if_present=True,
        search_url="https://www.unternehmensverzeichnis.org/suche/{what}/{where}",
        page_param="?page=",
    ),
)

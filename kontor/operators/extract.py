"""Structured extraction from HTML pages.

Pages arrive as rows.  The tree search runs in Arrow batches next to the data and
only hands back the strings it found; numbers, addresses, links and provenance are
then made from them with Spark expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.functions import markup as H
from kontor.functions.text import blank_to_null, contains_any, filled, strip
from kontor.sources.profiles import REGISTRY, Profile

#: Pages whose found strings are alive at once.
PAGES = 256

_FOUND = ["name", "street", "postal_code", "city", "place", "phone_href", "phone_text", "website", "email_href", "email_text", "description", "detail", "entry_text"]


def _map_pages(pages: DataFrame, per_page: Callable[[str], list[dict]], fields: str) -> DataFrame:
    """One output row per dict that ``per_page`` makes of a page; page_id and url are kept.

    ``fields``: DDL of the dict values.  What was found leaves the task after every ``PAGES`` pages, however many Spark hands over.
    """
    id_type = dict(pages.dtypes)["page_id"]
    schema = f"page_id {id_type}, url string, entry_no int, {fields}"
    columns = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), PAGES):
                part = batch.iloc[start : start + PAGES]
                rows = []
                for page_id, url, html in zip(part["page_id"], part["url"], part["html"]):
                    for n, found in enumerate(per_page(html)):
                        rows.append({"page_id": page_id, "url": url, "entry_no": n, **found})
                yield pd.DataFrame(rows, columns=columns)

    return pages.select("page_id", "url", "html").mapInPandas(run, schema)


def _entry(p: Profile, entry: H.Node) -> dict:
    name = H.read(H.first(entry, *p.name))
    box = H.first(entry, *p.address_box) if p.address_box else entry
    phone, email = H.first(entry, *p.phone), H.first(entry, *p.email)
    detail = H.first(entry, *p.detail)
    if detail is None and p.detail_by_name and name:
        detail = next((a for a in H.select(entry, "a", p.detail_by_name) if a.attrs[p.detail_by_name] == name), None)

    def within(rules):
        return H.read(H.first(box, *rules)) if box is not None and rules else None

    return {
        "name": name,
        "street": within(p.street),
        "postal_code": within(p.postal_code),
        "city": within(p.city),
        "place": within(p.place),
        "phone_href": H.read(phone, "href"),
        "phone_text": H.read(phone),
        "website": H.read(H.first(entry, *p.website), "href") if p.website else None,
        "email_href": H.read(email, "href"),
        "email_text": H.read(email),
        "description": H.read(H.first(entry, *p.description)) if p.description else None,
        "detail": H.read(detail, "href"),
        "entry_text": "".join(entry.strings()) if p.phone_from_text else None,
    }


def _entries(p: Profile) -> Callable[[str], list[dict]]:
    def per_page(html: str) -> list[dict]:
        root = H.parse(html)
        for rule in p.entries:
            found = list(H.select(root, *rule))
            if found:
                # an entry without a name is left out, the page goes on
                return [row for row in (_entry(p, e) for e in found) if row["name"] is not None]
        return []

    return per_page


def extract(pages: DataFrame, profile: str | Profile) -> DataFrame:
    """Leads of directory pages (page_id, url, html) of one layout.

    One row per entry: the lead columns, ``detail_url`` and ``source``
    struct<name, url, fields>.
    """
    p = REGISTRY[profile] if isinstance(profile, str) else profile
    found = _map_pages(pages, _entries(p), ", ".join(f"{c} string" for c in _FOUND))
    return _finish(found, p)


def _finish(found: DataFrame, p: Profile) -> DataFrame:
    place = r"^([0-9]{5})\s+(.+)"
    plz = F.regexp_extract("place", place, 1) if p.place else F.col("postal_code")
    city = F.regexp_extract("place", place, 2) if p.place else F.col("city")
    rows = found.withColumns({"postal_code": blank_to_null(plz), "city": blank_to_null(city)})

    called = strip(F.replace("phone_href", F.lit("tel:"), F.lit("")))
    if p.phone_symbols_only:
        phone = F.regexp_replace(F.coalesce(called, "phone_text"), r"[^0-9+\s\-()/]", "")
    elif p.phone_from_text:
        phone = F.coalesce(called, blank_to_null(strip(F.regexp_extract("entry_text", r"(\+49|0)\s*\d+[\s\d\-/()]+", 0))))
    else:
        phone = called

    mail = F.replace("email_href", F.lit("mailto:"), F.lit(""))
    if p.email_text:
        written = F.col("email_text")
        mail = F.coalesce(mail, F.when(written.contains("@") & written.contains("."), written))
    mail = F.substring_index(mail, "?", 1)

    description = F.col("description")
    if p.description_limit:
        n = p.description_limit
        description = F.when(F.length("description") > n, F.concat(F.substring("description", 1, n - 3), F.lit("..."))).otherwise(description)

    number_and_city = F.concat(F.col("postal_code"), F.lit(" "), F.col("city"))
    shown = F.coalesce(number_and_city, F.col("postal_code"), F.col("city")) if p.partial_place else number_and_city
    some = filled(F.col("street")) | filled(F.col("postal_code")) | filled(F.col("city"))
    address = F.when(some, F.concat_ws(", ", blank_to_null(F.col("street")), shown))

    rows = rows.withColumns(
        {
            "address": address,
            "phone": phone,
            "website": _own_site(F.col("website"), p),
            "email": mail,
            "description": description,
            "detail_url": _detail(F.col("detail"), p),
        }
    )
    usual = ["company_name", "address", "city", "postal_code"]
    listed = usual + ["phone", "email", "website"] + (["description"] if p.fields_if_present else [])
    sure = ["company_name"] if p.fields_if_present else usual
    out = rows.withColumnRenamed("name", "company_name")
    fields = F.array_compact(
        F.array(*[F.lit(c) if c in sure else F.when(filled(F.col(c)), F.lit(c)) for c in sorted(listed)])
    )
    source = F.struct(
        F.lit(p.source).alias("name"), F.coalesce("detail_url", "url").alias("url"), fields.alias("fields")
    )
    return out.select(
        "page_id", "entry_no", "company_name", "website", "phone", "email", "address", "city", "postal_code",
        "description", "detail_url", source.alias("source"),
    )


def _own_site(href: Column, p: Profile) -> Column:
    """The company's own address, without the directory's tracking links."""
    if p.redirects == "unwrap":
        target = F.substring_index(href, "/redirect/", -1)
        return (
            F.when(href.startswith("/redirect/"), F.when(target.rlike("^https?://"), target))
            .when(href.contains(p.own_host) & href.contains("/redirect"), F.lit(None))
            .otherwise(href)
        )
    drop = href.contains(p.own_host) if p.own_host else F.lit(False)
    if p.redirects == "drop":
        drop = drop | href.contains("/redirect")
    return F.when(~drop, href)


def _detail(href: Column, p: Profile) -> Column:
    if p.strip_search_prefix:
        start = p.strip_search_prefix
        href = F.when(href.startswith(start), F.concat(F.lit("/branchenbuch/"), F.substr(href, F.lit(len(start) + 1)))).otherwise(href)
    relative = href.startswith("/") if p.root_links_only else F.lit(True)
    return F.when(href.startswith("http"), href).when(relative, F.concat(F.lit(p.base_url), href))


# --- detail pages ----------------------------------------------------------------------

# Hosts that are never the company's own site.
_NOT_OWN = ["11880.com", "werkenntdenbesten", "google.com/partners", "cleverb2b.de", "wirfindendeinenjob.de"]
_NOT_OWN_ANY = _NOT_OWN + [
    "facebook.com",
    "linkedin.com",
    "xing.com",
    "instagram.com",
    "twitter.com",
    "youtube.com",
    "postleitzahlen.de",
    "bundesnetzagentur.de",
]
# The directory's own texts and profiles.
_HOUSE_TEXTS = ["Über 11880.com", "Über uns", "Arbeiten bei 11880", "Investor Relations", "11880.com"]
_HOUSE_PROFILES = ["11880com", "11880.com", "11880-internet-services", "11880internetservicesag"]
_NETWORKS = {
    "facebook": r"facebook\.com",
    "linkedin": r"linkedin\.com",
    "xing": r"xing\.com",
    "twitter": r"twitter\.com|x\.com",
    "instagram": r"instagram\.com",
    "youtube": r"youtube\.com",
}

_PERSON = "struct<name:string,role:string,phone:string,email:string>"
_LOCATION = "struct<street:string,postal_code:string,city:string,phone:string,name:string>"
_DETAIL_FIELDS = f"""tracked string, labelled string, hrefs array<string>, hours array<struct<day:string,time:string>>,
  texts array<string>, services array<string>, persons array<{_PERSON}>, founded string, staff string, meta string,
  crumb string, street string, postal_code string, city string, confirmed string, badges array<string>,
  updated string, entered string, locations array<{_LOCATION}>, branches array<struct<url:string,text:string>>"""


def _has(word: str) -> tuple[str, str]:
    return "class", "(?i)" + word


def _detail_page(html: str) -> list[dict]:
    root = H.parse(html)
    links = list(H.select(root, "a", "href"))

    def labelled(pattern: str) -> Iterator[H.Node]:
        return (a for a in H.select(root, "a") if re.search(pattern, a.only_string() or ""))

    def item(prop: str, scope: H.Node = root) -> str | None:
        return H.read(H.first(scope, ("span", "itemprop", f"^{prop}$")))

    opening = H.first(root, ("div", *_has("opening")))
    days = list(H.select(opening, "div", *_has("day"))) if opening else []
    hours = [(H.read(H.first(d, ("span", *_has("name")))), H.read(H.first(d, ("span", *_has("time"))))) for d in days]
    services = H.first(root, ("div", *_has("service")))
    info = H.first(root, ("div", *_has("company-info")))
    places = list(H.select(root, "div", *_has("standort|filiale")))
    places = places or list(H.select(root, "div", "itemtype", r"^http://schema\.org/PostalAddress$"))
    text_rules = [("div", *_has("description")), ("div", *_has("about")), ("p", *_has("text"))]
    return [
        {
            "tracked": H.read(H.first(root, ("a", "class", "tracking--entry-detail-website-link")), "href"),
            "labelled": H.read(next(labelled("(?i)Website"), None), "href"),
            "hrefs": [a.attrs["href"] for a in links],
            "hours": [{"day": d, "time": t} for d, t in hours if d is not None and t is not None],
            "texts": [t for t in (H.read(H.first(root, rule)) for rule in text_rules) if t is not None],
            "services": [n.text() for n in H.select(services, "li|span")] if services else [],
            "persons": [
                {
                    "name": H.read(H.first(box, ("h3|h4|span", *_has("name")))),
                    "role": H.read(H.first(box, ("span", *_has("role|position")))),
                    "phone": H.read(H.first(box, ("a", "href", "tel:")), "href"),
                    "email": H.read(H.first(box, ("a", "href", "mailto:")), "href"),
                }
                for box in H.select(root, "div", *_has("person"))
            ],
            "founded": H.find_string(info, "(?i)gegründet|seit|founded") if info else None,
            "staff": H.find_string(info, "(?i)mitarbeiter|employees") if info else None,
            "meta": H.read(H.first(root, ("meta", "name", "^description$")), "content"),
            "crumb": H.read(H.first(root, ("span", "itemprop", "^name$"))),
            "street": item("streetAddress"),
            "postal_code": item("postalCode"),
            "city": item("addressLocality"),
            "confirmed": H.find_string(root, "(?i)Vom Inhaber bestätigt"),
            "badges": [n.text() for n in H.select(root, "div", *_has("badge"))],
            "updated": H.find_string(root, "(?i)wurde aktualisiert am"),
            "entered": H.find_string(root, "(?i)Eintragsdaten vom"),
            "locations": [
                {
                    "street": item("streetAddress", box),
                    "postal_code": item("postalCode", box),
                    "city": item("addressLocality", box),
                    "phone": H.read(H.first(box, ("a", "href", "tel:")), "href"),
                    "name": H.read(H.first(box, ("h3",), ("h4",))),
                }
                for box in (places if len(places) > 1 else [])
            ],
            "branches": [
                {"url": a.attrs.get("href", ""), "text": a.text()} for a in labelled("(?i)weitere.*(standort|filiale)")
            ][:5],
        }
    ]


def _some(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def _number(c: Column) -> Column:
    return strip(F.replace(c, F.lit("tel:"), F.lit("")))


def _mail(c: Column) -> Column:
    return F.substring_index(F.replace(c, F.lit("mailto:"), F.lit("")), "?", 1)


def detail(pages: DataFrame) -> DataFrame:
    """The fourteen blocks of a company's detail page, empty blocks NULL."""
    found = _map_pages(pages, _detail_page, _DETAIL_FIELDS)

    def own(c: Column) -> Column:
        return F.when(c.startswith("http") & ~contains_any(c, _NOT_OWN), c)

    external = F.filter("hrefs", lambda u: u.rlike("^https?://") & ~contains_any(u, _NOT_OWN_ANY))
    texts = F.filter("texts", lambda t: ~contains_any(t, _HOUSE_TEXTS) & (F.length(t) > 50))

    def network(pattern: str) -> Column:
        fit = F.filter("hrefs", lambda u: u.rlike(pattern) & (u != "") & ~contains_any(u, _HOUSE_PROFILES))
        return F.try_element_at(fit, F.lit(1))

    social = F.map_filter(
        F.create_map(*[x for n, p in _NETWORKS.items() for x in (F.lit(n), network(p))]), lambda k, v: v.isNotNull()
    )
    persons = F.transform(
        F.filter("persons", lambda p: filled(p["name"])),
        lambda p: F.struct(
            p["name"].alias("name"),
            p["role"].alias("role"),
            F.replace(p["phone"], F.lit("tel:"), F.lit("")).alias("phone"),
            _mail(p["email"]).alias("email"),
        ),
    )
    tel = F.filter(F.transform(F.filter("hrefs", lambda u: u.contains("tel:")), _number), filled)
    mail = F.filter(F.transform(F.filter("hrefs", lambda u: u.contains("mailto:")), _mail), filled)
    year = blank_to_null(F.regexp_extract("founded", r"\b((?:19|20)\d{2})\b", 1))
    staff = blank_to_null(F.regexp_extract("staff", r"\d+", 0))
    head = strip(F.substring_index("meta", "|", 1))
    industry = F.when(F.col("meta").contains("|") & (head != "") & (F.length(head) < 100), head)
    badges = _some(F.filter("badges", lambda b: (b != "") & (F.length(b) < 100)))
    day = r"(\d{2}\.\d{2}\.\d{4})"
    changed, entered = (blank_to_null(F.regexp_extract(c, day, 1)) for c in ("updated", "entered"))

    def block(*parts: Column) -> Column:
        """A struct, NULL if all its parts are."""
        return F.when(F.coalesce(*[p.cast("string") for p in parts]).isNotNull(), F.struct(*parts))

    locations = F.transform(
        F.filter("locations", lambda s: F.coalesce(s["street"], s["postal_code"], s["city"], s["phone"], s["name"]).isNotNull()),
        lambda s: F.struct(
            F.lit("location").alias("type"), s["street"].alias("street"), s["postal_code"].alias("postal_code"),
            s["city"].alias("city"), _number(s["phone"]).alias("phone"), s["name"].alias("name"), F.lit(None).cast("string").alias("url"),
        ),
    )
    nothing = F.lit(None).cast("string")
    branches = F.transform(
        "branches",
        lambda b: F.struct(
            F.lit("additional_branch").alias("type"), nothing.alias("street"), nothing.alias("postal_code"), nothing.alias("city"),
            nothing.alias("phone"), b["text"].alias("name"), b["url"].alias("url"),
        ),
    )
    return found.select(
        "page_id",
        F.coalesce(own(F.col("tracked")), own(F.col("labelled")), F.try_element_at(external, F.lit(1))).alias("website"),
        _some(F.transform("hours", lambda h: F.concat(h["day"], F.lit(" "), h["time"]))).alias("opening_hours"),
        F.try_element_at(texts, F.lit(1)).alias("description"),
        _some(F.filter("services", lambda s: F.length(s) > 3)).alias("services"),
        _some(persons).alias("contact_persons"),
        F.when(F.size(social) > 0, social).alias("social_media"),
        _some(F.array_distinct(tel)).alias("additional_phones"),
        _some(F.array_distinct(mail)).alias("additional_emails"),
        block(year.alias("founded_year"), staff.alias("employees")).alias("company_info"),
        F.coalesce(industry, "crumb").alias("industry"),
        block(F.col("street"), F.col("postal_code"), F.col("city")).alias("address"),
        _some(F.concat(locations, branches)).alias("locations"),
        block(F.when(F.col("confirmed").isNotNull(), True).alias("owner_verified"), badges.alias("badges")).alias("verified"),
        block(changed.alias("last_updated"), entered.alias("entry_date")).alias("metadata"),
    )


# --- team pages and register results -------------------------------------------------------


def _team_page(html: str) -> list[dict]:
    boxes = list(H.select(H.parse(html), "div|article", *_has("team|member|person|mitarbeiter")))[:20]
    return [
        {
            "name": H.read(H.first(box, ("h2|h3|h4|strong",))),
            "role": H.find_string(box, "(?i)(Geschäftsführer|CEO|CTO|Manager|Leiter|Developer)"),
            "email": H.read(H.first(box, ("a", "href", "mailto:")), "href"),
            "phone": H.read(H.first(box, ("a", "href", "tel:")), "href"),
        }
        for box in boxes
    ]


def team(pages: DataFrame) -> DataFrame:
    """Team members: at most 20 boxes per page, a name has two words or more."""
    found = _map_pages(pages, _team_page, "name string, role string, email string, phone string")
    words = F.size(F.filter(F.split("name", r"\s+"), lambda w: w != ""))
    return found.filter(words >= 2).select(
        "page_id", "entry_no", "name", strip(F.col("role")).alias("role"), _mail(F.col("email")).alias("email"), _number(F.col("phone")).alias("phone")
    )


def _register_page(html: str) -> list[dict]:
    box = H.first(H.parse(html), ("div", *_has("result")))
    if box is None:
        return []
    # names are looked for in the element that holds the role word
    role = "Geschäftsführer|Vorstand"
    holder = next((n for n in [box, *box.walk()] if any(isinstance(c, str) and re.search(role, c) for c in n.children)), None)
    person = "[A-ZÄÖÜ][a-zäöüß]+\\s+[A-ZÄÖÜ][a-zäöüß]+"
    names = [s.strip() for s in holder.strings() if re.search(person, s)] if holder is not None else []
    return [
        {
            "legal_form": H.find_string(box, r"\b(GmbH|AG|KG|OHG|UG|SE)\b"),
            "number": H.find_string(box, r"HRB?\s*\d+"),
            "court": H.find_string(box, r"Amtsgericht|AG\s+\w+"),
            "address": H.read(H.first(box, ("div", *_has("address")))),
            "directors": names[:5],
            "capital": H.find_string(box, "Stammkapital|Grundkapital"),
        }
    ]


def register_result(pages: DataFrame) -> DataFrame:
    """First hit of a company register result page; no register number, no row."""
    found = _map_pages(
        pages, _register_page, "legal_form string, number string, court string, address string, directors array<string>, capital string"
    )
    return found.select(
        "page_id",
        strip(F.col("legal_form")).alias("legal_form"),
        blank_to_null(F.regexp_extract("number", r"(HRB?\s*\d+)", 1)).alias("register_number"),
        strip(F.col("court")).alias("register_court"),
        "address",
        "directors",
        blank_to_null(F.regexp_extract("capital", r"([\d.,]+)\s*EUR", 1)).alias("capital"),
    ).filter("register_number is not null")

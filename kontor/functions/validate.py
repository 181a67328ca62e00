"""Field validators: a valid value in its canonical form, NULL when invalid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kontor.functions.text import blank_to_null, contains_any, filled, let, squash, strip

_ATOM = r"[a-z0-9!#$%&'*+/=?^_`{|}~-]+"
EMAIL_SYNTAX = rf"^{_ATOM}(\.{_ATOM})*@([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z][a-z0-9-]*[a-z0-9]$"

# The scorer's looser address pattern.
LOOSE_EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"

# Hosts that are directories, search engines or social networks.
NON_COMPANY_SITES = [
    "google.com",
    "duckduckgo.com",
    "youtube.com",
    "facebook.com",
    "linkedin.com",
    "xing.com",
    "instagram.com",
    "twitter.com",
    "x.com",
    "11880.com",
    "gelbeseiten.de",
    "dasoertliche.de",
    "wikipedia.org",
    "yelp.de",
    "golocal.de",
    "meinestadt.de",
]

# Numbering plan facts.  Country calling codes are one, two or three digits long;
# the first two digits decide which.
CALLING_CODE = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
DE_MOBILE = r"^1[567][0-9]{8,9}$"
DE_MOBILE_PREFIX = r"^(15[0-9]{2}|1[67][0-9])"
DE_FIXED = r"^[2-9][0-9]{5,10}$"
# Area-code length classes of the German plan: four two-digit codes, the
# three-digit codes, five digits in the 33..39 ranges, otherwise four.
DE_AREA = (
    r"^(30|40|69|89|[2-9][1-9]1|20[1-389]|21[24]|228|234|335|340|345|355|365|375|385|395|906"
    r"|3[3-9][0-9]{3}|[2-9][0-9]{3})"
)


def valid_email(c: Column) -> Column:
    def check(addr: Column) -> Column:
        return F.when(addr.rlike(EMAIL_SYNTAX) & (F.length(addr) <= 254) & (F.instr(addr, "@") <= 65), addr)

    return let(F.regexp_replace(F.lower(strip(c)), "^(mailto:|email:)", ""), check)


def _dialled(c: Column) -> Column:
    """Digits with a leading '+' for international input; NULL if other symbols occur."""
    bare = strip(F.regexp_replace(strip(c), "(?i)^(tel:|phone:|telefon:)", ""))
    packed = F.regexp_replace(F.regexp_replace(bare, r"[ \-/().\t]", ""), "^00", "+")
    return F.nullif(F.regexp_extract(packed, r"^(\+?[0-9]+)$", 1), F.lit(""))


def phone_parts(c: Column, country_code: str = "49") -> Column:
    """struct<cc, national>: calling code and national number without trunk zero."""

    def parts(dialled: Column) -> Column:
        cc = F.regexp_extract(dialled, r"^\+" + CALLING_CODE.lstrip("^"), 1)
        foreign = F.struct(
            cc.alias("cc"),
            F.regexp_replace(F.substr(dialled, F.length(cc) + 2, F.lit(32)), "^0", "").alias("national"),
        )
        home = F.struct(F.lit(country_code).alias("cc"), F.regexp_replace(dialled, "^0", "").alias("national"))
        return F.when(dialled.startswith("+"), foreign).when(dialled.isNotNull(), home)

    return let(_dialled(c), parts)


def valid_phone(c: Column, country_code: str = "49") -> Column:
    """International format of a valid number.

    Germany has full length rules and area-code spacing; other countries are
    accepted on the general 8..15 digit rule and written as one group.
    """

    def spaced(nat: Column, pattern: str) -> Column:
        return F.concat(
            F.lit("+49 "), let(F.regexp_extract(nat, pattern, 1), lambda head: F.concat(head, F.lit(" "), F.substr(nat, F.length(head) + 1, F.lit(32))))
        )

    def check(part: Column) -> Column:
        cc, nat = part["cc"], part["national"]
        german = F.when(nat.rlike(DE_MOBILE), spaced(nat, DE_MOBILE_PREFIX)).when(nat.rlike(DE_FIXED), spaced(nat, DE_AREA))
        foreign = (cc != "") & (F.length(cc) + F.length(nat)).between(8, 15)
        return F.when(cc == "49", german).when(foreign, F.concat(F.lit("+"), cc, F.lit(" "), nat))

    return let(phone_parts(c, country_code), check)


def valid_website(c: Column) -> Column:
    shape = r"^(https?)://([^/?#]*)([^?#]*)"

    def with_scheme(url: Column) -> Column:
        return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(
            F.concat(F.lit("https://"), url)
        )

    def check(url: Column) -> Column:
        host = F.lower(F.regexp_extract(url, shape, 2))
        path = F.regexp_replace(F.regexp_extract(url, shape, 3), r";[^/]*$", "")
        path = F.regexp_replace(path, r"/+$", "")
        return let(
            host,
            lambda h: F.when(
                (h != "") & (h.contains("[") == h.contains("]")),
                F.concat(F.regexp_extract(url, shape, 1), F.lit("://"), h, path),
            ),
        )

    return F.when(filled(c), let(let(strip(c), with_scheme), check))


def valid_postal_code(c: Column, country: str = "DE") -> Column:
    trimmed = strip(c)
    if country != "DE":
        return blank_to_null(trimmed)
    digits = F.regexp_replace(trimmed, "[^0-9]", "")
    return F.when(F.length(digits) == 5, digits).otherwise(blank_to_null(trimmed))


def valid_company_name(c: Column) -> Column:
    return let(squash(c), lambda name: F.when(F.length(name) >= 2, name))


def is_email(c: Column) -> Column:
    return F.coalesce(c.rlike(LOOSE_EMAIL), F.lit(False))


def is_phone(c: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(c, "[^0-9]", "")) >= 6, F.lit(False))


def is_company_site(c: Column, excluded: list[str] | None = None) -> Column:
    hosts = NON_COMPANY_SITES if excluded is None else excluded
    return F.coalesce(c.startswith("http"), F.lit(False)) & ~contains_any(c, hosts)

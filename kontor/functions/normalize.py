"""Normalizers: canonical spelling of names, legal forms, places and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kontor.functions.text import blank_to_null, cap_first, filled, let, squash, strip, title_case

# Legal forms, searched in this order.
LEGAL_FORMS = {
    "gmbh": "GmbH",
    "ug": "UG",
    "ag": "AG",
    "kg": "KG",
    "ohg": "OHG",
    "gbr": "GbR",
    "ev": "e.V.",
    "eg": "eG",
    "einzelunternehmen": "Einzelunternehmen",
    "freiberufler": "Freiberufler",
}

# State codes and the states they stand for.
STATE_CODES = {
    "bw": "Baden-Württemberg",
    "by": "Bayern",
    "be": "Berlin",
    "bb": "Brandenburg",
    "hb": "Bremen",
    "hh": "Hamburg",
    "he": "Hessen",
    "mv": "Mecklenburg-Vorpommern",
    "ni": "Niedersachsen",
    "nw": "Nordrhein-Westfalen",
    "rp": "Rheinland-Pfalz",
    "sl": "Saarland",
    "sn": "Sachsen",
    "st": "Sachsen-Anhalt",
    "sh": "Schleswig-Holstein",
    "th": "Thüringen",
}

# Legal-form endings of a company name.
_FORM = r"GmbH|UG|AG|KG|OHG|GbR|e\.V\.|eG"
FORM_SUFFIX = rf"(?i)\s+({_FORM})(\s+&\s+Co\.?\s+KG)?$"
FORM_PARENS = rf"(?i)\s+\(({_FORM})\)$"

UUID_SEGMENT = r"/[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
NUMBER_SEGMENT = r"/(?:[0-9]+|0x[0-9a-fA-F]+)"


def norm_name(c: Column) -> Column:
    """Capitalise plain words; keep acronyms and words with inner capitals."""

    def word(w: Column) -> Column:
        tail = F.substring(w, 2, 2147483647)
        acronym = (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 1)
        inner_capital = tail != F.lower(tail)
        return F.when(acronym | inner_capital, w).otherwise(cap_first(w))

    return F.array_join(F.transform(F.split(squash(c), " "), word), " ")


def norm_legal_form(c: Column) -> Column:
    def pick(form: Column) -> Column:
        result = F.upper(form)
        for key, label in reversed(LEGAL_FORMS.items()):
            result = F.when(form.contains(key), F.lit(label)).otherwise(result)
        return result

    return let(c, lambda x: F.when(filled(x), let(F.regexp_replace(F.lower(strip(x)), r"(^rechtsform:?\s*|\s*\(.*\)$)", ""), pick)))


def norm_state(c: Column) -> Column:
    state = F.lower(strip(c))
    names = {name.lower(): name for name in STATE_CODES.values()}
    names["baden württemberg"] = STATE_CODES["bw"]
    lookup = {**STATE_CODES, **names}
    table = F.create_map(*[F.lit(x) for pair in lookup.items() for x in pair])
    return F.when(filled(c), F.coalesce(F.try_element_at(table, state), title_case(state)))


def norm_city(c: Column) -> Column:
    return F.when(filled(c), title_case(squash(c)))


def norm_list(c: Column) -> Column:
    """Drop empty items, trim, keep the first of case-insensitive repeats; empty -> NULL."""
    def first_of_each(items: Column) -> Column:
        folded = F.transform(items, F.lower)
        return let(folded, lambda low: F.filter(items, lambda x, i: F.array_position(low, F.lower(x)) == i + 1))

    cleaned = F.transform(F.filter(c, filled), strip)
    return let(let(cleaned, first_of_each), lambda kept: F.when(F.size(kept) > 0, kept))


def split_legal_form(c: Column) -> Column:
    """struct<name, legal_form>: the ending of the name that states a legal form."""
    plain = F.regexp_extract(c, FORM_SUFFIX, 0)
    ending = F.coalesce(blank_to_null(plain), F.regexp_extract(c, FORM_PARENS, 0))

    def cut(e: Column) -> Column:
        name = F.when(e != "", strip(F.substr(c, F.lit(1), F.length(c) - F.length(e)))).otherwise(c)
        return F.struct(name.alias("name"), blank_to_null(strip(e)).alias("legal_form"))

    return let(ending, cut)


def clip_description(c: Column, limit: int = 1000) -> Column:
    def clip(text: Column) -> Column:
        return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)

    return let(strip(c), clip)


def phone_key(c: Column) -> Column:
    return blank_to_null(F.regexp_replace(c, "[^0-9]", ""))


def endpoint_template(path: Column) -> Column:
    templated = F.regexp_replace(F.regexp_replace(path, UUID_SEGMENT, "/{id}"), NUMBER_SEGMENT, "/{id}")
    return F.when(filled(path), templated).otherwise(F.lit("/"))


def domain_key(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return F.coalesce(blank_to_null(host), url)


def format_address(street: Column, postal_code: Column, city: Column) -> Column:
    """``street, plz city`` from whatever parts are filled; nothing filled -> NULL."""
    place = F.concat_ws(" ", blank_to_null(postal_code), blank_to_null(city))
    return blank_to_null(F.concat_ws(", ", blank_to_null(street), blank_to_null(strip(place))))

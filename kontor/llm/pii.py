"""Format-preserving pseudonyms for personal numbers and dates, by keyed Feistel networks.

Native DataFrame operations only, one projection without a shuffle: a pseudonym depends
on the key, the kind and the value alone, so equal values have equal pseudonyms in all
documents and every value can be restored with the key.

Values are found by one pattern and then validated: check digits of payment cards and
account numbers, ranges of addresses, calendar dates, lengths of telephone numbers.  Their
characters are permuted within the format; check digits are computed anew, and a result
that isn't valid is permuted again until it is (cycle walking), which keeps the mapping
one-to-one within the kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Cycle walking ends long before: every step fails with a chance below one half.
WALK = 128
KEY = "demonstration key"

DIGITS, HEX = "0123456789", "0123456789abcdef"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Days from 1900-01-01 to 2099-12-31
FIRST_DAY, DAYS = "1900-01-01", 73049

# Length of the account numbers of each country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE BI", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BF CF CG CI DJ FR GR IT MC MR SM", 28: "AL AZ BJ BY CM CV CY DO DZ GA GQ GT GW HU KM LB MA MG ML MZ NE PL SN SV TD TG HN NI",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_form() -> str:
    """A number of its country's length; another one, or another country's, as long as its groups go on."""
    forms = []
    for n, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(n - 4, 4)
        forms.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    end = r"(?![\p{L}\p{N}_]|[.\-/@][\p{N}])"
    return rf"(?:(?:{'|'.join(forms)}){end}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)"


# Forms of the values that are looked for, the first that fits a place is taken.
FORMS = {
    "email": r"[A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}",
    "iban": _iban_form(),
    "secret": r"(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})",
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})",
    "ipv4": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{1,5}(?:[ .\-]?[0-9]{2,5}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})",
    "card": r"(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ \-])[0-9]{6}\2[0-9]{5})",
    "national": r"(?:00[1-9][0-9]{0,2}[ .\-/](?:\([0-9]{1,5}\)[ .\-/]?)?[0-9]{2,8}(?:[ .\-/][0-9]{2,8}){0,3}|(?:\(0[1-9][0-9]{1,4}\)[ .\-/]?|0[1-9][0-9]{1,4}[ \-/])[0-9]{3,8}(?:[ \-][0-9]{2,5}){0,2})",
}
#: A value begins and ends where no letter or digit goes on, and no further group of digits after a point.
_PATTERN = r"(?<![\p{L}\p{N}_])(?<![\p{N}][.\-/])(?:" + "|".join(FORMS.values()) + r")(?![\p{L}\p{N}_]|[.\-/@][\p{N}])"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _char(alphabet: str, c: Column, by: Column) -> Column:
    place = F.instr(F.lit(alphabet), c) - 1
    return F.substring(F.lit(alphabet), F.pmod(place + by, F.lit(len(alphabet))) + 1, F.lit(1))


def _shift(text: Column, stream: Column, sign: int, alphabet: str | None) -> Column:
    """Every character moved within its alphabet (its class of digits, small or capital letters without one)."""

    def one(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        by = F.conv(F.substring(stream, (i - 1) * 4 + 1, F.lit(4)), 16, 10).cast("int") * sign
        if alphabet:
            return _char(alphabet, c, by)
        return (
            F.when(c.between("0", "9"), _char(DIGITS, c, by)).when(c.between("a", "z"), _char(LOWER, c, by))
            .when(c.between("A", "Z"), _char(UPPER, c, by)).otherwise(c)
        )

    moved = F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")
    return F.when(F.length(text) == 0, text).otherwise(moved)


def feistel(text: Column, key: str, tweak: str, forward: bool = True, alphabet: str | None = None) -> Column:
    """Keyed permutation of the strings of the same length and classes of characters."""
    sign = 1 if forward else -1

    def turn(state: Column, r: Column) -> Column:
        a, b = state["a"], state["b"]
        even = r % 2 == 0
        seed = F.concat_ws("|", F.lit(key), F.lit(tweak), (F.length(a) + F.length(b)).cast("string"), r.cast("string"), F.when(even, b).otherwise(a))
        blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.length(a), F.length(b)) / 32).cast("int"))  # 32 characters each
        stream_of = lambda start: F.array_join(
            F.transform(blocks, lambda i: F.sha2(F.when(i == 0, start).otherwise(F.concat_ws("|", start, i.cast("string"))), 512)), ""
        )
        return _let(
            _let(seed, stream_of),
            lambda stream: F.when(even, F.struct(_shift(a, stream, sign, alphabet).alias("a"), b.alias("b"))).otherwise(
                F.struct(a.alias("a"), _shift(b, stream, sign, alphabet).alias("b"))
            ),
        )

    def run(x: Column) -> Column:
        half = F.floor(F.length(x) / 2).cast("int")
        start = F.struct(F.substring(x, F.lit(1), half).alias("a"), F.substring(x, half + 1, F.length(x)).alias("b"))
        rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1)) if forward else F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1))
        return F.aggregate(rounds, start, turn, lambda s: F.concat(s["a"], s["b"]))

    return _let(text, run)


def _walk(value: Column, step: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """``step`` once, and again while the result isn't valid."""
    start = F.struct(value.alias("x"), F.lit(False).alias("done"))

    def turn(state: Column, _: Column) -> Column:
        return F.when(state["done"], state).otherwise(
            _let(step(state["x"]), lambda y: F.struct(y.alias("x"), F.coalesce(valid(y), F.lit(False)).alias("done")))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, turn, lambda s: s["x"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of check of a string of digits; ``doubled``: 1 if the last digit counts double."""
    at = F.sequence(F.lit(1), F.length(digits))

    def one(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (F.length(digits) - i) % 2 == 1 - doubled
        return total + F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(at, F.lit(0), one)


def luhn(digits: Column) -> Column:
    return _luhn_sum(digits, 0) % 10 == 0


def _fill(form: Column, fresh: Column, kept: str = "[0-9]") -> Column:
    """``form`` with the characters that match ``kept`` replaced, one by one, by those of ``fresh``."""

    def run(new: Column) -> Column:
        def one(state: Column, c: Column) -> Column:
            n = state["n"]
            return F.when(c.rlike(kept), F.struct(F.concat(state["out"], F.substring(new, n, F.lit(1))).alias("out"), (n + 1).alias("n"))).otherwise(
                F.struct(F.concat(state["out"], c).alias("out"), n.alias("n"))
            )

        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("n"))
        return F.aggregate(F.filter(F.split(form, ""), lambda c: c != ""), start, one, lambda s: s["out"])

    return _let(fresh, run)


def _mod97(text: Column) -> Column:
    def one(total: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (total * 10 + F.ascii(c) - 48) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c.rlike("[A-Z0-9]")), F.lit(0), one)


def _iban(m: Column, key: str, forward: bool) -> tuple[Column, Column]:
    flat = F.replace(m, F.lit(" "), F.lit(""))
    country, body = F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat))
    valid = F.length(flat).between(15, 34) & (_mod97(F.concat(body, F.substring(flat, 1, 4))) == 1)
    whole = _let(
        feistel(body, key, "iban", forward),
        lambda new: F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0"), new),
    )
    return valid, _fill(m, whole, "[A-Z0-9]")


def _date(m: Column, key: str, forward: bool) -> tuple[Column, Column]:
    iso = m.rlike("^[0-9]{4}-")
    part = lambda a, b: F.when(iso, F.substring(m, *a)).otherwise(F.substring(m, *b))
    year, middle = part((1, 4), (7, 4)), part((6, 2), (4, 2))
    other = part((9, 2), (1, 2))
    # with slashes the month comes first unless it can't be one
    swap = m.contains("/") & (middle.cast("int") > 12)
    american = m.contains("/") & ~swap
    month = F.when(american, other).otherwise(F.when(swap, other).otherwise(middle))
    day = F.when(american | swap, middle).otherwise(other)
    date = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")
    number = F.datediff(date, F.lit(FIRST_DAY).cast("date"))
    valid = date.isNotNull() & number.between(0, DAYS - 1)
    text = F.lpad(number.cast("string"), 5, "0")
    new = _walk(text, lambda x: feistel(x, key, "date", forward, DIGITS), lambda x: x.cast("int") < DAYS)
    form = F.when(iso, "yyyy-MM-dd").when(m.contains("/"), "MM/dd/yyyy").otherwise("dd.MM.yyyy")
    return valid, F.call_function("date_format", F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int")), form)


def _ipv4(m: Column, key: str, forward: bool) -> tuple[Column, Column]:
    parts = F.split(m, r"\.")
    valid = F.forall(parts, lambda p: p.cast("int") <= 255)
    flat = F.array_join(F.transform(parts, lambda p: F.lower(F.lpad(F.hex(p.cast("int")), 2, "0"))), "")
    back = lambda x: F.concat_ws(".", *(F.conv(F.substring(x, 2 * i + 1, 2), 16, 10) for i in range(4)))
    return valid, _let(feistel(flat, key, "ipv4", forward, HEX), back)


def _card(m: Column, key: str, forward: bool) -> Column:
    """Only numbers whose check digit is right, which stay so; times, order and book numbers are left alone."""

    def run(d: Column) -> Column:
        body = feistel(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", forward, DIGITS)
        checked = _let(body, lambda b: F.concat(b, F.pmod(-_luhn_sum(b, 1), F.lit(10)).cast("string")))
        return F.when(luhn(d), checked).otherwise(d)

    return _fill(m, _let(_digits(m), run))


def kind_of(m: Column) -> Column:
    """Kind of a found value: the first form that fits it whole."""
    out = F
    for kind, form in FORMS.items():
        out = out.when(m.rlike(f"^(?:{form})$"), F.lit(kind))
    return out


def pseudonym(m: Column, kind: Column, key: str = KEY, forward: bool = True) -> Column:
    """Pseudonym of a found value, or the value itself if it isn't valid; backward: the value of a pseudonym."""
    iban_ok, iban = _iban(m, key, forward)
    date_ok, date = _date(m, key, forward)
    ip_ok, ip = _ipv4(m, key, forward)
    at = F.instr(m, "@")
    email = F.concat(feistel(F.lower(F.substring(m, F.lit(1), at - 1)), key, "email", forward), F.lower(F.substring(m, at, F.length(m))))
    hex_ok = m.rlike("[0-9]") & m.rlike("[a-fA-F]")
    secret = _let(feistel(F.lower(m), key, "secret", forward, HEX), lambda low: F.when(m.rlike("[A-F]"), F.upper(low)).otherwise(low))
    ssn_form = r"^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"
    d = _digits(m)
    ssn = _fill(m, _walk(d, lambda x: feistel(x, key, "ssn", forward, DIGITS), lambda x: x.rlike(ssn_form)))
    country = F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[^0-9])|\+[0-9]{2}|00[1-9][0-9]{0,2}(?=[^0-9])|\(?0|)", 1)
    local = F.substring(m, F.length(country) + 1, F.length(m))
    trunk = m.rlike(r"^\(?0[1-9]")  # an area code has no second zero
    digits = _walk(_digits(local), lambda x: feistel(x, key, "phone", forward, DIGITS), lambda x: ~trunk | ~x.startswith("0"))
    phone = F.concat(country, _fill(local, digits))
    return (
        F.when(kind == "email", email).when((kind == "iban") & iban_ok, iban).when((kind == "secret") & hex_ok, secret)
        .when((kind == "date") & date_ok, date).when((kind == "ipv4") & ip_ok, ip).when((kind == "ssn") & d.rlike(ssn_form), ssn)
        .when(kind.isin("phone", "national") & F.length(d).between(7, 15), phone).when(kind == "card", _card(m, key, forward))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = KEY, forward: bool = True) -> DataFrame:
    """``docs`` with ``text_col`` rewritten; ``forward=False`` restores the values with the same key.

    All columns and rows stay.  Null stays null.  What is restored is the canonical form:
    addresses for mail in small letters, slashed dates with the month first, octets
    without leading zeros.  Telephone numbers keep their country code or the zero before
    their area code, mail addresses their domain.
    """
    return docs.withColumn(text_col, rewritten(F.col(text_col), key, forward))


def found(text: Column) -> Column:
    """Array of the candidate values of a text, in order."""
    return F.regexp_extract_all(text, F.lit(_PATTERN), F.lit(0))


def rewritten(text: Column, key: str = KEY, forward: bool = True) -> Column:
    values = F.transform(found(text), lambda m: _let(kind_of(m), lambda k: pseudonym(m, k, key, forward)))
    return F.when(text.rlike("[0-9@]"), _woven(text, values)).otherwise(text)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """``doc_id``, the rewritten ``text``, and ``n_values``: the values that have a pseudonym.

    A null text stays null with no values, an empty one stays empty, texts of any length
    are read whole.  Repeated rows come back as often as they came, an empty table gives
    an empty one, and other columns are not read.
    """
    text = F.col(text_col)
    before = F.when(text.rlike("[0-9@]"), found(text)).otherwise(F.array().cast("array<string>"))
    slim = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), before.alias("_found"))
    after = F.transform("_found", lambda m: _let(kind_of(m), lambda k: pseudonym(m, k, key)))
    return slim.select("doc_id", "_text", "_found", after.alias("_new")).select(
        "doc_id",
        F.when(F.size("_found") > 0, _woven(F.col("_text"), F.col("_new"))).otherwise(F.col("_text")).alias("text"),
        F.coalesce(F.size(F.filter(F.arrays_zip("_found", "_new"), lambda p: p["_found"] != p["_new"])), F.lit(0)).alias("n_values"),
    )


def _woven(text: Column, values: Column) -> Column:
    gaps = F.split(text, _PATTERN, -1)
    return F.array_join(F.concat(F.flatten(F.zip_with(gaps, values, lambda g, v: F.array(g, F.coalesce(v, F.lit("")))))), "")

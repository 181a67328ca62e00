"""Page text, links and labelled facts, found with regular expressions in generated code."""

from __future__ import annotations

import html as html_lib
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.functions.text import blank_to_null, let, strip
from kontor.operators.enrich import distinct_domains

# an anchor that is never closed ends at the next one
ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)(?:</a>|(?=<a\b)|\z)"""

# Words that mark the links to a site's standard pages.
PAGE_KINDS = {
    "impressum": ["impressum", "imprint", "legal"],
    "team": ["team", "über uns", "about", "mitarbeiter"],
    "kontakt": ["kontakt", "contact", "ansprechpartner"],
}

# Labels in front of directors' names in an imprint.
DIRECTOR_LABELS = ["Geschäftsführer", "Geschäftsführung", "Inhaber", "Vorstand"]


@F.pandas_udf(T.StringType())
def _references(s: pd.Series) -> pd.Series:
    return s.map(html_lib.unescape, na_action="ignore")


def _unescape(c: Column) -> Column:
    """Character references resolved; only texts that hold one are sent to Python."""
    return F.coalesce(_references(F.when(c.contains("&"), c)), c)


@F.pandas_udf(T.StringType())
def _join_url(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b, h) if b is not None and h is not None else None for b, h in zip(base, href)])


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def visible_text(html: Column) -> Column:
    """Text of a page with character references resolved; scripts, styles and comments removed."""
    bare = html
    for hidden in ("script", "style", "template"):
        bare = F.regexp_replace(bare, rf"(?is)<{hidden}\b[^>]*>.*?</{hidden}\s*>", "")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", "")
    return _unescape(F.regexp_replace(bare, r"(?s)<[^>]*>", ""))


def page_text(pages: DataFrame, n: int = 1000) -> DataFrame:
    """Title and the first ``n`` characters of the text of every page."""
    title = blank_to_null(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.select("page_id", _unescape(title).alias("title"), F.substring(visible_text(F.col("html")), 1, n).alias("text"))


def text_gate(df: DataFrame, column: str = "text", min_len: int = 100, clip: int = 3000) -> DataFrame:
    """Rows with enough text, clipped for the next step."""
    return df.filter(F.length(column) >= min_len).withColumn(column, F.substring(column, 1, clip))


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, position, href, title) for every link, in document order."""
    hrefs = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))
    labels = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2))
    both = F.arrays_zip(hrefs.alias("href"), labels.alias("label"))
    return pages.select("page_id", "url", F.posexplode(both).alias("position", "a")).select(
        "page_id", "url", "position", F.col("a.href").alias("href"), strip(strip_tags(F.col("a.label"))).alias("title")
    )


def classify_links(pages: DataFrame, kinds: dict[str, list[str]] | None = None) -> DataFrame:
    """First link of each kind per page, as an absolute address."""
    groups = kinds or PAGE_KINDS
    label = F.lower("title")
    hits = [
        F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: label.contains(w)), F.lit(kind))
        for kind, words in groups.items()
    ]
    found = anchors(pages).select("page_id", "url", "position", "href", F.explode(F.array_compact(F.array(*hits))).alias("kind"))
    firsts = found.groupBy("page_id", "kind").agg(F.min_by(F.struct("url", "href"), "position").alias("l"))
    return firsts.select("page_id", "kind", _join_url("l.url", "l.href").alias("target"))


def contact_links(pages: DataFrame, n: int = 10) -> DataFrame:
    """Distinct addresses of the first ``n`` mail and phone links of every page."""

    def hrefs(scheme: str) -> Column:
        found = F.regexp_extract_all("html", F.lit(rf"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*{scheme}[^"']*)["']"""), F.lit(1))
        return F.slice(found, 1, n)

    mails = F.transform(hrefs("mailto:"), lambda u: F.substring_index(F.replace(u, F.lit("mailto:"), F.lit("")), "?", 1))
    calls = F.transform(hrefs("tel:"), lambda u: strip(F.replace(u, F.lit("tel:"), F.lit(""))))
    return pages.select(
        "page_id",
        F.array_distinct(F.filter(mails, lambda x: x != "")).alias("emails"),
        F.array_distinct(F.filter(calls, lambda x: x != "")).alias("phones"),
    )


def search_links(pages: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` company sites among the links of every page, one per host."""
    links = anchors(pages).select("page_id", "position", "title", F.col("href").alias("url"))
    return distinct_domains(links, n, ["page_id"])


def imprint(df: DataFrame, text: str = "text") -> DataFrame:
    """Add directors, register_number, register_court and vat_id; rows with none are dropped."""
    person = r"([A-ZÄÖÜ][a-zäöüß]+(?:\s+[A-ZÄÖÜ][a-zäöüß]+)+)"
    groups = [
        F.slice(F.regexp_extract_all(text, F.lit(rf"{label}[:\s]+{person}"), F.lit(1)), 1, 3) for label in DIRECTOR_LABELS
    ]
    facts = {
        "directors": F.concat(*groups),
        "register_number": blank_to_null(F.regexp_extract(text, r"(HRB?\s*[0-9]+)", 1)),
        "register_court": blank_to_null(F.regexp_extract(text, r"(?:Amtsgericht|Registergericht)\s+([A-ZÄÖÜ][a-zäöüß]+)", 1)),
        "vat_id": F.replace(
            blank_to_null(F.regexp_extract(text, r"USt[.-]?IdNr[.:]?\s*([A-Z]{2}\s*[0-9]+)", 1)), F.lit(" "), F.lit("")
        ),
    }
    some = (F.size("directors") > 0) | F.coalesce("register_number", "register_court", "vat_id").isNotNull()
    return df.withColumns(facts).filter(some)


def _pick(c: Column, *patterns: str) -> Column:
    """First group of the first pattern that matches; '' is a match, NULL is none."""
    result = F.lit(None).cast("string")
    for pattern in reversed(patterns):
        result = F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(result)
    return result


def labelled_facts(html: Column) -> Column:
    """struct of the facts a simple company page states: name, address, contacts, services, directors.

    ``html`` has its character references resolved.
    """
    mail = r"([\w.+-]+@[\w-]+\.[\w.-]+)"
    low = F.lower(html)
    email = F.coalesce(_pick(low, rf"(?U)mailto:{mail}"), _pick(html, f"(?U){mail}"))
    phone = F.coalesce(
        _pick(low, r"tel:([+\d\s-]+)"), _pick(html, r"(?i)(?:phone|telefon|tel)[:\s]*([+\d\s/()-]{6,})")
    )
    services = F.regexp_extract(html, r"(?is)<h2[^>]*>\s*services\s*</h2>\s*<ul>(.*?)</ul>", 1)
    items = F.transform(F.regexp_extract_all(services, F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1)), lambda x: strip(strip_tags(x)))
    named = F.regexp_extract_all(html, F.lit(r"(?i)(?:director|ceo|cto|cfo|coo|lead|head)[:\s]+([^<]+)"), F.lit(1))
    return F.struct(
        strip(strip_tags(_pick(html, r"(?is)<h1[^>]*>(.*?)</h1>"))).alias("company_name"),
        strip(strip_tags(_pick(html, r"(?i)(?:adresse|address)[:\s]*(.+?)</"))).alias("address"),
        strip(phone).alias("phone"),
        email.alias("email"),
        _pick(html, r"(?U)(https?://[\w./-]+)").alias("website"),
        F.filter(items, lambda x: x != "").alias("services"),
        F.filter(F.transform(named, strip), lambda x: x != "").alias("directors"),
    )


def regex_ground_truth(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    plain = pages.select(key, _unescape(F.col(html)).alias("_html"))
    return plain.select(key, labelled_facts(F.col("_html")).alias("f")).select(key, "f.*")


def recover_json(c: Column) -> Column:
    """The JSON in a model's answer: outermost object, else array, else the whole text.

    struct<payload variant, raw string>; ``raw`` holds the text if nothing parses.
    """
    candidates = [F.regexp_extract(c, r"(?s)\{.*\}", 0), F.regexp_extract(c, r"(?s)\[.*\]", 0), c]

    def strict(x: Column) -> Column:
        # the parser ignores what follows the first value; inside brackets it cannot
        wrapped = F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))
        return let(
            wrapped,
            lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant")),
        )

    parsed = F.coalesce(*[strict(blank_to_null(x)) for x in candidates])
    return let(parsed, lambda v: F.struct(v.alias("payload"), F.when(v.isNull(), c).alias("raw")))


def first_success(df: DataFrame, methods: dict[str, Column], preferred: str | None = None) -> DataFrame:
    """Add ``result`` and ``method_used``: first non-empty result, the preferred method first."""
    order = [*([preferred] if preferred in methods else []), *[m for m in methods if m != preferred]]
    value, used = F.lit(None).cast("string"), F.lit(None).cast("string")
    for m in reversed(order):
        good = F.coalesce(methods[m] != "", F.lit(False))
        value = F.when(good, methods[m]).otherwise(value)
        used = F.when(good, F.lit(m)).otherwise(used)
    return df.withColumns({"result": value, "method_used": used})


def method_usage(df: DataFrame) -> DataFrame:
    """How often each method won; NULL counts the failures."""
    return df.groupBy("method_used").agg(F.count(F.lit(1)).alias("n"))

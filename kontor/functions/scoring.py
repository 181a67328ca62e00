"""Lead scoring rules.  Every rule is a struct column with ``points`` and details."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kontor.functions.text import contains_any, filled, let, strip
from kontor.functions.validate import is_email, is_phone

# Industry words of high value.
VALUED_INDUSTRIES = [
    "software",
    "it",
    "tech",
    "saas",
    "cloud",
    "ai",
    "ml",
    "consulting",
    "beratung",
    "engineering",
    "automation",
    "fintech",
    "medtech",
    "healthtech",
    "e-commerce",
]

# Technology keywords of modern companies.
MODERN_KEYWORDS = [
    "react",
    "vue",
    "angular",
    "node",
    "python",
    "aws",
    "azure",
    "kubernetes",
    "docker",
    "microservices",
    "api",
    "rest",
    "graphql",
    "mongodb",
    "postgresql",
    "redis",
    "kafka",
]

# Social networks that are no company site of its own.
SOCIAL_SITES = ["facebook", "linkedin", "twitter", "instagram", "xing"]

# Recommendation texts.
ADVICE_CONTACT = "Kontaktdaten vervollständigen (Email, Telefon)"
ADVICE_WEBSITE = "Website-Informationen überprüfen"
ADVICE_QUALITY = "Datenqualität verbessern (Duplikate, Validierung)"

# Lower bounds of the categories and their stored grade.
CATEGORIES = [(80, "hot", "a"), (60, "warm", "b"), (40, "cold", "c"), (0, "low_quality", "d")]


def _some(c: Column) -> Column:
    """True for a non-empty array."""
    return F.coalesce(F.size(c) > 0, F.lit(False))


def _graded(c: Column, valid: Column) -> tuple[Column, Column]:
    state = F.when(~filled(c), "missing").when(valid, "valid").otherwise("invalid")
    points = F.when(~filled(c), 0).when(valid, 10).otherwise(5)
    return points, state


def contact_score(
    email: Column, phone: Column, address: Column, directors: Column, street: Column | None = None, city: Column | None = None
) -> Column:
    mail_points, mail = _graded(email, is_email(email))
    call_points, call = _graded(phone, is_phone(phone))
    placed = filled(address)
    if street is not None and city is not None:
        placed = placed | (filled(street) & filled(city))
    led = _some(directors)
    found = F.concat(F.size(directors).cast("string"), F.lit(" found"))
    return F.struct(
        (mail_points + call_points + F.when(placed, 5).otherwise(0) + F.when(led, 5).otherwise(0)).alias("points"),
        mail.alias("email"),
        call.alias("phone"),
        F.when(placed, "present").otherwise("missing").alias("address"),
        F.when(led, found).otherwise("missing").alias("directors"),
    )


def website_score(website: Column) -> Column:
    def rate(site: Column) -> Column:
        there = filled(site)
        secure = there & site.startswith("https://")
        own = there & ~contains_any(site, SOCIAL_SITES)
        points = F.when(there, F.lit(10) + F.when(secure, 5).otherwise(0) + F.when(own, 5).otherwise(0)).otherwise(0)
        return F.struct(
            points.alias("points"),
            there.alias("present"),
            F.coalesce(secure, F.lit(False)).alias("https"),
            own.alias("own_domain"),
            F.when(there, "present").otherwise("missing").alias("status"),
        )

    return let(strip(F.lower(website)), rate)


def industry_score(industry: Column) -> Column:
    def rate(text: Column) -> Column:
        there = filled(text)
        valued = there & F.arrays_overlap(F.split(text, r"\s+"), F.array(*[F.lit(w) for w in VALUED_INDUSTRIES]))
        return F.struct(
            F.when(valued, 15).when(there, 5).otherwise(0).alias("points"),
            F.when(there, "present").otherwise("missing").alias("status"),
            F.coalesce(valued, F.lit(False)).alias("high_value"),
        )

    return let(strip(F.lower(industry)), rate)


def size_score(team_size: Column) -> Column:
    """``team_size`` may be a number or text; unreadable text scores like a missing value."""
    text = team_size.cast("string")
    size = text.try_cast("int")
    unknown = ~filled(text) | (size == 0)
    bands = [(100, 15, "large"), (50, 12, "medium"), (10, 10, "small")]
    points, label = F.lit(7), F.lit("micro")
    for floor, value, name in reversed(bands):
        points = F.when(size >= floor, value).otherwise(points)
        label = F.when(size >= floor, name).otherwise(label)
    return F.struct(
        F.when(unknown | size.isNull(), 5).otherwise(points).alias("points"),
        F.when(~unknown & size.isNotNull(), label).alias("category"),
        F.when(unknown, "unknown").when(size.isNull(), "invalid").otherwise("missing").alias("status"),
    )


def tech_score(technologies: Column) -> Column:
    there = _some(technologies)
    modern = F.size(F.filter(technologies, lambda t: contains_any(F.lower(t), MODERN_KEYWORDS)))
    # two points per modern item, five at most
    points = F.when(there, F.lit(5) + F.least(F.lit(5), modern * 2)).otherwise(0)
    return F.struct(
        points.alias("points"),
        F.when(there, F.size(technologies)).otherwise(0).alias("count"),
        F.when(there, modern).otherwise(0).alias("modern_count"),
    )


def quality_score(name: Column, fields: list[Column], lists: list[Column], error: Column | None = None) -> Column:
    """``fields``: scalar inputs, filled unless NULL, empty or the word null; the caller
    turns a numeric zero into NULL.  ``lists``: array inputs, filled when not empty."""
    bad_name = F.coalesce(F.length(name) < 3, F.lit(True))
    has_error = filled(error) if error is not None else F.lit(False)

    def set_value(c: Column) -> Column:
        return (~F.coalesce(c.cast("string"), F.lit("")).isin("", "null")).cast("int")

    count = F.lit(0)
    for c in fields:
        count = count + set_value(c)
    for c in lists:
        count = count + _some(c).cast("int")
    sparse = count < 3
    loss = F.when(bad_name, 5).otherwise(0) + F.when(has_error, 3).otherwise(0) + F.when(sparse, 2).otherwise(0)
    issues = F.array_compact(
        F.array(
            F.when(bad_name, F.lit("invalid_name")),
            F.when(has_error, F.lit("has_errors")),
            F.when(sparse, F.lit("incomplete_data")),
        )
    )
    return F.struct(
        F.greatest(F.lit(0), F.lit(10) - loss).alias("points"),
        issues.alias("issues"),
        count.alias("filled_fields"),
    )


def category(score: Column) -> Column:
    label = F.lit(CATEGORIES[-1][1])
    for floor, name, _ in reversed(CATEGORIES[:-1]):
        label = F.when(score >= floor, name).otherwise(label)
    return label


def quality_enum(quality: Column) -> Column:
    table = F.create_map(*[F.lit(x) for _, name, grade in CATEGORIES for x in (name, grade)])
    return F.coalesce(F.try_element_at(table, quality), F.lit("unknown"))

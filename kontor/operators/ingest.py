"""Cleansing of raw lead rows: validation, normalization and their composition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.functions import normalize as N
from kontor.functions import validate as V
from kontor.functions.text import blank_to_null, filled, squash, strip

_CHECKED = {
    "email": V.valid_email,
    "phone": V.valid_phone,
    "website": V.valid_website,
    "postal_code": V.valid_postal_code,
}
_TRIMMED = ["city", "address", "description", "industry", "legal_form"]
_LISTS = ["directors", "services", "technologies"]


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with a ``reason``).  Invalid optional fields become NULL."""
    name = V.valid_company_name(F.col("company_name"))
    changes = {c: fn(F.col(c)) for c, fn in _CHECKED.items() if c in df.columns}
    changes |= {
        c: F.when(filled(F.col(c)), strip(F.col(c))).otherwise(F.col(c)) for c in _TRIMMED if c in df.columns
    }
    # the plain length test keeps the filter cheap enough to be pushed below the projection
    usable = F.length(squash(F.col("company_name"))) >= 2
    valid = df.filter(usable).withColumns({"company_name": name, **changes})
    rejected = df.filter(~F.coalesce(usable, F.lit(False))).withColumn("reason", F.lit("company name is required and invalid"))
    return valid, rejected


def normalize(df: DataFrame) -> DataFrame:
    """Canonical spelling of every known column; a legal form is taken from the name if absent."""
    has = set(df.columns)
    form = F.col("legal_form") if "legal_form" in has else F.lit(None).cast("string")
    # a stated legal form leaves the name alone; otherwise the ending of the name is one
    as_is = F.struct(F.col("company_name").alias("name"), form.alias("legal_form"))
    split = F.when(filled(form), as_is).otherwise(N.split_legal_form(F.col("company_name")))
    work = df.withColumn("_split", split)
    changes = {
        "company_name": N.norm_name(F.col("_split.name")),
        "legal_form": N.norm_legal_form(F.col("_split.legal_form")),
    }
    if "city" in has:
        changes["city"] = N.norm_city(F.col("city"))
    if "state" in has:
        changes["state"] = N.norm_state(F.col("state"))
    if "description" in has:
        changes["description"] = N.clip_description(F.col("description"))
    changes |= {c: N.norm_list(F.col(c)) for c in _LISTS if c in has}
    return work.withColumns(changes).drop("_split")


def clean(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as they are stored, and the rejected rows.

    Normalized values win over validated ones, except that the stored company name
    is the validated one (with its legal form); a city that normalizes to nothing
    falls back to what came in.
    """
    valid, rejected = validate(df)
    keep = valid.withColumn("_name", F.col("company_name"))
    if "city" in df.columns:
        keep = keep.withColumn("_city", F.col("city"))
    stored = normalize(keep).withColumn("company_name", F.col("_name")).drop("_name")
    if "city" in df.columns:
        stored = stored.withColumn("city", F.coalesce(blank_to_null(F.col("city")), blank_to_null(F.col("_city")))).drop("_city")
    return stored, rejected

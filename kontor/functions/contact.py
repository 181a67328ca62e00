"""Verification rules for contact data: status codes, parts of an address or a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kontor.functions.validate import DE_FIXED, DE_MOBILE, phone_parts

# Statuses that a result cache must not keep.
NEVER_CACHED = ["rate_limited", "not_attempted"]


def status_from_code(code: Column) -> Column:
    """Mail server answer to a recipient probe."""
    return (
        F.when(code == 250, "valid")
        .when(code.isin(451, 452), "temporary_error")
        .when(code == 550, "invalid")
        .otherwise(F.concat(F.lit("smtp_"), code.cast("string")))
    )


def provider_status(provider: Column, answer: Column) -> Column:
    """struct<status, valid, deliverable> for the three known checking services."""
    text = F.coalesce(F.nullif(F.lower(answer), F.lit("")), F.lit("unknown"))
    zero, hunter, listed = (provider == p for p in ("zerobounce", "hunter", "emaillistverify"))
    status = (
        F.when(zero | hunter, text)
        .when(listed, F.when(text == "ok", "valid").otherwise(text))
        .otherwise("api_unsupported")
    )
    valid = (
        F.when(zero, text.isin("valid", "catch-all"))
        .when(hunter, text.isin("deliverable", "risky"))
        .when(listed, text == "ok")
        .otherwise(False)
    )
    deliverable = F.when(zero, text == "valid").when(hunter, text == "deliverable").when(listed, text == "ok")
    return F.struct(status.alias("status"), valid.alias("valid"), deliverable.alias("deliverable"))


def phone_struct(c: Column) -> Column:
    """struct<valid, status, e164, number_type, country_code, national_number>."""
    part = phone_parts(c)
    cc, nat = part["cc"], part["national"]
    readable = cc.isNotNull() & (cc != "") & (nat != "")
    size = F.length(cc) + F.length(nat)
    mobile = (cc == "49") & nat.rlike(DE_MOBILE)
    fixed = (cc == "49") & nat.rlike(DE_FIXED)
    valid = readable & (mobile | fixed | ((cc != "49") & (size >= 8) & (size <= 15)))
    return F.struct(
        F.coalesce(valid, F.lit(False)).alias("valid"),
        F.when(~F.coalesce(readable, F.lit(False)), "invalid_format").when(valid, "valid").otherwise("invalid").alias("status"),
        F.when(readable, F.concat(F.lit("+"), cc, nat)).alias("e164"),
        F.when(mobile, "mobile").when(fixed, "fixed_line").when(readable, "unknown").alias("number_type"),
        F.when(readable, cc.try_cast("int")).alias("country_code"),
        F.when(readable, nat.try_cast("bigint")).alias("national_number"),
    )

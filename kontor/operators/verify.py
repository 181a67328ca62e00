"""Set logic of contact verification: work lists, cached results, mail hosts, re-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.functions.contact import NEVER_CACHED
from kontor.functions.text import filled, strip

# Life time of a cached result, age of a due re-check, batch size.
CACHE_TTL_SECONDS = 604_800
REVERIFY_DAYS = 30
REVERIFY_BATCH = 100


def work_list(df: DataFrame, column: str, lower: bool = True) -> DataFrame:
    """Distinct non-empty contact values, trimmed (and lower-cased for e-mail)."""
    value = strip(F.lower(column)) if lower else strip(F.col(column))
    return df.filter(filled(F.col(column))).select(value.alias(column)).filter(F.col(column) != "").distinct()


def cacheable(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("status").isin(NEVER_CACHED))


def cache_join(work: DataFrame, cache: DataFrame, key: str, now: Column, ttl: int = CACHE_TTL_SECONDS) -> DataFrame:
    """Add the newest unexpired cached status and ``cached``; FALSE rows are to be verified.

    ``cache``: key, status, verified_at.
    """
    fresh = cacheable(cache).filter(
        (F.col("verified_at") <= now) & (F.unix_micros("verified_at") > F.unix_micros(now) - F.lit(ttl * 1_000_000))
    )
    latest = fresh.groupBy(key).agg(F.max_by("status", F.struct("verified_at", "status")).alias("status"), F.lit(True).alias("_hit"))
    return work.join(latest, key, "left").withColumn("cached", F.coalesce("_hit", F.lit(False))).drop("_hit")


def mx_join(df: DataFrame, mx: DataFrame, email: str = "email") -> DataFrame:
    """Mail host per address: the one with the lowest preference.

    ``mx``: domain, preference, host.  ``status`` is NULL when a host is known.
    """
    best = mx.groupBy("domain").agg(F.min_by("host", F.struct("preference", "host")).alias("mx_host"))
    local, domain = F.substring_index(email, "@", 1), F.regexp_extract(email, "^[^@]*@(.*)$", 1)
    split = df.withColumns({"_local": local, "domain": domain})
    bad = (F.col("domain") == "") | (F.col("_local") == "")
    status = F.when(bad, "invalid_format").when(F.col("mx_host").isNull(), "no_mx_records")
    return split.join(best, "domain", "left").withColumn("status", status).drop("_local")


def due_for_reverify(df: DataFrame, now: Column, days: int = REVERIFY_DAYS, n: int = REVERIFY_BATCH, key: str = "id") -> DataFrame:
    """The ``n`` oldest results verified more than ``days`` ago."""
    old = F.col("verified_at") < now - F.make_dt_interval(F.lit(days))
    return df.filter(old).orderBy("verified_at", key).limit(n)

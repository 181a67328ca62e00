"""Enrichment joins, lookup budgets and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.functions.normalize import domain_key
from kontor.functions.text import blank_to_null, filled, strip
from kontor.functions.validate import is_company_site
from kontor.operators.prefix import carry


def enrich(
    df: DataFrame,
    lookup: DataFrame,
    on: str,
    fill: dict[str, str],
    block: str,
    source: str,
    always: list[str] | None = None,
) -> DataFrame:
    """Left join a lookup: fill empty columns, attach the block, note the provenance.

    ``fill`` maps a column of ``df`` to the lookup column that may fill it.  The
    lookup has one row per key.  ``<block>_source`` is a struct<name, fields>, NULL
    where the lookup has no row; ``always`` fields are listed when filled.
    """
    joined = df.join(lookup.select(on, F.struct(*[c for c in lookup.columns if c != on]).alias(block)), on, "left")
    return _filled(joined, dict(lookup.dtypes), fill, block, source, always)


def _filled(joined: DataFrame, kinds: dict[str, str], fill: dict[str, str], block: str, source: str, always: list[str] | None) -> DataFrame:
    """Take the values of an attached block."""
    got = F.col(block).isNotNull()
    offered = list(dict.fromkeys([*fill.values(), *(always or [])]))

    def present(c: str) -> Column:
        value = F.col(f"{block}.{c}")
        return filled(value) if kinds[c] == "string" else value.isNotNull()

    fields = F.array_compact(F.array(*[F.when(present(c), F.lit(c)) for c in offered]))
    changes = {
        mine: F.when(filled(F.col(mine)), F.col(mine)).otherwise(F.coalesce(blank_to_null(F.col(f"{block}.{theirs}")), F.col(mine)))
        for mine, theirs in fill.items()
    }
    return joined.withColumns(
        {**changes, f"{block}_source": F.when(got, F.struct(F.lit(source).alias("name"), F.array_sort(fields).alias("fields")))}
    )


def budget_flag(
    df: DataFrame,
    order: str,
    n: int,
    eligible: Column,
    hit: Column | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Add ``looked_up``: the row is within the lookup budget.

    Attempts budget (``hit`` is None): the first ``n`` eligible rows.  Hits budget:
    rows are looked up while fewer than ``n`` earlier eligible rows were hits.
    """
    counted = eligible if hit is None else eligible & hit
    one = F.coalesce(counted, F.lit(False)).cast("bigint")
    run = carry(df.withColumn("_one", one), keys or [], [order], sums={"_used": F.col("_one")})
    return run.withColumn("looked_up", F.coalesce(eligible, F.lit(False)) & (F.col("_used") - F.col("_one") < n)).drop("_used", "_one")


def enrich_budgeted(
    df: DataFrame, lookup: DataFrame, on: str, fill: dict[str, str], block: str, source: str,
    n: int, order: str, budget: str = "hits", eligible: Column | None = None,
) -> DataFrame:
    """``enrich`` for at most ``n`` hits or attempts in ``order``; other rows pass through.

    The lookup is joined once and its values are carried along, until the budget tells who may have them.
    """
    joined = df.join(lookup.select(on, F.struct(*[c for c in lookup.columns if c != on]).alias(block)), on, "left")
    can = F.lit(True) if eligible is None else eligible
    flagged = budget_flag(joined, order, n, can, F.col(block).isNotNull() if budget == "hits" else None)
    held = flagged.withColumn(block, F.when(F.col("looked_up"), F.col(block)))
    return _filled(held, dict(lookup.dtypes), fill, block, source, None)


def fill_website(df: DataFrame, candidates: DataFrame, on: str) -> DataFrame:
    """Take the best search candidate where the website is missing or a search engine's.

    ``candidates``: on, rank, url; the lowest rank wins.
    """
    best = candidates.groupBy(on).agg(F.min_by("url", "rank").alias("_found"))
    lacking = ~filled(F.col("website")) | F.col("website").contains("google.com")
    take = F.coalesce(lacking, F.lit(True)) & F.col("_found").isNotNull()
    return (
        df.join(best, on, "left")
        .withColumn("website_found", take)
        .withColumn("website", F.when(F.col("website_found"), F.col("_found")).otherwise(F.col("website")))
        .drop("_found")
    )


def detail_url(explicit: Column, source_urls: Column) -> Column:
    """The stated detail page, else the first source URL on a directory detail path."""
    matches = F.filter(source_urls, lambda u: F.coalesce(u.contains("/branchenbuch/"), F.lit(False)))
    return F.coalesce(blank_to_null(explicit), F.try_element_at(matches, F.lit(1)))


def discover_fallback(jobs: DataFrame, leads: DataFrame, candidates: DataFrame) -> DataFrame:
    """Leads made from search candidates for jobs that found nothing.

    ``jobs``: job_id, city.  ``leads``: job_id.  ``candidates``: job_id, title, url.
    """
    empty = jobs.join(leads.select("job_id").distinct(), "job_id", "left_anti")
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    name = strip(F.coalesce(blank_to_null(F.col("title")), blank_to_null(host), F.col("url")))
    return (
        candidates.filter(filled(F.col("url")))
        .join(empty, "job_id")
        .select(
            "job_id",
            name.alias("company_name"),
            F.col("url").alias("website"),
            "city",
            F.struct(
                F.lit("duckduckgo_discovery").alias("name"), F.col("url").alias("url"), F.array(F.lit("website")).alias("fields")
            ).alias("source"),
        )
        .filter(F.col("company_name") != "")
    )


def clip_reviews(reviews: Column, count: int = 5, length: int = 200) -> Column:
    """First reviews with their text cut; items are struct<author, rating, text, time>."""
    return F.transform(
        F.slice(reviews, 1, count),
        lambda r: F.struct(
            r["author"].alias("author"),
            r["rating"].alias("rating"),
            F.substring(F.coalesce(r["text"], F.lit("")), 1, length).alias("text"),
            r["time"].alias("time"),
        ),
    )


def merge_provenance(sources: DataFrame, keys: list[str]) -> DataFrame:
    """Long-form provenance, one row per (keys, name, url) with the sorted union of fields.

    ``sources``: keys, position, name, url, fields.  Field names are column names, a
    small vocabulary, so the union per source stays small; the list of sources per
    company stays in rows.
    """
    group = [*keys, "name", "url"]
    return (
        sources.select(*group, "position", F.explode_outer("fields").alias("field"))
        .groupBy(*group)
        .agg(F.min("position").alias("position"), F.array_sort(F.collect_set("field")).alias("fields"))
    )


def merge_sources(leads: DataFrame, order: str) -> DataFrame:
    """One lead per lower-cased trimmed name: the first record is the base.

    Phone, e-mail and website are filled from later records.  Everything is an
    aggregate with map-side combine, so a very frequent name is no hot task.
    """
    fill = [c for c in ("phone", "email", "website") if c in leads.columns]
    base = [c for c in leads.columns if c not in (*fill, order)]
    # a name is compared in lower case without outer blanks
    name = strip(F.lower("company_name"))
    return (
        leads.groupBy(name.alias("name_key"))
        .agg(
            F.min(order).alias(order),
            F.count(F.lit(1)).alias("records"),
            *[F.min_by(F.struct(c), order).alias(f"_{c}") for c in base],
            *[F.min_by(c, F.when(filled(F.col(c)), F.col(order))).alias(c) for c in fill],
        )
        .select("name_key", order, "records", *[F.col(f"_{c}.{c}").alias(c) for c in base], *fill)
    )


def distinct_domains(links: DataFrame, n: int, keys: list[str], position: str = "position") -> DataFrame:
    """First ``n`` company sites of every page in document order, one per host.

    ``links``: keys, position, title, url.
    """
    firsts = (
        links.filter(is_company_site(F.col("url")))
        .groupBy(*keys, domain_key(F.col("url")).alias("host"))
        .agg(F.min_by(F.struct("title", "url"), position).alias("l"), F.min(position).alias(position))
    )
    order = Window.partitionBy(*keys).orderBy(position)
    return (
        firsts.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select(*keys, "rank", blank_to_null(F.col("l.title")).alias("title"), "l.url", "host")
    )

"""Readers and generators of the source tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.operators.prefix import carry, in_ranges
from kontor.schemas import SOURCE, SOURCE_REF
from kontor.session import checkpoint_cut
from kontor.sources.profiles import REGISTRY, Profile

# The known sources (name, display name, address, type).
SOURCES = [
    ("11880", "11880.com", "https://www.11880.com", "directory"),
    ("gelbe_seiten", "Gelbe Seiten", "https://www.gelbeseiten.de", "directory"),
    ("das_oertliche", "Das Örtliche", "https://www.dasoertliche.de", "directory"),
    ("goyellow", "GoYellow", "https://www.goyellow.de", "directory"),
    ("google_places", "Google Places", "https://maps.google.com", "api"),
    ("handelsregister", "Handelsregister", "https://www.handelsregister.de", "registry"),
    ("website_scraping", "Website Scraping", "", "scraping"),
    ("smart_scraper", "Smart Scraper (AI)", "", "ai_scraping"),
]

_LEAD_TEXT = ["company_name", "website", "phone", "email", "address", "city", "postal_code", "description", "scraped_at"]


def read_leads_json(spark: SparkSession, path: str) -> DataFrame:
    """Lead dumps (one JSON array per file) with ``sources`` as a list in both known shapes.

    Old dumps hold ``sources`` as {primary, urls, data_sources}; the url list is
    paired with the data sources in order.  Large files are read in pieces, one row per lead; ``corrupt`` has what isn't valid.
    """
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in _LEAD_TEXT], T.StructField("sources", T.StringType())])
    return unify_sources(read_json_objects(spark, path, schema))


def read_json_objects(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Objects of files with JSON arrays (or objects one after the other) of any size, and ``corrupt``: the text of those that aren't valid.

    The files are read in pieces that end at a closing brace, which Spark splits like lines, so one large array is many
    tasks.  Running counts tell for each piece whether it starts inside a string and how
    deep it is; the pieces up to a brace at the top are one object.  Whatever stands before an object besides commas and
    brackets makes it corrupt, and so does a missing end.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    order = ["block", "row"]
    pieces = in_ranges(raw, ["file"], order)
    plain = F.regexp_replace("value", r"\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    marked = checkpoint_cut(carry(pieces, ["file"], order, sums={"_quotes": quotes.cast("bigint")}))
    starts_inside = (F.col("_quotes") - quotes) % 2 == 1
    closed = F.regexp_replace(F.concat(F.when(starts_inside, F.lit('"')).otherwise(F.lit("")), plain), '"[^"]*"', "")
    outside = F.regexp_replace(closed, '"[^"]*$', "")
    ends = (F.col("_quotes") % 2 == 0).cast("bigint")  # the brace that ends the piece isn't part of a string
    opens = F.length(outside) - F.length(F.replace(outside, F.lit("{"), F.lit("")))
    deep = checkpoint_cut(carry(marked.withColumns({"_change": opens - ends, "_ends": ends}), ["file"], order, sums={"_depth": F.col("_change")}))
    top = ((F.col("_ends") == 1) & (F.col("_depth") == 0)).cast("bigint")
    told = carry(deep.withColumn("_top", top), ["file"], order, sums={"_objects": F.col("_top")})
    parts = F.sort_array(F.collect_list(F.struct("block", "row", "value")))
    whole = told.groupBy("file", (F.col("_objects") - F.col("_top")).alias("_object")).agg(parts.alias("_parts"), F.max("_top").alias("_whole"))
    joined = F.array_join(F.transform("_parts", lambda p: p["value"]), "}")
    text = F.regexp_replace(F.concat(joined, F.when(F.col("_whole") == 1, F.lit("}")).otherwise(F.lit(""))), r"^[\s,\[\]]+", "")
    objects = whole.select(text.alias("_text")).filter("_text <> ''")
    known = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = T.StructType([*known.fields, T.StructField("corrupt", T.StringType())])
    parsed = F.from_json("_text", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    good = F.col("_text").startswith("{")
    return objects.select(parsed.alias("_v"), "_text", good.alias("_good")).select(
        *[F.when(F.col("_good") & F.col("_v.corrupt").isNull(), F.col(f"_v.{f.name}")).alias(f.name) for f in fields if f.name != "corrupt"],
        F.when(F.col("_good"), F.col("_v.corrupt")).otherwise(F.col("_text")).alias("corrupt"),
    )


def unify_sources(raw: DataFrame, column: str = "sources") -> DataFrame:
    """Replace the JSON text of ``sources`` by array<struct<name, url, scraped_at, fields>>."""
    listed = F.from_json(column, T.ArrayType(SOURCE_REF))
    old = F.from_json(column, "primary string, urls array<string>, data_sources map<string,array<string>>")
    from_old = F.transform(
        F.map_entries(old["data_sources"]),
        lambda e, i: F.struct(
            e["key"].alias("name"),
            F.coalesce(F.try_element_at(old["urls"], i + 1), F.try_element_at(old["urls"], F.lit(1))).alias("url"),
            F.col("scraped_at").alias("scraped_at"),
            F.array_sort(e["value"]).alias("fields"),
        ),
    )
    is_list = F.ltrim(F.col(column)).startswith("[")
    return raw.withColumn(column, F.when(is_list, listed).otherwise(from_old))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw HTML files as rows (url, html); the url is the file's path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Quality test cases; ``expected_data`` stays JSON text so that its kind can be checked."""
    schema = "id string, name string, complexity string, content_type string, html_content string, expected_data string, metadata string"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def validate_cases(cases: DataFrame, order: str | None = None) -> DataFrame:
    """One row (id, problem) per defect of the test cases.

    A duplicate id is reported once per repetition, from counts, so no group of
    equal ids is collected.
    """
    def problems(condition: Column, text: str) -> Column:
        return F.when(condition, F.lit(text))

    missing = [problems(F.col(f).isNull(), f"missing {f}") for f in ("id", "name", "expected_data", "html_content")]
    empty = problems(F.trim("html_content") == "", "html_content is empty")
    kind = problems(~F.ltrim("expected_data").startswith("{"), "expected_data is not an object")
    defects = cases.select("id", F.explode(F.array_compact(F.array(*missing, empty, kind))).alias("problem"))
    repeats = (
        cases.groupBy("id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("id", F.explode(F.sequence(F.lit(2).cast("bigint"), "n")).alias("_nth"))
        .select("id", F.lit("duplicate id").alias("problem"))
    )
    return defects.unionByName(repeats)


def read_load_stats(spark: SparkSession, path: str) -> DataFrame:
    """Endpoint rows of a load-test statistics file."""
    return parse_load_stats(spark.read.option("header", True).csv(path))


def parse_load_stats(raw: DataFrame) -> DataFrame:
    """Typed endpoint rows; totals and other row types are left out.

    Percentile columns are called ``95%`` or ``95%ile``; a missing column counts 0.
    """
    def number(*names: str) -> Column:
        present = [F.col(f"`{n}`").try_cast("double") for n in names if n in raw.columns]
        return F.coalesce(*present, F.lit(0.0))

    method = F.coalesce(F.col("Method"), F.col("Type")) if "Method" in raw.columns else F.col("Type")
    rows = raw.filter(F.col("Type").isin("HTTP", "Request") & ~F.coalesce(F.col("Name").isin("Total", "_Total"), F.lit(False)))
    return rows.select(
        F.col("Name").alias("name"),
        method.alias("method"),
        number("Requests").cast("bigint").alias("requests"),
        number("Failures").cast("bigint").alias("failures"),
        number("Median Response Time").alias("median_ms"),
        number("95%", "95%ile").alias("p95_ms"),
        number("99%", "99%ile").alias("p99_ms"),
        number("Average Response Time").alias("avg_ms"),
        number("Min Response Time").alias("min_ms"),
        number("Max Response Time").alias("max_ms"),
        number("Requests/s").alias("rps"),
        number("Average Content Size").alias("avg_size"),
    )


def seed_sources(existing: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Existing sources plus those of the seed list whose name is not there yet."""
    if seeds is None:
        seeds = existing.sparkSession.createDataFrame([(*s, True) for s in SOURCES], SOURCE)
    fresh = seeds.join(existing.select("name"), "name", "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def _quote_plus(c: Column) -> Column:
    """Form encoding: blanks become '+', everything unsafe becomes %XX."""
    encoded = F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def search_urls(terms: DataFrame, profile: str | Profile, max_pages: int = 5) -> DataFrame:
    """Search addresses for every (industry, city) row and page 1..n.

    The caller decides which combinations are searched; the page number is left out
    of the first page's address.
    """
    p = REGISTRY[profile] if isinstance(profile, str) else profile
    filled = F.replace(
        F.replace(F.lit(p.search_url), F.lit("{what}"), _quote_plus(F.col("industry"))), F.lit("{where}"), _quote_plus(F.col("city"))
    )
    pages = terms.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(max_pages))))
    suffix = F.when(F.col("page") > 1, F.concat(F.lit(p.page_param), F.col("page").cast("string"))).otherwise(F.lit(""))
    return pages.withColumn("url", F.concat(filled, suffix))

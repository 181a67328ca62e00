"""Filters, lookups and paging over company and job tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def active(companies: DataFrame) -> DataFrame:
    return companies.filter("is_active")


def parse_choice(value: str, allowed: list[str], by: str = "name") -> str:
    """Check an enumeration argument: by name in any case, or by its exact value."""
    choice = value.lower() if by == "name" else value
    if choice not in allowed:
        raise ValueError(f"unknown value {value!r}; expected one of {allowed}")
    return choice


def search(
    df: DataFrame,
    city: str | None = None,
    industry: str | None = None,
    status: str | None = None,
    quality: str | None = None,
    text: str | None = None,
) -> DataFrame:
    """Active leads matching all given filters; ``%`` and ``_`` in the terms are wildcards."""
    rows = active(df)
    if city:
        rows = rows.filter(F.col("city").ilike(f"%{city}%"))
    if industry:
        rows = rows.filter(F.col("industry").ilike(f"%{industry}%"))
    if status:
        rows = rows.filter(F.col("lead_status") == status)
    if quality:
        rows = rows.filter(F.col("lead_quality") == quality)
    if text:
        like = f"%{text}%"
        rows = rows.filter(
            F.col("company_name").ilike(like) | F.col("email").ilike(like) | F.col("website").ilike(like)
        )
    return rows


def page(df: DataFrame, skip: int = 0, limit: int = 100, order: list[Column] | None = None) -> DataFrame:
    """One page in a stable order; Spark plans it as a bounded top-k, not a full sort."""
    return df.orderBy(*(order or [F.col("id")])).offset(skip).limit(limit)


def page_with_total(df: DataFrame, skip: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(page, one-row total); callers that skip the total never pay for the count."""
    return page(df, skip, limit), df.agg(F.count(F.lit(1)).alias("total"))


def by_id(df: DataFrame, value: int) -> DataFrame:
    return df.filter(F.col("id") == value)


def select_ids(df: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows found, requested ids that do not exist)."""
    wanted = ids.select("id").distinct()
    return df.join(wanted, "id", "left_semi"), wanted.join(df.select("id"), "id", "left_anti")


def list_jobs(jobs: DataFrame, status: str | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
    rows = jobs if status is None else jobs.filter(F.col("status") == status)
    return page(rows, skip, limit, [F.desc("created_at"), F.col("id")])


def name_match(df: DataFrame, terms: list[str], column: str = "company_name") -> DataFrame:
    """Rows whose text holds every given word (no stemming)."""
    words = F.split(F.lower(F.regexp_replace(column, r"(?U)[^\w]+", " ")), " ")
    wanted = F.array(*[F.lit(t.lower()) for t in terms])
    return df.filter(F.size(F.array_except(wanted, words)) == 0)


def token_index(df: DataFrame, column: str, key: str = "id") -> DataFrame:
    """(token, key) rows for repeated word lookups; write it partitioned or bucketed by token."""
    words = F.split(F.lower(F.regexp_replace(column, r"(?U)[^\w]+", " ")), " ")
    return df.select(key, F.explode(F.array_distinct(words)).alias("token")).filter("token <> ''")


#: Folders that the postings are dealt to by their token.
POSTING_BUCKETS = 64


def write_postings(df: DataFrame, path: str, column: str = "company_name", key: str = "id", buckets: int = POSTING_BUCKETS) -> None:
    """Write the token index for lookups: a folder per bucket of tokens, sorted by token within its files.

    A bucket is written by as many tasks as its rows are spread over, so a word of most rows isn't one file.
    """
    rows = token_index(df, column, key).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "bucket", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("bucket", "token")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup_postings(spark: SparkSession, path: str, terms: list[str], buckets: int = POSTING_BUCKETS) -> DataFrame:
    """Keys of the rows that hold every given word: reads the buckets of those words only and counts words by key."""
    wanted = sorted({t.lower() for t in terms})
    asked = spark.createDataFrame([(t,) for t in wanted], "token string")
    folders = sorted({r[0] for r in asked.select(F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")).collect()})
    rows = spark.read.parquet(path).filter(F.col("bucket").isin(folders) & F.col("token").isin(wanted))
    key = next(c for c in rows.columns if c not in ("token", "bucket"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") == len(wanted)).select(key)

"""Exports, dumps and snapshot housekeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.operators.select import parse_choice
from kontor.schemas import LEAD_QUALITY, LEAD_STATUS

# Header and order of the CSV export.
CSV_COLUMNS = {
    "ID": "id",
    "Name": "company_name",
    "City": "city",
    "Street": "street",
    "Postal Code": "postal_code",
    "Phone": "phone",
    "Email": "email",
    "Website": "website",
    "Industry": "industry",
    "Lead Status": "lead_status",
    "Lead Quality": "lead_quality",
    "Lead Score": "lead_score",
    "Created At": "first_scraped_at",
    "Updated At": "last_updated_at",
}

# Keys of the JSON export that differ from the column names.
JSON_NAMES = {"company_name": "name", "first_scraped_at": "created_at", "last_updated_at": "updated_at"}

# Snapshots kept per class.
KEEP_SNAPSHOTS = {"daily": 7, "weekly": 4, "monthly": 12}


def iso_time(c: Column) -> Column:
    """ISO text; the fraction appears only when there is one."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(c), F.lit(1_000_000))
    return F.when(micros == 0, whole).otherwise(F.concat(whole, F.lit("."), F.lpad(micros.cast("string"), 6, "0")))


def _chosen(df: DataFrame, status: str | None, quality: str | None, limit: int | None, by: str) -> DataFrame:
    """The rows asked for: all of them, or a page of the ``limit`` lowest ids."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    rows = df
    if status:
        rows = rows.filter(F.col("lead_status") == parse_choice(status, LEAD_STATUS, by))
    if quality:
        rows = rows.filter(F.col("lead_quality") == parse_choice(quality, LEAD_QUALITY, by))
    rows = rows.orderBy("id")
    return rows if limit is None else rows.limit(limit)


def csv_rows(df: DataFrame, status: str | None = None, quality: str | None = None, limit: int | None = None) -> DataFrame:
    """The export columns; a missing time is an empty string."""
    rows = _chosen(df, status, quality, limit, "name")
    times = {"first_scraped_at", "last_updated_at"}
    return rows.select(
        *[
            (F.coalesce(iso_time(F.col(c)), F.lit("")) if c in times else F.col(c)).alias(title)
            for title, c in CSV_COLUMNS.items()
        ]
    )


def export_csv(df: DataFrame, path: str, **filters) -> None:
    csv_rows(df, **filters).write.mode("overwrite").option("header", True).csv(path)


def json_rows(df: DataFrame, status: str | None = None, quality: str | None = None, limit: int | None = None) -> DataFrame:
    rows = _chosen(df, status, quality, limit, "value")
    times = {"first_scraped_at", "last_updated_at"}
    return rows.select(
        *[
            (iso_time(F.col(c)) if c in times else F.col(c)).alias(JSON_NAMES.get(c, c)) for c in CSV_COLUMNS.values()
        ]
    )


def json_envelope(df: DataFrame, exported_at: Column, **filters) -> DataFrame:
    """One row {total, exported_at, filters, companies}: a page, held in one row, so pass a ``limit``."""
    rows = json_rows(df, **filters)
    asked = F.struct(
        F.lit(filters.get("status")).cast("string").alias("lead_status"),
        F.lit(filters.get("quality")).cast("string").alias("lead_quality"),
        F.lit(filters.get("limit")).cast("int").alias("limit"),
    )
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_list(F.struct("*"))).alias("companies")
    ).select("total", exported_at.alias("exported_at"), asked.alias("filters"), "companies")


def export_json(df: DataFrame, path: str, **filters) -> None:
    json_rows(df, **filters).write.mode("overwrite").json(path)


def dump_rows(df: DataFrame) -> DataFrame:
    """Leads without the page addresses that are kept in the provenance."""
    return df.drop("detail_url", "source_url")


def dump_leads(df: DataFrame, path: str) -> None:
    dump_rows(df).write.mode("overwrite").json(path)


def expired_snapshots(manifest: DataFrame, keep: dict[str, int] | None = None) -> DataFrame:
    """Snapshots beyond the newest N of their class.  Rows: snapshot, kind, created_at.

    The N newest of a class are found by a bounded sort (each task keeps N rows); the last of them is the
    boundary that the manifest is filtered by.  Of equally new snapshots the lower ones stay; those without a time are the oldest.
    """
    limits = KEEP_SNAPSHOTS if keep is None else keep
    bounds = None
    for kind, n in limits.items():
        newest = manifest.filter(F.col("kind") == kind).select("kind", "created_at", "snapshot").orderBy(F.desc("created_at"), "snapshot").limit(n)
        nth = newest.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("created_at"), "snapshot")))  # n rows
        # below a class of fewer rows nothing expires; of a class that keeps none, all do
        part = nth.filter(F.col("nth") == n).select("kind", F.col("created_at").alias("since"), F.col("snapshot").alias("upto"))
        if n == 0:
            part = manifest.sparkSession.createDataFrame([(kind,)], "kind string").select(
                "kind", F.lit(None).cast(manifest.schema["created_at"].dataType).alias("since"), F.lit(None).cast(manifest.schema["snapshot"].dataType).alias("upto")
            )
        bounds = part if bounds is None else bounds.unionByName(part)
    older = F.coalesce(F.col("created_at") < F.col("since"), F.col("since").isNotNull() & F.col("created_at").isNull())
    tied = F.col("created_at").eqNullSafe(F.col("since")) & (F.col("snapshot") > F.col("upto"))
    return manifest.join(bounds, "kind").filter(F.col("upto").isNull() | older | tied).select(manifest.columns)


def snapshot_check(tables: dict[str, DataFrame], copies: dict[str, DataFrame]) -> DataFrame:
    """Row counts of every table and its copy, and whether they agree."""
    parts = []
    for name in sorted(tables):
        copy = copies[name].agg(F.count(F.lit(1))).scalar()
        parts.append(tables[name].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count", copy.alias("copied")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("valid", F.col("row_count") == F.col("copied"))

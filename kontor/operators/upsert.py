"""Upserts, bulk changes and job bookkeeping on company snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.functions import validate as V
from kontor.operators.prefix import numbered
from kontor.operators.select import parse_choice
from kontor.schemas import LEAD_QUALITY, LEAD_STATUS
from kontor.session import checkpoint_cut

# Columns a bulk update may touch.
BULK_FIELDS = ["lead_status", "lead_quality", "industry", "notes", "tags", "lead_score"]

KEY = ["company_name", "city"]


def _same_key(left: DataFrame, right: DataFrame) -> Column:
    return (left["company_name"] == right["company_name"]) & left["city"].eqNullSafe(right["city"])


def upsert(
    current: DataFrame, incoming: DataFrame, order_col: str, defaults: dict | None = None, top: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(snapshot, outcome counts) of writing ``incoming`` over ``current``.

    Rows match on the exact name and city (NULL city equals NULL).  Non-NULL
    incoming values overwrite; inside one batch a later row updates an earlier
    one.  Of several stored rows of one name and city the one with the lowest id is
    updated.  New rows are numbered after the highest id (``top`` where that is known) in order of arrival, and have
    ``defaults`` where the batch has nothing.  Rows without a name are errors.
    """
    values = [c for c in incoming.columns if c not in (*KEY, order_col, "id") and c in current.columns]
    named = incoming.filter(F.col("company_name").isNotNull() & (F.col("company_name") != ""))
    reduced = named.groupBy(*KEY).agg(
        F.min(order_col).alias("_first"),
        F.count(F.lit(1)).alias("_rows"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order_col))).alias(f"_new_{c}") for c in values],
    )
    batch = checkpoint_cut(reduced.withColumnsRenamed({"company_name": "_name", "city": "_city"}))
    # the keys of the table meet those of the batch once; all that follows is as large as the batch
    met = (current["company_name"] == batch["_name"]) & current["city"].eqNullSafe(batch["_city"])
    target = current.select("id", *KEY).join(batch.select("_name", "_city"), met).groupBy(F.col("_name").alias("_n"), F.col("_city").alias("_c"))
    target = target.agg(F.min("id").alias("_target"))
    same = (F.col("_name") == F.col("_n")) & F.col("_city").eqNullSafe(F.col("_c"))
    found = checkpoint_cut(batch.join(target, same, "left").drop("_n", "_c"))
    rest = [c for c in current.columns if c not in values]
    hits = found.filter("_target is not null").select("_target", *[f"_new_{c}" for c in values])
    updated = current.join(hits, current["id"] == hits["_target"], "left").select(
        *rest, *[F.coalesce(hits[f"_new_{c}"], current[c]).alias(c) for c in values]
    )
    fresh = found.filter("_target is null").withColumnsRenamed({"_name": "company_name", "_city": "city"})
    named_rows = numbered(fresh, ["_first"], "_nth")
    highest = F.lit(top).cast("bigint") if top is not None else current.agg(F.coalesce(F.max("id"), F.lit(-1))).scalar()
    given = defaults or {}
    empty = {c: F.lit(given.get(c)).cast(current.schema[c].dataType) for c in rest if c not in (*KEY, "id")}
    inserted = named_rows.withColumns({"id": highest + F.col("_nth"), **empty}).withColumnsRenamed({f"_new_{c}": c for c in values})
    inserted = inserted.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in given.items() if c in values})
    snapshot = updated.select(current.columns).unionByName(inserted.select(current.columns))
    # a second row of a key updates the row that the first one inserted
    errors = incoming.agg(F.count_if(F.col("company_name").isNull() | (F.col("company_name") == "")))
    counts = found.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"), F.count_if(F.col("_target").isNull()).alias("new"))
    return snapshot, counts.select("new", (F.col("rows") - F.col("new")).alias("updated"), errors.scalar().alias("errors"))


def insert_absent(current: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, conflicts): an existing name and city is a conflict."""
    keys = current.select(*[F.col(c) for c in KEY]).distinct()
    return (
        incoming.join(keys, _same_key(incoming, keys), "left_anti"),
        incoming.join(keys, _same_key(incoming, keys), "left_semi"),
    )


def _flagged(df: DataFrame, ids: DataFrame) -> DataFrame:
    wanted = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return df.join(wanted, "id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def bulk_set(df: DataFrame, ids: DataFrame, updates: dict) -> tuple[DataFrame, DataFrame]:
    """(rows with the updates applied, ids that do not exist)."""
    unknown = sorted(set(updates) - set(BULK_FIELDS))
    if unknown:
        raise ValueError(f"invalid update fields {unknown}; allowed: {BULK_FIELDS}")
    if not updates:
        raise ValueError("no update fields given")
    values = dict(updates)
    for column, allowed in (("lead_status", LEAD_STATUS), ("lead_quality", LEAD_QUALITY)):
        if column in values:
            values[column] = parse_choice(values[column], allowed, by="name")
    missing = ids.select("id").distinct().join(df.select("id"), "id", "left_anti")
    changes = {
        c: F.when(F.col("_hit"), F.lit(v)).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c, v in values.items()
    }
    return _flagged(df, ids).withColumns(changes).drop("_hit"), missing


# Columns that an update of a company may set.
COMPANY_FIELDS = (
    "company_name legal_form industry description website email phone address city postal_code lead_status lead_quality lead_score directors services technologies"
).split()


def update_companies(df: DataFrame, changes: DataFrame, order_col: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(rows with the changes applied, refused changes with a ``reason``).

    ``changes``: id, ``given`` (names of the fields that the change sets), the fields, and ``order_col``.  A given field may be
    NULL and then empties the column; fields that aren't given stay.  Several changes of a company count field by field, the latest first.
    A change is refused as a whole if a name is empty or longer than 255, an e-mail address has a wrong form, a score is outside 0..100, a
    status or grade is none of the known ones, a field can't be set, or the company doesn't exist.
    """
    fields = [c for c in COMPANY_FIELDS if c in changes.columns and c in df.columns]
    checks = {
        "company_name": ~F.length("company_name").between(1, 255), "email": V.valid_email(F.col("email")).isNull(), "lead_score": ~F.col("lead_score").between(0, 100),
        "lead_status": ~F.col("lead_status").isin(LEAD_STATUS), "lead_quality": ~F.col("lead_quality").isin(LEAD_QUALITY),
    }
    unknown = F.size(F.array_except("given", F.array(*[F.lit(c) for c in fields]).cast("array<string>"))) > 0
    reason = F.when(unknown, "field cannot be set")
    for c, wrong in checks.items():
        if c in fields:
            reason = reason.when(F.array_contains("given", c) & F.col(c).isNotNull() & F.coalesce(wrong, F.lit(True)), f"invalid {c}")
    known = df.select("id", F.lit(True).alias("_known"))
    judged = changes.join(known, "id", "left").withColumn("reason", F.when(F.col("_known").isNull(), "company not found").otherwise(reason)).drop("_known")
    judged = checkpoint_cut(judged)
    good = judged.filter("reason is null")
    latest = good.groupBy("id").agg(*[F.max_by(F.struct(c), F.when(F.array_contains("given", c), F.col(order_col))).alias(f"_set_{c}") for c in fields])
    changed = {c: F.when(F.col(f"_set_{c}").isNotNull(), F.col(f"_set_{c}")[c].cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in fields}
    return df.join(latest, "id", "left").withColumns(changed).select(df.columns), judged.filter("reason is not null").select("id", order_col, "reason")


def change_status(df: DataFrame, ids: DataFrame, status: str | None = None, quality: str | None = None):
    updates = {k: v for k, v in (("lead_status", status), ("lead_quality", quality)) if v}
    if not updates:
        raise ValueError("at least one of status or quality is required")
    return bulk_set(df, ids, updates)


def soft_delete(df: DataFrame, ids: DataFrame) -> DataFrame:
    return _flagged(df, ids).withColumn("is_active", F.col("is_active") & ~F.col("_hit")).drop("_hit")


def hard_delete(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_anti")


def restore(df: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, restored count): only rows that were inactive count."""
    flagged = _flagged(df, ids)
    count = flagged.agg(F.count_if(F.col("_hit") & ~F.col("is_active")).alias("restored"))
    return flagged.withColumn("is_active", F.col("is_active") | F.col("_hit")).drop("_hit"), count


def finalize_jobs(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Final counts, status, progress and duration of jobs.

    ``jobs``: id, status, progress, started_at, completed_at.  ``outcomes``: one row
    per processed result with job_id and outcome (new, updated, merged, error), and where it is known the number of ``candidates``
    (possible duplicates) that the result gave.
    """
    candidates = F.coalesce(F.sum("candidates"), F.lit(0)) if "candidates" in outcomes.columns else F.lit(0)
    per_job = outcomes.groupBy(F.col("job_id").alias("id")).agg(
        F.count_if(F.col("outcome") != "error").alias("results_count"),
        F.count_if(F.col("outcome") == "new").alias("new_companies"),
        F.count_if(F.col("outcome") == "updated").alias("updated_companies"),
        F.count_if(F.col("outcome") == "error").alias("errors_count"),
        F.count_if(F.col("outcome") == "merged").alias("auto_merged_duplicates"),
        candidates.cast("bigint").alias("duplicate_candidates_created"),
    )
    counts = ["results_count", "new_companies", "updated_companies", "errors_count", "auto_merged_duplicates", "duplicate_candidates_created"]
    joined = jobs.join(per_job, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    cancelled = F.col("status") == "cancelled"
    empty = (F.col("status") != "failed") & (F.col("results_count") == 0)
    failed = (F.col("status") == "failed") | empty
    status = F.when(cancelled, "cancelled").when(failed, "failed").otherwise("completed")
    capped = F.when(F.col("progress").isNull(), F.lit(0.0)).otherwise(F.least("progress", F.lit(99.0)))
    return joined.withColumns(
        {
            "duration_seconds": (F.unix_micros("completed_at") - F.unix_micros("started_at")) / F.lit(1e6),
            "progress": F.when(cancelled, capped).otherwise(F.lit(100.0)),
            "error_message": F.when(~cancelled & empty, "Scraping returned no results"),
            "status": status,
        }
    )


def progress(current: Column, total: Column, lo: float = 0.0, hi: float = 80.0) -> Column:
    """Share of ``current`` in ``total`` mapped to lo..hi and kept within 0..100."""
    share = F.when(total > 0, current / total).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(lo) + share * F.lit(hi - lo)))

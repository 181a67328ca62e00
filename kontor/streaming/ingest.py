"""Continuous ingest: cleanse, upsert and resolve every micro-batch.

Plain files have no MERGE, so the table lies in copy-on-write buckets (``buckets``): a batch reads
the buckets of its cities and rewrites those whose rows it changes.  A bucket version belongs to one batch id and is
overwritten on a retry, which makes the sink idempotent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from kontor.operators import ingest, resolve, upsert
from kontor.streaming import buckets

#: What a new row has where the batch says nothing.
DEFAULTS = {"is_active": True, "is_duplicate": False}


def read_snapshot(spark: SparkSession, root: str, before: int | None = None, schema: StructType | None = None) -> DataFrame | None:
    """The table after its newest batch, or after the newest one older than ``before``; an empty one before the first."""
    entries = buckets.manifest(spark, root, before)
    if not entries and schema is None:
        return None
    if schema is None:
        first = entries[0]
        schema = spark.read.parquet(f"{root}/data/batch={first.version}/cb={first.cb}/nb={first.nb}").schema
    return buckets.read(spark, root, entries or [], schema)


def apply_batch(
    current: DataFrame, batch: DataFrame, order: str, auto_merge: float = 0.95, candidate: float = 0.80, top: int | None = None
) -> dict[str, DataFrame]:
    """One ingest step: snapshot, candidates, merges, outcome counts and rejected rows.

    ``current`` holds at least all rows of the batch's cities; ``top`` is the highest id of the whole table where
    ``current`` is a part of it.  A new row may match rows that existed before and earlier rows of its batch; the
    best hit (score, then id) decides.  Merges go to the root of their chain.  ``counts``: new (without those merged at once), updated, errors
    (rejected rows as well), auto_merged_duplicates, duplicate_candidates_created.
    """
    accepted, rejected = ingest.clean(batch)
    written, counts = upsert.upsert(current, resolve.checkpoint_cut(accepted), order, defaults=DEFAULTS, top=top)
    written = resolve.checkpoint_cut(written)
    before = current.select("id", F.lit(True).alias("old"))
    fresh = written.join(before, "id", "left_anti")
    hits = resolve.find_duplicates(fresh, written, k=5, threshold=int(candidate * 100), earlier_only=True)
    routed = resolve.checkpoint_cut(resolve.route(hits, auto_merge, candidate))
    merges = routed.filter("decision = 'merge'")
    chained = merges.select("id", F.col("cand_id").alias("parent"))
    tops = chained.select(F.col("parent").alias("id")).distinct().join(chained, "id", "left_anti")
    forest = chained.unionByName(tops.withColumn("parent", F.lit(None).cast("bigint")))
    roots = resolve.resolve_roots(forest).filter("id <> root")
    to_root = resolve.checkpoint_cut(roots.select(F.col("id").alias("duplicate_id"), F.col("root").alias("primary_id")))
    snapshot, _ = resolve.merge_companies(written, to_root)
    found = routed.agg(F.count_if(F.col("decision") == "candidate").alias("found"), F.count_if(F.col("decision") == "merge").alias("merged"))
    merged = found.select("merged").scalar()
    counts = counts.select(
        (F.col("new") - merged).alias("new"), "updated", (F.col("errors") + rejected.agg(F.count("*")).scalar()).alias("errors"),
        merged.alias("auto_merged_duplicates"), found.select("found").scalar().alias("duplicate_candidates_created"),
    )
    return {
        "snapshot": snapshot,
        "accepted": accepted,
        "candidates": routed.filter("decision = 'candidate'"),
        "merges": to_root,
        "counts": counts,
        "rejected": rejected,
    }


def batch_writer(
    root: str, schema: StructType, order: str = "seq", cities: int = buckets.CITIES, names: int = buckets.NAMES, **thresholds: float
) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function of the ingest.  ``cities`` and ``names`` only count for a new table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        entries = buckets.manifest(spark, root, before=batch_id) or []
        by = (entries[0].cities, entries[0].names) if entries else (cities, names)
        raw = resolve.checkpoint_cut(batch)
        keys = buckets.place(ingest.clean(raw)[0], *by).select("cb", "nb").distinct()
        touched = {(r.cb, r.nb) for r in keys.collect()}  # cities * names rows at most
        here = {cb for cb, _ in touched}
        current = buckets.read(spark, root, [b for b in entries if b.cb in here], schema)
        parts = apply_batch(current, raw, order, top=max((b.top for b in entries), default=-1), **thresholds)
        for name in ("candidates", "merges", "counts", "rejected"):
            parts[name].write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        snapshot = resolve.checkpoint_cut(parts["snapshot"].select(schema.fieldNames()))
        ids = parts["merges"].select(F.explode(F.array("duplicate_id", "primary_id")).alias("id")).distinct()
        merged = buckets.place(snapshot.join(ids, "id", "left_semi"), *by).select("cb", "nb").distinct()
        touched |= {(r.cb, r.nb) for r in merged.collect()}
        buckets.write(snapshot, root, batch_id, entries, touched, *by)

    return write


def ingest_stream(
    stream: DataFrame, root: str, checkpoint: str, schema: StructType, order: str = "seq", once: bool = False, **thresholds: float
) -> StreamingQuery:
    """Start the ingest of a raw lead stream into ``root``."""
    writer = stream.writeStream.foreachBatch(batch_writer(root, schema, order, **thresholds)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

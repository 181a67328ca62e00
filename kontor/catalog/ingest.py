"""Queries on the ingest step: a table in buckets takes a batch of raw rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kontor.catalog import duck as D
from kontor.catalog.base import query
from kontor.catalog.entity import OVERALL_SQL, ceiling
from kontor.catalog.leads import stored
from kontor.plans.demo_view import companies
from kontor.session import scratch_dir
from kontor.streaming import buckets, ingest

# Every third company is stored already, the others arrive as one raw batch in the order of their ids.
_FIELDS = ["address", "phone", "website", "email", "industry"]
_COLS = ", ".join(_FIELDS)

_BATCH_SQL = f"""
s AS MATERIALIZED (SELECT id, company_name, city, {_COLS}, is_active FROM ({D.STORED}) st),
cur AS (SELECT * FROM s WHERE id % 3 = 0), inc AS (SELECT * FROM s WHERE id % 3 <> 0),
red AS (SELECT company_name, city, min(id) AS seq, count(*) AS n, {', '.join(f'arg_max({c}, id) FILTER ({c} IS NOT NULL) AS {c}' for c in _FIELDS)}
  FROM inc GROUP BY company_name, city),
tgt AS MATERIALIZED (SELECT r.*, c.target FROM red r LEFT JOIN (SELECT company_name, city, min(id) AS target FROM cur GROUP BY company_name, city) c
  ON c.company_name = r.company_name AND c.city IS NOT DISTINCT FROM r.city),
w AS MATERIALIZED (
  SELECT c.id, c.company_name, c.city, {', '.join(f'coalesce(t.{c}, c.{c}) AS {c}' for c in _FIELDS)}, c.is_active, false AS fresh
  FROM cur c LEFT JOIN tgt t ON t.target = c.id
  UNION ALL SELECT (SELECT coalesce(max(id), -1) FROM cur) + row_number() OVER (ORDER BY seq), company_name, city, {_COLS}, true, true
  FROM tgt WHERE target IS NULL),
k AS MATERIALIZED (SELECT id, city, is_active, fresh, {D.token_key('company_name')} AS name_key, CASE WHEN address <> '' THEN {D.token_key('address')} END AS address_key,
  nullif({D.digits('phone')}, '') AS phone_key, CASE WHEN website <> '' THEN lower(website) END AS website_key FROM w),
raw AS MATERIALIZED (SELECT a.id, b.id AS cand_id, a.name_key AS na, b.name_key AS nb, a.address_key AS aa, b.address_key AS ab,
    a.phone_key AS pa, b.phone_key AS pb, a.website_key AS wa, b.website_key AS wb
  FROM k a JOIN k b ON a.city IS NOT DISTINCT FROM b.city AND b.id < a.id WHERE a.fresh AND b.is_active
    AND 2 * {ceiling('a.name_key', 'b.name_key')} + {ceiling('a.address_key', 'b.address_key')}
      + {ceiling('a.phone_key', 'b.phone_key')} + {ceiling('a.website_key', 'b.website_key')} >= 399.99),
sims AS MATERIALIZED (SELECT id, cand_id, {D.ratio('na', 'nb')} AS name_sim, {D.ratio('aa', 'ab')} AS address_sim,
    {D.ratio('pa', 'pb')} AS phone_sim, {D.ratio('wa', 'wb')} AS website_sim FROM raw),
hits AS (SELECT id, cand_id, {OVERALL_SQL} AS overall, row_number() OVER (PARTITION BY id ORDER BY {OVERALL_SQL} DESC, cand_id) AS rank
  FROM sims WHERE {OVERALL_SQL} >= 80 QUALIFY rank <= 5),
routed AS MATERIALIZED (SELECT *, CASE WHEN rank = 1 AND overall >= 95 THEN 'merge'
    WHEN max(overall) OVER (PARTITION BY id) < 95 THEN 'candidate' END AS decision FROM hits),
link AS (SELECT id, cand_id AS parent FROM routed WHERE decision = 'merge'),
walk AS (SELECT id, parent AS root FROM link WHERE parent NOT IN (SELECT id FROM link)
  UNION ALL SELECT l.id, v.root FROM link l JOIN walk v ON v.id = l.parent),
offer AS (SELECT root, {', '.join(f"arg_min(w.{c}, w.id) FILTER (w.{c} <> '') AS {c}" for c in _FIELDS)} FROM walk JOIN w ON w.id = walk.id GROUP BY root)
"""


def _batch(spark, sf_dir):
    raw = companies(spark, sf_dir).filter("id % 3 <> 0")
    return raw.select("company_name", "city", *_FIELDS, F.col("id").alias("seq"))


def _table(spark, sf_dir):
    """The stored third, in a bucketed table of its own."""
    rows = stored(spark, sf_dir).filter("id % 3 = 0").select(
        "id", "company_name", "city", *_FIELDS, "is_active", F.lit(False).alias("is_duplicate"), F.lit(None).cast("bigint").alias("duplicate_of_id")
    )
    root = f"{scratch_dir(spark)}/kontor-ingest-{uuid.uuid4().hex}"
    buckets.seed(rows, root)
    return root, rows.schema


@query(
    "ingest_apply_batch",
    f"""WITH RECURSIVE {_BATCH_SQL} SELECT w.id, w.company_name, w.city, {', '.join(f"coalesce(nullif(w.{c}, ''), o.{c}, w.{c}) AS {c}" for c in _FIELDS)},
          w.is_active AND v.root IS NULL AS is_active, v.root IS NOT NULL AS is_duplicate, v.root AS duplicate_of_id
        FROM w LEFT JOIN walk v ON v.id = w.id LEFT JOIN offer o ON o.root = w.id""",
)
def _(spark, sf_dir):
    root, schema = _table(spark, sf_dir)
    ingest.batch_writer(root, schema)(_batch(spark, sf_dir), 1)
    return ingest.read_snapshot(spark, root, schema=schema)


@query(
    "ingest_batch_counts",
    f"""WITH RECURSIVE {_BATCH_SQL} SELECT count(*) FILTER (target IS NULL) - (SELECT count(*) FROM link) AS new,
          CAST(sum(CASE WHEN target IS NULL THEN n - 1 ELSE n END) AS BIGINT) AS updated,
          (SELECT count(*) FROM ({D.CO}) co WHERE id % 3 <> 0) - (SELECT count(*) FROM inc) AS errors,
          (SELECT count(*) FROM link) AS auto_merged_duplicates,
          (SELECT count(*) FROM routed WHERE decision = 'candidate') AS duplicate_candidates_created FROM tgt""",
)
def _(spark, sf_dir):
    root, schema = _table(spark, sf_dir)
    current = ingest.read_snapshot(spark, root, schema=schema)
    return ingest.apply_batch(current, _batch(spark, sf_dir), "seq")["counts"]

"""Queries on upserts, bulk changes, provenance, enrichment and verification."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kontor.catalog import duck as D
from kontor.catalog.base import query
from kontor.catalog.leads import stored
from kontor.functions import contact
from kontor.operators import enrich as E
from kontor.operators import upsert as U
from kontor.operators import verify as V
from kontor.plans.demo_view import companies, table

# The stored companies are split: ids not divisible by 3 exist, every id arrives again
# with some columns changed, and every fifth row arrives twice.
_INCOMING_SQL = f"""
cur AS (SELECT id, company_name, city, email, phone, industry FROM ({D.STORED}) s WHERE id % 3 <> 0),
one AS (SELECT CASE WHEN id % 31 = 9 THEN NULL ELSE company_name END AS company_name, city,
    CASE WHEN id % 2 = 0 THEN 'neu@' || CAST(g AS VARCHAR) || '.de' END AS email,
    CASE WHEN id % 4 = 0 THEN '+49 30 ' || CAST(id AS VARCHAR) END AS phone, industry, id * 2 AS seq FROM ({D.STORED}) s),
inc AS (SELECT * FROM one UNION ALL SELECT company_name, city, NULL, '+49 40 ' || CAST(seq AS VARCHAR), 'Zweite', seq + 1 FROM one WHERE seq % 10 = 0),
red AS (SELECT company_name, city, min(seq) AS seq, count(*) AS n, arg_max(email, seq) FILTER (email IS NOT NULL) AS email,
    arg_max(phone, seq) FILTER (phone IS NOT NULL) AS phone, arg_max(industry, seq) FILTER (industry IS NOT NULL) AS industry
  FROM inc WHERE company_name <> '' GROUP BY company_name, city),
joined AS (SELECT c.id, coalesce(c.company_name, r.company_name) AS company_name, coalesce(c.city, r.city) AS city,
    coalesce(r.email, c.email) AS email, coalesce(r.phone, c.phone) AS phone, coalesce(r.industry, c.industry) AS industry, r.seq, r.n
  FROM cur c FULL JOIN red r ON c.company_name = r.company_name AND c.city IS NOT DISTINCT FROM r.city)
"""


def _upsert_input(spark, sf_dir):
    rows = stored(spark, sf_dir)
    cur = rows.filter("id % 3 <> 0").select("id", "company_name", "city", "email", "phone", "industry")
    one = rows.selectExpr(
        "CASE WHEN id % 31 <> 9 THEN company_name END AS company_name",
        "city",
        "CASE WHEN id % 2 = 0 THEN concat('neu@', CAST(g AS STRING), '.de') END AS email",
        "CASE WHEN id % 4 = 0 THEN concat('+49 30 ', CAST(id AS STRING)) END AS phone",
        "industry",
        "id * 2 AS seq",
    )
    again = one.filter("seq % 10 = 0").selectExpr(
        "company_name", "city", "CAST(NULL AS STRING) AS email", "concat('+49 40 ', CAST(seq AS STRING)) AS phone",
        "'Zweite' AS industry", "seq + 1 AS seq",
    )
    return cur, one.unionByName(again)


@query(
    "upsert_snapshot",
    f"""WITH {_INCOMING_SQL}
        SELECT coalesce(id, (SELECT max(id) FROM cur) + row_number() OVER (PARTITION BY id IS NULL ORDER BY seq)) AS id,
          company_name, city, email, phone, industry FROM joined""",
)
def _(spark, sf_dir):
    cur, inc = _upsert_input(spark, sf_dir)
    return U.upsert(cur, inc, "seq")[0]


@query(
    "upsert_counts",
    f"""WITH {_INCOMING_SQL}
        SELECT count(*) FILTER (id IS NULL) AS new, CAST(sum(CASE WHEN id IS NOT NULL THEN n ELSE n - 1 END) AS BIGINT) AS updated,
          (SELECT count(*) FROM inc WHERE coalesce(company_name, '') = '') AS errors FROM joined""",
)
def _(spark, sf_dir):
    cur, inc = _upsert_input(spark, sf_dir)
    return U.upsert(cur, inc, "seq")[1]


@query(
    "upsert_insert_absent",
    f"""WITH s AS ({D.STORED}), cur AS (SELECT company_name, city FROM s WHERE id % 3 <> 0)
        SELECT id, CASE WHEN EXISTS (SELECT 1 FROM cur WHERE cur.company_name = s.company_name AND cur.city IS NOT DISTINCT FROM s.city)
          THEN 'conflict' ELSE 'insert' END AS outcome FROM s""",
)
def _(spark, sf_dir):
    rows = stored(spark, sf_dir).select("id", "company_name", "city")
    fresh, conflicts = U.insert_absent(rows.filter("id % 3 <> 0"), rows)
    return (
        fresh.withColumn("outcome", F.lit("insert")).unionByName(conflicts.withColumn("outcome", F.lit("conflict")))
    ).select("id", "outcome")


def _ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").selectExpr("o_custkey + 50 AS id")


_WANT = "SELECT o_custkey + 50 FROM orders WHERE o_orderstatus = 'F'"


@query(
    "bulk_set",
    f"""SELECT id, CASE WHEN id IN ({_WANT}) THEN 'contacted' ELSE lead_status END AS lead_status,
        CASE WHEN id IN ({_WANT}) THEN 99.5::DOUBLE ELSE lead_score END AS lead_score FROM ({D.CO}) c""",
)
def _(spark, sf_dir):
    rows = companies(spark, sf_dir).select("id", "lead_status", "lead_score")
    return U.bulk_set(rows, _ids(spark, sf_dir), {"lead_status": "Contacted", "lead_score": 99.5})[0]


@query("bulk_set_missing", f"SELECT DISTINCT o_custkey + 50 AS id FROM orders WHERE o_orderstatus = 'F' AND o_custkey + 50 NOT IN (SELECT c_custkey FROM customer)")
def _(spark, sf_dir):
    rows = companies(spark, sf_dir).select("id", "lead_status")
    return U.bulk_set(rows, _ids(spark, sf_dir), {"lead_status": "new"})[1]


@query("bulk_soft_delete", f"SELECT id, is_active AND id NOT IN ({_WANT}) AS is_active FROM ({D.CO}) c")
def _(spark, sf_dir):
    return U.soft_delete(companies(spark, sf_dir).select("id", "is_active"), _ids(spark, sf_dir))


@query("bulk_hard_delete", f"SELECT id, is_active FROM ({D.CO}) c WHERE id NOT IN ({_WANT})")
def _(spark, sf_dir):
    return U.hard_delete(companies(spark, sf_dir).select("id", "is_active"), _ids(spark, sf_dir))


@query("bulk_restore", f"SELECT id, is_active OR id IN ({_WANT}) AS is_active FROM ({D.CO}) c")
def _(spark, sf_dir):
    return U.restore(companies(spark, sf_dir).select("id", "is_active"), _ids(spark, sf_dir))[0]


@query("bulk_restore_count", f"SELECT count(*) AS restored FROM ({D.CO}) c WHERE NOT is_active AND id IN ({_WANT})")
def _(spark, sf_dir):
    return U.restore(companies(spark, sf_dir).select("id", "is_active"), _ids(spark, sf_dir))[1]


@query(
    "bulk_change_status",
    f"""SELECT id, CASE WHEN id IN ({_WANT}) THEN 'rejected' ELSE lead_status END AS lead_status,
        CASE WHEN id IN ({_WANT}) THEN 'd' ELSE lead_quality END AS lead_quality FROM ({D.CO}) c""",
)
def _(spark, sf_dir):
    rows = companies(spark, sf_dir).select("id", "lead_status", "lead_quality")
    return U.change_status(rows, _ids(spark, sf_dir), "REJECTED", "D")[0]


# Changes of companies by id: an order line changes the company of its supplier number, in the order of the lines.
_GIVEN = [("phone", "l_linenumber <> 3"), ("email", "l_linenumber % 2 = 0"), ("lead_score", "l_linenumber >= 5"), ("city", "l_linenumber = 1")]
_NEW = {
    "phone": "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE concat('+49 30 ', CAST(l_partkey AS {t})) END",
    "email": "CASE WHEN l_partkey % 4 = 0 THEN 'kein' ELSE concat('neu', CAST(l_partkey AS {t}), '@x.de') END",
    "lead_score": "CAST(l_partkey % 110 AS DOUBLE)", "city": "concat('Ort ', CAST(l_partkey % 9 AS {t}))",
}
_CHANGES_SQL = f"""
ch AS MATERIALIZED (SELECT id, seq, {', '.join(f"{g} AS g_{c}, {_NEW[c].format(t='VARCHAR')} AS {c}" for c, g in _GIVEN)}
  FROM (SELECT l_suppkey * 3 AS id, l_orderkey * 8 + l_linenumber AS seq, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) l),
judged AS MATERIALIZED (SELECT ch.*, CASE WHEN s.id IS NULL THEN 'company not found' WHEN g_email AND ch.email = 'kein' THEN 'invalid email'
    WHEN g_lead_score AND ch.lead_score > 100 THEN 'invalid lead_score' END AS reason FROM ch LEFT JOIN ({D.CO}) s ON s.id = ch.id)
"""


def _changed(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(
        F.expr("l_suppkey * 3 AS id"), F.expr("l_orderkey * 8 + l_linenumber AS seq"), "l_linenumber"
    ).agg(F.max("l_partkey").alias("l_partkey"))
    given = "array_compact(array(" + ", ".join(f"CASE WHEN {g} THEN '{c}' END" for c, g in _GIVEN) + ")) AS given"
    changes = lines.selectExpr("id", "seq", given, *[f"{x.format(t='STRING')} AS {c}" for c, x in _NEW.items()])
    return U.update_companies(companies(spark, sf_dir).select("id", "company_name", *_NEW), changes)


@query(
    "company_update",
    f"""WITH {_CHANGES_SQL}, ok AS (SELECT * FROM judged WHERE reason IS NULL),
        last AS (SELECT id, {', '.join(f"max(seq) FILTER (g_{c}) AS at_{c}" for c, _ in _GIVEN)} FROM ok GROUP BY id)
        SELECT s.id, company_name, {', '.join(f"CASE WHEN at_{c} IS NOT NULL THEN o_{c}.{c} ELSE s.{c} END AS {c}" for c, _ in _GIVEN)}
        FROM ({D.CO}) s LEFT JOIN last ON last.id = s.id {' '.join(f"LEFT JOIN ok o_{c} ON o_{c}.id = s.id AND o_{c}.seq = at_{c}" for c, _ in _GIVEN)}""",
)
def _(spark, sf_dir):
    return _changed(spark, sf_dir)[0]


@query("company_update_refused", f"WITH {_CHANGES_SQL} SELECT id, seq, reason FROM judged WHERE reason IS NOT NULL")
def _(spark, sf_dir):
    return _changed(spark, sf_dir)[1]


# --- jobs: an order is a job, its lines are processed results ---------------------------

_OUTCOME = "CASE WHEN l_returnflag = 'R' THEN 'error' WHEN l_linestatus = 'F' THEN 'new' WHEN l_partkey % 5 = 0 THEN 'merged' ELSE 'updated' END"


def jobs(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        "CASE o_orderstatus WHEN 'P' THEN 'cancelled' ELSE 'running' END AS status",
        "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 120 AS DOUBLE) END AS progress",
        "o_orderdate AS started_at",
        "timestamp_micros(unix_micros(o_orderdate) + (o_orderkey % 4000) * 1500000) AS completed_at",
        "o_orderpriority AS source",
    )


def outcomes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS job_id", f"{_OUTCOME} AS outcome", "CASE WHEN l_suppkey % 4 = 0 THEN l_linenumber END AS candidates")


JOB_SQL = f"""
SELECT o.o_orderkey AS id, o_orderpriority AS source, coalesce(r, 0) AS results_count, coalesce(n, 0) AS new_companies, coalesce(u, 0) AS updated_companies,
  coalesce(e, 0) AS errors_count, coalesce(m, 0) AS auto_merged_duplicates, CAST(coalesce(dc, 0) AS BIGINT) AS duplicate_candidates_created, CAST((o_orderkey % 4000) * 1.5::DOUBLE AS DOUBLE) AS duration_seconds,
  CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 5 <> 0 THEN least(CAST(o_orderkey % 120 AS DOUBLE), 99.0::DOUBLE) ELSE 0.0::DOUBLE END ELSE 100.0::DOUBLE END AS progress,
  CASE WHEN o_orderstatus = 'P' THEN 'cancelled' WHEN coalesce(r, 0) = 0 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN o_orderstatus <> 'P' AND coalesce(r, 0) = 0 THEN 'Scraping returned no results' END AS error_message
FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) FILTER (x <> 'error') AS r, count(*) FILTER (x = 'new') AS n,
    count(*) FILTER (x = 'updated') AS u, count(*) FILTER (x = 'error') AS e, count(*) FILTER (x = 'merged') AS m, sum(c) AS dc
  FROM (SELECT l_orderkey, {_OUTCOME} AS x, CASE WHEN l_suppkey % 4 = 0 THEN l_linenumber END AS c FROM lineitem) y GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
"""
_JOB_COLS = "id results_count new_companies updated_companies errors_count auto_merged_duplicates duplicate_candidates_created duration_seconds progress status error_message".split()


@query("job_finalize", f"SELECT {', '.join(_JOB_COLS)} FROM ({JOB_SQL}) j")
def _(spark, sf_dir):
    return U.finalize_jobs(jobs(spark, sf_dir), outcomes(spark, sf_dir)).select(_JOB_COLS)


@query(
    "job_progress",
    """SELECT l_orderkey AS id, round(greatest(0, least(100, count(*) * 80.0::DOUBLE / max(l_linenumber))), 6) AS pages,
         round(greatest(0, least(100, 80 + count(*) * 10.0::DOUBLE / max(l_linenumber))), 6) AS enrichment FROM lineitem GROUP BY l_orderkey""",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).alias("cur"), F.max("l_linenumber").alias("total")
    )
    return lines.select(
        "id",
        F.round(U.progress(F.col("cur"), F.col("total")), 6).alias("pages"),
        F.round(U.progress(F.col("cur"), F.col("total"), 80.0, 90.0), 6).alias("enrichment"),
    )


# --- enrichment ---------------------------------------------------------------------------


def _lookup(spark, sf_dir):
    """A register keyed by supplier number: stands for an external lookup."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey * 7 AS id",
        "CASE WHEN s_suppkey % 3 <> 0 THEN concat('https://lookup', CAST(s_suppkey AS STRING), '.de') END AS site",
        "CASE WHEN s_suppkey % 4 <> 0 THEN concat('+49 40 ', CAST(s_suppkey AS STRING)) END AS call",
        "s_acctbal AS rating",
    )


_LOOKUP_SQL = """
SELECT s_suppkey * 7 AS id, CASE WHEN s_suppkey % 3 <> 0 THEN 'https://lookup' || CAST(s_suppkey AS VARCHAR) || '.de' END AS site,
  CASE WHEN s_suppkey % 4 <> 0 THEN '+49 40 ' || CAST(s_suppkey AS VARCHAR) END AS call, s_acctbal AS rating FROM supplier
"""


@query(
    "enrich_lookup",
    f"""SELECT s.id, coalesce(nullif(s.website, ''), l.site, s.website) AS website, coalesce(nullif(s.phone, ''), l.call, s.phone) AS phone, l.rating,
          CASE WHEN l.id IS NOT NULL THEN concat_ws(',', CASE WHEN l.call IS NOT NULL THEN 'call' END,
            CASE WHEN l.rating IS NOT NULL THEN 'rating' END, CASE WHEN l.site IS NOT NULL THEN 'site' END) END AS fields
        FROM ({D.STORED}) s LEFT JOIN ({_LOOKUP_SQL}) l ON l.id = s.id""",
)
def _(spark, sf_dir):
    rows = E.enrich(
        stored(spark, sf_dir), _lookup(spark, sf_dir), "id", {"website": "site", "phone": "call"}, "places", "google_places", ["rating"]
    )
    return rows.select(
        "id", "website", "phone", F.col("places.rating").alias("rating"),
        F.when(F.col("places_source").isNotNull(), F.array_join("places_source.fields", ",")).alias("fields"),
    )


def _budget_sql(used: str, eligible: str, n: int) -> str:
    return f"""WITH s AS (SELECT s.id, s.website, l.id IS NOT NULL AS hit, l.site FROM ({D.STORED}) s LEFT JOIN ({_LOOKUP_SQL}) l ON l.id = s.id),
      r AS (SELECT *, coalesce(sum(CASE WHEN {used} THEN 1 ELSE 0 END) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM s)
      SELECT id, {eligible} AND used < {n} AS looked_up,
        CASE WHEN {eligible} AND used < {n} THEN coalesce(nullif(website, ''), site, website) ELSE website END AS website FROM r"""


@query("enrich_budget_hits", _budget_sql("hit", "true", 20))
def _(spark, sf_dir):
    rows = E.enrich_budgeted(
        stored(spark, sf_dir), _lookup(spark, sf_dir), "id", {"website": "site"}, "places", "google_places", 20, "id", "hits"
    )
    return rows.select("id", "looked_up", "website")


@query("enrich_budget_attempts", _budget_sql("website IS NOT NULL", "website IS NOT NULL", 200))
def _(spark, sf_dir):
    rows = E.enrich_budgeted(
        stored(spark, sf_dir), _lookup(spark, sf_dir), "id", {"website": "site"}, "smart", "smart_scraper", 200, "id", "attempts",
        F.col("website").isNotNull(),
    )
    return rows.select("id", "looked_up", "website")


@query(
    "enrich_fill_website",
    f"""WITH best AS (SELECT o_custkey AS id, arg_min('https://gefunden' || CAST(o_orderkey AS VARCHAR) || '.de', o_orderkey) AS url FROM orders GROUP BY o_custkey)
        SELECT s.id, CASE WHEN coalesce(s.website, '') = '' AND b.url IS NOT NULL THEN b.url ELSE s.website END AS website,
          coalesce(s.website, '') = '' AND b.url IS NOT NULL AS website_found FROM ({D.STORED}) s LEFT JOIN best b ON b.id = s.id""",
)
def _(spark, sf_dir):
    found = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS id", "o_orderkey AS rank", "concat('https://gefunden', CAST(o_orderkey AS STRING), '.de') AS url"
    )
    return E.fill_website(stored(spark, sf_dir), found, "id").select("id", "website", "website_found")


@query(
    "enrich_detail_url",
    f"""SELECT id, CASE WHEN id % 5 = 0 THEN 'https://detail.de/' || CAST(id AS VARCHAR)
          WHEN id % 3 = 0 THEN 'https://www.11880.com/branchenbuch/' || CAST(g AS VARCHAR) END AS detail FROM ({D.CO}) c""",
)
def _(spark, sf_dir):
    rows = companies(spark, sf_dir).selectExpr(
        "id",
        "CASE WHEN id % 5 = 0 THEN concat('https://detail.de/', CAST(id AS STRING)) WHEN id % 5 = 1 THEN '' END AS explicit",
        """array('https://other.de/x', CASE WHEN id % 3 = 0 THEN concat('https://www.11880.com/branchenbuch/', CAST(g AS STRING)) END,
                 CASE WHEN id % 3 = 0 THEN 'https://www.11880.com/branchenbuch/later' END) AS urls""",
    )
    return rows.select("id", E.detail_url(F.col("explicit"), F.col("urls")).alias("detail"))


@query(
    "enrich_discover",
    rf"""WITH empty AS (SELECT o_orderkey AS job_id, o_orderpriority AS city FROM orders
           WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R')),
         cand AS (SELECT l_orderkey AS job_id, CASE WHEN l_partkey % 2 = 0 THEN '  Firma ' || CAST(l_partkey AS VARCHAR) || ' ' END AS title,
           'https://host' || CAST(l_suppkey AS VARCHAR) || '.de/a' AS url FROM lineitem)
         SELECT job_id, coalesce({D.strip('title')}, regexp_extract(url, '^https://([^/]*)', 1)) AS company_name, url AS website, city FROM cand JOIN empty USING (job_id)""",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    cand = lines.selectExpr(
        "l_orderkey AS job_id",
        "CASE WHEN l_partkey % 2 = 0 THEN concat('  Firma ', CAST(l_partkey AS STRING), ' ') END AS title",
        "concat('https://host', CAST(l_suppkey AS STRING), '.de/a') AS url",
    )
    job = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS job_id", "o_orderpriority AS city")
    found = lines.filter("l_returnflag <> 'R'").selectExpr("l_orderkey AS job_id")
    return E.discover_fallback(job, found, cand).select("job_id", "company_name", "website", "city")


@query(
    "enrich_clip_reviews",
    """SELECT conv_id, len(list_slice(l, 1, 5)) AS kept, array_to_string(list_transform(list_slice(l, 1, 5), lambda t: substr(t, 1, 200)), '|') AS texts
       FROM (SELECT conv_id, list(text ORDER BY turn) AS l FROM conversations GROUP BY conv_id) x""",
)
def _(spark, sf_dir):
    # the first five turns are found before the list is built, which they bound
    first = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "text")
    review = F.struct("nth", F.col("turn").alias("time"), F.col("role").alias("author"), F.col("turn").alias("rating"), "text")
    talks = (
        table(spark, sf_dir, "conversations")
        .withColumn("nth", F.row_number().over(first))
        .filter("nth <= 5")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(review)).alias("r"))
    )
    return talks.select("conv_id", E.clip_reviews(F.col("r")).alias("r")).select(
        "conv_id", F.size("r").cast("bigint").alias("kept"), F.array_join("r.text", "|").alias("texts")
    )


# --- provenance -----------------------------------------------------------------------------


def sources(spark, sf_dir):
    """Long-form provenance: an order line is one source entry of its part number."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS company_id",
        "l_orderkey * 10 + l_linenumber AS position",
        "l_returnflag AS name",
        "concat('https://src', CAST(l_suppkey % 2 AS STRING), '.de') AS url",
        "array(l_linestatus, CASE WHEN l_linenumber % 2 = 0 THEN 'phone' ELSE 'email' END) AS fields",
    )


@query(
    "provenance_merge",
    """SELECT company_id, name, url, min(position) AS position, array_to_string(list_sort(list_distinct(flatten(list(fields)))), ',') AS fields
       FROM (SELECT l_partkey AS company_id, l_orderkey * 10 + l_linenumber AS position, l_returnflag AS name,
         'https://src' || CAST(l_suppkey % 2 AS VARCHAR) || '.de' AS url,
         [l_linestatus, CASE WHEN l_linenumber % 2 = 0 THEN 'phone' ELSE 'email' END] AS fields FROM lineitem) x
       GROUP BY company_id, name, url""",
)
def _(spark, sf_dir):
    merged = E.merge_provenance(sources(spark, sf_dir), ["company_id"])
    return merged.withColumn("fields", F.array_join("fields", ","))


@query("provenance_leads_per_source", "SELECT l_returnflag AS name, count(*) AS leads FROM (SELECT DISTINCT l_partkey, l_returnflag, l_suppkey % 2 FROM lineitem) x GROUP BY 1")
def _(spark, sf_dir):
    from kontor.operators.rollup import leads_per_source

    return leads_per_source(E.merge_provenance(sources(spark, sf_dir), ["company_id"]))


@query(
    "provenance_merge_sources",
    """WITH l AS (SELECT '  ' || upper(p_name) || ' ' AS company_name, p_partkey AS seq, CASE WHEN p_partkey % 3 = 0 THEN '0' || CAST(p_partkey AS VARCHAR) ELSE '' END AS phone,
         CASE WHEN p_partkey % 5 = 0 THEN 'a' || CAST(p_partkey AS VARCHAR) || '@x.de' END AS email, p_brand AS city FROM part)
       SELECT lower(trim(company_name)) AS name_key, min(seq) AS seq, count(*) AS records, arg_min(company_name, seq) AS company_name, arg_min(city, seq) AS city,
         arg_min(phone, seq) FILTER (phone <> '') AS phone, arg_min(email, seq) FILTER (email <> '') AS email FROM l GROUP BY 1""",
)
def _(spark, sf_dir):
    leads = table(spark, sf_dir, "part").selectExpr(
        "concat('  ', upper(p_name), ' ') AS company_name",
        "p_partkey AS seq",
        "CASE WHEN p_partkey % 3 = 0 THEN concat('0', CAST(p_partkey AS STRING)) ELSE '' END AS phone",
        "CASE WHEN p_partkey % 5 = 0 THEN concat('a', CAST(p_partkey AS STRING), '@x.de') END AS email",
        "p_brand AS city",
    )
    return E.merge_sources(leads, "seq")


# --- verification ---------------------------------------------------------------------------

_MAIL = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+)"


def _doc_mails(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(_MAIL), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("email"))


_DOC_MAILS = f"SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) AS email FROM documents"


@query("verify_work_list", f"SELECT DISTINCT lower(email) AS email FROM ({_DOC_MAILS}) m")
def _(spark, sf_dir):
    return V.work_list(_doc_mails(spark, sf_dir), "email")


@query(
    "verify_cache_join",
    """WITH w AS (SELECT DISTINCT user_id FROM events),
       c AS (SELECT user_id, arg_max(event_type, ts) AS status FROM events WHERE event_type NOT IN ('rate_limited', 'not_attempted')
         AND ts <= TIMESTAMP '2024-01-20' AND ts > TIMESTAMP '2024-01-20' - INTERVAL 604800 SECOND GROUP BY user_id)
       SELECT w.user_id, c.status, c.user_id IS NOT NULL AS cached FROM w LEFT JOIN c USING (user_id)""",
)
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    cache = events.selectExpr("user_id", "event_type AS status", "ts AS verified_at")
    return V.cache_join(events.select("user_id").distinct(), cache, "user_id", F.lit("2024-01-20").cast("timestamp"))


@query(
    "verify_mx_join",
    f"""WITH m AS (SELECT DISTINCT lower(email) AS email FROM ({_DOC_MAILS}) m UNION SELECT 'kein-at' || CAST(r_regionkey AS VARCHAR) FROM region),
        d AS (SELECT email, regexp_extract(email, '^[^@]*@(.*)$', 1) AS domain FROM m),
        mx AS (SELECT domain, arg_min('mx' || CAST(s_suppkey % 4 AS VARCHAR) || '.' || domain, s_suppkey % 4) AS host FROM (SELECT DISTINCT domain FROM d), supplier
          WHERE domain <> '' AND length(domain) % 2 = 0 GROUP BY domain)
        SELECT email, d.domain, host AS mx_host, CASE WHEN d.domain = '' THEN 'invalid_format' WHEN host IS NULL THEN 'no_mx_records' END AS status
        FROM d LEFT JOIN mx ON mx.domain = d.domain""",
)
def _(spark, sf_dir):
    mails = V.work_list(_doc_mails(spark, sf_dir), "email")
    odd = table(spark, sf_dir, "region").select(F.concat(F.lit("kein-at"), F.col("r_regionkey").cast("string")).alias("email"))
    work = mails.unionByName(odd)
    # mail hosts 0..3 of every domain of even length stand for a domain name table
    domain = F.regexp_extract("email", "^[^@]*@(.*)$", 1)
    mx = (
        work.select(domain.alias("domain"))
        .distinct()
        .filter("domain <> '' AND length(domain) % 2 = 0")
        .select("domain", F.explode(F.array(*[F.lit(i) for i in (3, 1, 0, 2)])).alias("preference"))
        .withColumn("host", F.concat(F.lit("mx"), F.col("preference").cast("string"), F.lit("."), "domain"))
    )
    return V.mx_join(work, mx)


@query(
    "verify_status_code",
    """SELECT event_id, CASE code WHEN 250 THEN 'valid' WHEN 451 THEN 'temporary_error' WHEN 550 THEN 'invalid' ELSE 'smtp_' || CAST(code AS VARCHAR) END AS status
       FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 250 WHEN 'click' THEN 451 WHEN 'error' THEN 550 ELSE 421 END AS code FROM events) x""",
)
def _(spark, sf_dir):
    code = F.expr("CASE event_type WHEN 'view' THEN 250 WHEN 'click' THEN 451 WHEN 'error' THEN 550 ELSE 421 END")
    return table(spark, sf_dir, "events").select("event_id", contact.status_from_code(code).alias("status"))


@query(
    "verify_provider_status",
    """SELECT event_id, CASE p WHEN 'emaillistverify' THEN CASE WHEN a = 'ok' THEN 'valid' ELSE a END WHEN 'other' THEN 'api_unsupported' ELSE a END AS status,
         CASE p WHEN 'zerobounce' THEN a = 'valid' WHEN 'hunter' THEN a = 'deliverable' WHEN 'emaillistverify' THEN a = 'ok' ELSE false END AS valid
       FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'zerobounce' WHEN 1 THEN 'hunter' WHEN 2 THEN 'emaillistverify' ELSE 'other' END AS p,
         CASE event_type WHEN 'view' THEN 'valid' WHEN 'click' THEN 'deliverable' WHEN 'error' THEN 'ok' ELSE 'unknown' END AS a FROM events) x""",
)
def _(spark, sf_dir):
    provider = F.expr("CASE event_id % 4 WHEN 0 THEN 'zerobounce' WHEN 1 THEN 'hunter' WHEN 2 THEN 'emaillistverify' ELSE 'other' END")
    answer = F.expr("CASE event_type WHEN 'view' THEN 'VALID' WHEN 'click' THEN 'Deliverable' WHEN 'error' THEN 'ok' ELSE '' END")
    rows = table(spark, sf_dir, "events").select("event_id", contact.provider_status(provider, answer).alias("r"))
    return rows.select("event_id", "r.status", "r.valid")


@query(
    "verify_due",
    """SELECT o_orderkey AS id FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY ORDER BY o_orderdate, o_orderkey LIMIT 100""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderdate AS verified_at")
    return V.due_for_reverify(rows, F.lit("1998-01-01").cast("timestamp")).select("id")


_CC, _NAT = D.phone_parts("phone")


@query(
    "verify_phone",
    f"""SELECT id, coalesce(ok, false) AS valid, CASE WHEN NOT readable THEN 'invalid_format' WHEN ok THEN 'valid' ELSE 'invalid' END AS status,
          CASE WHEN readable THEN '+' || cc || nat END AS e164,
          CASE WHEN NOT readable THEN NULL WHEN mob THEN 'mobile' WHEN fix THEN 'fixed_line' ELSE 'unknown' END AS number_type,
          CASE WHEN readable THEN CAST(cc AS INT) END AS country_code, CASE WHEN readable THEN CAST(nat AS BIGINT) END AS national_number
        FROM (SELECT *, coalesce(cc <> '' AND nat <> '', false) AS readable, cc = '49' AND regexp_matches(nat, '^1[567][0-9]{{8,9}}$') AS mob,
            cc = '49' AND regexp_matches(nat, '^[2-9][0-9]{{5,10}}$') AS fix,
            (cc = '49' AND (regexp_matches(nat, '^1[567][0-9]{{8,9}}$') OR regexp_matches(nat, '^[2-9][0-9]{{5,10}}$')))
              OR (cc <> '49' AND length(cc) + length(nat) BETWEEN 8 AND 15) AS ok
          FROM (SELECT id, {_CC} AS cc, {_NAT} AS nat FROM ({D.CO}) c) y) x""",
)
def _(spark, sf_dir):
    return companies(spark, sf_dir).select("id", contact.phone_struct(F.col("phone")).alias("p")).select("id", "p.*")

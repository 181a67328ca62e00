"""Queries on duplicate companies: similarity, search, scan, routing, merge, review."""

from __future__ import annotations

from pyspark.sql import functions as F

from kontor.catalog import duck as D
from kontor.catalog.base import query
from kontor.catalog.leads import stored
from kontor.functions.similarity import ratio, token_sort_key
from kontor.operators import resolve as R
from kontor.plans.demo_view import companies, table

_KEYS = f"""
SELECT id, g, company_name, address, phone, website, city, is_active,
  {D.token_key('company_name')} AS name_key,
  CASE WHEN address <> '' THEN {D.token_key('address')} END AS address_key,
  nullif({D.digits('phone')}, '') AS phone_key,
  CASE WHEN website <> '' THEN lower(website) END AS website_key
FROM ({D.STORED}) st
"""


def _w(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


OVERALL_SQL = f"{_w(0.4)} * name_sim + {_w(0.2)} * address_sim + {_w(0.2)} * phone_sim + {_w(0.2)} * website_sim"


def ceiling(a: str, b: str) -> str:
    """Upper bound of a rounded ratio: an edit distance never exceeds the insert/delete distance."""
    return f"coalesce(100.5 - 100.0 * levenshtein({a}, {b}) / greatest(length({a}) + length({b}), 1), 0)"


# Every unordered pair of active companies of one city whose score can reach 80 at all
# (the list-based LCS of DuckDB is too slow to run on pairs that cannot).
_PAIRS = f"""
k AS MATERIALIZED ({_KEYS}),
raw AS MATERIALIZED (SELECT a.id AS lo, b.id AS hi, a.name_key AS na, b.name_key AS nb, a.address_key AS aa, b.address_key AS ab,
    a.phone_key AS pa, b.phone_key AS pb, a.website_key AS wa, b.website_key AS wb
  FROM k a JOIN k b ON a.city IS NOT DISTINCT FROM b.city AND a.id < b.id WHERE a.is_active AND b.is_active
    AND 2 * {ceiling('a.name_key', 'b.name_key')} + {ceiling('a.address_key', 'b.address_key')}
      + {ceiling('a.phone_key', 'b.phone_key')} + {ceiling('a.website_key', 'b.website_key')} >= 399.99),
sims AS MATERIALIZED (SELECT lo, hi, {D.ratio('na', 'nb')} AS name_sim, {D.ratio('aa', 'ab')} AS address_sim,
    {D.ratio('pa', 'pb')} AS phone_sim, {D.ratio('wa', 'wb')} AS website_sim FROM raw),
pairs AS MATERIALIZED (SELECT *, {OVERALL_SQL} AS overall FROM sims WHERE {OVERALL_SQL} >= 80),
both_ways AS (SELECT lo AS id, hi AS cand_id, * EXCLUDE (lo, hi) FROM pairs UNION ALL SELECT hi, lo, * EXCLUDE (lo, hi) FROM pairs),
hits AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overall DESC, cand_id) AS rank FROM both_ways QUALIFY rank <= 5)
"""

_PAIR_SIM = f"""
WITH k AS ({_KEYS})
SELECT a.id AS a_id, b.id AS b_id, {D.ratio('a.name_key', 'b.name_key')} AS name_sim,
  {D.ratio('a.address_key', 'b.address_key')} AS address_sim, {D.ratio('a.phone_key', 'b.phone_key')} AS phone_sim,
  {D.ratio('a.website_key', 'b.website_key')} AS website_sim
FROM k a JOIN k b ON a.g = b.g AND a.id < b.id
"""


def _group_pairs(spark, sf_dir):
    """All pairs inside the demo groups (three rows each)."""
    keyed = R.comparison_keys(stored(spark, sf_dir)).select("id", "g", *[f"{f}_key" for f in R.FIELDS])

    def side(s):
        return keyed.select("g", F.col("id").alias(f"{s}_id"), *[F.col(f"{f}_key").alias(f"{s}_{f}_key") for f in R.FIELDS])

    return R.pair_similarity(side("a").join(side("b"), "g").filter("a_id < b_id"))


@query(
    "similarity_ratio",
    f"SELECT p_partkey AS id, {D.ratio('lower(p_name)', 'lower(p_type)')} AS ratio FROM part",
)
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), ratio(F.lower("p_name"), F.lower("p_type")).alias("ratio"))


@query("similarity_token_key", f"SELECT id, {D.token_key('company_name')} AS name_key FROM ({D.CO}) co")
def _(spark, sf_dir):
    return companies(spark, sf_dir).select("id", token_sort_key(F.lower("company_name")).alias("name_key"))


@query("similarity_pairs", f"SELECT *, round({OVERALL_SQL}, 6) AS overall FROM ({_PAIR_SIM}) p")
def _(spark, sf_dir):
    return _group_pairs(spark, sf_dir).select(
        "a_id", "b_id", *[f"{f}_sim" for f in R.FIELDS], F.round("overall", 6).alias("overall")
    )


@query(
    "similarity_is_duplicate",
    f"""SELECT a_id, b_id FROM ({_PAIR_SIM}) p WHERE name_sim >= 85
        AND (address_sim >= 80 OR phone_sim >= 90 OR website_sim >= 95 OR {OVERALL_SQL} >= 80)""",
)
def _(spark, sf_dir):
    sims = [F.col(f"{f}_sim") for f in R.FIELDS]
    return _group_pairs(spark, sf_dir).filter(R.is_duplicate(*sims, F.col("overall"))).select("a_id", "b_id")


def _hits(spark, sf_dir, k=5):
    return R.find_duplicates(stored(spark, sf_dir), k=k)


@query(
    "resolve_find",
    f"""WITH {_PAIRS} SELECT id, cand_id, CAST(rank AS INT) AS rank, name_sim, address_sim, phone_sim, website_sim,
        round(overall, 6) AS overall FROM hits""",
)
def _(spark, sf_dir):
    return _hits(spark, sf_dir).select(
        "id", "cand_id", "rank", *[f"{f}_sim" for f in R.FIELDS], F.round("overall", 6).alias("overall")
    )


@query(
    "resolve_find_probe",
    f"""WITH {_PAIRS}, wide AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overall DESC, cand_id) AS pos FROM both_ways)
        SELECT id, cand_id, CAST(pos AS INT) AS rank, round(overall, 6) AS overall FROM wide
        WHERE pos <= 10 AND id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH')""",
)
def _(spark, sf_dir):
    base = stored(spark, sf_dir)
    asked = table(spark, sf_dir, "orders").filter("o_orderpriority = '2-HIGH'").selectExpr("o_custkey AS id").distinct()
    probe = base.filter("is_active").join(asked, "id", "left_semi")
    hits = R.find_duplicates(probe, base, k=10)
    return hits.select("id", "cand_id", "rank", F.round("overall", 6).alias("overall"))


_SCAN = f"""{_PAIRS}, seen AS (SELECT least(id, cand_id) AS lo, greatest(id, cand_id) AS hi, bool_or(id < cand_id) AS lo_first,
  any_value(name_sim) AS name_sim, any_value(overall) AS overall FROM hits GROUP BY 1, 2),
scanned AS (SELECT CASE WHEN lo_first THEN lo ELSE hi END AS company_a_id, CASE WHEN lo_first THEN hi ELSE lo END AS company_b_id,
  name_sim, overall FROM seen)"""


@query(
    "resolve_scan",
    f"""WITH {_SCAN} SELECT company_a_id, company_b_id, round(name_sim / 100.0::DOUBLE, 6) AS name_similarity,
        round(overall / 100.0::DOUBLE, 6) AS overall_similarity, 'pending' AS status FROM scanned""",
)
def _(spark, sf_dir):
    return R.scan(stored(spark, sf_dir)).select(
        "company_a_id",
        "company_b_id",
        F.round("name_similarity", 6).alias("name_similarity"),
        F.round("overall_similarity", 6).alias("overall_similarity"),
        "status",
    )


@query(
    "resolve_scan_incremental",
    f"""WITH {_SCAN} SELECT company_a_id, company_b_id FROM scanned
        WHERE NOT (greatest(company_a_id, company_b_id) % 2 = 0 AND least(company_a_id, company_b_id) + 1 = greatest(company_a_id, company_b_id))""",
)
def _(spark, sf_dir):
    rows = stored(spark, sf_dir)
    # pairs (2n, 2n-1) are already known, stored the other way round
    known = rows.filter("id % 2 = 0").selectExpr("id AS company_a_id", "id - 1 AS company_b_id")
    return R.scan(rows, known).select("company_a_id", "company_b_id")


@query(
    "resolve_scan_summary",
    f"""WITH {_PAIRS} SELECT (SELECT count(*) FROM k WHERE is_active) AS scanned_companies,
        (SELECT count(*) FROM hits) AS candidates_created, 80.0::DOUBLE AS threshold""",
)
def _(spark, sf_dir):
    return R.scan_summary(stored(spark, sf_dir), _hits(spark, sf_dir))


@query(
    "resolve_scan_report",
    f"""WITH {_PAIRS} SELECT h.id, a.company_name, h.cand_id, b.company_name AS cand_name, CAST(h.rank AS INT) AS rank,
        round(h.overall, 6) AS overall FROM hits h JOIN k a ON a.id = h.id JOIN k b ON b.id = h.cand_id""",
)
def _(spark, sf_dir):
    report = R.scan_report(stored(spark, sf_dir), _hits(spark, sf_dir))
    return report.withColumn("overall", F.round("overall", 6))


_ROUTED = f"""{_PAIRS}, routed AS (SELECT *, CASE WHEN rank = 1 AND overall >= 95 THEN 'merge'
   WHEN max(overall) OVER (PARTITION BY id) < 95 AND overall >= 80 THEN 'candidate' END AS decision FROM hits)"""


@query(
    "resolve_route",
    f"WITH {_ROUTED} SELECT id, cand_id, decision, round(overall, 6) AS overall FROM routed WHERE decision IS NOT NULL",
)
def _(spark, sf_dir):
    return R.route(_hits(spark, sf_dir)).select("id", "cand_id", "decision", F.round("overall", 6).alias("overall"))


# --- merge, roots, review ------------------------------------------------------------

# In every demo group the first member is the primary of the other two.
_MERGE_SQL = f"""
WITH s AS ({D.STORED}),
pair AS (SELECT d.id AS dup, d.g * 3 AS prim FROM s d JOIN s p ON p.id = d.g * 3 WHERE d.id <> d.g * 3),
donor AS (SELECT p.prim, s.* FROM pair p JOIN s ON s.id = p.dup),
offer AS (SELECT prim,
  arg_min(email, id) FILTER (email <> '') AS email, arg_min(phone, id) FILTER (phone <> '') AS phone,
  arg_min(website, id) FILTER (website <> '') AS website, arg_min(industry, id) FILTER (industry <> '') AS industry,
  arg_min(directors_text, id) FILTER (directors_text IS NOT NULL) AS directors_text FROM donor GROUP BY prim)
SELECT s.id,
  coalesce(nullif(s.email, ''), o.email, s.email) AS email, coalesce(nullif(s.phone, ''), o.phone, s.phone) AS phone,
  coalesce(nullif(s.website, ''), o.website, s.website) AS website, coalesce(nullif(s.industry, ''), o.industry, s.industry) AS industry,
  coalesce(s.directors_text, o.directors_text) AS directors_text,
  s.is_active AND p.dup IS NULL AS is_active, p.dup IS NOT NULL AS is_duplicate, p.prim AS duplicate_of_id
FROM s LEFT JOIN offer o ON o.prim = s.id LEFT JOIN pair p ON p.dup = s.id
"""


def _group_merges(rows):
    primaries = rows.select(F.col("id").alias("primary_id"))
    dups = rows.filter("id <> g * 3").select(F.col("id").alias("duplicate_id"), (F.col("g") * 3).alias("primary_id"))
    return dups.join(primaries, "primary_id", "left_semi").select("primary_id", "duplicate_id")


@query("resolve_merge", _MERGE_SQL)
def _(spark, sf_dir):
    rows = stored(spark, sf_dir)
    merged, _ = R.merge_companies(rows, _group_merges(rows))
    return merged.select(
        "id", "email", "phone", "website", "industry", F.array_join("directors", "|").alias("directors_text"),
        "is_active", "is_duplicate", "duplicate_of_id",
    )


@query(
    "resolve_merge_provenance",
    f"""WITH s AS ({D.STORED}),
        pair AS (SELECT d.id AS dup, d.g * 3 AS prim FROM s d JOIN s p ON p.id = d.g * 3 WHERE d.id <> d.g * 3),
        src AS (SELECT o_custkey AS company_id, o_orderkey AS ordinal, o_orderpriority AS name FROM orders WHERE o_custkey IN (SELECT id FROM s))
        SELECT company_id, ordinal, name, CAST(NULL AS BIGINT) AS origin_id FROM src
        UNION ALL SELECT p.prim, ordinal, name, company_id FROM src JOIN pair p ON p.dup = company_id""",
)
def _(spark, sf_dir):
    rows = stored(spark, sf_dir)
    sources = (
        table(spark, sf_dir, "orders")
        .selectExpr("o_custkey AS company_id", "o_orderkey AS ordinal", "o_orderpriority AS name")
        .join(rows.select(F.col("id").alias("company_id")), "company_id", "left_semi")
    )
    return R.merge_companies(rows, _group_merges(rows), sources)[1]


@query(
    "resolve_roots",
    """WITH RECURSIVE node AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey - 1 - o_orderkey % 3 END AS parent FROM orders),
       link AS (SELECT n.id, CASE WHEN p.id IS NOT NULL THEN n.parent END AS parent FROM node n LEFT JOIN node p ON p.id = n.parent),
       walk AS (SELECT id, id AS root FROM link WHERE parent IS NULL UNION ALL
                SELECT l.id, w.root FROM link l JOIN walk w ON l.parent = w.id)
       SELECT id, root FROM walk""",
)
def _(spark, sf_dir):
    nodes = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey - 1 - o_orderkey % 3 END AS parent"
    )
    known = nodes.selectExpr("id AS parent", "true AS known")
    links = nodes.join(known, "parent", "left").selectExpr("id", "CASE WHEN known THEN parent END AS parent")
    return R.resolve_roots(links).select("id", "root")


# Candidates and review decisions derived from orders.
_CAND_SQL = """
SELECT o_orderkey AS id, o_custkey AS company_a_id, (o_custkey * 7 + 1) % (SELECT count(*) FROM customer) AS company_b_id,
  round(0.5::DOUBLE + (o_orderkey % 50) / 100.0::DOUBLE, 2) AS overall_similarity,
  CASE o_orderstatus WHEN 'F' THEN 'rejected' WHEN 'P' THEN 'confirmed' ELSE 'pending' END AS status,
  CASE WHEN o_orderkey % 4 = 0 THEN 'old note' END AS notes, o_orderdate AS created_at
FROM orders
"""


def _candidates(spark, sf_dir):
    n = table(spark, sf_dir, "customer").agg(F.count(F.lit(1))).scalar()
    orders = table(spark, sf_dir, "orders").withColumn("n", n)
    return orders.selectExpr(
        "o_orderkey AS id",
        "o_custkey AS company_a_id",
        "(o_custkey * 7 + 1) % n AS company_b_id",
        "round(0.5D + (o_orderkey % 50) / 100.0D, 2) AS overall_similarity",
        "CASE o_orderstatus WHEN 'F' THEN 'rejected' WHEN 'P' THEN 'confirmed' ELSE 'pending' END AS status",
        "CAST(NULL AS STRING) AS reviewed_by",
        "CAST(NULL AS TIMESTAMP) AS reviewed_at",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'old note' END AS notes",
        "o_orderdate AS created_at",
    )


def _decisions(spark, sf_dir):
    """A decision for every order line; orders and their line numbers are the sequence.  Lines are dealt by order, as decisions are by candidate."""
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
        .repartition("l_orderkey")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"), F.min("l_returnflag").alias("flag"))
        .selectExpr(
            "l_orderkey AS candidate_id",
            "CASE WHEN flag = 'R' THEN 'reject' ELSE 'merge' END AS action",
            "l_suppkey AS primary_id",
            "CASE WHEN l_partkey % 9 = 0 THEN l_suppkey ELSE l_partkey END AS duplicate_id",
            "concat('user', CAST(l_suppkey % 3 AS STRING)) AS reviewer",
            "timestamp'2024-01-01 00:00:00' AS decided_at",
            "CASE WHEN l_partkey % 2 = 0 THEN 'same firm' END AS reason",
            "l_orderkey * 8 + l_linenumber AS seq",
        )
    )


_DECISION_SQL = """
SELECT l_orderkey AS candidate_id, CASE WHEN min(l_returnflag) = 'R' THEN 'reject' ELSE 'merge' END AS action,
  min(l_suppkey) AS primary_id, CASE WHEN min(l_partkey) % 9 = 0 THEN min(l_suppkey) ELSE min(l_partkey) END AS duplicate_id,
  'user' || CAST(min(l_suppkey) % 3 AS VARCHAR) AS reviewer, CASE WHEN min(l_partkey) % 2 = 0 THEN 'same firm' END AS reason,
  l_orderkey * 8 + l_linenumber AS seq
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""

# A sequential fold: the state is the list of companies merged away so far, each followed by minus the position of its merge.
_REVIEW_SQL = f"""
cand AS ({_CAND_SQL}), co AS (SELECT id, is_active, id % 37 = 5 AS is_duplicate FROM ({D.CO}) x),
dec AS MATERIALIZED ({_DECISION_SQL}),
fixed AS MATERIALIZED (SELECT d.*, du.is_duplicate AS already, CASE WHEN c.id IS NULL THEN 'candidate not found'
    WHEN action = 'merge' AND (p.id IS NULL OR du.id IS NULL) THEN 'company not found'
    WHEN action = 'merge' AND primary_id = duplicate_id THEN 'self merge'
    WHEN action = 'merge' AND NOT p.is_active THEN 'primary inactive' END AS error
  FROM dec d LEFT JOIN cand c ON c.id = d.candidate_id LEFT JOIN co p ON p.id = d.primary_id LEFT JOIN co du ON du.id = d.duplicate_id),
folded AS (SELECT list_reduce(list([CAST(primary_id AS BIGINT), CAST(duplicate_id AS BIGINT), CAST(seq AS BIGINT)] ORDER BY seq),
    lambda s, x: CASE WHEN list_contains(s, x[1]) OR list_contains(s, x[2]) THEN s ELSE list_concat(s, [x[2], -x[3]]) END,
    CAST([] AS BIGINT[])) AS s FROM fixed WHERE action = 'merge' AND error IS NULL AND NOT already),
gone AS (SELECT s[2 * i - 1] AS company, -s[2 * i] AS done FROM folded, unnest(generate_series(1, len(s) // 2)) t(i)),
judged AS MATERIALIZED (SELECT f.* EXCLUDE (error, already), CASE WHEN error IS NOT NULL OR action <> 'merge' THEN error
    WHEN p.done < seq THEN 'primary inactive' WHEN already OR o.done < seq THEN 'already duplicate' END AS error
  FROM fixed f LEFT JOIN gone p ON p.company = f.primary_id LEFT JOIN gone o ON o.company = f.duplicate_id),
good AS (SELECT *, coalesce(action <> 'merge' OR reason <> '', false) AS noted FROM judged WHERE error IS NULL),
verdict AS (SELECT candidate_id, arg_max(action, seq) AS action, arg_max(reviewer, seq) AS reviewer,
    max(seq) FILTER (noted) AS note_at FROM good GROUP BY candidate_id)
"""


def _reviewed(spark, sf_dir):
    co = stored_flags(spark, sf_dir)
    return R.apply_reviews(_candidates(spark, sf_dir), co, _decisions(spark, sf_dir))


def stored_flags(spark, sf_dir):
    return companies(spark, sf_dir).selectExpr("id", "is_active", "id % 37 = 5 AS is_duplicate")


@query(
    "resolve_review",
    f"""WITH {_REVIEW_SQL} SELECT c.id,
          CASE WHEN v.candidate_id IS NULL THEN c.status WHEN v.action = 'merge' THEN 'confirmed' ELSE 'rejected' END AS status,
          v.reviewer AS reviewed_by, CASE WHEN v.note_at IS NULL THEN c.notes ELSE n.reason END AS notes
        FROM cand c LEFT JOIN verdict v ON v.candidate_id = c.id LEFT JOIN good n ON n.seq = v.note_at""",
)
def _(spark, sf_dir):
    return _reviewed(spark, sf_dir)[0].select("id", "status", "reviewed_by", "notes")


@query(
    "resolve_review_errors",
    f"WITH {_REVIEW_SQL} SELECT candidate_id, action, primary_id, duplicate_id, seq, error FROM judged WHERE error IS NOT NULL",
)
def _(spark, sf_dir):
    return _reviewed(spark, sf_dir)[2]


@query(
    "resolve_review_merges",
    f"WITH {_REVIEW_SQL} SELECT candidate_id, primary_id, duplicate_id, seq FROM good WHERE action = 'merge'",
)
def _(spark, sf_dir):
    return _reviewed(spark, sf_dir)[1]


_LISTED = "company_name address city phone website".split()


@query(
    "resolve_list_candidates",
    f"""WITH cand AS ({_CAND_SQL}), co AS ({D.CO}), pg AS (SELECT * FROM cand WHERE status = 'pending' AND overall_similarity >= 0.7
          ORDER BY overall_similarity DESC, company_a_id, company_b_id LIMIT 50 OFFSET 20)
        SELECT pg.company_a_id, pg.company_b_id, overall_similarity, {', '.join(f'a.{c} AS a_{c}' for c in _LISTED)},
          {', '.join(f'b.{c} AS b_{c}' for c in _LISTED)}
        FROM pg JOIN co a ON a.id = pg.company_a_id JOIN co b ON b.id = pg.company_b_id""",
)
def _(spark, sf_dir):
    rows = R.list_candidates(_candidates(spark, sf_dir), companies(spark, sf_dir), min_similarity=0.7, skip=20)
    return rows.select(
        "company_a_id", "company_b_id", "overall_similarity", *[f"{s}_{c}" for s in "ab" for c in _LISTED]
    )


_SIMS = {f"{f}_similarity": k for k, f in enumerate(R.FIELDS, 3)}


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_quantity > 45").selectExpr("l_orderkey + l_linenumber AS id")


_DETAIL_SQL = f"""WITH cand AS ({_CAND_SQL}), co AS ({D.CO}), asked AS (SELECT DISTINCT l_orderkey + l_linenumber AS id FROM lineitem WHERE l_quantity > 45)"""


@query(
    "resolve_candidate_detail",
    f"""{_DETAIL_SQL} SELECT c.id, {', '.join(f'c.id % {10 * k} / {10.0 * k}::DOUBLE AS {s}' for s, k in _SIMS.items())}, overall_similarity, status, notes,
          {', '.join(f'{s}.{f} AS {s}_{f}' for s in 'ab' for f in ['id', *_LISTED])}
        FROM cand c JOIN asked USING (id) LEFT JOIN co a ON a.id = company_a_id LEFT JOIN co b ON b.id = company_b_id""",
)
def _(spark, sf_dir):
    cand = _candidates(spark, sf_dir).withColumns({s: F.expr(f"id % {10 * k} / {10 * k}D") for s, k in _SIMS.items()})
    found = R.candidate_detail(cand, companies(spark, sf_dir), _asked(spark, sf_dir))[0]
    return found.select(
        "id", *_SIMS, "overall_similarity", "status", "notes", *[F.col(f"company_{s}.{f}").alias(f"{s}_{f}") for s in "ab" for f in ["id", *_LISTED]]
    )


@query("resolve_candidate_missing", f"{_DETAIL_SQL} SELECT id FROM asked WHERE id NOT IN (SELECT id FROM cand)")
def _(spark, sf_dir):
    cand = _candidates(spark, sf_dir).withColumns({s: F.lit(0.0) for s in _SIMS})
    return R.candidate_detail(cand, companies(spark, sf_dir), _asked(spark, sf_dir))[1]


@query(
    "resolve_candidate_stats",
    f"""WITH cand AS ({_CAND_SQL}), recent AS (SELECT o_orderkey % 4 AS n FROM orders WHERE o_orderkey % 3 <> 0
          ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100)
        SELECT count(*) AS total_candidates, count(*) FILTER (status = 'pending') AS pending,
          count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'rejected') AS rejected,
          (SELECT CAST(nullif(sum(n), 0) AS BIGINT) FROM recent) AS auto_merged FROM cand""",
)
def _(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        "o_orderdate AS created_at",
        """CASE WHEN o_orderkey % 3 <> 0 THEN concat('{"auto_merged_duplicates": ', CAST(o_orderkey % 4 AS STRING), '}') END AS stats""",
    )
    return R.candidate_stats(_candidates(spark, sf_dir), jobs)


@query(
    "resolve_expire",
    f"""WITH cand AS ({_CAND_SQL}) SELECT id, coalesce(status = 'rejected' AND created_at < TIMESTAMP '1999-01-01' - INTERVAL 90 DAY, false) AS expired FROM cand""",
)
def _(spark, sf_dir):
    now = F.lit("1999-01-01").cast("timestamp")
    kept, expired = R.expire_candidates(_candidates(spark, sf_dir), now)
    return kept.select("id", F.lit(False).alias("expired")).unionByName(expired.select("id", F.lit(True).alias("expired")))

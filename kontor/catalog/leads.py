"""Queries on the demo company table: cleansing, scoring, filters, rollups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.catalog import duck as D
from kontor.catalog.base import query
from kontor.functions import normalize as N
from kontor.functions import validate as V
from kontor.functions.text import strip
from kontor.operators import ingest, rollup, score, select
from kontor.plans.demo_view import companies, table
from kontor.session import scratch_dir
from kontor.sources import readers


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demo companies after cleansing."""
    return ingest.clean(companies(spark, sf_dir))[0]


def _co(fields: str, tail: str = "") -> str:
    return f"SELECT {fields} FROM ({D.CO}) co {tail}"


def _st(fields: str, tail: str = "") -> str:
    return f"SELECT {fields} FROM ({D.STORED}) st {tail}"


# --- sources and filters -------------------------------------------------------

BRIEF = ["id", "company_name", "city", "email", "lead_status", "lead_quality"]
BRIEF_SQL = ", ".join(BRIEF)


@query("scan_active", _co(BRIEF_SQL, "WHERE is_active"))
def _(spark, sf_dir):
    return select.active(companies(spark, sf_dir)).select(BRIEF)


@query(
    "filter_search",
    _co(
        BRIEF_SQL,
        "WHERE is_active AND city ILIKE '%nation_1%' AND industry ILIKE '%a%' AND lead_status = 'new'"
        " AND (company_name ILIKE '%te%' OR email ILIKE '%te%' OR website ILIKE '%te%')",
    ),
)
def _(spark, sf_dir):
    return select.search(companies(spark, sf_dir), city="nation_1", industry="a", status="new", text="te").select(BRIEF)


@query("filter_page", _co(BRIEF_SQL, "WHERE is_active ORDER BY id LIMIT 25 OFFSET 50"))
def _(spark, sf_dir):
    return select.page(select.active(companies(spark, sf_dir)).select(BRIEF), 50, 25)


@query("filter_page_total", _co("count(*) AS total", "WHERE is_active AND lead_quality = 'a'"))
def _(spark, sf_dir):
    return select.page_with_total(select.search(companies(spark, sf_dir), quality="a"))[1]


@query("filter_by_id", _co(BRIEF_SQL, "WHERE id = 77"))
def _(spark, sf_dir):
    return select.by_id(companies(spark, sf_dir), 77).select(BRIEF)


@query(
    "filter_select_ids",
    """
    WITH want AS (SELECT DISTINCT o_custkey * 2 AS id FROM orders)
    SELECT c_custkey AS id, 'found' AS outcome FROM customer WHERE c_custkey IN (SELECT id FROM want)
    UNION ALL
    SELECT id, 'missing' FROM want WHERE id NOT IN (SELECT c_custkey FROM customer)
    """,
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    ids = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("id"))
    found, missing = select.select_ids(rows, ids)
    return found.withColumn("outcome", F.lit("found")).unionByName(missing.withColumn("outcome", F.lit("missing")))


@query("filter_enum_by_name", _co(BRIEF_SQL, "WHERE lead_status = 'qualified' AND lead_quality = 'b'"))
def _(spark, sf_dir):
    status = select.parse_choice("QUALIFIED", ["new", "qualified"], by="name")
    quality = select.parse_choice("b", ["a", "b"], by="value")
    rows = companies(spark, sf_dir)
    return rows.filter((F.col("lead_status") == status) & (F.col("lead_quality") == quality)).select(BRIEF)


@query("filter_then_limit", _co(BRIEF_SQL, "WHERE lead_status = 'contacted' ORDER BY id LIMIT 40"))
def _(spark, sf_dir):
    rows = companies(spark, sf_dir).filter("lead_status = 'contacted'")
    return select.page(rows.select(BRIEF), 0, 40)


@query(
    "filter_list_jobs",
    "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F'"
    " ORDER BY o_orderdate DESC, o_orderkey LIMIT 30 OFFSET 10",
)
def _(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_orderstatus AS status", "o_orderdate AS created_at"
    )
    return select.list_jobs(jobs, "F", 10, 30).select("id", "status")


@query(
    "filter_name_match",
    "SELECT p_partkey AS id, p_name FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'red')"
    " AND list_contains(string_split(lower(p_name), ' '), 'widget')",
)
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name")
    index = f"{scratch_dir(spark)}/kontor-postings-{uuid.uuid4().hex}"
    select.write_postings(part, index, "p_name")
    return part.join(select.lookup_postings(spark, index, ["red", "Widget"]), "id")


@query(
    "filter_name_scan",
    "SELECT p_partkey AS id, p_name FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'red')"
    " AND list_contains(string_split(lower(p_name), ' '), 'widget')",
)
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name")
    return select.name_match(part, ["red", "Widget"], "p_name")


# Leads as dumps of arrays, 200 to a line; every 50th is broken off, every 70th isn't JSON.
_DUMPED = "concat('Firma ', c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ' {\"x\"}, [' ELSE '' END)"


@query(
    "source_read_dumps",
    """SELECT CASE WHEN c_custkey % 50 <> 7 AND c_custkey % 70 <> 3 THEN c_custkey END AS id,
         CASE WHEN c_custkey % 50 <> 7 AND c_custkey % 70 <> 3 THEN 'Firma ' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN ' {"x"}, [' ELSE '' END END AS company_name,
         CASE WHEN c_custkey % 50 <> 7 AND c_custkey % 70 <> 3 THEN c_mktsegment END AS city,
         c_custkey % 50 = 7 OR c_custkey % 70 = 3 AS broken FROM customer""",
)
def _(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    lead = F.to_json(F.struct(
        F.col("c_custkey").alias("id"), F.expr(_DUMPED).alias("company_name"), F.struct(F.lit("n}").alias("note"), F.array(F.lit(1), F.lit(2)).alias("list")).alias("more"),
        F.col("c_mktsegment").alias("city"),
    ))
    text = F.when(F.col("c_custkey") % 50 == 7, F.lit('{"id": 1, "company_name": , "city": "A"}')).when(
        F.col("c_custkey") % 70 == 3, F.lit('oops {"id": 2}')
    ).otherwise(lead)
    arrays = customer.groupBy(F.floor(F.col("c_custkey") / 200).alias("block")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(text), ", "), F.lit("]")).alias("value"))
    path = f"{scratch_dir(spark)}/kontor-dumps-{uuid.uuid4().hex}"
    arrays.select("value").write.text(path)
    rows = readers.read_json_objects(spark, path, "id bigint, company_name string, city string")
    return rows.select("id", "company_name", "city", F.col("corrupt").isNotNull().alias("broken"))


@query(
    "filter_token_index",
    r"""SELECT token, count(*) AS docs FROM (
      SELECT DISTINCT doc_id, unnest(regexp_split_to_array(
        lower(regexp_replace(text, '[^\p{L}\p{M}\p{N}_]+', ' ', 'g')), ' ')) AS token FROM documents)
      WHERE token <> '' GROUP BY token""",
)
def _(spark, sf_dir):
    tokens = select.token_index(table(spark, sf_dir, "documents"), "text", "doc_id")
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("docs"))


# --- validators ------------------------------------------------------------------


@query("validate_email", _co(f"id, {D.email('email')} AS email"))
def _(spark, sf_dir):
    return companies(spark, sf_dir).select("id", V.valid_email(F.col("email")).alias("email"))


@query("validate_phone", _co(f"id, {D.phone('phone')} AS phone"))
def _(spark, sf_dir):
    return companies(spark, sf_dir).select("id", V.valid_phone(F.col("phone")).alias("phone"))


@query("validate_website", _co(f"id, {D.website('website')} AS website"))
def _(spark, sf_dir):
    return companies(spark, sf_dir).select("id", V.valid_website(F.col("website")).alias("website"))


@query("validate_page_url", f"SELECT page_id, {D.website('url')} AS url FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", V.valid_website(F.col("url")).alias("url"))


@query("validate_postal_code", _co(f"id, {D.postal_code('postal_code')} AS postal_code"))
def _(spark, sf_dir):
    return companies(spark, sf_dir).select("id", V.valid_postal_code(F.col("postal_code")).alias("postal_code"))


@query("validate_company_name", _co(f"id, {D.company_name('company_name')} AS company_name"))
def _(spark, sf_dir):
    return companies(spark, sf_dir).select("id", V.valid_company_name(F.col("company_name")).alias("company_name"))


@query(
    "validate_company",
    f"""SELECT id, 'valid' AS outcome, {D.company_name('company_name')} AS company_name,
          CASE WHEN legal_form <> '' THEN {D.strip('legal_form')} ELSE legal_form END AS legal_form,
          {D.email('email')} AS email
        FROM ({D.CO}) co WHERE {D.company_name('company_name')} IS NOT NULL
        UNION ALL
        SELECT id, 'rejected', company_name, legal_form, email FROM ({D.CO}) co WHERE {D.company_name('company_name')} IS NULL""",
)
def _(spark, sf_dir):
    valid, rejected = ingest.validate(companies(spark, sf_dir))
    cols = ["id", "outcome", "company_name", "legal_form", "email"]
    return (
        valid.withColumn("outcome", F.lit("valid"))
        .select(cols)
        .unionByName(rejected.withColumn("outcome", F.lit("rejected")).select(cols))
    )


@query(
    "validate_loose_contact",
    _co(
        f"id, coalesce(regexp_matches(email, {D.q(V.LOOSE_EMAIL)}), false) AS mail_ok,"
        f" coalesce(length({D.digits('phone')}) >= 6, false) AS phone_ok"
    ),
)
def _(spark, sf_dir):
    return companies(spark, sf_dir).select(
        "id", V.is_email(F.col("email")).alias("mail_ok"), V.is_phone(F.col("phone")).alias("phone_ok")
    )


@query(
    "validate_company_site",
    "SELECT page_id, starts_with(url, 'http') AND NOT ("
    + " OR ".join(f"contains(url, '{h}')" for h in V.NON_COMPANY_SITES)
    + ") AS company_site FROM pages",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", V.is_company_site(F.col("url")).alias("company_site"))


# --- normalizers -------------------------------------------------------------------


@query("normalize_name", _co(f"id, {D.norm_name('company_name')} AS name"))
def _(spark, sf_dir):
    return companies(spark, sf_dir).select("id", N.norm_name(F.col("company_name")).alias("name"))


@query("normalize_legal_form", _co(f"id, {D.norm_legal_form('legal_form')} AS legal_form"))
def _(spark, sf_dir):
    return companies(spark, sf_dir).select("id", N.norm_legal_form(F.col("legal_form")).alias("legal_form"))


@query("normalize_state", _co(f"id, {D.norm_state('state')} AS state"))
def _(spark, sf_dir):
    return companies(spark, sf_dir).select("id", N.norm_state(F.col("state")).alias("state"))


@query("normalize_city", _co(f"id, {D.norm_city('city')} AS city"))
def _(spark, sf_dir):
    return companies(spark, sf_dir).select("id", N.norm_city(F.col("city")).alias("city"))


@query(
    "normalize_list",
    _co(f"id, {D.norm_list('directors_text')} AS directors, {D.norm_list('technologies_text')} AS technologies"),
)
def _(spark, sf_dir):
    rows = companies(spark, sf_dir)
    return rows.select(
        "id", *[F.array_join(N.norm_list(F.col(c)), "|").alias(c) for c in ("directors", "technologies")]
    )


@query(
    "normalize_split_legal_form",
    f"SELECT id, {D.form_name('n')} AS name, nullif({D.strip(D.form_ending('n'))}, '') AS legal_form"
    f" FROM (SELECT id, {D.company_name('company_name')} AS n FROM ({D.CO}) co) x",
)
def _(spark, sf_dir):
    rows = companies(spark, sf_dir)
    return rows.select("id", N.split_legal_form(V.valid_company_name(F.col("company_name"))).alias("s")).select("id", "s.*")


@query("normalize_description", f"SELECT doc_id, {D.clip('text')} AS description FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.clip_description(F.col("text")).alias("description"))


@query(
    "normalize_company",
    f"""SELECT id, {D.norm_name('name')} AS company_name, {D.norm_legal_form('form')} AS legal_form,
          {D.norm_city('city')} AS city, {D.norm_state('state')} AS state, {D.clip('description')} AS description,
          {D.norm_list('directors_text')} AS directors
        FROM (SELECT *, CASE WHEN coalesce(legal_form, '') = '' THEN {D.form_name('company_name')} ELSE company_name END AS name,
                CASE WHEN coalesce(legal_form, '') = '' THEN {D.strip(D.form_ending('company_name'))} ELSE legal_form END AS form
              FROM ({D.CO}) co) x""",
)
def _(spark, sf_dir):
    rows = ingest.normalize(companies(spark, sf_dir))
    return rows.select(
        "id", "company_name", "legal_form", "city", "state", "description", F.array_join("directors", "|").alias("directors")
    )


STORED_COLS = (
    "id company_name legal_form industry description website email phone address postal_code city state"
    " directors_text technologies_text"
).split()


@query("clean_stored", _st(", ".join(STORED_COLS)))
def _(spark, sf_dir):
    rows = stored(spark, sf_dir).withColumns(
        {"directors_text": F.array_join("directors", "|"), "technologies_text": F.array_join("technologies", "|")}
    )
    return rows.select(STORED_COLS)


@query("normalize_phone_key", _co(f"id, nullif({D.digits('phone')}, '') AS phone_key"))
def _(spark, sf_dir):
    return companies(spark, sf_dir).select("id", N.phone_key(F.col("phone")).alias("phone_key"))


@query(
    "normalize_endpoint",
    rf"""SELECT page_id, CASE WHEN p <> '' THEN regexp_replace(regexp_replace(p, '{N.UUID_SEGMENT}', '/{{id}}', 'g'),
           '{N.NUMBER_SEGMENT}', '/{{id}}', 'g') ELSE '/' END AS endpoint
         FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages) x""",
)
def _(spark, sf_dir):
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", N.endpoint_template(path).alias("endpoint"))


@query("normalize_domain", f"SELECT page_id, {D.domain('url')} AS host FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.domain_key(F.col("url")).alias("host"))


@query("normalize_address", _co(f"id, {D.address('street', 'postal_code', 'city')} AS address"))
def _(spark, sf_dir):
    return companies(spark, sf_dir).select(
        "id", N.format_address(F.col("street"), F.col("postal_code"), F.col("city")).alias("address")
    )


# --- scoring -----------------------------------------------------------------------

_SCORED = D.score_sql(D.STORED)


def _scored(spark, sf_dir):
    return score.score(stored(spark, sf_dir))


# A third of the companies has its addresses with a contact person.
_CONTACT_SQL = f"""SELECT * EXCLUDE (email, phone), CASE WHEN id % 3 <> 0 THEN email ELSE '' END AS own_email, CASE WHEN id % 3 <> 1 THEN phone END AS own_phone,
  CASE WHEN id % 5 = 0 THEN 'kein' ELSE email END AS contact_email, CASE WHEN id % 7 = 0 THEN '12' ELSE phone END AS contact_phone FROM ({D.STORED}) st"""
_CONTACT_SQL = f"""SELECT * EXCLUDE (own_email, own_phone), CASE WHEN own_email <> '' THEN own_email ELSE contact_email END AS email,
  CASE WHEN own_phone <> '' THEN own_phone ELSE contact_phone END AS phone FROM ({_CONTACT_SQL}) c"""


@query("score_contact_person", f"SELECT id, contact_pts AS points FROM ({D.score_sql(_CONTACT_SQL)}) s")
def _(spark, sf_dir):
    rows = stored(spark, sf_dir).selectExpr(
        "* EXCEPT (email, phone)", "CASE WHEN id % 3 <> 0 THEN email ELSE '' END AS email", "CASE WHEN id % 3 <> 1 THEN phone END AS phone",
        "CASE WHEN id % 5 = 0 THEN 'kein' ELSE email END AS contact_email", "CASE WHEN id % 7 = 0 THEN '12' ELSE phone END AS contact_phone",
    )
    return score.score(rows).select("id", F.col("breakdown.contact_data.points").alias("points"))


_PART_NAMES = {
    "score_contact": ("contact_data", "contact_pts"),
    "score_website": ("website", "website_pts"),
    "score_industry": ("industry", "industry_pts"),
    "score_size": ("company_size", "size_pts"),
    "score_tech": ("technologies", "tech_pts"),
    "score_quality": ("data_quality", "quality_pts"),
}


def _register_parts() -> None:
    for name, (part, column) in _PART_NAMES.items():
        sql = f"SELECT id, {column} AS points FROM ({_SCORED}) s"

        def build(spark, sf_dir, part=part):
            return _scored(spark, sf_dir).select("id", F.col(f"breakdown.{part}.points").alias("points"))

        query(name, sql)(build)


_register_parts()


@query(
    "score_total",
    f"""SELECT id, score, quality, array_to_string(list_filter([
          CASE WHEN contact_pts < 20 THEN 'Kontaktdaten vervollständigen (Email, Telefon)' END,
          CASE WHEN website_pts < 10 THEN 'Website-Informationen überprüfen' END,
          CASE WHEN quality_pts < 5 THEN 'Datenqualität verbessern (Duplikate, Validierung)' END],
          lambda a: a IS NOT NULL), '; ') AS advice FROM ({_SCORED}) s""",
)
def _(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "score", "quality", F.array_join("recommendations", "; ").alias("advice"))


@query(
    "score_write_back",
    f"""SELECT id, CAST(score AS DOUBLE) AS lead_score,
          CASE quality WHEN 'hot' THEN 'a' WHEN 'warm' THEN 'b' WHEN 'cold' THEN 'c' ELSE 'd' END AS lead_quality
        FROM ({_SCORED}) s""",
)
def _(spark, sf_dir):
    return score.write_back(_scored(spark, sf_dir)).select("id", "lead_score", "lead_quality")


_DIST = (
    "count(*) AS total_scored, count(*) FILTER (quality = 'hot') AS hot_leads, count(*) FILTER (quality = 'warm') AS warm_leads,"
    " count(*) FILTER (quality = 'cold') AS cold_leads, count(*) FILTER (quality = 'low_quality') AS low_quality"
)


@query(
    "score_bulk_ids",
    f"SELECT {_DIST} FROM ({_SCORED}) s WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def _(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").selectExpr("o_custkey AS id")
    return score.bulk_score(stored(spark, sf_dir), ids=ids)[1]


@query(
    "score_bulk_filter",
    f"SELECT id, score, quality FROM ({_SCORED}) s WHERE lead_status = 'qualified'",
)
def _(spark, sf_dir):
    return score.bulk_score(stored(spark, sf_dir), status="QUALIFIED")[0].select("id", "score", "quality")


@query(
    "score_quality_report",
    f"""WITH s AS (SELECT CAST(score AS DOUBLE) AS lead_score,
          CASE quality WHEN 'hot' THEN 'a' WHEN 'warm' THEN 'b' WHEN 'cold' THEN 'c' ELSE 'd' END AS grade FROM ({_SCORED}) x)
        SELECT 'all' AS grade, count(*) AS n, round(avg(lead_score), 2) AS average FROM s
        UNION ALL SELECT grade, count(*), CAST(NULL AS DOUBLE) FROM s GROUP BY grade""",
)
def quality_report(spark, sf_dir):
    """Flagship: cleanse and score every lead, then report grades and the average."""
    return rollup.scoring_stats(score.write_back(_scored(spark, sf_dir)))


# --- rollups -------------------------------------------------------------------------


def _top_sql(column: str, where: str) -> str:
    return (
        f"SELECT '{column}' AS section, {column} AS label, count(*) AS n,"
        f" CAST(row_number() OVER (ORDER BY count(*) DESC, {column} NULLS LAST) AS INT) AS pos"
        f" FROM co {where} GROUP BY {column} QUALIFY pos <= 10"
    )


def _plain_sql(column: str, where: str = "") -> str:
    return f"SELECT '{column}' AS section, {column} AS label, count(*) AS n, CAST(NULL AS INT) AS pos FROM co {where} GROUP BY {column}"


@query(
    "rollup_overview",
    f"""WITH co AS (SELECT * FROM ({D.CO}) x WHERE is_active)
        SELECT 'total' AS section, CAST(NULL AS VARCHAR) AS label, count(*) AS n, CAST(NULL AS INT) AS pos FROM co
        UNION ALL {_plain_sql('lead_status')} UNION ALL {_plain_sql('lead_quality')}
        UNION ALL SELECT * FROM ({_top_sql('city', '')})""",
)
def _(spark, sf_dir):
    return rollup.overview(companies(spark, sf_dir))


@query(
    "rollup_export_stats",
    f"""WITH co AS (SELECT * FROM ({D.CO}) x)
        SELECT 'total' AS section, CAST(NULL AS VARCHAR) AS label, count(*) AS n, CAST(NULL AS INT) AS pos FROM co
        UNION ALL {_plain_sql('lead_status')} UNION ALL {_plain_sql('lead_quality')}
        UNION ALL SELECT * FROM ({_top_sql('industry', 'WHERE industry IS NOT NULL')})
        UNION ALL SELECT * FROM ({_top_sql('city', 'WHERE city IS NOT NULL')})""",
)
def _(spark, sf_dir):
    return rollup.export_stats(companies(spark, sf_dir))


@query(
    "rollup_scoring_stats",
    f"""WITH co AS (SELECT * FROM ({D.CO}) x)
        SELECT 'all' AS grade, count(*) AS n, coalesce(round(avg(lead_score), 2), 0) AS average FROM co
        UNION ALL SELECT lead_quality, count(*), CAST(NULL AS DOUBLE) FROM co GROUP BY lead_quality""",
)
def _(spark, sf_dir):
    return rollup.scoring_stats(companies(spark, sf_dir))


@query(
    "rollup_top_bottom",
    """SELECT * FROM (SELECT c_custkey AS id, c_acctbal AS balance, 'top' AS side FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10)
       UNION ALL SELECT * FROM (SELECT c_custkey, c_acctbal, 'bottom' FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10)""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_acctbal AS balance")
    return rollup.top_bottom(rows, "balance")


@query(
    "rollup_completeness",
    f"""WITH st AS ({D.STORED}), t AS (SELECT count(*) AS total,
          count(*) FILTER (website <> '') AS website, count(*) FILTER (email <> '') AS email, count(*) FILTER (phone <> '') AS phone,
          count(directors_text) AS directors, count(technologies_text) AS technologies FROM st),
        u AS (UNPIVOT t ON website, email, phone, directors, technologies INTO NAME field VALUE filled)
        SELECT total, field, filled, round(filled * 100.0::DOUBLE / total, 4) AS share FROM u""",
)
def _(spark, sf_dir):
    return rollup.completeness(stored(spark, sf_dir), ["website", "email", "phone", "directors", "technologies"])

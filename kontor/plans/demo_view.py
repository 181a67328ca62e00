"""A company table derived from the driver's ``customer`` and ``nation`` tables.

The driver tables hold no phone, e-mail or website, so the demo queries compute
them from ``c_custkey`` with integer arithmetic.  The SQL text below is accepted
by Spark and by DuckDB alike, which is what makes every demo query checkable.

Three consecutive ids form a group ``g``.  ``g % 4`` decides how much its members
share (0: all contacts, 1: phone and website, 2: address only, 3: nothing), so all
similarity bands occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SYLLABLES = "NordoSudenWestaOstraAlphaBetonGammoDeltoOmegaKappaSigmaThetaLumenFerroCelloVentoTerraAquosPyronAetho"
_TRADES = "TechnikSystemeBeratenMaschinConsultHandelnService"

COMPANY_SQL = f"""
WITH seed AS (
  SELECT c.c_custkey AS id,
         CAST(floor(c.c_custkey / 3) AS BIGINT) AS g,
         c.c_custkey % 3 AS m,
         n.n_name AS nation,
         c.c_acctbal AS acctbal,
         c.c_mktsegment AS segment
  FROM {{customer}} c JOIN {{nation}} n
    ON n.n_nationkey = CAST(floor(c.c_custkey / 3) AS BIGINT) % 25
), parts AS (
  SELECT *,
         substr('{_SYLLABLES}', CAST(1 + 5 * (g % 20) AS INT), 5) AS w1,
         substr('{_TRADES}', CAST(1 + 7 * ((g * 3 + 1) % 7) AS INT), 7) AS w2,
         CASE id % 7 WHEN 0 THEN '' WHEN 1 THEN ' GmbH' WHEN 2 THEN ' AG' WHEN 3 THEN ' (UG)'
              WHEN 4 THEN ' GmbH & Co. KG' WHEN 5 THEN ' e.V.' ELSE ' gmbh' END AS form,
         CASE g % 5 WHEN 0 THEN '30' WHEN 1 THEN '40' WHEN 2 THEN '711' WHEN 3 THEN '69' ELSE '89' END AS area,
         CASE WHEN g % 4 <= 1 THEN g ELSE id + 500000 END AS contact_no,
         CASE WHEN g % 4 IN (0, 2) THEN g ELSE id + 700000 END AS place_no
  FROM seed
), shaped AS (
  SELECT *,
         CAST(1000000 + (contact_no * 7919) % 8999993 AS STRING) AS subscriber,
         lower(w1) || lower(w2) || CAST(contact_no AS STRING) || '.de' AS host,
         w1 || 'straße ' || CAST(1 + place_no % 199 AS STRING) AS street0,
         CAST(10000 + (place_no * 37) % 89989 AS STRING) AS plz
  FROM parts
)
SELECT id, g,
       CASE WHEN id % 41 = 7 THEN ' X '
            WHEN m = 0 THEN w1 || ' ' || w2 || ' ' || CAST(g AS STRING) || form
            WHEN m = 1 THEN upper(w1) || ' ' || upper(w2) || ' ' || CAST(g AS STRING) || form
            ELSE '  ' || w1 || '   ' || lower(w2) || ' ' || CAST(g AS STRING) || form END AS company_name,
       CASE WHEN id % 9 = 4 THEN 'Rechtsform: gmbh (alt)' WHEN id % 9 = 5 THEN 'Stiftung'
            WHEN id % 9 = 6 THEN '' END AS legal_form,
       CASE WHEN g % 6 = 0 THEN 'IT Beratung' WHEN g % 6 = 1 THEN 'Handwerk' WHEN g % 6 = 2 THEN 'Cloud und SaaS'
            WHEN g % 6 = 3 THEN segment WHEN g % 6 = 4 THEN '' END AS industry,
       CASE WHEN id % 8 = 0 THEN NULL
            WHEN id % 8 = 1 THEN repeat(w1 || ' liefert ' || w2 || '. ', 50)
            ELSE '  ' || w1 || ' liefert ' || w2 || '  ' END AS description,
       CASE WHEN id % 13 = 5 THEN NULL
            WHEN id % 6 = 0 THEN 'https://www.' || host
            WHEN id % 6 = 1 THEN 'www.' || host || '/'
            WHEN id % 6 = 2 THEN 'http://www.' || upper(host) || '/Kontakt/?x=1#y'
            WHEN id % 6 = 3 THEN 'https://www.' || host || '/'
            WHEN id % 6 = 4 AND g % 4 = 3 THEN 'https://www.facebook.com/' || host
            ELSE ' https://www.' || host || ' ' END AS website,
       CASE id % 5 WHEN 0 THEN 'info@' || host WHEN 1 THEN upper('info@' || host)
            WHEN 2 THEN 'mailto:info@' || host WHEN 3 THEN 'kontakt.' || host END AS email,
       CASE WHEN id % 11 = 0 THEN NULL WHEN id % 29 = 3 THEN '123'
            WHEN id % 4 = 0 THEN '+49 ' || area || ' ' || subscriber
            WHEN id % 4 = 1 THEN '0' || area || ' ' || subscriber
            WHEN id % 4 = 2 THEN '0' || area || '/' || subscriber
            ELSE 'tel:+49' || area || subscriber END AS phone,
       street0 AS street,
       CASE WHEN id % 17 = 4 THEN NULL ELSE street0 || ', ' || plz || ' ' || nation END AS address,
       CASE WHEN id % 6 = 1 THEN ' ' || plz || ' ' WHEN id % 6 = 2 THEN 'D-' || plz
            WHEN id % 6 = 3 THEN substr(plz, 1, 4) WHEN id % 19 = 0 THEN NULL ELSE plz END AS postal_code,
       CASE WHEN g % 97 = 5 THEN NULL WHEN g % 8 = 3 THEN lower(nation) ELSE nation END AS city,
       CASE id % 7 WHEN 0 THEN 'bw' WHEN 1 THEN ' BY ' WHEN 2 THEN 'baden-württemberg' WHEN 3 THEN 'tirol west'
            WHEN 4 THEN 'HH' WHEN 5 THEN '' END AS state,
       CAST(id % 250 AS INT) AS team_size,
       CASE WHEN id % 4 = 0 THEN '' WHEN id % 4 = 1 THEN 'Max ' || w1 || '| Eva ' || w1 || ' |max ' || lower(w1)
            WHEN id % 4 = 2 THEN 'Ute ' || w1 ELSE ' | ' || w1 END AS directors_text,
       CASE WHEN id % 5 = 0 THEN '' WHEN id % 5 = 1 THEN 'React|Python 3|Excel' WHEN id % 5 = 2 THEN 'REST API|react'
            WHEN id % 5 = 3 THEN 'Cobol' ELSE 'Docker|Kafka|AWS Lambda|Redis' END AS technologies_text,
       CASE id % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'qualified' WHEN 2 THEN 'contacted' WHEN 3 THEN 'converted'
            ELSE 'rejected' END AS lead_status,
       CASE (id * 3) % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'd' ELSE 'unknown' END AS lead_quality,
       CASE WHEN id % 23 = 6 THEN NULL ELSE round(acctbal / 100, 2) END AS lead_score,
       id % 13 <> 0 AS is_active
FROM shaped
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; times without a zone are read as session-zone timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f for f, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: df[c].cast("timestamp") for c in zoneless}) if zoneless else df


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a table that arrives in fewer splits than there are cores.

    A large table has more splits than cores and passes through untouched, so only
    inputs of a few splits are ever moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demo company table with list columns split."""
    text = COMPANY_SQL.format(customer="{customer}", nation="{nation}")
    customer = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"))
    raw = spark.sql(text, customer=customer, nation=table(spark, sf_dir, "nation"))
    return raw.selectExpr(
        "*",
        r"split(directors_text, '\\|') AS directors",
        r"split(technologies_text, '\\|') AS technologies",
    )


def company_sql() -> str:
    """The same table as DuckDB text (without the list columns)."""
    return COMPANY_SQL.format(customer="customer", nation="nation")

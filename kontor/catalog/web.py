"""Queries on pages: readers, directory layouts, detail pages, links, facts, JSON recovery.

The directory pages are built by Spark from the demo companies, twenty to a page, in
each of the five layouts; the check computes the expected leads from the companies.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kontor.catalog import duck as D
from kontor.catalog.base import query
from kontor.functions.validate import NON_COMPANY_SITES
from kontor.operators import extract as X
from kontor.operators import webtext as W
from kontor.plans.demo_view import companies, spread, table
from kontor.sources import readers as R

# --- derived directory pages -----------------------------------------------------------------

_ESC = "replace(company_name, '&', '&amp;')"


def _span(attr: str, value: str) -> str:
    return f"""coalesce(concat('<span {attr}>', {value}, '</span>'), '')"""


_TEL = """concat('<a href="tel:', coalesce(phone, ''), '">Anruf</a>')"""
_MAIL = """coalesce(concat('<a href="mailto:', email, '?subject=Hallo">Mail</a>'), '')"""
_SITE = "CASE WHEN id % 3 = 1 THEN 'https://www.{host}/redirect?x=1' WHEN website IS NOT NULL THEN trim(website) END"


def _link(cls: str, href: str, label: str = "x") -> str:
    return f"""coalesce(concat('<a class="{cls}" href="', {href}, '">{label}</a>'), '')"""


_HTML = {
    "a": f"""concat('<li class="result-list-entry big"><p>Tel. ', CASE WHEN id % 4 = 1 AND id % 29 <> 3 AND id % 11 <> 0 THEN phone ELSE '' END, '</p>',
        '<h2 class="result-list-entry-title__headline">', {_ESC}, '</h2>', {_span('class="js-street-address"', 'street')}, '<br>',
        {_span('class="js-postal-code"', 'postal_code')}, {_span('class="js-address-locality"', 'city')},
        CASE WHEN id % 4 = 1 AND id % 29 <> 3 AND id % 11 <> 0 THEN '' ELSE {_TEL} END, {_link('x-website', _SITE.format(host='11880.com'))}, {_MAIL},
        '<div class="category">', coalesce(industry, ''), '</div>',
        CASE WHEN id % 2 = 0 THEN concat('<a href="/suche/branchenbuch/', CAST(id AS STRING), '">Details') ELSE '' END, '</li>')""",
    "b": f"""concat('<article class="mod mod-Treffer"><h2 itemprop="name">', {_ESC}, '</h2>', {_span('itemprop="streetAddress"', 'street')},
        {_span('itemprop="postalCode"', 'postal_code')}, {_span('itemprop="addressLocality"', 'city')}, {_TEL}, {_MAIL},
        coalesce(concat('<a itemprop="url" href="', CASE id % 3 WHEN 1 THEN '/redirect/nowhere' WHEN 2 THEN concat('/redirect/https://www.x', CAST(id AS STRING), '.de') ELSE trim(website) END, '">w</a>'), ''),
        '</article>')""",
    "c": f"""concat('<article class="Hit"><h2>', {_ESC}, '</h2>', {_span('class="street"', 'street')}, {_span('class="Ort"', "concat(trim(postal_code), ' ', city)")},
        {_TEL}, {_MAIL}, {_link('homepage', _SITE.format(host='dasoertliche.de'))}, '<a href="/Themen/', CAST(id AS STRING), '">d</a></article>')""",
    "d": f"""concat('<article class="gs-Result"><h3>', {_ESC}, '</h3><div class="Address">', {_span('class="street"', 'street')},
        {_span('class="city"', "concat(trim(postal_code), ' ', city)")}, '</div>', {_TEL}, {_MAIL},
        coalesce(concat('<a title="Zur Website" href="', {_SITE.format(host='goyellow.de')}, '">w</a>'), ''), '<a href="https://g.de/unternehmen/', CAST(id AS STRING), '">d</a></article>')""",
    "e": f"""concat('<div class="listing"><h3 class="title">', {_ESC}, '</h3>', {_span('class="street"', 'street')}, {_span('class="zip"', 'postal_code')},
        {_span('class="locality"', 'city')}, {_span('class="phone"', "concat('Tel ', phone)")}, {_span('class="mail"', 'email')},
        {_link('homepage', _SITE.format(host='unternehmensverzeichnis.org'))}, '<p class="about">', coalesce(description, ''), '</p>',
        CASE WHEN id % 2 = 0 THEN concat('<a class="more" href="', CASE WHEN id % 4 = 0 THEN '/' ELSE '' END, 'z', CAST(id AS STRING), '">d</a>') ELSE '' END, '</div>')""",
}


def listing_pages(spark, sf_dir, layout):
    """Directory pages in one layout, twenty entries each."""
    entries = companies(spark, sf_dir).selectExpr("CAST(floor(id / 20) AS BIGINT) AS page_id", "id", f"{_HTML[layout]} AS entry")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "entry"))), lambda e: e["entry"]), "\n")
    return entries.groupBy("page_id").agg(body.alias("body")).select(
        "page_id",
        F.concat(F.lit("https://list.example/"), F.col("page_id").cast("string")).alias("url"),
        F.concat(F.lit("<!DOCTYPE html><html><head><title>Liste</title></head><body><ul>"), "body", F.lit("</ul></body></html>")).alias("html"),
    )


_PAGE_URL = "'https://list.example/' || CAST(CAST(floor(id / 20) AS BIGINT) AS VARCHAR)"
_NAME = D.strip("company_name")
_MAIL_OUT = "regexp_replace(replace(email, 'mailto:', ''), '[?].*$', '')"
_PLZ5 = "regexp_matches({p} || ' ' || city, '^[0-9]{{5}}\\s+.+')".format(p=D.strip("postal_code"))


def _expected(layout: str) -> str:
    plz = f"nullif({D.strip('postal_code')}, '')"
    city = "city"
    if layout in "cd":
        plz, city = f"CASE WHEN {_PLZ5} THEN {plz} END", f"CASE WHEN {_PLZ5} THEN city END"
    place = f"CASE WHEN {plz} IS NOT NULL AND {city} IS NOT NULL THEN {plz} || ' ' || {city} {'' if layout in 'cd' else f'ELSE coalesce({plz}, {city})'} END"
    phone = D.strip("replace(coalesce(phone, ''), 'tel:', '')")
    if layout == "e":
        phone = r"regexp_replace('Tel ' || phone, '[^0-9+\s\-()/]', '', 'g')"
    site = "CASE WHEN id % 3 <> 1 THEN trim(website) END"
    if layout == "b":
        site = "CASE id % 3 WHEN 0 THEN trim(website) WHEN 2 THEN 'https://www.x' || CAST(id AS VARCHAR) || '.de' END"
    mail = _MAIL_OUT if layout != "e" else f"CASE WHEN contains(email, '@') AND contains(email, '.') THEN regexp_replace({D.strip('email')}, '[?].*$', '') END"
    detail = {
        "a": "CASE WHEN id % 2 = 0 THEN 'https://www.11880.com/branchenbuch/' || CAST(id AS VARCHAR) END",
        "b": "CAST(NULL AS VARCHAR)",
        "c": "'https://www.dasoertliche.de/Themen/' || CAST(id AS VARCHAR)",
        "d": "'https://g.de/unternehmen/' || CAST(id AS VARCHAR)",
        "e": "CASE WHEN id % 4 = 0 THEN 'https://www.unternehmensverzeichnis.org/z' || CAST(id AS VARCHAR) END",
    }[layout]
    desc = {"a": "coalesce(industry, '')", "e": f"CASE WHEN length({D.strip('description')}) > 500 THEN substr({D.strip('description')}, 1, 497) || '...' ELSE coalesce({D.strip('description')}, '') END"}
    listed = (
        f"concat_ws(',', CASE WHEN {'address IS NOT NULL' if layout == 'e' else 'true'} THEN 'address' END, CASE WHEN {'city IS NOT NULL' if layout == 'e' else 'true'} THEN 'city' END, 'company_name'"
        f", CASE WHEN description <> '' AND '{layout}' = 'e' THEN 'description' END, CASE WHEN email <> '' THEN 'email' END, CASE WHEN phone <> '' THEN 'phone' END"
        f", CASE WHEN {'postal_code IS NOT NULL' if layout == 'e' else 'true'} THEN 'postal_code' END, CASE WHEN website <> '' THEN 'website' END)"
    )
    return f"""SELECT page_id, entry_no, company_name, website, phone, email, address, city, postal_code, description, detail_url,
        coalesce(detail_url, page_url) AS source_url, {listed} AS fields FROM (
      SELECT CAST(floor(id / 20) AS BIGINT) AS page_id, CAST(id % 20 AS INT) AS entry_no, {_PAGE_URL} AS page_url, {_NAME} AS company_name, {site} AS website,
        {phone} AS phone, {mail} AS email, nullif(concat_ws(', ', street, {place}), '') AS address, {city} AS city, {plz} AS postal_code,
        {desc.get(layout, 'CAST(NULL AS VARCHAR)')} AS description, {detail} AS detail_url FROM ({D.CO}) c) e"""


def _register_layouts() -> None:
    for layout in "abcde":
        def build(spark, sf_dir, layout=layout):
            found = X.extract(listing_pages(spark, sf_dir, layout), layout)
            return found.withColumns(
                {"source_url": F.col("source.url"), "fields": F.array_join("source.fields", ",")}
            ).drop("source")

        query(f"html_directory_{layout}", _expected(layout))(build)


_register_layouts()

# --- detail, team and register pages -----------------------------------------------------------

_DETAIL_HTML = f"""concat('<html><head><meta name="description" content="', coalesce(industry, ''), CASE WHEN id % 2 = 0 THEN ' | mehr' ELSE '' END, '"></head><body>',
  '<span itemprop="name">Krume ', CAST(g AS STRING), '</span><span itemprop="streetAddress">', street, '</span>', {_span('itemprop="addressLocality"', 'city')},
  CASE WHEN id % 3 = 0 THEN concat('<a class="tracking--entry-detail-website-link" href="https://firma', CAST(id AS STRING), '.de">x</a>')
       WHEN id % 3 = 1 THEN concat('<a href="https://site', CAST(id AS STRING), '.de"><b>Zur Website</b></a>') ELSE '' END,
  '<a href="https://www.11880.com/eigen">e</a><a href="https://facebook.com/11880.com">f</a><a href="https://facebook.com/f', CAST(id AS STRING), '">f</a>',
  '<div class="opening-hours"><div class="day"><span class="day-name">Montag</span><span class="time">9-', CAST(id % 12 + 8 AS STRING), '</span></div></div>',
  '<div class="about">', coalesce(description, ''), '</div>',
  '<div class="services"><ul><li>', w, '</li><li>IT</li></ul></div>',
  '<div class="person"><h3 class="name">Max Muster', CAST(id AS STRING), '</h3><span class="role">Chef</span><a href="tel:+4930', CAST(id AS STRING), '">t</a></div>',
  {_MAIL}, '<div class="company-info"><p>Gegründet im Jahr ', CAST(1900 + id % 120 AS STRING), '</p><p>', CAST(team_size AS STRING), ' Mitarbeiter</p></div>',
  CASE WHEN id % 2 = 1 THEN '<p>Vom Inhaber bestätigt</p>' ELSE '' END, '<div class="badge">Top ', CAST(id % 5 AS STRING), '</div>',
  '<p>Der Eintrag wurde aktualisiert am 0', CAST(id % 9 + 1 AS STRING), '.02.2024</p>',
  '<div class="standort"><h4>Filiale ', CAST(id AS STRING), '</h4></div><div class="standort"></div><a href="/alle">Weitere Standorte</a></body></html>')"""


def detail_pages(spark, sf_dir):
    rows = companies(spark, sf_dir).withColumn("w", F.substring("street", 1, 5))
    return rows.selectExpr("id AS page_id", "concat('https://d.example/', CAST(id AS STRING)) AS url", f"{_DETAIL_HTML} AS html")


_DESC = D.strip("coalesce(description, '')")


@query(
    "html_detail",
    f"""SELECT id AS page_id,
          CASE id % 3 WHEN 0 THEN 'https://firma' || CAST(id AS VARCHAR) || '.de' WHEN 1 THEN 'https://site' || CAST(id AS VARCHAR) || '.de' END AS website,
          'Montag 9-' || CAST(id % 12 + 8 AS VARCHAR) AS hours, CASE WHEN length({_DESC}) > 50 THEN {_DESC} END AS description, substr(street, 1, 5) AS services,
          'Max Muster' || CAST(id AS VARCHAR) || '/Chef/+4930' || CAST(id AS VARCHAR) AS person, 'https://facebook.com/f' || CAST(id AS VARCHAR) AS facebook,
          '+4930' || CAST(id AS VARCHAR) AS phones, CASE WHEN email IS NOT NULL THEN {_MAIL_OUT} END AS emails, CAST(1900 + id % 120 AS VARCHAR) AS founded,
          CAST(team_size AS VARCHAR) AS employees, CASE WHEN id % 2 = 0 AND coalesce(industry, '') <> '' THEN industry ELSE 'Krume ' || CAST(g AS VARCHAR) END AS industry,
          street, city, id % 2 = 1 AS verified, 'Top ' || CAST(id % 5 AS VARCHAR) AS badges, '0' || CAST(id % 9 + 1 AS VARCHAR) || '.02.2024' AS updated,
          'Filiale ' || CAST(id AS VARCHAR) || ',Weitere Standorte' AS locations FROM ({D.CO}) c""",
)
def _(spark, sf_dir):
    d = X.detail(detail_pages(spark, sf_dir))
    p = F.col("contact_persons")[0]
    return d.select(
        "page_id",
        "website",
        F.array_join("opening_hours", ",").alias("hours"),
        "description",
        F.array_join("services", ",").alias("services"),
        F.concat_ws("/", p["name"], p["role"], p["phone"], p["email"]).alias("person"),
        F.try_element_at("social_media", F.lit("facebook")).alias("facebook"),
        F.array_join("additional_phones", ",").alias("phones"),
        F.array_join("additional_emails", ",").alias("emails"),
        F.col("company_info.founded_year").alias("founded"),
        F.col("company_info.employees").alias("employees"),
        "industry",
        F.col("address.street").alias("street"),
        F.col("address.city").alias("city"),
        F.coalesce("verified.owner_verified", F.lit(False)).alias("verified"),
        F.array_join("verified.badges", ",").alias("badges"),
        F.col("metadata.last_updated").alias("updated"),
        F.array_join(F.col("locations.name"), ",").alias("locations"),
    )


@query(
    "html_team",
    """SELECT CAST(floor(c_custkey / 30) AS BIGINT) AS page_id, c_name || ' Muster' AS name, CASE c_custkey % 2 WHEN 0 THEN 'Leiter ' || c_mktsegment END AS role,
         lower(c_mktsegment) || '@x.de' AS email, '+49 ' || CAST(c_custkey AS VARCHAR) AS phone
       FROM customer WHERE c_custkey % 30 < 20 AND c_custkey % 3 <> 0""",
)
def _(spark, sf_dir):
    # thirty boxes to a page; names of one word are no names
    boxes = table(spark, sf_dir, "customer").selectExpr(
        "CAST(floor(c_custkey / 30) AS BIGINT) AS page_id",
        "c_custkey",
        """concat('<div class="member"><h3>', c_name, CASE WHEN c_custkey % 3 <> 0 THEN ' Muster' ELSE '' END, '</h3>',
             CASE WHEN c_custkey % 2 = 0 THEN concat('<p> Leiter ', c_mktsegment, ' </p>') ELSE '' END,
             '<a href="mailto:', lower(c_mktsegment), '@x.de?subject=a">m</a><a href="tel:+49 ', CAST(c_custkey AS STRING), '">t</a></div>') AS box""",
    )
    pages = boxes.groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "box"))), lambda b: b["box"]), "").alias("html")
    )
    return X.team(pages.withColumn("url", F.lit("https://t.example"))).drop("entry_no")


@query(
    "html_register",
    f"""SELECT id AS page_id, 'Firma ' || CAST(g AS VARCHAR) || ' GmbH' AS legal_form, 'HRB ' || CAST(id AS VARCHAR) AS register_number,
          'Amtsgericht Stuttgart' AS register_court, street AS address, 'Max Muster' AS directors, '25.' || CAST(id % 900 + 100 AS VARCHAR) || ',00' AS capital
        FROM ({D.CO}) c WHERE id % 4 <> 0""",
)
def _(spark, sf_dir):
    pages = companies(spark, sf_dir).selectExpr(
        "id AS page_id",
        "'https://r.example' AS url",
        """concat('<div class="search-Result"><b>Firma ', CAST(g AS STRING), ' GmbH </b>', CASE WHEN id % 4 <> 0 THEN concat('<i>Nr. HRB ', CAST(id AS STRING), '</i>') ELSE '' END,
             '<i> Amtsgericht Stuttgart</i><div class="address">', street, '</div><p>Geschäftsführer: <em>Max Muster</em></p><p>Stammkapital: 25.',
             CAST(id % 900 + 100 AS STRING), ',00 EUR</p></div><div class="result">HRB 1</div>') AS html""",
    )
    return X.register_result(pages).withColumn("directors", F.array_join("directors", ","))


# --- links and text of the given pages ------------------------------------------------------------


def _pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages"))


_KINDS = {"impressum": ["nicht", "el"], "team": ["the", "über uns"], "kontakt": ["que", "kontakt"]}
_ANCHOR_SQL = """SELECT page_id, url, list_extract(h, CAST(i AS BIGINT)) AS href, list_extract(t, CAST(i AS BIGINT)) AS label, i AS position FROM (
  SELECT page_id, url, h, t, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, url,
    regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS h,
    regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS t FROM pages) x) y""".replace("\\\\", "\\")


@query(
    "html_classify_links",
    f"""WITH a AS ({_ANCHOR_SQL}), k AS ({' UNION ALL '.join(f"SELECT page_id, url, href, position, '{kind}' AS kind FROM a WHERE " + ' OR '.join(f"contains(lower(label), '{w}')" for w in words) for kind, words in _KINDS.items())})
        SELECT page_id, kind, arg_min(regexp_extract(url, '^[a-z]+://[^/?#]*') || href, position) AS target FROM k GROUP BY page_id, kind""",
)
def _(spark, sf_dir):
    return W.classify_links(_pages(spark, sf_dir), _KINDS)


_TEXT_SQL = "html"
for _tag in ("script", "style", "template"):
    _TEXT_SQL = rf"regexp_replace({_TEXT_SQL}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>', '', 'g')"
_TEXT_SQL = rf"regexp_replace(regexp_replace({_TEXT_SQL}, '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', '', 'g')"


def _unescape_sql(x: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", "\u00a0"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


@query(
    "html_page_text",
    rf"SELECT page_id, {_unescape_sql("nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '')")} AS title, substr({_unescape_sql(_TEXT_SQL)}, 1, 1000) AS text FROM pages",
)
def _(spark, sf_dir):
    return W.page_text(_pages(spark, sf_dir))


@query("html_text_gate", "SELECT doc_id, substr(text, 1, 3000) AS text FROM documents WHERE length(text) >= 100")
def _(spark, sf_dir):
    return W.text_gate(table(spark, sf_dir, "documents").select("doc_id", "text"))


_FACT_HTML = """concat('<html><head></head><body><h1>', replace(company_name, '&', '&amp;'), '</h1><p>Adresse: <b>', coalesce(address, ''), '</b></p>',
  CASE WHEN id % 3 = 0 THEN concat('<p>Telefon: +49 711 ', CAST(100000 + id AS STRING), '</p>') WHEN id % 3 = 1 THEN concat('<a href="tel:+49 30 ', CAST(200000 + id AS STRING), '">t</a>') ELSE '' END,
  CASE WHEN id % 2 = 0 THEN concat('<p>info@firma', CAST(id AS STRING), '.de</p>') ELSE concat('<a href="mailto:POST@Firma', CAST(id AS STRING), '.de">m</a>') END,
  CASE WHEN id % 5 <> 0 THEN concat('<p>http://www.firma', CAST(id AS STRING), '.de/start?x=1</p>') ELSE '' END,
  '<h2>Services</h2><ul><li>Beratung <i>A</i></li><li> </li><li>Wartung</li></ul><p>CEO: Eva ', CAST(g AS STRING), '</p><p>Team Lead  Max</p></body></html>')"""


@query(
    "html_ground_truth",
    f"""SELECT id AS page_id, {_NAME} AS company_name, CASE WHEN address IS NULL THEN '' ELSE address END AS address,
          CASE id % 3 WHEN 0 THEN '+49 711 ' || CAST(100000 + id AS VARCHAR) WHEN 1 THEN '+49 30 ' || CAST(200000 + id AS VARCHAR) END AS phone,
          CASE id % 2 WHEN 0 THEN 'info@firma' || CAST(id AS VARCHAR) || '.de' ELSE 'post@firma' || CAST(id AS VARCHAR) || '.de' END AS email,
          CASE WHEN id % 5 <> 0 THEN 'http://www.firma' || CAST(id AS VARCHAR) || '.de/start' END AS website, 'Beratung A,Wartung' AS services, 'Eva ' || CAST(g AS VARCHAR) || ',Max' AS directors
        FROM ({D.CO}) c""",
)
def _(spark, sf_dir):
    pages = companies(spark, sf_dir).selectExpr("id AS page_id", f"{_FACT_HTML} AS html")
    facts = W.regex_ground_truth(pages)
    return facts.withColumns({c: F.array_join(c, ",") for c in ("services", "directors")})


_P = _unescape_sql("html")


@query(
    "html_ground_truth_pages",
    rf"""SELECT page_id, CASE WHEN regexp_matches(h, '(?is)<h1[^>]*>(.*?)</h1>') THEN {D.strip("regexp_replace(regexp_extract(h, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')")} END AS company_name,
          CASE WHEN regexp_matches(h, 'https?://[\p{{L}}\p{{N}}_./-]+') THEN regexp_extract(h, 'https?://[\p{{L}}\p{{N}}_./-]+') END AS website
        FROM (SELECT page_id, {_P} AS h FROM pages) p""",
)
def _(spark, sf_dir):
    return W.regex_ground_truth(_pages(spark, sf_dir)).select("page_id", "company_name", "website")


@query(
    "html_contact_links",
    f"""WITH l AS (SELECT CAST(floor(id / 20) AS BIGINT) AS page_id, id, {_MAIL_OUT} AS mail, {D.strip("replace(coalesce(phone, ''), 'tel:', '')")} AS tel FROM ({D.CO}) c),
        m AS (SELECT page_id, id, mail FROM l WHERE mail IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY id) <= 10),
        t AS (SELECT page_id, id, tel FROM l QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY id) <= 10),
        dm AS (SELECT page_id, mail, min(id) AS id FROM m WHERE mail <> '' GROUP BY 1, 2), dt AS (SELECT page_id, tel, min(id) AS id FROM t WHERE tel <> '' GROUP BY 1, 2)
        SELECT a.page_id, coalesce(b.emails, '') AS emails, a.phones FROM (SELECT page_id, string_agg(tel, ',' ORDER BY id) AS phones FROM dt GROUP BY 1) a
          LEFT JOIN (SELECT page_id, string_agg(mail, ',' ORDER BY id) AS emails FROM dm GROUP BY 1) b USING (page_id)""",
)
def _(spark, sf_dir):
    links = W.contact_links(listing_pages(spark, sf_dir, "b"))
    return links.withColumns({c: F.array_join(c, ",") for c in ("emails", "phones")})


@query(
    "html_search_links",
    f"""WITH l AS (SELECT CAST(floor(id / 20) AS BIGINT) AS page_id, id, CASE id % 3 WHEN 1 THEN 'https://www.11880.com/redirect?x=1' ELSE trim(website) END AS url FROM ({D.CO}) c),
        ok AS (SELECT *, {D.domain('url')} AS host FROM l WHERE starts_with(url, 'http') AND NOT ({' OR '.join(f"contains(url, '{h}')" for h in NON_COMPANY_SITES)})),
        f AS (SELECT page_id, host, arg_min(url, id) AS url, min(id) AS id FROM ok GROUP BY 1, 2)
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY id) AS INT) AS rank, 'x' AS title, url, host FROM f QUALIFY rank <= 5""",
)
def _(spark, sf_dir):
    return W.search_links(listing_pages(spark, sf_dir, "a"), 5)


@query(
    "html_imprint",
    f"""SELECT id, CASE WHEN id % 2 = 0 THEN 'Max ' || substr(street, 1, 5) || ' Muster' ELSE 'Eva ' || substr(street, 1, 5) END AS directors,
          CASE WHEN id % 3 <> 0 THEN 'HRB ' || CAST(id AS VARCHAR) END AS register_number, CASE WHEN id % 3 = 1 THEN 'Stuttgart' END AS register_court,
          CASE WHEN id % 4 = 0 THEN 'DE' || CAST(1000 + id AS VARCHAR) END AS vat_id FROM ({D.CO}) c WHERE id % 5 <> 0""",
)
def _(spark, sf_dir):
    texts = companies(spark, sf_dir).selectExpr(
        "id",
        """CASE WHEN id % 5 = 0 THEN 'Kein Impressum' ELSE concat(CASE WHEN id % 2 = 0 THEN concat('Geschäftsführer: Max ', substr(street, 1, 5), ' Muster')
             ELSE concat('Inhaber Eva ', substr(street, 1, 5)) END, '. ', CASE WHEN id % 3 = 1 THEN 'Amtsgericht Stuttgart, ' ELSE '' END,
             CASE WHEN id % 3 <> 0 THEN concat('HRB ', CAST(id AS STRING)) ELSE '' END, CASE WHEN id % 4 = 0 THEN concat(' USt-IdNr. DE ', CAST(1000 + id AS STRING)) ELSE '' END) END AS text""",
    )
    return W.imprint(texts).select("id", F.array_join("directors", ",").alias("directors"), "register_number", "register_court", "vat_id")


@query(
    "html_imprint_documents",
    r"""SELECT doc_id, nullif(regexp_extract(text, '(HRB?\s*[0-9]+)', 1), '') AS register_number FROM documents
        WHERE regexp_matches(text, '(HRB?\s*[0-9]+)') OR regexp_matches(text, '(Geschäftsführer|Geschäftsführung|Inhaber|Vorstand)[:\s]+[A-ZÄÖÜ][a-zäöüß]+\s+[A-ZÄÖÜ][a-zäöüß]+')
          OR regexp_matches(text, '(Amtsgericht|Registergericht)\s+[A-ZÄÖÜ][a-zäöüß]+') OR regexp_matches(text, 'USt[.-]?IdNr[.:]?\s*[A-Z]{2}\s*[0-9]+')""",
)
def _(spark, sf_dir):
    return W.imprint(table(spark, sf_dir, "documents")).select("doc_id", "register_number")


@query(
    "html_recover_json",
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
         CASE event_id % 4 WHEN 2 THEN 'array' WHEN 3 THEN 'raw' ELSE 'object' END AS kind FROM events""",
)
def _(spark, sf_dir):
    answers = events_answers(spark, sf_dir).withColumn("r", W.recover_json(F.col("answer")))
    k = F.coalesce(F.try_variant_get("r.payload", "$.k", "bigint"), F.try_variant_get("r.payload", "$[0].k", "bigint"))
    kind = (
        F.when(F.col("r.raw").isNotNull(), "raw")
        .when(F.schema_of_variant("r.payload").startswith("ARRAY"), "array")
        .otherwise("object")
    )
    return answers.select("event_id", k.alias("k"), kind.alias("kind"))


def events_answers(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        """CASE event_id % 4 WHEN 0 THEN concat('Here is the result: ', props, ' as asked.') WHEN 1 THEN props
             WHEN 2 THEN concat('List: [', props, ', {"k": -1}] done') ELSE concat('broken {', props) END AS answer""",
    )


@query(
    "html_first_success",
    f"""WITH m AS (SELECT doc_id, CASE WHEN n_chars > 3000 THEN substr(text, 1, 20) ELSE '' END AS a, CASE WHEN lang = 'en' THEN lang || source END AS b, CASE WHEN doc_id % 3 = 0 THEN source END AS c FROM documents)
        SELECT doc_id, coalesce(nullif(b, ''), nullif(a, ''), nullif(c, '')) AS result, CASE WHEN b <> '' THEN 'trafilatura' WHEN a <> '' THEN 'crawl' WHEN c <> '' THEN 'httpx' END AS method_used FROM m""",
)
def _(spark, sf_dir):
    return _first(spark, sf_dir).select("doc_id", "result", "method_used")


def _first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    methods = {
        "crawl": F.expr("CASE WHEN n_chars > 3000 THEN substr(text, 1, 20) ELSE '' END"),
        "trafilatura": F.expr("CASE WHEN lang = 'en' THEN concat(lang, source) END"),
        "httpx": F.expr("CASE WHEN doc_id % 3 = 0 THEN source END"),
    }
    return W.first_success(docs, methods, preferred="trafilatura")


@query(
    "html_method_usage",
    """SELECT CASE WHEN lang = 'en' THEN 'trafilatura' WHEN n_chars > 3000 THEN 'crawl' WHEN doc_id % 3 = 0 THEN 'httpx' END AS method_used, count(*) AS n FROM documents GROUP BY 1""",
)
def _(spark, sf_dir):
    return W.method_usage(_first(spark, sf_dir))


# --- sources ------------------------------------------------------------------------------------------


@query(
    "source_validate_cases",
    """WITH c AS (SELECT CAST(doc_id % 900 AS VARCHAR) AS id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS name, CASE WHEN doc_id % 13 = 0 THEN '  ' ELSE text END AS html, doc_id % 7 = 0 AS bad FROM documents)
       SELECT id, 'missing name' AS problem FROM c WHERE name IS NULL UNION ALL SELECT id, 'html_content is empty' FROM c WHERE trim(html) = ''
       UNION ALL SELECT id, 'expected_data is not an object' FROM c WHERE bad
       UNION ALL SELECT id, 'duplicate id' FROM (SELECT id, unnest(range(1, n)) FROM (SELECT id, count(*) AS n FROM c GROUP BY id))""",
)
def _(spark, sf_dir):
    cases = table(spark, sf_dir, "documents").selectExpr(
        "CAST(doc_id % 900 AS STRING) AS id",
        "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS name",
        "CASE WHEN doc_id % 13 = 0 THEN '  ' ELSE text END AS html_content",
        "CASE WHEN doc_id % 7 = 0 THEN '[1]' ELSE '{}' END AS expected_data",
    )
    return R.validate_cases(cases)


@query(
    "source_unify",
    """SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS name, 'https://s' || CAST(l_suppkey AS VARCHAR) AS url, 'email,phone' AS fields FROM lineitem""",
)
def _(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS id",
        "CAST(l_shipdate AS STRING) AS scraped_at",
        """CASE WHEN l_linenumber % 2 = 0
             THEN concat('{"primary": "', l_returnflag, '", "urls": ["https://s', CAST(l_suppkey AS STRING), '"], "data_sources": {"', l_returnflag, '": ["phone", "email"]}}')
             ELSE concat('[{"name": "', l_returnflag, '", "url": "https://s', CAST(l_suppkey AS STRING), '", "fields": ["email", "phone"]}]') END AS sources""",
    )
    return R.unify_sources(raw).select("id", F.explode("sources").alias("s")).select(
        "id", "s.name", "s.url", F.array_join("s.fields", ",").alias("fields")
    )


@query(
    "source_load_stats",
    """SELECT event_type || CAST(user_id AS VARCHAR) AS name, count(*) AS requests, count(*) FILTER (value > 100) AS failures, max(value) AS p95_ms FROM events
       WHERE event_type <> 'error' GROUP BY event_type, user_id""",
)
def _(spark, sf_dir):
    raw = (
        table(spark, sf_dir, "events")
        .groupBy("event_type", "user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 100).alias("f"), F.max("value").alias("m"))
        .selectExpr(
            "CASE WHEN event_type = 'error' THEN 'None' ELSE 'HTTP' END AS Type",
            "concat(event_type, CAST(user_id AS STRING)) AS Name",
            "CAST(n AS STRING) AS Requests",
            "CAST(f AS STRING) AS Failures",
            "CAST(m AS STRING) AS `95%ile`",
        )
    )
    return R.parse_load_stats(raw).select("name", "requests", "failures", "p95_ms")


@query(
    "source_seed",
    """SELECT r_name AS name, r_name AS display_name FROM region UNION ALL SELECT n_name, 'Neu ' || n_name FROM nation WHERE n_regionkey <> 1""",
)
def _(spark, sf_dir):
    existing = table(spark, sf_dir, "region").selectExpr("r_name AS name", "r_name AS display_name")
    known = table(spark, sf_dir, "nation").filter("n_regionkey = 1").selectExpr("n_name AS name", "'alt' AS display_name")
    seeds = table(spark, sf_dir, "nation").selectExpr("n_name AS name", "concat('Neu ', n_name) AS display_name")
    both = R.seed_sources(existing.unionByName(known), seeds)
    return both.filter("display_name <> 'alt'")


def _terms(spark, sf_dir):
    """Industry and city pairs that occur: part types delivered by suppliers of a nation."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey AS l_partkey", "concat(p_type, ' & mehr') AS industry")
    sup = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS l_suppkey", "s_nationkey AS n_nationkey")
    nations = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "concat(n_name, ' Ä*~') AS city")
    pairs = lines.distinct().join(parts, "l_partkey").join(sup, "l_suppkey").join(nations, "n_nationkey")
    return pairs.select("industry", "city").distinct()


def _url_sql(template: str, param: str) -> str:
    what, where = "p_type || '+%26+mehr'", "n_name || '+%C3%84%2A~'"
    url = "'" + template.replace("{what}", f"' || {what} || '").replace("{where}", f"' || {where} || '") + "'"
    return f"""SELECT DISTINCT p_type || ' & mehr' AS industry, n_name || ' Ä*~' AS city, CAST(pg AS INT) AS page,
      {url} || CASE WHEN pg > 1 THEN '{param}' || CAST(pg AS VARCHAR) ELSE '' END AS url
      FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey, range(1, 4) r(pg)"""


def _register_urls() -> None:
    from kontor.sources.profiles import REGISTRY

    for key in "abcde":
        p = REGISTRY[key]

        def build(spark, sf_dir, key=key):
            return R.search_urls(_terms(spark, sf_dir), key, 3)

        query(f"source_search_urls_{key}", _url_sql(p.search_url, p.page_param))(build)


_register_urls()

"""Directory, detail, team and register pages on hand-written HTML."""

import gc
import json

from pyspark.sql import functions as F

from kontor.functions import markup as H
from kontor.operators import extract as X
from kontor.operators import ingest, upsert
from kontor.operators import webtext as W
from kontor.sources import readers as R


def pages(spark, *htmls):
    return spark.createDataFrame([(i, f"https://dir.example/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def entry_a(name, street, plz, city, tail=""):
    head = f'<h2 class="result-list-entry-title__headline">{name}</h2>' if name else ""
    return f"""<li class="result-list-entry"><div>{head}<div><span class="js-street-address">{street}</span><br>
      <span class="js-postal-code">{plz}</span> <span class="js-address-locality">{city}</span></div>{tail}</div></li>"""


A_PAGE = "<html><body><ul class='result-list'>" + "".join(
    [
        entry_a("Zimmerei Roth", "Sägeweg 3", "68159", "Mannheim", '<p>Tel: 0621 220044 ab 9 Uhr</p><a class="homepage" href="https://www.11880.com/r">w</a>'),
        entry_a("Buchbinderei Lindner", "Am Fischbach 8", "68161", "Mannheim",
                '<a href="https://www.11880.com/branchenbuch/mannheim/77/lindner.html">Details</a><a href="tel:+49621445566">anrufen</a>'),
        entry_a("Gärtnerei Halm", "Beetstraße 6", "68163", "Mannheim"),
        entry_a("Neckarrad GmbH", "Kornweg 27", "69115", "Heidelberg", '<a href="mailto:werkstatt@neckarrad.de?subject=Termin">m</a><a class="homepage" href="https://www.neckarrad.de">w</a>'),
    ]
) + "</ul></body></html>"


def entry_b(name, street, plz, city, contact):
    return f"""<article class="mod-Treffer"><h2 itemprop="name">{name}</h2><div><span itemprop="streetAddress">{street}</span><br>
      <span itemprop="postalCode">{plz}</span> <span itemprop="addressLocality">{city}</span></div><div>{contact}</div></article>"""


B_PAGE = "<div class='mod-Treffer'>" + "".join(
    [
        entry_b("Zimmerei Roth", "Holzmarkt 1", "67059", "Ludwigshafen", '<a href="tel:+49621909090">0621 909090</a>'),
        entry_b("Buchbinderei Lindner", "Am Fischbach 8", "68161", "Mannheim",
                '<a href="mailto:atelier@lindner-buch.de">m</a><a href="/redirect/https://www.lindner-buch.de" itemprop="url">w</a>'),
        entry_b("Optik Seeger GmbH", "Linsengasse 14", "68165", "Mannheim", '<a href="tel:+49621881188">0621 881188</a>'),
    ]
) + "</div>"


def test_profile_a(spark):
    rows = X.extract(pages(spark, A_PAGE), "a").orderBy("entry_no").collect()
    assert [r.company_name for r in rows] == ["Zimmerei Roth", "Buchbinderei Lindner", "Gärtnerei Halm", "Neckarrad GmbH"]
    # a link to the directory itself is no website
    assert rows[0].phone == "0621 220044" and rows[0].website is None and rows[0].source.url == "https://dir.example/0"
    assert rows[1].address == "Am Fischbach 8, 68161 Mannheim" and rows[1].phone == "+49621445566"
    assert rows[1].source.url == rows[1].detail_url == "https://www.11880.com/branchenbuch/mannheim/77/lindner.html"
    assert rows[2].source.fields == ["address", "city", "company_name", "postal_code"]
    assert rows[3].email == "werkstatt@neckarrad.de" and rows[3].website == "https://www.neckarrad.de"


def test_empty_and_broken_pages(spark):
    # a blank headline (an entry with an empty name), unquoted attributes with a bare ampersand, and closing tags that nothing opened
    broken = "<ul>" + entry_a("  ", "Talgasse 2", "68161", "Mannheim") + (
        "<li class=result-list-entry></em></p><h2 class=result-list-entry-title__headline>Huber & Söhne KG</h2>"
        "<div><span class=js-street-address>Talgasse 4</span><span class=js-postal-code>68161</span></div></li>"
    ) + entry_a("Weberei Kolb", "Spulenweg 5", "68161", "Mannheim", "</b></i>") + "</ul>"
    rows = X.extract(pages(spark, "", broken, "<p>keine Treffer</p>"), "a").orderBy("page_id", "entry_no").collect()
    assert [(r.page_id, r.company_name) for r in rows] == [(1, ""), (1, "Huber & Söhne KG"), (1, "Weberei Kolb")]
    assert rows[1].address.startswith("Talgasse 4") and rows[1].postal_code == "68161" and rows[1].city is None


def test_second_source_updates_one_and_adds_two(spark):
    cols = ["company_name", "website", "phone", "email", "address", "city", "postal_code", "description", "seq"]
    empty = spark.createDataFrame([], "id long, company_name string, website string, phone string, email string, address string, city string, postal_code string, description string, legal_form string")

    def load(current, html, key):
        leads = X.extract(pages(spark, html), key).withColumn("seq", F.col("entry_no").cast("long")).select(cols)
        clean, rejected = ingest.clean(leads)
        assert rejected.count() == 0
        return upsert.upsert(current, clean, "seq")

    first, counts = load(empty, A_PAGE, "a")
    assert counts.first().asDict() == {"new": 4, "updated": 0, "errors": 0}
    second, counts = load(first, B_PAGE, "b")
    assert counts.first().asDict() == {"new": 2, "updated": 1, "errors": 0}
    rows = {(r.company_name, r.city): r for r in second.collect()}
    assert len(rows) == 6
    # the same name in another town is another company
    assert rows["Zimmerei Roth", "Mannheim"].phone == "+49 621 220044" and rows["Zimmerei Roth", "Ludwigshafen"].phone == "+49 621 909090"
    both = rows["Buchbinderei Lindner", "Mannheim"]
    assert (both.email, both.website, both.phone) == ("atelier@lindner-buch.de", "https://www.lindner-buch.de", "+49 621 445566")
    assert rows["Optik Seeger GmbH", "Mannheim"].legal_form == "GmbH"


def test_profiles_c_d_e(spark):
    c = """<div class="entry-box"><a class="Name">Firma C</a><span class="strasse street">Weg 1</span><span class="ort">70173 Stuttgart</span>
           <a class="homepage" href="https://www.dasoertliche.de/x">w</a><a href="/Themen/c.html">d</a></div>"""
    d = """<div class="company"><h3>Firma D</h3><span class="street">draußen</span><div class="address"><span class="street">Weg 2</span><span class="city">Ulm</span></div>
           <a title="Homepage" href="https://d.de">w</a></div>"""
    e = f"""<article class="business"><a class="company">Firma E</a><div class="phone">Tel.: 0711/12-3</div><div class="mail">kein mail</div>
            <p class="info">{'x' * 600}</p><a class="more" href="relativ">m</a></article>"""
    row = X.extract(pages(spark, c), "c").first()
    assert (row.company_name, row.address, row.website, row.detail_url) == ("Firma C", "Weg 1, 70173 Stuttgart", None, "https://www.dasoertliche.de/Themen/c.html")
    row = X.extract(pages(spark, d), "d").first()
    assert (row.company_name, row.address, row.city, row.website) == ("Firma D", "Weg 2", None, "https://d.de")
    row = X.extract(pages(spark, e), "e").first()
    assert (row.phone, row.email, row.detail_url, len(row.description)) == (" 0711/12-3", None, None, 500)
    assert row.source.fields == ["company_name", "description", "phone"]


def test_detail_blocks_stay_empty_on_an_empty_page(spark):
    row = X.detail(pages(spark, "<html></html>")).first().asDict()
    assert [k for k, v in row.items() if v is not None] == ["page_id"]


def test_register_needs_a_number(spark):
    good = "<div class='Result'><p>Beta AG</p><p>HRB 77</p><p>Vorstand: <b>Eva Muster</b><i>Max Maier</i></p><p>Grundkapital 1.000,00 EUR</p></div>"
    rows = X.register_result(pages(spark, good, "<div class='result'>nichts</div>", "<p>leer</p>")).collect()
    assert len(rows) == 1
    assert (rows[0].legal_form, rows[0].register_number, rows[0].capital, rows[0].directors) == ("Beta AG", "HRB 77", "1.000,00", ["Eva Muster", "Max Maier"])


def test_links_text_and_imprint(spark):
    html = """<title>T &amp; U</title><script>x</script><a href="../impressum.html"><b>Impressum</b></a><a href="/team">Über uns</a>
              <a href="https://k.de/kontakt">Kontakt</a><a href="/team2">Team</a><!-- weg --><p>Hallo &uuml;</p>"""
    df = spark.createDataFrame([(1, "https://x.de/a/b", html)], "page_id long, url string, html string")
    assert {r.kind: r.target for r in W.classify_links(df).collect()} == {
        "impressum": "https://x.de/impressum.html", "team": "https://x.de/team", "kontakt": "https://k.de/kontakt",
    }
    row = W.page_text(df).first()
    assert row.title == "T & U" and "Hallo ü" in row.text and "weg" not in row.text
    text = "Geschäftsführer: Max Muster.\nVorstand Eva Maier. Registergericht Ulm HRB  12, USt-IdNr. DE 123"
    row = W.imprint(spark.createDataFrame([(1, text), (2, "leer")], "id long, text string")).collect()
    assert [(r.id, r.directors, r.register_number, r.register_court, r.vat_id) for r in row] == [
        (1, ["Max Muster", "Eva Maier"], "HRB  12", "Ulm", "DE123")
    ]


def test_ground_truth_of_a_plain_page(spark):
    html = """<html><body><h1>Tischlerei Brandt GmbH</h1><p>Website: https://www.brandt-holz.de</p><p>E-Mail: post@brandt-holz.de</p>
              <p>Telefon: +49 381 707172</p><p>Adresse: Hafenallee 19, 18055 Rostock</p></body></html>"""
    row = W.regex_ground_truth(pages(spark, "<p>nur Text</p>", html)).orderBy("page_id").collect()
    assert row[0].company_name is None and row[0].phone is None
    assert row[1].asDict() == {
        "page_id": 1, "company_name": "Tischlerei Brandt GmbH", "address": "Hafenallee 19, 18055 Rostock", "phone": "+49 381 707172",
        "email": "post@brandt-holz.de", "website": "https://www.brandt-holz.de", "services": [], "directors": [],
    }


def test_recover_json(spark):
    texts = ['so: {"a": 1} ok', "[1, 2]", "{kaputt [3] x", "12", "gar nichts", '{"a": 1} {"b": 2}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", W.recover_json(F.col("t")).alias("r")).select("i", F.to_json("r.payload").alias("p"), "r.raw").orderBy("i").collect()
    assert [(r.p, r.raw) for r in got] == [
        ('{"a":1}', None), ("[1,2]", None), ("[3]", None), ("12", None), (None, "gar nichts"), (None, '{"a": 1} {"b": 2}'),
    ]


def test_lead_dumps_of_both_shapes(spark, tmp_path):
    old = [{"company_name": "A", "scraped_at": "t1", "sources": {"primary": "s", "urls": ["u"], "data_sources": {"s": ["b", "a"]}}}]
    new = [{"company_name": "B", "scraped_at": "t2", "sources": [{"name": "s", "url": "v", "scraped_at": "t3", "fields": ["c"]}]}]
    (tmp_path / "old.json").write_text(json.dumps(old))
    (tmp_path / "new.json").write_text(json.dumps(new))
    rows = {r.company_name: r.sources[0] for r in R.read_leads_json(spark, str(tmp_path)).collect()}
    assert tuple(rows["A"]) == ("s", "u", "t1", ["a", "b"])
    assert tuple(rows["B"]) == ("s", "v", "t3", ["c"])


def test_readers_of_files(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.html").write_text("<h1>ä</h1>", encoding="utf-8")
    assert R.read_pages(spark, str(tmp_path / "p")).first().html == "<h1>ä</h1>"
    cases = [
        {"id": "1", "name": "n", "html_content": "<p>", "expected_data": {"a": 1}},
        {"id": "1", "html_content": " ", "expected_data": [1]},
    ]
    (tmp_path / "cases.json").write_text(json.dumps(cases))
    problems = sorted(r.problem for r in R.validate_cases(R.read_cases(spark, str(tmp_path / "cases.json"))).collect())
    assert problems == ["duplicate id", "expected_data is not an object", "html_content is empty", "missing name"]
    (tmp_path / "stats.csv").write_text(
        "Type,Name,Requests,Failures,Median Response Time,95%,99%,Requests/s,Method\n"
        "HTTP,/companies,1200,12,100,220,300,40,GET\nNone,Total,1200,12,,,,,\n"
    )
    row = R.read_load_stats(spark, str(tmp_path / "stats.csv")).collect()
    assert len(row) == 1 and (row[0].requests, row[0].p95_ms, row[0].rps, row[0].method) == (1200, 220.0, 40.0, "GET")
    assert R.seed_sources(spark.createDataFrame([("11880", "mine")], "name string, display_name string")).count() == 8


def test_large_json_arrays_are_read_in_pieces(spark, tmp_path):
    """One array of one line over many splits, with braces and quotes in its strings, against Python's parser."""
    import json
    import random

    rng = random.Random(5)

    def text():
        return "".join(rng.choice(['a', 'ß', '{', '}', '"', '\\', ',', '[', ']', '\n', ' ']) for _ in range(rng.randint(0, 12)))

    items = [{"id": i, "name": text(), "more": {"x": [text(), {"y": text()}], "z": {}}} for i in range(3000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text(json.dumps(items), encoding="utf-8")
    (tmp_path / "in" / "two.json").write_text(json.dumps([{"id": 5000 + i, "name": text(), "more": None} for i in range(300)], indent=2), encoding="utf-8")
    (tmp_path / "in" / "bad.json").write_text('[{"id": 9000, "name": "ok"}, {"id": 9001, "name": }, {"id": 9002, "name": "cut', encoding="utf-8")
    (tmp_path / "in" / "empty.json").write_text("[]")
    (tmp_path / "in" / "single.json").write_text('{"id": 9100, "name": "s"}\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = R.read_json_objects(spark, str(tmp_path / "in"), "id bigint, name string, more struct<x: array<string>, z: map<string,string>>").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    good = {r.id: r for r in rows if r.corrupt is None}
    assert sorted(good) == [*range(3000), *range(5000, 5300), 9000, 9100]
    assert all(good[x["id"]].name == x["name"] and good[x["id"]].more.x[0] == x["more"]["x"][0] for x in items)
    assert sorted(r.corrupt for r in rows if r.corrupt is not None) == ['{"id": 9001, "name": }', '{"id": 9002, "name": "cut']
    assert all(r.id is None and r.name is None for r in rows if r.corrupt is not None)


def test_a_parsed_page_leaves_no_cycles():
    """A tree is freed when it goes out of use, so pages don't pile up in a task until cycles are searched for."""
    html = "<ul>" + "<li class='x'><p>a<b>b</b><br>" * 50 + "</ul>"
    gc.collect()
    gc.disable()
    try:
        assert len(list(H.select(H.parse(html), "li"))) == 50
        assert gc.collect() < 50
    finally:
        gc.enable()


def test_found_rows_leave_a_task_in_pieces(spark, monkeypatch):
    """A batch of more pages than PAGES comes out as several; page ids and entry numbers are those of one batch."""
    monkeypatch.setattr(X, "PAGES", 3)
    pages = spark.range(10).coalesce(1).selectExpr("id AS page_id", "concat('u', id) AS url", "repeat('x', CAST(id % 3 AS INT)) AS html")
    found = X._map_pages(pages, lambda html: [{"name": f"{k}"} for k in range(len(html))], "name string")
    assert sorted((r.page_id, r.url, r.entry_no, r.name) for r in found.collect()) == [(i, f"u{i}", k, f"{k}") for i in range(10) for k in range(i % 3)]

"""Literal in, literal out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kontor.functions import contact, normalize as N, routing, scoring as S, similarity as M, validate as V


def run(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    (V.valid_email, "mailto:info@test.de", "info@test.de"),
    (V.valid_email, " INFO@TEST.DE ", "info@test.de"),
    (V.valid_email, "E-Mail:x@y.de", None),
    (V.valid_email, "email:x@y.de", "x@y.de"),
    (V.valid_email, "invalid-email", None),
    (V.valid_email, "@test.de", None),
    (V.valid_email, "test@", None),
    (V.valid_email, "a..b@test.de", None),
    (V.valid_email, "", None),
    (V.valid_email, None, None),
    (V.valid_phone, "0711 123456", "+49 711 123456"),
    (V.valid_phone, "tel:+49 711 123456", "+49 711 123456"),
    (V.valid_phone, "+49 (0)711/123456", "+49 711 123456"),
    (V.valid_phone, "0049 30 1234567", "+49 30 1234567"),
    (V.valid_phone, "0171 1234567", "+49 171 1234567"),
    (V.valid_phone, "+1 212 5550100", "+1 2125550100"),
    (V.valid_phone, "+41 44 1234567", "+41 441234567"),
    (V.valid_phone, "123", None),
    (V.valid_phone, "invalid", None),
    (V.valid_phone, "", None),
    (V.valid_website, "https://www.test.de/", "https://www.test.de"),
    (V.valid_website, "WWW.Test.de/Pfad/?a=1#b", "https://www.test.de/Pfad"),
    (V.valid_website, "http://x.de/a;b", "http://x.de/a"),
    (V.valid_website, "https://", None),
    (V.valid_website, "", None),
    (V.valid_postal_code, " 70173 ", "70173"),
    (V.valid_postal_code, "D-70173", "70173"),
    (V.valid_postal_code, "123", "123"),
    (V.valid_postal_code, "", None),
    (V.valid_company_name, "  test   company ", "test company"),
    (V.valid_company_name, "x", None),
    (N.norm_name, "  test   company  ", "Test Company"),
    (N.norm_name, "IBM COMPANY", "IBM COMPANY"),
    (N.norm_name, "eBay mcDonald a", "eBay mcDonald A"),
    (N.norm_legal_form, "gmbh", "GmbH"),
    (N.norm_legal_form, "ug", "UG"),
    (N.norm_legal_form, "Rechtsform: ag (Aktiengesellschaft)", "AG"),
    (N.norm_legal_form, "gmbh & co. kg", "GmbH"),
    (N.norm_legal_form, "stiftung", "STIFTUNG"),
    (N.norm_legal_form, "", None),
    (N.norm_city, "BERLIN", "Berlin"),
    (N.norm_city, "villingen-schwenningen", "Villingen-Schwenningen"),
    (N.norm_city, "bad  homburg v.d.höhe", "Bad Homburg V.D.Höhe"),
    (N.norm_state, "bw", "Baden-Württemberg"),
    (N.norm_state, " BY ", "Bayern"),
    (N.norm_state, "tirol", "Tirol"),
    (N.clip_description, "x" * 1500, "x" * 997 + "..."),
    (N.clip_description, " kurz ", "kurz"),
    (N.endpoint_template, "/jobs/1234/results/abcd1234-ab12-cd34-ef56-abcdef123456", "/jobs/{id}/results/{id}"),
    (N.endpoint_template, "", "/"),
    (N.domain_key, "HTTPS://Www.X.de/a", "www.x.de"),
    (N.domain_key, "x.de/a", "x.de/a"),
]


def test_string_rules(spark):
    by_fn = {}
    for fn, given, want in CASES:
        by_fn.setdefault(fn, []).append((given, want))
    for fn, pairs in by_fn.items():
        got = run(spark, fn, [g for g, _ in pairs])
        assert got == [w for _, w in pairs], fn.__name__


def test_split_legal_form(spark):
    got = run(spark, N.split_legal_form, ["Test Company (UG)", "Foo GmbH & Co. KG", "Foo AG KG", "Plain", "a e.v."])
    assert [(r.name, r.legal_form) for r in got] == [
        ("Test Company", "(UG)"), ("Foo", "GmbH & Co. KG"), ("Foo AG", "KG"), ("Plain", None), ("a", "e.v."),
    ]


def test_norm_list(spark):
    got = run(spark, N.norm_list, [["Director 1", "Director 2", "director 1 "], ["", None], [], None, ["  ", "a"]], "array<string>")
    assert got == [["Director 1", "Director 2"], None, None, None, ["", "a"]]


def test_scoring_parts(spark):
    full = spark.sql(
        """SELECT 'test@example.com' AS email, '+49 711 123456' AS phone, 'Str 1' AS address, array('A') AS directors,
           'https://x.de' AS site, 'Software Development' AS ind, 150 AS size, array('Python', 'React', 'AWS', 'Excel') AS tech"""
    )
    row = full.select(
        S.contact_score(F.col("email"), F.col("phone"), F.col("address"), F.col("directors")).alias("c"),
        S.website_score(F.col("site")).alias("w"),
        S.industry_score(F.col("ind")).alias("i"),
        S.size_score(F.col("size")).alias("s"),
        S.tech_score(F.col("tech")).alias("t"),
        S.size_score(F.lit("viele")).alias("bad"),
        S.size_score(F.lit(0)).alias("zero"),
    ).first()
    assert (row.c.points, row.w.points, row.i.points, row.s.points, row.t.points) == (30, 20, 15, 15, 10)
    assert row.c.email == "valid" and row.c.directors == "1 found" and row.i.high_value and row.t.modern_count == 3
    assert (row.bad.points, row.bad.status, row.zero.points, row.zero.status) == (5, "invalid", 5, "unknown")


def test_score_bands(spark):
    df = spark.range(0, 101, 10).select(S.category(F.col("id")).alias("q")).collect()
    assert [r.q for r in df] == ["low_quality"] * 4 + ["cold"] * 2 + ["warm"] * 2 + ["hot"] * 3


def test_routing(spark):
    df = spark.createDataFrame(
        [(500, "simple", "accuracy"), (500, "simple", None), (9000, "medium", "speed"), (2000, None, "resource_efficient"), (2000, "", "")],
        "n int, c string, p string",
    )
    got = [r.m for r in df.select(routing.route_model(F.col("n"), F.col("c"), F.col("p")).alias("m")).collect()]
    assert got == ["llama3.2", "llama3.2:1b", "mistral", "qwen2.5", "mistral"]


def test_contact_status(spark):
    df = spark.createDataFrame([(250,), (451,), (550,), (421,)], "c int")
    assert [r.s for r in df.select(contact.status_from_code(F.col("c")).alias("s")).collect()] == [
        "valid", "temporary_error", "invalid", "smtp_421",
    ]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
    return row[-1]


def test_lcs_lengths_match_the_table_method():
    rng = random.Random(7)
    pairs = [("", ""), ("", "abc"), ("a" * 64, "a" * 64), ("ab" * 40, "ba" * 50), ("x" * 65, "x" * 200), ("a\0b", "a\0b")]
    for _ in range(400):
        n, m = rng.choice([3, 20, 63, 64, 65, 90]), rng.choice([1, 18, 64, 70])
        pairs.append(tuple("".join(rng.choice("abcdé ") for _ in range(k)) for k in (n, m)))
    got = M.lcs_lengths([a for a, _ in pairs], [b for _, b in pairs])
    assert list(got) == [slow_lcs(a, b) for a, b in pairs]


@pytest.mark.parametrize(
    "a,b,want",
    [("4971112345", "0711123456", 80), ("test company gmbh", "company gmbh tset", 71), ("abc", "xyz", 0), ("", "", 100), ("a", "", 0), (None, "a", None)],
)
def test_ratio(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(M.ratio(F.col("a"), F.col("b")).alias("r")).first().r == want


def test_token_sort_key(spark):
    got = run(spark, M.token_sort_key, ["Müller & Söhne GmbH", "b_1  a-c", "äöü", "ŠKODA x"])
    assert got == ["gmbh mller shne", "a b_1 c", "", "x škoda"]


def test_whole_score(spark):
    from kontor.operators import score

    rows = spark.sql(
        """SELECT * FROM VALUES
           (1, 'Tech GmbH', 'info@tech.de', '+49 711 123456', 'https://tech.de', 'Weg 1', '70173', 'Ulm', 'Software', 120, array('Python','React','AWS'), array('Eva')),
           (2, 'X', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, array(), CAST(NULL AS ARRAY<STRING>)),
           (3, 'null', 'kaputt', '12', 'facebook.com/x', NULL, NULL, 'Ulm', 'Bau', 5, array('Cobol'), array())
           AS t(id, company_name, email, phone, website, street, postal_code, city, industry, team_size, technologies, directors)"""
    )
    got = {r.id: r for r in score.score(rows).collect()}
    assert (got[1].score, got[1].quality, got[1].recommendations) == (100, "hot", [])
    assert got[2].breakdown.data_quality.issues == ["invalid_name", "incomplete_data"]
    assert (got[2].score, got[2].quality, len(got[2].recommendations)) == (8, "low_quality", 3)
    # mail 5 + phone 5 + address 5, site 10, industry 5, size 7, tech 5, quality 10
    assert (got[3].score, got[3].quality) == (52, "cold")
    assert got[3].breakdown.data_quality.filled_fields == 8


def test_tile_bounds_never_fall_below_the_score():
    from kontor.operators import tiles

    rng = random.Random(3)
    fields = [["".join(rng.choice("abcdefgh 0123ßé") for _ in range(rng.randint(0, 30))) for _ in range(60)] for _ in range(2)]
    fields[1][5] = None
    key = [bytes([i]) for i in range(60)]
    side = tiles.Side(np.zeros(60, int), key, np.ones(60, bool), fields)
    bound = tiles._ceilings(side, side, slice(0, 60), [0.6, 0.4])
    for i in range(60):
        for j in range(60):
            score = 0.6 * M.ratio_values([fields[0][i]], [fields[0][j]])[0]
            if fields[1][i] is not None and fields[1][j] is not None:
                score += 0.4 * M.ratio_values([fields[1][i]], [fields[1][j]])[0]
            assert bound[i, j] >= score - 1e-2


@pytest.mark.parametrize("asks", [lambda i: True, lambda i: i % 9 == 0])
def test_tile_meets_each_pair_once_and_keeps_the_best(monkeypatch, asks):
    """Rows of many leaves: each pair is bounded once for both of its rows, none for rows that don't ask, and the best are exact."""
    from kontor.operators import tiles

    rng = random.Random(8)
    n, best, weights = 150, 3, [0.6, 0.4]
    name = lambda: " ".join(rng.choice(["nordo", "süd", "bau", "technik", "\U0001f600", ""]) for _ in range(3)) + str(rng.randrange(90))
    fields = [[name() for _ in range(n)], [rng.choice([None, name(), name() * 9]) for _ in range(n)]]
    keys = [f"{i:03d}".encode() for i in range(n)]
    met = []
    ceilings = tiles._ceilings

    def counted(*args, **kwargs):
        bound = ceilings(*args, **kwargs)
        met.append(bound.size)
        return bound

    monkeypatch.setattr(tiles, "_ceilings", counted)
    monkeypatch.setattr(tiles, "LEAF", 8)
    probe = np.array([asks(i) for i in range(n)])
    side = tiles.Side(np.zeros(n, int), keys, probe, fields, np.arange(n), np.array([i % 5 != 0 for i in range(n)]), np.arange(n), np.arange(n))
    (way,) = tiles.best_pairs(side, side, weights, 60, best, True, False)
    row, partner, score, _ = way.held
    got = {(side.key[i], side.key[j], round(s, 6)) for i, j, s in zip(row, partner, score)}
    want = set()
    for i in range(n):
        if not asks(i):
            continue
        found = []
        for j in range(n):
            if i != j and j % 5:
                total = sum(w * M.ratio_values([f[i]], [f[j]])[0] for w, f in zip(weights, fields) if f[i] is not None and f[j] is not None)
                found += [(-round(total, 6), j)] if total >= 60 else []
        want |= {(keys[i], keys[j], -s) for s, j in sorted(found)[:best]}
    assert len(want) > 20 and got == want
    few = int(probe.sum())
    assert sum(met) <= (few + 8) * (n + 8) - few * few / 2 + 8 * n


def test_equal_strings_are_not_compared_by_letter(monkeypatch):
    compared = []
    monkeypatch.setattr(M, "_lcs_short", lambda a, b: compared.extend(zip(a, b)) or np.array([slow_lcs(x, y) for x, y in zip(a, b)]))
    left, right = ["nordo", "", "bau", "x" * 70, "a\0b"], ["nordo", "", "baum", "x" * 70, "a\0b"]
    assert M.ratio_values(left, right).tolist() == [100, 100, 86, 100, 100] and compared == [("bau", "baum")]

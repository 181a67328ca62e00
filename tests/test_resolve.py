"""Duplicate search against a brute-force rendering of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from kontor.operators import resolve as R
from kontor.session import checkpoint_cut
from test_functions import slow_lcs

SCHEMA = "id long, company_name string, city string, address string, phone string, website string, is_active boolean"


def py_ratio(a, b):
    if a == b:
        return 100
    total = len(a) + len(b)
    return round(100 * (2 * slow_lcs(a, b) / total))


def py_tokens(s):
    import re

    s = "".join(ch for ch in s.lower() if not 128 <= ord(ch) <= 255)
    return " ".join(sorted(re.sub(r"\W", " ", s).lower().split()))


def py_overall(x, y):
    n = py_ratio(py_tokens(x[1]), py_tokens(y[1]))
    a = py_ratio(py_tokens(x[3]), py_tokens(y[3])) if x[3] and y[3] else 0
    px, py = ("".join(ch for ch in (v or "") if ch.isdigit()) for v in (x[4], y[4]))
    p = py_ratio(px, py) if px and py else 0
    w = py_ratio(x[5].lower(), y[5].lower()) if x[5] and y[5] else 0
    return 0.4 * n + 0.2 * a + 0.2 * p + 0.2 * w


def brute(rows, k, threshold=80):
    out = set()
    for x in rows:
        if not x[6]:
            continue
        found = [(-py_overall(x, y), y[0]) for y in rows if y[0] != x[0] and y[6] and y[2] == x[2]]
        found = sorted(f for f in found if -f[0] >= threshold)[:k]
        out |= {(x[0], cand, i + 1, round(-s, 6)) for i, (s, cand) in enumerate(found)}
    return out


def make_rows(n=220, seed=5):
    """Skewed data: one city holds most rows and one record has many copies."""
    rng = random.Random(seed)
    words = ["Alpha", "Beta", "Müller", "Technik", "Systeme", "Bau", "IT", "Haus"]
    rows = []
    for i in range(n):
        if i % 3 == 0:  # copies of one record
            base = ("Kopie Technik GmbH", "Stuttgart", "Hauptstr. 1, 70173 Stuttgart", "+49 711 123456", "https://www.kopie.de")
        else:
            g = rng.randint(0, 25)
            name = f"{words[g % 8]} {words[(g * 3) % 8]} {g}"
            base = (name, "Stuttgart" if g % 4 else None, f"Weg {g}, 7017{g % 4} Stuttgart", f"+49 711 55{g:03d}1", f"https://www.{name.split()[0].lower()}{g}.de")
        name, city, addr, phone, web = base
        if rng.random() < 0.3:
            name = name.upper() + rng.choice(["", " AG", "x"])
        if rng.random() < 0.2:
            addr = rng.choice([None, "", addr + "a", "Platz 9"])
        if rng.random() < 0.2:
            phone = rng.choice([None, "keine", phone[:-1] + "9"])
        if rng.random() < 0.2:
            web = rng.choice([None, web + "/x", "http" + web[5:]])
        if i % 50 == 7:
            name, addr = name + " " + "sehr lang " * 12, (addr or "") + " Hinterhaus" * 8
        rows.append((i, name, city, addr, phone, web, i % 17 != 0))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile_rows", [7, 20_000])
def test_find_equals_brute_force(spark, tile_rows):
    rows = make_rows()
    hits = R.find_duplicates(spark.createDataFrame(rows, SCHEMA), k=5, tile_rows=tile_rows)
    got = {(r.id, r.cand_id, r["rank"], round(r.overall, 6)) for r in hits.collect()}
    want = brute(rows, 5)
    assert len(want) > 300
    assert got == want


def missing_rows(n=160, seed=11):
    """Copies that differ in one field or lack one; long values that still round to 100."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = rng.randrange(9)
        long = g % 3 == 0
        name = f"Firma {g} " + (" ".join(f"wort{j}" for j in range(30)) if long else "Bau")
        addr = f"Weg {g} " + (" ".join(f"ort{j}" for j in range(30)) if long else "Ulm")
        phone = "0711" + (f"{g}" * (120 if long else 6))
        web = f"https://www.f{g}.de/" + ("pfad/" * 30 if long else "")
        fields = [name, addr, phone, web]
        edit = rng.randrange(8)
        if edit < 4:
            fields[edit] += "7"
        if edit == 5:
            fields[rng.randrange(4)] = fields[2][:-2] + "89"
        gone = rng.randrange(6)
        if 1 <= gone <= 3:
            fields[gone] = rng.choice([None, ""])
        if gone == 4:
            fields[1] = fields[2] = None
        rows.append((i, fields[0], "Ulm", fields[1], fields[2], fields[3], True))
    return rows


def test_missing_fields_and_long_values_equal_brute_force(spark):
    rows = missing_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    for threshold in (80, 79, 90):
        got = {(r.id, r.cand_id, r["rank"], round(r.overall, 6)) for r in R.find_duplicates(df, k=40, threshold=threshold).collect()}
        want = brute(rows, 40, threshold)
        assert len(want) > 100 and got == want, threshold
    some = [r for r in rows if r[0] % 4 == 0]
    got = {(r.id, r.cand_id, r["rank"]) for r in R.find_duplicates(spark.createDataFrame(some, SCHEMA), df, k=40).collect()}
    assert got == {(a, b, c) for a, b, c, _ in brute(rows, 40) if a % 4 == 0}


def test_profiles_with_a_missing_field_grow_with_the_rows(spark):
    """One city; each profile without a field meets a few others, not the city."""
    made = []
    for n in (5_000, 20_000):
        keys = spark.range(n).selectExpr(
            "'b' AS block", "unhex(md5(string(id))) AS pkey", "true AS probe", "concat('firma ', id div 4) AS name_key",
            "CASE WHEN id % 4 <> 1 THEN concat('weg ', id div 4) END AS address_key", "CASE WHEN id % 4 <> 2 THEN string(id div 4) END AS phone_key",
            "CASE WHEN id % 4 <> 3 THEN concat('w', id div 4, '.de') END AS website_key",
        )
        made.append(R.near_equal_pairs(keys).count())
    assert made == [3 * 5_000 // 4, 3 * 20_000 // 4]


def test_lower_threshold_is_exact_too(spark):
    rows = make_rows(90, seed=9)
    hits = R.find_duplicates(spark.createDataFrame(rows, SCHEMA), k=3, threshold=60)
    got = {(r.id, r.cand_id, r["rank"], round(r.overall, 6)) for r in hits.collect()}
    assert got == brute(rows, 3, 60)


def test_earlier_only(spark):
    rows = make_rows(120, seed=2)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.id, r.cand_id, r["rank"]) for r in R.find_duplicates(df, k=2, earlier_only=True).collect()}
    want = set()
    for x in rows:
        if x[6]:
            found = sorted((-py_overall(x, y), y[0]) for y in rows if y[0] < x[0] and y[6] and y[2] == x[2])
            want |= {(x[0], c, i + 1) for i, (s, c) in enumerate([f for f in found if -f[0] >= 80][:2])}
    assert got == want


def test_different_cities_never_match(spark):
    rows = [(1, "A GmbH", "Ulm", "Weg 1", "0711 1", "x.de", True), (2, "A GmbH", "Bonn", "Weg 1", "0711 1", "x.de", True)]
    assert R.find_duplicates(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_scan_keeps_scan_order_and_skips_known_pairs(spark):
    rows = make_rows(60, seed=4)
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = {(r.company_a_id, r.company_b_id) for r in R.scan(df).collect()}
    hits = brute(rows, 5)
    directed = {(a, b) for a, b, *_ in hits}
    want = {(min(a, b), max(a, b)) if (min(a, b), max(a, b)) in directed else (max(a, b), min(a, b)) for a, b in directed}
    assert pairs == want
    known = spark.createDataFrame([(b, a) for a, b in list(pairs)[:10]], "company_a_id long, company_b_id long")
    assert R.scan(df, known).count() == len(pairs) - 10


def test_merge_fills_only_empty_fields_and_concatenates_sources(spark):
    companies = spark.createDataFrame(
        [(1, "A", "", "p1", ["d"], True), (2, "A", "m2", "p2", [], True), (3, "A", "m3", None, ["x"], True)],
        "id long, company_name string, email string, phone string, directors array<string>, is_active boolean",
    )
    merges = spark.createDataFrame([(1, 3), (1, 2)], "primary_id long, duplicate_id long")
    sources = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 0, "c")], "company_id long, ordinal long, name string")
    merged, provenance = R.merge_companies(companies, merges, sources)
    rows = {r.id: r for r in merged.collect()}
    assert (rows[1].email, rows[1].phone, rows[1].directors) == ("m2", "p1", ["d"])
    assert rows[1].is_active and not rows[1].is_duplicate
    assert not rows[2].is_active and rows[3].is_duplicate and rows[3].duplicate_of_id == 1
    ordered = provenance.filter("company_id = 1").orderBy(F.col("origin_id").asc_nulls_first(), "ordinal")
    assert [r.name for r in ordered.collect()] == ["a", "b", "c"]


def test_roots_of_a_long_chain_and_a_cycle(spark):
    chain = spark.createDataFrame([(0, None)] + [(i, i - 1) for i in range(1, 40)], "id long, parent long")
    assert {r.root for r in R.resolve_roots(chain).collect()} == {0}
    # a cycle beside a tree
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (10, None), (11, 10), (12, 11)], "id long, parent long")
    with pytest.raises(ValueError):
        R.resolve_roots(loop).count()


def test_review_guards(spark):
    cand = spark.createDataFrame(
        [(i, "pending", None, None, "alt") for i in range(1, 7)], "id long, status string, reviewed_by string, reviewed_at timestamp, notes string"
    )
    comp = spark.createDataFrame(
        [(1, True, False), (2, True, False), (3, False, False), (4, True, True)], "id long, is_active boolean, is_duplicate boolean"
    )
    dec = spark.createDataFrame(
        [
            (1, "merge", 1, 2, "u", "gleich", 1),
            (2, "merge", 1, 1, "u", None, 1),
            (3, "merge", 3, 2, "u", None, 1),
            (4, "merge", 1, 4, "u", None, 1),
            (5, "merge", 1, 2, "u", None, 1),
            (5, "reject", None, None, "v", None, 2),
            (9, "reject", None, None, "u", None, 1),
        ],
        "candidate_id long, action string, primary_id long, duplicate_id long, reviewer string, reason string, seq int",
    ).withColumn("decided_at", F.lit("2024-01-01").cast("timestamp"))
    updated, merges, errors = R.apply_reviews(cand, comp, dec)
    state = {r.id: (r.status, r.notes) for r in updated.collect()}
    assert state[1] == ("confirmed", "gleich") and state[5] == ("rejected", None) and state[6] == ("pending", "alt")
    assert {(r.candidate_id, r.error) for r in errors.collect()} == {
        (2, "self merge"), (3, "primary inactive"), (4, "already duplicate"), (5, "already duplicate"), (9, "candidate not found"),
    }
    assert [(r.primary_id, r.duplicate_id) for r in merges.collect()] == [(1, 2)]


def fold_reviews(cand, comp, dec):
    """The rules, one decision after the other."""
    cand, active, dup = {c[0]: list(c[1:]) for c in cand}, {c[0]: c[1] for c in comp}, {c[0]: bool(c[2]) for c in comp}
    merges, errors = [], []
    for c, action, p, d, who, why, seq in sorted(dec, key=lambda x: (x[6], x[0], x[2], x[3])):
        if c not in cand:
            error = "candidate not found"
        elif action == "reject":
            cand[c] = ["rejected", who, why]
            continue
        elif p not in active or d not in active:
            error = "company not found"
        elif p == d:
            error = "self merge"
        elif not active[p]:
            error = "primary inactive"
        elif dup[d]:
            error = "already duplicate"
        else:
            active[d], dup[d] = False, True
            merges.append((c, p, d, seq))
            cand[c] = ["confirmed", who, why or cand[c][2]]
            continue
        errors.append((c, action, p, d, seq, error))
    return {(k, *v) for k, v in cand.items()}, sorted(merges), sorted(errors)


@pytest.mark.parametrize("seed, n, ids, hot", [(1, 400, 60, 0.0), (2, 500, 40, 0.4), (3, 300, 300, 0.0), (4, 200, 8, 0.3)])
def test_reviews_equal_a_sequential_fold(spark, seed, n, ids, hot):
    rng = random.Random(seed)
    cand = [(i, "pending", None, None, rng.choice([None, "alt"])) for i in range(50)]
    comp = [(i, rng.random() < 0.9, rng.choice([True, False, None]) if rng.random() < 0.15 else False) for i in range(ids)]

    def company():
        return 0 if rng.random() < hot else rng.randrange(ids + 2)

    dec = [(rng.randrange(53), rng.choice(["merge"] * 4 + ["reject"]), company(), company(), f"u{i % 3}", rng.choice([None, "", f"r{i}"]), i) for i in range(n)]
    dec += [(1, "merge", 3, 4, "u", "same", 50_000)] * 3  # repeated rows
    # a chain in which every merge waits for the one before it
    dec += [(i % 50, "merge", i % ids, (i + 1) % ids, "k", None, 10_000 + i) for i in range(25)]
    rng.shuffle(dec)
    want = fold_reviews([(c[0], c[1], c[2], c[4]) for c in cand], comp, dec)
    updated, merges, errors = R.apply_reviews(
        spark.createDataFrame(cand, "id long, status string, reviewed_by string, reviewed_at timestamp, notes string"),
        spark.createDataFrame(comp, "id long, is_active boolean, is_duplicate boolean"),
        spark.createDataFrame(dec, "candidate_id long, action string, primary_id long, duplicate_id long, reviewer string, reason string, seq long")
        .withColumn("decided_at", F.lit("2024-01-01").cast("timestamp")).repartition(6),
    )
    assert {(r.id, r.status, r.reviewed_by, r.notes) for r in updated.collect()} == want[0]
    rows = merges.collect()
    assert sorted(map(tuple, rows)) == want[1] and len({r.duplicate_id for r in rows}) == len(rows)
    assert sorted(map(tuple, errors.collect())) == want[2]


def test_no_reviews(spark):
    empty = spark.createDataFrame([], "candidate_id long, action string, primary_id long, duplicate_id long, reviewer string, reason string, seq long, decided_at timestamp")
    cand = spark.createDataFrame([(1, "pending", None, None, "n")], "id long, status string, reviewed_by string, reviewed_at timestamp, notes string")
    updated, merges, errors = R.apply_reviews(cand, spark.createDataFrame([(1, True, False)], "id long, is_active boolean, is_duplicate boolean"), empty)
    assert [tuple(r) for r in updated.collect()] == [(1, "pending", None, None, "n")] and merges.count() == errors.count() == 0


@pytest.mark.parametrize("tile_rows", [5, 20_000])
def test_probe_against_base(spark, tile_rows):
    rows = make_rows(150, seed=11)
    df = spark.createDataFrame(rows, SCHEMA)
    probe = df.filter("is_active AND id % 4 = 0")
    hits = R.find_duplicates(probe, df, k=4, tile_rows=tile_rows)
    got = {(r.id, r.cand_id, r["rank"], round(r.overall, 6)) for r in hits.collect()}
    assert got == {h for h in brute(rows, 4) if h[0] % 4 == 0}


def test_merge_names_a_duplicate_once(spark):
    companies = spark.createDataFrame(
        [(1, "a@x.de", True), (2, None, True), (3, "c@x.de", True)], "id long, email string, is_active boolean"
    )
    merges = spark.createDataFrame([(2, 3, 2), (1, 3, 5), (2, 3, 9)], "primary_id long, duplicate_id long, seq long")
    sources = spark.createDataFrame([(3, 0, "s")], "company_id long, ordinal long, name string")
    merged, provenance = R.merge_companies(companies, merges, sources)
    got = {r.id: (r.email, r.is_active, r.duplicate_of_id) for r in merged.collect()}
    assert merged.count() == 3 and got == {1: ("a@x.de", True, None), 2: ("c@x.de", True, None), 3: ("c@x.de", False, 2)}
    assert sorted((r.company_id, r.origin_id) for r in provenance.fillna(0).collect()) == [(2, 3), (3, 0)]


@pytest.mark.parametrize("tile_rows", [50, 20_000])
def test_links_of_alike_profiles_grow_with_the_rows(spark, tile_rows):
    """All profiles of a city are alike; each keeps its best partners and not all of them."""
    n = 240
    rows = [(i, f"Nordo Technik {i * 37 % 911} GmbH", "Ulm", f"Weg {i % 9}, 89073 Ulm", f"0731 55{i * 7 % 13:03d}", f"https://www.nordo{i * 37 % 911}.de", True) for i in range(n)]
    keyed = R.comparison_keys(spark.createDataFrame(rows, SCHEMA)).selectExpr(
        "'Ulm' AS block", "unhex(md5(string(id))) AS pkey", "true AS probe", "id AS least", "true AS offers", "id AS first", "id AS last", *[f"{f}_key" for f in R.FIELDS]
    )
    assert R.profile_pairs(keyed, 80, 6, tile_rows).count() == 6 * n
    got = {(r.id, r.cand_id, r["rank"], round(r.overall, 6)) for r in R.find_duplicates(spark.createDataFrame(rows, SCHEMA), k=5, tile_rows=tile_rows).collect()}
    assert got == brute(rows, 5)


def test_settled_merges_are_not_written_again(spark, monkeypatch):
    """A long chain of merges doesn't make every round write the merges of the rounds before."""
    written = []

    def counted(df):
        out = checkpoint_cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(R, "checkpoint_cut", counted)
    alone, chain = 400, 6
    rows = [(10_000 + i, 20_000 + i, i) for i in range(alone)] + [(i, i + 1, alone + i) for i in range(chain)]
    merges = spark.createDataFrame(rows, "primary_id long, duplicate_id long, at long")
    gone = {(r["company"], r["done"]) for r in R.settle_merges(merges).collect()}
    assert gone == {(d, at) for _, d, at in rows[:alone]} | {(i + 1, alone + i) for i in range(0, chain, 2)}
    assert sum(written) <= 2 * alone + chain * chain

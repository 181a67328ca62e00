"""Operators against brute force on small tables, with nulls, empty tables, ties, repeats and clashing columns."""

import hashlib
import os
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kontor.llm import decontaminate, dom, graph, licenses, lines, mixing, pii, quality, separators, simhash, substring, wrapper
from kontor.session import checkpoint_cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, code long"


def words(text):
    return WORD.findall(text or "")


def make(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(rng.choices(vocabulary, k=rng.randint(1, 25))) for _ in range(rng.randint(1, 6)))
        if i % 5 == 4 and rows:
            text = rows[rng.randrange(len(rows))][1] or ""
            parts = text.split(" ")
            parts[rng.randrange(len(parts))] = rng.choice(vocabulary)
            text = " ".join(parts)
        rows.append((i * 3, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None])))
    rows += [(500, None, "en", "a"), (501, "", "en", "a"), (502, " \t\n ", None, None), (None, rows[0][1], "en", "a"), (503, "x", "en", "c")]
    rows += [rows[3], (504, "the same words " * 400, "en", "b")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 2, 3) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def slow_fingerprint(text):
    found = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not found:
        return 0
    grams = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [" ".join(found)]
    codes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def test_simhash(docs, rows, empty):
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    codes = [slow_fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= 3:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)].append(r[0])
    assert got == sorted((r[0] or (0 if r[0] == 0 else -1), f"{codes[i]:016x}", min(least[root(i)])) for i, r in enumerate(rows)) or got == sorted(
        (r[0] or -1, f"{codes[i]:016x}", min(least[root(i)])) for i, r in enumerate(rows)
    )
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("limit", [0, 1, 2, 3])
def test_trie_join_finds_all_links(spark, limit):
    rng = random.Random(limit)
    codes = {rng.getrandbits(64) for _ in range(40)}
    for c in list(codes):
        for _ in range(6):
            c ^= 1 << rng.randrange(64)
            codes.add(c)
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "code long")
    found = graph.components(simhash.links(df, len(codes), limit))
    roots = {r.node: r.root for r in found.collect()}
    parent = {c: c for c in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(codes):
        for j in range(i):
            if bin(a ^ codes[j]).count("1") <= limit:
                x, y = root(signed[i]), root(signed[j])
                parent[max(x, y)] = min(x, y)
    assert {c: roots.get(c, c) for c in signed} == {c: root(c) for c in signed}


def test_trie_join_keeps_visitors_of_several_nodes_apart(spark):
    # node 3 has visitors from nodes 1 and 2; their lower bits are not in one order
    low = [5, 1 << 39, 1 << 38, (1 << 39) | 7]
    codes = [(3 << 40) | low[0], (3 << 40) | low[1], (1 << 40) | low[1], (1 << 40) | low[3], (2 << 40) | low[0], (2 << 40) | low[2]]
    pairs = {(a, b) for a in codes for b in codes if a < b and bin(a ^ b).count("1") <= 3}
    home = [(c >> 40, c, True) for c in codes]
    away = [((c >> 40) | (1 << i), c, False) for c in codes for i in range(24) if not c >> 40 & (1 << i)]
    node, code, at_home = (np.array(x) for x in zip(*home, *away))
    a, b = simhash.trie_join(node.astype(np.int64), code.astype(np.uint64), at_home)
    found = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    assert found <= pairs
    assert found == {p for p in pairs if bin((p[0] ^ p[1]) >> 32).count("1") <= 1}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(5, 5), (160, 159)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 60)}}


def slow_spans(rows, width):
    least = {}
    for doc_id, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - width + 1):
            if doc_id is not None:
                key = tuple(w[i : i + width])
                least[key] = min(least.get(key, doc_id), doc_id)
    out = []
    for doc_id, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if doc_id is not None and least[tuple(w[i : i + width])] < doc_id:
                gone[i : i + width] = [True] * width
        out.append((doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("width,minimizer", [(13, 7), (4, 2)])
def test_repeated_spans(docs, rows, empty, width, minimizer):
    got = substring.repeated_spans(docs, width=width, minimizer=minimizer).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == slow_spans(rows, width)
    text = {r[0]: words(r[1]) for r in rows}
    for r in got:
        for s in r.spans:  # source coordinates hold the same words
            assert s.source_id < r.doc_id
            assert text[r.doc_id][s.start : s.start + s.n_words] == text[s.source_id][s.source_start : s.source_start + s.n_words]
    assert substring.repeated_spans(empty).count() == 0


def slow_lines(rows, t=0.8):
    found = sorted((r[0], i, frozenset(words(x.lower()))) for r in {r[:2] for r in rows} if r[0] is not None and r[1] for i, x in enumerate(r[1].split("\n")))
    found = [f for f in found if f[2]]
    return {(d, i) for k, (d, i, s) in enumerate(found) if any(5 * len(s & u) >= 4 * len(s | u) for _, _, u in found[:k])}


def test_similar_lines(docs, rows, empty):
    got = {(r.doc_id, r.line_no) for r in lines.similar_lines(docs).collect()}
    assert got == slow_lines(rows)
    out = {(r.doc_id, r.text) for r in lines.dedup_lines(docs).collect()}
    assert out == {
        (d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in got)) for d, t, *_ in rows
    }
    clash = docs.withColumns({c: F.lit(7) for c in ("_gone", "_gone_id", "least", "place")})
    assert lines.dedup_lines(clash).columns == clash.columns and {(r.doc_id, r.text) for r in lines.dedup_lines(clash).collect()} == out
    assert lines.dedup_lines(docs).columns == docs.columns and lines.dedup_lines(docs).count() == len(rows)
    assert lines.similar_lines(empty).count() == 0 and lines.report(docs).count() == len(rows)


def test_similar_lines_settles_groups_of_variants(spark):
    rng = random.Random(1)
    base = [f"t{i}" for i in range(30)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(30)] = f"z{rng.randrange(40)}"
        rows.append((i, " ".join(w), None, None))
    assert {(r.doc_id, r.line_no) for r in lines.similar_lines(frame(spark, rows)).collect()} == slow_lines(rows)


def test_similar_lines_of_any_length(spark):
    # sizes on both sides of LONG, pairs just above and just below the threshold, copies with another order of words
    rng = random.Random(2)
    rows = []
    for i in range(120):
        w = [f"l{i}w{k}" for k in range(rng.choice((4, 5, 9, 40, 80, 90, 95, 96, 100, 110, 260)))]
        for j in range(3):
            v = list(w)
            for k in rng.sample(range(len(v)), round(len(v) * rng.choice((0, 0.1, 0.11, 0.12)))):
                v[k] = rng.choice((f"x{rng.randrange(10**6)}", w[0]))
            rng.shuffle(v)
            rows.append((rng.randrange(10**9), f"\x0b{' '.join(v)}\t\n \r\n{v[0].upper()}\x0c{v[1]}", None, None))
    assert {(r.doc_id, r.line_no) for r in lines.similar_lines(frame(spark, rows)).collect()} == slow_lines(rows)


def test_written_tables_leave_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before = files()
    kept = checkpoint_cut(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count().repartition(3, "count"))
    ends = time.time() + 5  # Spark removes them in the background
    while files() - before and time.time() < ends:
        time.sleep(0.1)
    assert not files() - before
    assert kept.count() == 100


def test_quality_stats(docs, rows, empty):
    got = sorted(tuple(r)[:8] for r in quality.quality(docs).where("doc_id is not null").collect())
    expected = []
    for d, t, *_ in rows:
        if d is None:
            continue
        w = words(t)
        ls = [x for x in (t or "").split("\n") if words(x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        expected.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), len(covered), failed))
    expected.sort()
    assert [g[:7] for g in got] == expected
    assert all(not g[7] for g in got if g[6])
    assert quality.quality(empty).count() == 0


def test_quality_outliers(spark):
    rng = random.Random(3)
    plain = [(i, " ".join("x" * rng.randint(2, 9) + str(rng.randrange(10**6)) for _ in range(rng.randint(20, 400))), "en", "s") for i in range(200)]
    junk = [(1000 + i, " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}###" for _ in range(100)), "en", "s") for i in range(30)]
    kept = {r.doc_id for r in quality.quality(frame(spark, plain + junk)).where("kept").collect()}
    assert kept == {r[0] for r in plain}


def test_quality_outliers_in_a_tight_group(spark):
    rng = random.Random(4)
    word = lambda n=5: "".join(rng.choices("abcdefghijklmnopqrst", k=n))
    plain = [(i, " ".join(word(rng.randint(3, 7)) for _ in range(rng.randint(90, 110))), "en", "s") for i in range(300)]
    odd = [
        (1000, " ".join(word() for _ in range(1200)), "en", "s"),  # length
        (1001, " ".join(word(9) for _ in range(100)), "en", "s"),  # word
        (1002, " ".join(word() + "#" * (i % 20 == 0) for i in range(100)), "en", "s"),  # symbols
        (1003, "\n".join(["ab cd"] * 7 + [word()] * 1) + " " + " ".join(word() for _ in range(90)), "en", "s"),  # lines
        (1004, " ".join(w for _ in range(50) for w in [word()] * 2), "en", "s"),  # words like the one before
        (1005, " ".join(["ab cd ef gh ij"] * 6 + [word() for _ in range(70)]), "en", "s"),  # repeated windows
    ]
    kept = {r.doc_id for r in quality.quality(frame(spark, plain + odd)).where("kept").collect()}
    assert kept == {r[0] for r in plain}


def test_symbols_class():
    # the class is [#*$%&|<>]: the brackets delimit it
    assert quality.text_stats("a # * $ % & | < > x")[2] == 8
    assert quality.text_stats("[a] # [b]")[2] == 1


@pytest.mark.parametrize("share", [0.1, 0.2, 0.3, 0.4])
def test_junk_of_a_source_is_not_its_norm(spark, share):
    rng = random.Random(11)
    voc = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(300)]
    good = lambda: " ".join(rng.choices(voc, k=rng.randint(60, 140))) + "."
    junk = lambda: " ".join(rng.choices(["#$%&", "<<>>", "||||", "ab"], k=rng.randint(60, 140)))
    bad = int(300 * share)
    rows = [(i, junk() if i < bad else good(), "en", "hot") for i in range(300)] + [(1000 + i, good(), "en", "other") for i in range(100)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept == (r.doc_id >= bad) for r in got if not r.base_failed)


def test_mix(docs, rows, empty):
    got = mixing.mix(docs, block_words=4).collect()
    assert len(got) == len(rows)
    total = sum(len(words(r[1])) for r in rows)
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
    for r, s in ((r, r.source_size) for r in got):
        by[(s, r.target)][0] += r.taken
        by[(s, r.target)][2] = r.target
    assert abs(sum(v[2] for v in by.values()) - 1.5 * total) < 1e-6 * total
    for (size, target), (taken, _, _) in by.items():
        assert abs(taken - target) <= 0.5 and target <= 2 * size
    again = mixing.mix(docs.repartition(7), block_words=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(empty).count() == 0
    taken_once = {r.first_slot for r in got if r.size and r.taken}
    assert None not in taken_once


def test_every_prefix_of_the_schedule_is_near_its_shares(spark):
    need = {1: 64 * 700, 2: 64 * 40 - 5, 3: 0, 4: 64 * 333 + 1, 5: 1}
    got = mixing.slots(spark.createDataFrame(list(need.items()), "n int, words long")).orderBy("slot").collect()
    blocks = {n: -(-w // 64) for n, w in need.items()}
    total = sum(blocks.values())
    assert sorted((r.n, r.rank) for r in got) == sorted((n, k) for n, b in blocks.items() for k in range(b)) and len({(r.slot, r.n) for r in got}) == total
    # by brute force: radical inverses in cumulative shares, with a bound on the discrepancy of the sequence
    edges, low = [], 0
    for n, b in sorted(blocks.items()):
        edges.append((n, low / total, (low + b) / total))
        low += b
    seen, dealt, bound = defaultdict(int), [], 2 * np.log2(total) + 2
    for slot in range(total):
        u = int(f"{slot:048b}"[::-1], 2) / 2**48
        n = next(n for n, a, z in edges if a <= u < z)
        if seen[n] < blocks[n]:
            dealt.append((n, seen[n], slot))
        seen[n] += 1
        assert all(abs(seen[k] - (slot + 1) * blocks[k] / total) <= bound for k in blocks)
    assert [tuple(r) for r in got if r.slot < total] == dealt and total - len(dealt) <= len(need) * bound
    assert all(r.slot == total + r.rank for r in got if r.slot >= total)


def test_mix_places_documents_by_the_schedule(docs):
    got = mixing.mix(docs, block_words=4).where("first_slot is not null").collect()
    first = sorted({(r.first_slot, r.target) for r in got})
    # sources take turns: no source has its places all before another's
    by = defaultdict(list)
    for slot, target in first:
        by[target].append(slot)
    long = [x for x in by.values() if len(x) > 3]
    assert len(long) > 1 and all(min(a) < max(b) for a in long for b in long)


def test_targets(spark):
    df = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 500), ("z", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got["c"] == 20 and got["z"] == 0 and abs(sum(got.values()) - 1.5 * 1610) < 1e-9
    assert got["a"] == 200 and got[None] == 1000 and abs(got["b"] - (2415 - 1220)) < 1e-9


def test_decontamination(spark, empty):
    rng = random.Random(5)
    voc = [f"tok{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    item = "Anna bought 12 apples for Peter and then walked 3 km to see the old mill with Peter before noon today"
    items = [(1, item), (2, " ".join(rng.choices(voc, k=30))), (3, "one two three four five six seven"), (4, None), (None, item), (5, "ab cd")]
    filler = lambda k: " ".join(rng.choices(voc, k=k))
    changed = item.replace("Anna", "Carla").replace("12", "480").replace("Peter", "Ulrich").replace("3 km", "9 miles")
    broken = changed.replace("see the old mill with Ulrich", "see the old mill with Marta")
    rows = [
        (10, filler(40) + " " + item + " " + filler(40)), (11, filler(9) + " and " + changed + " " + filler(30)), (12, filler(5) + " and " + broken),
        (13, filler(200)), (14, filler(8) + " " + items[1][1].upper() + " " + filler(3)), (15, None), (16, "x ONE two, three four five six seven. y"), (None, item), (17, "ab cd ef"),
    ]
    docs = frame(spark, [(*r, "en", "s") for r in rows + rows[:1]])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.renamed for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(10, 1): False, (11, 1): True, (14, 2): False, (16, 3): False}
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_names_that_open_and_units_that_are_attached(spark):
    items = [
        (1, "Anna has 12 apples. Peter has 5 pears. How many fruits have Anna and Peter together?"),
        (2, "Maria walked 5kg of flour home on the 3rd of the month to her mother"),
        (3, "Karl is older than Otto today"),
    ]
    rows = [
        (10, "Carla has 40 apples. Ulrich has 7 pears. How many fruits have Carla and Ulrich together?"),
        (11, "Words go here. Carla has 40 apples. Ulrich has 7 pears. How many fruits have Carla and Marta together?"),
        (12, "Intro words. Lena walked 60 kg of flour home on the 21st of the month to her mother and on."),
        (13, "Emil is older than Hugo today"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.renamed for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(10, 1): True, (12, 2): True, (13, 3): True}


def test_decontamination_of_runs_accents_and_short_items(spark):
    tail = "rode the tram across the old town and then sat by the river with a book until dusk"
    items = [(1, f"On Monday Rome and Emile {tail}"), (2, f"He saw twenty geese when Anna {tail}"), (3, "Yes, of course"), (4, f"There Anna and Peter {tail} of Peter")]
    rows = [
        (10, f"On Monday Berlin and Oskar {tail}"), (11, f"On Monday New York and Émile {tail}"), (12, f"On Monday New York and Ångström van {tail}"),
        (13, f"He saw twenty five geese when Élodie {tail}"), (14, f"He saw eighty geese when Jean-Luc Picard {tail}"),
        (15, f"There Carla and Carla {tail} of Carla"), (16, f"There Carla and Otto {tail} of Otto"), (17, "Well. YES of course! And on."), (18, "Well yes, of course. And on."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.first_token for r in decontaminate.contaminated(docs, bench).collect()}
    # all four have the tail in common, so only the windows that hold the names tell
    assert {d for (d, i), first in got.items() if i == 1 and first == 0} == {10, 11}
    assert {d for (d, i), first in got.items() if i == 2 and first == 0} == {13, 14}
    assert {d for (d, i), first in got.items() if i == 4 and first == 0} == {16}
    assert {d for d, i in got if i == 3} == {17}


def test_pseudonyms(spark):
    texts = [
        "Call +1 (017) 555-7713 or und.34@mail7.example.com now, 4785380592391139$$$ and 4785-3805-9239-1139!",
        "ip 152.143.123.131### date 2021-03-04, 04.03.2021 03/04/2021 and 1234567890123 bad 2021-13-40 999.1.1.1 v1.2.3.4.5",
        "iban DE89 3704 0044 0532 0130 00 ssn 123-45-6789", None, "", "no values", "+49 711 123456 und.34@mail7.example.com é 4785380592391139",
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, _found string")
    new = pii.pseudonymise(df).orderBy("doc_id").collect()
    back = pii.pseudonymise(pii.pseudonymise(df), forward=False).orderBy("doc_id").collect()
    assert [r.text for r in back] == [*texts, texts[0]]
    card = re.search(r"\d{16}", new[0].text)[0]
    assert card != "4785380592391139" and card in new[6].text and "-".join(card[i : i + 4] for i in range(0, 16, 4)) in new[0].text
    total = sum(int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(card)))
    assert total % 10 == 0 and new[0].text == new[7].text
    dates = re.findall(r"\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}", new[1].text)
    assert dates[0] == "-".join(reversed(dates[1].split("."))) and dates[0] != "2021-03-04" and "2021-13-40" in new[1].text and "v1.2.3.4.5" in new[1].text
    iban = re.search(r"DE[\d ]+", new[2].text)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != "DE89370400440532013000"
    report = {r.doc_id: r for r in pii.report(df).collect()}
    assert report[0].n_values == 4 and report[5].n_values == 0 and report[3].text is None and report[0].text == new[0].text
    assert pii.report(df.limit(0)).count() == 0
    assert pii.pseudonymise(df, key="other").first().text != new[0].text


def test_only_validated_numbers_and_national_telephone_forms(spark):
    left = ["1700000000123", "9783161484100x", "at 1234567890123456 order", "9807915762804490", "12 0711", "1 000 000"]
    phones = ["0711 123456", "(0711) 123456", "0049 711 123456", "0151/2345678", "+49 711 123456", "(030) 1234-567"]
    texts = [*left, *(f"call {p} now" for p in phones), "4845168114407329"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = pii.pseudonymise(df).orderBy("doc_id").collect()
    back = pii.pseudonymise(pii.pseudonymise(df), forward=False).orderBy("doc_id").collect()
    assert [r.text for r in back] == texts
    assert [r.text for r in new][: len(left)] == left
    for old, r in zip(texts[len(left) :], new[len(left) :]):
        assert r.text != old and re.sub(r"\d", "9", r.text) == re.sub(r"\d", "9", old)
    assert "0049 " in new[len(left) + 2].text and new[len(left)].text.startswith("call 0")


def test_feistel_against_plain_python(spark):
    def feistel(text, key, tweak, alphabet):
        a, b = text[: len(text) // 2], text[len(text) // 2 :]
        for r in range(pii.ROUNDS):
            seed = "|".join([key, tweak, str(len(text)), str(r), b if r % 2 == 0 else a])
            stream = "".join(hashlib.sha512((seed + (f"|{i}" if i else "")).encode()).hexdigest() for i in range(len(text) // 32 + 2))
            turned = a if r % 2 == 0 else b
            turned = "".join(alphabet[(alphabet.index(c) + int(stream[4 * i : 4 * i + 4], 16)) % len(alphabet)] for i, c in enumerate(turned))
            a, b = (turned, b) if r % 2 == 0 else (a, turned)
        return a + b

    rng = random.Random(3)
    texts = ["", "7", "42", *("".join(rng.choices("0123456789", k=k)) for k in (3, 9, 64, 65, 130, 300))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", pii.feistel(F.col("t"), "k", "w", True, pii.DIGITS).alias("n")).collect()
    assert {r.t: r.n for r in got} == {t: feistel(t, "k", "w", "0123456789") for t in texts}
    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("t"))
    assert numbers.select(pii.feistel(F.col("t"), "k", "w", True, pii.DIGITS).alias("n")).distinct().count() == 1000


def test_account_numbers_before_capitals_and_digits(spark):
    def number(country, body):
        digits = "".join(str(int(c, 36)) for c in body + country + "00")
        return f"{country}{98 - int(digits) % 97:02d}{body}"

    def valid(n):
        return int("".join(str(int(c, 36)) for c in n[4:] + n[:4])) % 97 == 1

    numbers = ["AT611904300234573201", "ES9121000418450200051332", "BE68539007547034", "PL61109010140000071219812874", "DE89370400440532013000", number("NO", "86011117947")]
    spaced = lambda n: " ".join(n[i : i + 4] for i in range(0, len(n), 4))
    texts = [f"x {form(n)}{after}" for n in numbers for form in (str, spaced) for after in (" BIC GIBAATWW", " 25", " 2024 EUR", " A1 B2", ", AB", " end")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = [r.text for r in pii.pseudonymise(df).orderBy("doc_id").collect()]
    back = [r.text for r in pii.pseudonymise(pii.pseudonymise(df), forward=False).orderBy("doc_id").collect()]
    assert back == texts
    for i, (a, b) in enumerate(zip(texts, new)):
        n = numbers[i // 12]
        found = b[2 : 2 + len(n if i % 12 < 6 else spaced(n))]
        assert b[2 + len(found) :] == a[2 + len(found) :]
        assert valid(found.replace(" ", "")) and found.replace(" ", "") != n and found[:2] == n[:2]


def test_licences(spark, empty):
    mit = "\n".join(licenses.SENTENCES[i][0] + "." for i in ("mit-title", "mit-grant", "mit-notice", "as-is", "no-liability"))
    wrapped = "// " + re.sub(r"(.{40,60}) ", "\\1\n// ", licenses.SENTENCES["gpl-free"][0] + ".")
    texts = ["words here.\nReleased under the MIT License.\nmore", mit, wrapped, "Licensed under CC BY-NC 4.0.", None, "", "x\nLicensed under the Apache License, Version 2.0.", "licence of nothing"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, _text string")
    got = {r.doc_id: r.licences for r in licenses.scan(df).collect()}
    assert got == {0: ["MIT"], 1: ["MIT"], 2: ["GPL-3.0-or-later"], 3: ["CC-BY-NC-4.0"], 4: [], 5: [], 6: ["Apache-2.0"], 7: []}
    assert all(re.search(licenses.HINT.replace("(?i)", ""), s, re.I) for s in licenses.KNOWN)
    assert licenses.scan(empty).count() == 0


def test_licences_with_names_in_their_sentences_and_notices(spark):
    say = lambda *ids: "\n\n".join(licenses.SENTENCES[i][0].replace(licenses.HOLE, "Example University") + "." for i in ids)
    three = say("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is")
    texts = {
        "Copyright 2020 Example Ltd. All rights reserved.\n\n" + three: ["BSD-3-Clause"], say("bsd-grant", "bsd-source", "bsd-binary"): ["BSD-2-Clause"],
        "words\n© Example Ltd. All rights reserved.": ["All-Rights-Reserved"], "Proprietary and confidential. All rights reserved.": ["Proprietary"],
        say("lgpl-free-21", "lgpl-hope", "lgpl-details"): ["LGPL-2.1-or-later"], say("agpl-free", "gpl-hope", "agpl-details"): ["AGPL-3.0-or-later"],
        "x. " + say("gpl-3-text") + "\nmore words here.\n" + say("gpl-free", "gpl-hope", "gpl-details"): ["GPL-3.0-only"], say("apache-text"): ["Apache-2.0"],
        say("gpl-free", "gpl-hope", "gpl-details") + "\n" + say("mit-grant", "mit-notice"): ["GPL-3.0-or-later", "MIT"], say("epl-ref"): ["EPL-2.0"],
        "Neither the name of the rose nor the names of its petals": [],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_separator_scan(spark, tmp_path):
    rng = random.Random(2)
    expected = []
    for f in range(2):
        tokens = [rng.choice([1, 2, 3, 9, 9]) for _ in range(57 + f)] + ([] if f else [9])
        np.array(tokens, "<u2").tofile(tmp_path / f"part{f}.bin")
        start = 0
        for i, t in enumerate([*tokens, None]):
            if t in (9, None) and not (t is None and start == len(tokens)):
                expected.append((f"part{f}.bin", start, i - start, t == 9))
                start = i + 1
    for size in (1, 4, 1000):
        got = separators.documents(separators.read_files(spark, str(tmp_path), size), 9).collect()
        assert sorted((r.file.rsplit("/", 1)[1], r.start, r.n_tokens, r.closed) for r in got) == sorted(expected)
        assert sorted(r.ordinal for r in got if r.file.endswith("part0.bin")) == list(range(sum(e[0] == "part0.bin" for e in expected)))


def test_token_counts(docs, rows, empty):
    encode = separators.tokenizer(separators.VOCABULARY).encode_ordinary
    got = separators.count_tokens(docs, block_tokens=64).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(r[0]), len(encode(r[1] or ""))) for r in rows)
    assert separators.count_tokens(empty).count() == 0


def test_pages(spark):
    page = (
        '<html><head><title>t</title></head><body><nav><a href="/">home</a></nav><div class="content"><h2>Head {n}</h2>'
        "<p>First &amp; {n}<br>line\n\n two <b>bold</b></p><ul><li>one {n}<li>two {n}</ul></div><div class='box'>Read our daily mail</div>"
        '<aside>side</aside><div class="cookie-notice">we use cookies</div><section id="comments"><p>nice {n}</p></section><footer>&copy; x</footer></body></html>'
    )
    pages = [(n, "http://a.example/%d" % n, page.replace("{n}", str(n))) for n in range(4)]
    pages += [(10, "http://b.example/", "<article><header><h1>T</h1></header><p>a</p><form>f</form><p>b &am"), (11, None, None), (12, "http://c.example", ""), (13, "x", "plain <3 text")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in wrapper.main_text(df).collect()}
    for n in range(4):  # the box is the same on all pages of the host: template
        assert got[n] == f"Head {n}\n\nFirst & {n} line two bold\n\none {n}\n\ntwo {n}"
    assert got[10] == "T\n\na\n\nb &am" and got[11] == "" and got[12] == "" and got[13] == "plain <3 text"
    assert all(r.n_chars == len(r.text) for r in wrapper.main_text(df).collect())
    assert wrapper.main_text(df.limit(0)).count() == 0


def test_pages_of_a_host_with_odd_ones(spark):
    page = "<html><body><div class='content'><h2>Head {n}</h2><p>Text {n}</p></div><div class='box'>Read our daily mail</div></body></html>"
    html = [page.replace("{n}", str(n)) for n in range(8)]
    html[7] = html[7].replace("our daily", "no")
    html += ["", None, "<html><body><h1>Error</h1></body></html>", "<html><body><ul><li>a 1</li><li>b 2</li></ul></body></html>"]
    df = spark.createDataFrame([(n, "http://a.example/", h) for n, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrapper.main_text(df).collect()}
    assert all(got[n] == f"Head {n}\n\nText {n}" for n in range(7))
    assert got[7] == "Head 7\n\nText 7\n\nRead no mail" and got[8] == got[9] == "" and got[10] == "Error" and got[11] == "a 1\n\nb 2"
    # copies of one page are no template of the host
    df = spark.createDataFrame([(n, "http://a.example/", html[0 if n else 1]) for n in range(30)], "page_id long, url string, html string")
    assert {r.text for r in wrapper.main_text(df).where("page_id > 0").collect()} == {"Head 0\n\nText 0"}


def test_pages_in_forms_and_layout_classes(spark):
    story = "<h1>Head</h1><p>First part of the text.</p><p>Second part of the text.</p>"
    want = "Head\n\nFirst part of the text.\n\nSecond part of the text."
    around = "<nav><a href='/'>home</a></nav>{}<div class='sidebar'>side</div><section id='comments'><article class='comment'>nice</article></section><footer>f</footer>"
    html = [
        "<body><form action='x'>" + around.format(f"<div>{story}</div>") + "</form></body>",
        "<body><form>" + around.format(f"<article>{story}</article>") + "</form></body>",
        "<body><div class='content has-sidebar'>" + around.format(story) + "</div></body>",
        "<body><div class='with-sidebar no-comments'>" + around.format(story) + "</div></body>",
        "<body><p>3 May</p><div class='reader'>" + story + "</div></body>",
        "<body>" + around.format(f"<article class='post ad-free'>{story}</article>") + "</body>",
        "<body>" + around.format(f"<article class='post social'>{story}</article>") + "</body>",
        "<body><div class='widget'>" + around.format(f"<main>{story}</main>") + "</div></body>",
        "<body><p>Story.</p><div class='ad'>An advert that is longer than the story</div><form>your name</form></body>",
        "<body><article><p>Story.</p><form>f</form><div class='ad'>A longer advert, one</div></article></body>",
    ]
    df = spark.createDataFrame([(n, f"http://h{n}.example/", h) for n, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrapper.main_text(df).collect()}
    assert [got[n] for n in range(4)] == [want] * 4 and got[4] == "3 May\n\n" + want
    assert [got[n] for n in range(5, 8)] == [want] * 3 and got[8] == got[9] == "Story."


def test_tree_matching_keeps_order():
    a, b = dom.load("r(a b(x y) c)"), dom.load("r(b(y z) a c)")
    assert dom.dump(a) == "r(a b(x y) c)"
    assert dom.align(a, b) == {0: 0, 2: 1, 4: 2, 5: 5}


def test_kept_hash_is_of_the_kept_words(docs):
    r = substring.repeated_spans(docs).select("kept", F.sha2("kept", 256).alias("h")).first()
    assert r.h == hashlib.sha256(r.kept.encode()).hexdigest()

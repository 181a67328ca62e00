"""Misspelled terms, quotation and held-out accuracy."""

import random
import zlib

import pytest

from kontor.llm import automaton, catalog, toxicity

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string, score double, features string, toxic int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def slow_match(word, entries):
    exact = [(0, i) for i, (t, stem) in enumerate(entries) if not stem and t == word]
    stems = [(len(t), i) for i, (t, stem) in enumerate(entries) if stem and word.startswith(t)]
    near = [(distance(word, t), i) for i, (t, stem) in enumerate(entries) if not stem and distance(word, t) <= automaton.edits_allowed(t)]
    if exact:
        return exact[0][1], 0
    if stems:
        return max(stems)[1], 0
    return (min(near)[1], min(near)[0]) if near else None


def test_automaton_equals_distances():
    rng = random.Random(3)
    letters = "abcé"
    for _ in range(12):
        texts = {"".join(rng.choices(letters, k=rng.randint(1, 10))) for _ in range(14)}
        entries = [(t, rng.random() < 0.25) for t in sorted(texts)]
        lexicon = automaton.Lexicon(entries)
        words = ["".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(300)]
        for t, _ in entries:
            for _ in range(12):
                cut = rng.randint(0, len(t))
                words += [t, t[:cut] + rng.choice(letters) + t[cut:], t[:cut] + t[cut + 1 :], t + rng.choice(letters) * 2, t[:cut] + "x" + t[cut + 1 :]]
        for word in words:
            assert lexicon[word] == slow_match(word, entries), (word, entries)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(automaton, "WORDS", 20)
    monkeypatch.setattr(automaton, "STATES", 10)
    lexicon = automaton.Lexicon([("worthless", False), ("pathetic", False), ("scum", True)])
    rng = random.Random(1)
    for _ in range(500):
        word = "".join(rng.choices("abcdehiloprstuw", k=rng.randint(1, 9)))
        assert lexicon[word] == slow_match(word, lexicon.entries)
    assert len(lexicon) <= 22 and lexicon["wortless"] == (0, 1) and lexicon["scummy"] == (2, 0)


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(docs, toxicity.learnable(labels))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0.5, "f", 1) for i, t in rows], SCHEMA)


def scores(spark, model, *texts):
    found = toxicity.score(frame(spark, list(enumerate(texts))), model).collect()
    return [r.score for r in sorted(found, key=lambda r: r.doc_id)]


def test_held_out(spark, model):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out("doc_id")).select("doc_id", "score", "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in found)
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in found) / len(found)
    caught = sum(r.score >= 0.5 for r in found if r.toxic == 1) / sum(r.toxic == 1 for r in found)
    wrong = sum(r.score >= 0.5 for r in found if r.toxic == 0) / sum(r.toxic == 0 for r in found)
    assert right >= 0.97 and caught >= 0.85 and wrong <= 0.02


def test_learns_from_other_rows_only(spark):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(200)] + [(3, 0, "x"), (None, 1, "x"), (7, None, "x")], "doc_id long, toxic int, text string")
    own = toxicity.learnable(labels).collect()
    assert {r.doc_id for r in own} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    assert all(r.toxic == r.doc_id % 2 for r in own)


def test_misspelled_and_quoted(spark, model):
    filler = "ererea thandne onesor the of and ntha tiing"
    terms = ["worthless", "disgusting", "pathetic", "stupid", "trash"]
    wrong = ["wortless", "disgustimg", "pathetci", "stupidd", "trassh"]
    abuse = " ".join(f"{filler} {t}" for t in terms * 2)
    clean, hard, soft, quoted = scores(
        spark, model, " ".join([filler] * 10), abuse, " ".join(f"{filler} {t}" for t in wrong * 2), " ".join(f'{filler} "{t}"' for t in terms * 2)
    )
    assert clean < 0.1 < 0.5 <= soft and hard >= soft and quoted < hard


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (2, ""), (None, "idiot"), (3, " \t\n"), (4, "idiot moron scum " * 60_000)]
    found = toxicity.score(frame(spark, rows), model)
    assert found.columns == ["doc_id", "score", "n_matches"]
    by = {r.doc_id: r for r in found.collect()}
    assert found.count() == 6 and by[1].score == by[2].score < 0.5 <= by[4].score and by[4].n_matches == 180_000
    assert toxicity.score(frame(spark, []), model).count() == 0
    nothing = toxicity.fit(frame(spark, []), toxicity.learnable(frame(spark, [])))
    assert not nothing.entries and [r.score for r in toxicity.score(frame(spark, [(1, "a")]), nothing).collect()] == [0.5]


def test_query(spark):
    found = catalog.QUERIES["op13_toxicity"](spark, "/root/testdata/sf0.001")
    assert dict(found.dtypes).items() >= {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}.items()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = found.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)

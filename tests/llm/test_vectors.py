"""Whitening and product codes against brute force: nulls, ties, repeats, other lengths, empty tables, clashing columns."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kontor.llm import catalog, codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, key string, salt int, row long, n long, id string, vector string, entry int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, "i", "v", 4) for r in rows], SCHEMA).repartition(5)


def make(seed, n=90, dims=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims)).astype(np.float32)
    base[:, 1] += 2 * base[:, 0]
    rows = [(int(i * 3), [float(v) for v in base[i]], int(i % 4) if i % 5 else None) for i in range(n)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(60)]  # one vector holds many rows
    rows += [rows[3], rows[3], (None, rows[5][1], None), (2000, None, 1), (2001, [*rows[0][1][:-1], None], 1)]
    rows += [(2002, [*rows[0][1][:-1], math.nan], 1), (2003, [*rows[0][1][:-1], -math.inf], 2), (2004, [1.0] * 5, 2), (2005, [], 2)]
    return rows


def kept(rows, scale):
    """Rows that can be used, with whole-number vectors."""
    return [(i, [math.floor(scale * np.float64(np.float32(c))) for c in v], w) for i, v, w in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening(spark, weights):
    rows = make(1)
    found = whitening.whiten(frame(spark, rows), weights=weights).collect()
    usable = kept(rows, 256)
    assert sorted(str(r.vec_id) for r in found) == sorted(str(i) for i, _, _ in usable)
    main = [tuple(x) for _, x, _ in usable if len(x) == 16]
    fit = sorted(set(main)) if weights == "one" else sorted(main)
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, total)] for x in fit])
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    by_id = {}
    for i, x, _ in usable:
        by_id.setdefault(i, []).append(x)
    seen = {}
    for r in found:
        x = by_id[r.vec_id][0]
        assert r.n == n and r.identity_error < 1e-9
        if len(x) != 16:
            assert r.whitened is None and r.deviation is None
            continue
        assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(x, total))
        assert np.allclose(r.explained, values[:4] / values.sum(), rtol=1e-9)
        seen[tuple(x)] = r.whitened
    w = np.array([seen[x] for x in fit])
    assert np.allclose(w.T @ w / n, np.eye(4), atol=1e-9)
    axes = np.linalg.lstsq(centred, w, rcond=None)[0] * np.sqrt(values[:4])  # the directions that were used
    assert np.allclose(cov @ axes, axes * values[:4], atol=1e-6 * values[0]) and np.allclose(np.linalg.norm(axes, axis=0), 1)


def test_whitening_edges(spark):
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(frame(spark, [(1, [], 1), (2, None, 1)])).collect()[0].whitened is None
    one = whitening.whiten(frame(spark, [(1, [0.5, 1.0], 1), (2, [0.5, 1.0], 1)])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, [None, None], [None, None], None)] * 2
    two = whitening.whiten(frame(spark, [(1, [0.5, 1.0], 1), (2, [1.5, 1.0], 1)])).orderBy("vec_id").collect()
    assert [abs(r.whitened[0]) for r in two] == [1.0, 1.0] and two[0].whitened[0] == -two[1].whitened[0] and two[0].whitened[1] is None
    assert two[0].explained == [1.0, 0.0]
    with pytest.raises(ValueError):
        whitening.whiten(frame(spark, []), weights="none")


def test_whitening_query(spark):
    sf = "/root/testdata/sf0.001"
    found = catalog.QUERIES["op11_whitening"](spark, sf)
    assert found.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding is not null and forall(embedding, c -> c is not null and c = c and abs(c) < float('inf'))")
    assert found.count() == 4 * rows.count()
    again = {(r.vec_id, r.component): r.whitened for r in found.collect()}
    assert all(again[r.vec_id, r.component] == r.whitened for r in catalog.QUERIES["op11_whitening"](spark, sf).collect())


def slow_codes(rows, parts=8, entries=16, rounds=6):
    usable = [r for r in kept(rows, 4096)]
    dims = max(set(len(x) for _, x, _ in usable), key=lambda k: (sum(len(x) == k for _, x, _ in usable), k))
    own = [(i, x, w) for i, x, w in usable if len(x) == dims]
    width = -(-dims // parts)
    cut = [[(x + [0] * (parts * width - dims))[p * width : (p + 1) * width] for p in range(parts)] for _, x, _ in own]
    order = sorted(range(len(own)), key=lambda k: (own[k][0] is None, own[k][0] or 0, own[k][1]))
    book = [[list(cut[k][p]) for k in order[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), j) for j, e in enumerate(book[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        now = assign()
        for p in range(parts):
            for j in range(len(book[p])):
                members = [c[p] for c, a in zip(cut, now) if a[p][1] == j]
                if members:
                    book[p][j] = [sum(c) // len(members) for c in zip(*members)]
    out = [(i, w, [j for _, j in a], sum(d for d, _ in a)) for (i, _, w), a in zip(own, assign())]
    return out + [(i, w, None, None) for i, x, w in usable if len(x) != dims], book


@pytest.mark.parametrize("dims, n", [(16, 90), (13, 40), (8, 11)])
def test_codes(spark, dims, n):
    rows = make(dims, n, dims)
    coded, book = codes.compress(frame(spark, rows))
    expected, slow_book = slow_codes(rows)
    assert book.tolist() == slow_book
    assert sorted(map(str, (tuple(r) for r in coded.select("vec_id", "label", "code", "error").collect()))) == sorted(map(str, expected))
    assert codes.digest(book) == hashlib.sha256(",".join(str(c) for part in slow_book for e in part for c in e).encode()).hexdigest()
    total = {}
    for _, label, _, error in expected:
        total[label] = total.get(label, 0) + (error or 0)
    found = codes.group_errors(coded)
    assert found.count() == len(expected)
    assert all((r.label_error or 0) == total[r.label] for r in found.collect())


def test_codes_edges(spark):
    coded, book = codes.compress(spark.createDataFrame([], SCHEMA))
    assert coded.count() == 0 and book.size == 0 and len(codes.digest(book)) == 64
    assert codes.group_errors(coded).count() == 0
    coded, _ = codes.compress(frame(spark, [(5, [0.0] * 8, None), (4, [0.0] * 8, 2)]), label_col=None)
    assert [(r.code, r.error) for r in coded.collect()] == [([0] * 8, 0)] * 2  # equal entries: the lowest
    with pytest.raises(Exception, match="beyond"):
        codes.compress(frame(spark, [(5, [1e9] * 8, None)]))[0].collect()


def test_superseded_states_go(spark):
    import os

    from kontor.session import scratch_dir

    folder = scratch_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    coded, _ = codes.compress(frame(spark, make(4)))
    assert len(set(os.listdir(folder)) - before) == 1  # the last state alone
    assert coded.where(F.col("code").isNotNull()).count() == 90 + 60 + 3

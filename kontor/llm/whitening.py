"""Whitening of embeddings over distinct vectors, each with a weight.

Rows with equal whole-number vectors are one entry with a multiplicity.  The fit gives an
entry the weight one, or its multiplicity; sums and products are centred and gathered
by one matrix product per Arrow batch, d*d sums reach the driver.  Every distinct vector is
whitened once and the result joined back to the rows.

Rows are keyed by (vector, salt): a vector that a third of all rows share is counted and
joined in as many places as there are salts, and the table of distinct vectors carries the
salts that its rows have, so nothing is copied for rare vectors.

Sums stay exact, and so don't depend on the order of tasks, while weight times squared
entries are below 2**53: entries are shifted by the rounded mean before they are multiplied, and the rest of
the mean, below one, is taken off in whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.llm.tables import shuffle_partitions
from kontor.llm.vectors import lists, main_length, pack, unpack, usable, whole
from kontor.session import checkpoint_cut

COMPONENTS = 4
SCALE = 256
#: A hot vector is spread over at least so many places.
LEAST_SALTS = 16
#: An eigenvalue below this share of the trace is none.
FLAT = 1e-12


def _keyed(rows: DataFrame, scale: int, salts: int) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, bounds = lists(batch.column(1))
            x = whole(values, scale)
            keys = [pack(x[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(np.diff(bounds), pa.int64())], names=["id", "key", "n_dims"])

    keyed = rows.select("id", "vector").mapInArrow(run, f"id {kind}, key binary, n_dims long")
    return keyed.withColumn("salt", F.pmod(F.xxhash64("id", "key"), F.lit(salts)).cast("int"))


def _sums(distinct: DataFrame, dims: int) -> tuple[int, int, list[int]]:
    """Entries, their weight, and the weighted sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, weight, low, high = 0, 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x, w = unpack(batch.column(0), dims), batch.column(1).to_numpy()
            n, weight = n + len(w), weight + int(w.sum())
            low += w @ (x & 0x3FFFFFF)  # halves, so that no sum overflows
            high += w @ (x >> 26)
        total = [str((int(h) << 26) + int(s)) for h, s in zip(high, low)]
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(dims), pa.int32()), "n": pa.array([n] * dims), "w": pa.array([weight] * dims), "s": total})

    found = distinct.select("key", "weight").mapInArrow(run, "place int, n long, w long, s string")
    rows = found.groupBy("place").agg(F.sum("n"), F.sum("w"), F.sum(F.col("s").cast("decimal(38,0)"))).orderBy("place").collect()
    return int(rows[0][1]), int(rows[0][2]), [int(r[3]) for r in rows]


def _products(distinct: DataFrame, shift: np.ndarray) -> np.ndarray:
    """Weighted sums of products of entries shifted by ``shift``."""
    dims = len(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            y, w = (unpack(batch.column(0), dims) - shift).astype(np.float64), batch.column(1).to_numpy()
            total += (y * w[:, None]).T @ y
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(dims), pa.int32()), "line": pa.array(list(total), pa.list_(pa.float64()))})

    found = distinct.select("key", "weight").mapInArrow(run, "place int, line array<double>")
    cells = found.select("place", F.posexplode("line").alias("at", "value")).groupBy("place", "at").agg(F.sum("value").alias("value"))
    out = np.zeros((dims, dims))
    for r in cells.collect():  # d*d cells, whatever the rows
        out[r.place, r.at] = r.value
    return out


def covariance(products: np.ndarray, rest: list[int], weight: int) -> np.ndarray:
    """Covariance (divisor ``weight``) from sums of shifted products and the sums of shifted entries, rounded once."""
    dims, out = len(rest), np.empty(products.shape)
    for i in range(dims):
        for j in range(dims):
            out[i, j] = (weight * int(products[i, j]) - rest[i] * rest[j]) / (weight * weight)
    return out


def eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in rows; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1], vectors.T[::-1]
    at = np.abs(vectors).argmax(axis=1)
    return values, vectors * np.sign(vectors[np.arange(len(at)), at])[:, None]


def _whitened(distinct: DataFrame, shift: np.ndarray, rest: list[int], weight: int, axes: np.ndarray) -> DataFrame:
    """Each distinct vector with its whitened form and its exact deviation."""
    dims, mean = len(shift), np.array([r / weight for r in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = unpack(batch.column(0), dims) - shift
            top = int(np.abs(y).max(initial=0)) * weight + max(map(abs, rest), default=0)
            exact = weight * (y if top < 2**62 else y.astype(object)) - np.array(rest, dtype=np.int64 if top < 2**62 else object)
            if dims * top * top >= 1 << 63:
                exact = exact.astype(object)
            deviation = [int(d) if d < 1 << 63 else None for d in (exact * exact).sum(axis=1)]
            # summed entry by entry: a row's value doesn't depend on the batch it is in
            out = sum(((y[:, i] - mean[i])[:, None] * axes[:, i] for i in range(dims)), np.zeros((len(y), len(axes))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(deviation, pa.int64()), pa.array(list(out), pa.list_(pa.float64()))],
                names=["key", "weight", "salts", "deviation", "whitened"],
            )

    return distinct.select("key", "weight", "salts").mapInArrow(
        run, "key binary, weight long, salts array<int>, deviation long, whitened array<double>"
    )


def _identity_error(done: DataFrame, count: int, weight: int) -> float | None:
    """Largest entry of the whitened vectors' covariance minus the identity."""
    if not count:
        return None
    at = [F.col("whitened")[i] for i in range(count)]
    mean = done.agg(*(F.sum(c * F.col("weight")) / weight for c in at)).first()
    pairs = [(i, j) for i in range(count) for j in range(i, count)]

    def cov(i: int, j: int) -> Column:
        return F.sum((at[i] - F.lit(mean[i])) * (at[j] - F.lit(mean[j])) * F.col("weight")) / weight

    found = done.agg(*(cov(i, j) for i, j in pairs)).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, weights: str = "one", id_col="vec_id", vector_col="embedding") -> DataFrame:
    """Every row with the whitened form of its vector.

    Entries become floor(scale * entry).  ``weights`` is "one" (each distinct vector counts once) or "count" (as often as rows have
    it); ``n`` is the sum of weights.  Returns ``id_col``, n, deviation (sum over dimensions of (n*x - S)^2; null beyond 64 bits),
    whitened (array, one entry per component: up to ``components``, or the vectors' length), explained (array) and identity_error.

    Rows with a null vector, null or non-finite entries have no result.  Repeated rows and ids, and null ids, keep a result each.
    Vectors of another length than the most frequent one (the longer of two) aren't in the fit: their deviation is null and they have no
    components.  Components without variance (one distinct vector, fewer vectors than components) have null in ``whitened``;
    explained is null if nothing varies, identity_error if no component does.  Empty tables and vectors without
    entries give no component.  Other columns, whatever their names, aren't read.  Entries beyond 2**52 after scaling are an error.
    Equal eigenvalues: any one orthonormal basis.
    """
    if weights not in ("one", "count"):
        raise ValueError(f"weights are 'one' or 'count', not {weights!r}")
    salts = max(LEAST_SALTS, shuffle_partitions(rows))
    keyed = _keyed(usable(rows, id_col, vector_col), scale, salts)
    spread = keyed.groupBy("key", "salt").agg(F.count("*").alias("copies"), F.first("n_dims").alias("n_dims"))
    every = checkpoint_cut(
        spread.groupBy("key").agg(
            (F.sum("copies") if weights == "count" else F.lit(1).cast("long")).alias("weight"),
            F.first("n_dims").alias("n_dims"), F.collect_set("salt").alias("salts"),
        )
    )
    dims = main_length(every)
    distinct = every.where(F.col("n_dims") == dims)
    names = [F.col("id").alias(id_col), "n", "deviation", "whitened", "explained", "identity_error"]
    if not dims:
        nothing = {"n": "long", "deviation": "long", "whitened": "array<double>", "explained": "array<double>", "identity_error": "double"}
        return keyed.select("id", *(F.lit(None).cast(t).alias(k) for k, t in nothing.items())).select(*names)
    _, weight, total = _sums(distinct, dims)
    shift = np.array([round(s / weight) for s in total], dtype=np.int64)
    rest = [s - weight * int(c) for s, c in zip(total, shift)]
    values, vectors = eigen(covariance(_products(distinct, shift), rest, weight))
    trace = float(values.sum())
    count = min(components, dims)
    alive = sum(bool(v > FLAT * trace) for v in values[:count]) if trace > 0 else 0
    axes = np.array([v / math.sqrt(e) for v, e in zip(vectors[:alive], values[:alive])]).reshape(alive, dims)
    done = checkpoint_cut(_whitened(distinct, shift, rest, weight, axes))
    error = _identity_error(done, alive, weight)
    share = [max(0.0, float(v)) / trace if trace > 0 else None for v in values[:count]]
    results = done.select(
        "key", F.explode("salts").alias("salt"), "deviation",
        F.concat("whitened", F.array_repeat(F.lit(None).cast("double"), count - alive)).alias("whitened"),
        F.array(*(F.lit(s).cast("double") for s in share)).alias("explained"),
    )
    return keyed.select("id", "key", "salt").join(results, ["key", "salt"], "left").withColumns(
        {"n": F.lit(weight).cast("long"), "identity_error": F.lit(error).cast("double")}
    ).select(*names)

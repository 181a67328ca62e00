"""Product codes of vectors by Lloyd rounds over members that stay where they are.

A part of a vector is a row.  Rows are dealt by (position, entry, salt), so the members of a
codebook entry lie together, a large entry in as many places as there are salts.  In every
round the owners sum their resident members, a codebook of positions * entries rows goes
through the driver, each member is held against the new codebook in its place, and only those
that change their entry go through the next shuffle; the others are written on by the
task that has read them.  Each state is a table in the shared folder, the one before is
removed when it is complete, so a lost executor costs one round at most.

All arithmetic is in whole numbers: results don't depend on the order of rows or tasks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.llm.tables import shuffle_partitions
from kontor.llm.vectors import lists, main_length, usable, whole
from kontor.session import checkpoint_cut, scratch_dir

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: A hot entry or label is spread over at least so many places.
LEAST_SALTS = 16
#: Whole-number entries beyond this would let squared distances leave 64 bits.
LARGEST = 1 << 26
#: Distances of so many parts are alive at once.
BLOCK = 1 << 15

Codebook = np.ndarray  # position, entry, place in the part


def nearest(parts: np.ndarray, position: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """The lowest of the nearest entries of each part, and its squared distance."""
    entry, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for start in range(0, len(parts), BLOCK):
        own = slice(start, start + BLOCK)
        gap = parts[own, None, :] - book[position[own]]
        square = np.einsum("nej,nej->ne", gap, gap)
        entry[own] = square.argmin(axis=1)
        distance[own] = square[np.arange(len(square)), entry[own]]
    return entry, distance


def _width(top: int) -> str:
    return "<i2" if top < 1 << 15 else "<i4"


def _pack(parts: np.ndarray) -> pa.Array:
    kind = _width(int(np.abs(parts).max(initial=0)))
    raw = parts.astype(kind)
    size = raw.dtype.itemsize * raw.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw).tobytes())]).cast(pa.binary())


def _unpack(column: pa.Array, width: int) -> np.ndarray:
    out = np.empty((len(column), width), dtype=np.int64)
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    data = np.frombuffer(column.buffers()[2], np.uint8)[first:] if len(column) else np.zeros(0, np.uint8)
    start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        raw = data[(start[rows][:, None] + np.arange(size)).astype(np.int64)]
        out[rows] = np.ascontiguousarray(raw).view("<i2" if size == 2 * width else "<i4").reshape(len(rows), width)
    return out


def _split(rows: DataFrame, dims: int, parts: int, scale: int, book: Codebook) -> DataFrame:
    """A row per part with the entry it has under ``book``; the first part carries id and label."""
    width = book.shape[2]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    schema = f"row long, position int, entry int, part binary, id {kinds['id']}, label {kinds['label']}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = np.zeros((n, parts * width), np.int64)
            x[:, :dims] = whole(lists(batch.column(1))[0], scale, LARGEST).reshape(n, dims)
            for p in range(parts):
                own, place = x[:, p * width : (p + 1) * width], np.full(n, p)
                kept = [batch.column(2), batch.column(3)] if p == 0 else [pa.nulls(n, batch.column(i).type) for i in (2, 3)]
                entry = pa.array(nearest(own, place, book)[0], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place, pa.int32()), entry, _pack(own), *kept], names=["row", "position", "entry", "part", "id", "label"])

    return rows.select("row", "vector", "id", "label").mapInArrow(run, schema)


def _assigned(state: DataFrame, book: Codebook) -> DataFrame:
    """The state with ``next``, the entry of each member under ``book``, and the squared distance to it."""
    width = book.shape[2]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, distance = nearest(_unpack(batch.column(3), width), batch.column(1).to_numpy(), book)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(entry, pa.int32()), pa.array(distance)], names=[*batch.schema.names, "next", "distance"])

    return state.mapInArrow(run, f"{kinds}, next int, distance long")


def _dealt(members: DataFrame, salts: int) -> DataFrame:
    return members.repartition(shuffle_partitions(members), "position", "entry", F.pmod("row", F.lit(salts)))


def _updated(state: DataFrame, book: Codebook) -> Codebook:
    """Each entry as the floor of its members' mean; entries without members stay."""
    width = book.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = book.shape[0] * book.shape[1]
        count, total = np.zeros(size, np.int64), np.zeros((size, width), np.int64)
        for batch in batches:
            at = batch.column(0).to_numpy().astype(np.int64) * book.shape[1] + batch.column(1).to_numpy()
            np.add.at(total, at, _unpack(batch.column(2), width))
            count += np.bincount(at, minlength=size)
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"at": pa.array(own), "n": pa.array(count[own]), "total": pa.array(list(total[own]), pa.list_(pa.int64()))})

    found = state.select("position", "entry", "part").mapInArrow(run, "at long, n long, total array<long>")
    sums = found.groupBy("at").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[j]) for j in range(width))).alias("total"))
    out = book.copy()
    for r in sums.collect():  # positions * entries rows at most
        out[r["at"] // book.shape[1], r["at"] % book.shape[1]] = [t // r["n"] for t in r["total"]]
    return out


def _write(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{scratch_dir(df.sparkSession)}/kontor-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _remove(spark: SparkSession, path: str) -> None:
    """Remove a state that a complete later one has replaced."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def digest(book: Codebook) -> str:
    """SHA-256 of all components as decimals by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col="vec_id", vector_col="embedding", label_col: str | None = "label",
) -> tuple[DataFrame, Codebook]:
    """One row per vector with its code and its squared error, and the codebooks.

    Entries become floor(scale * entry); vectors are cut into ``parts`` equal consecutive parts, filled up with zeros where the
    length is no multiple.  Codebooks start from the ``entries`` rows with the lowest ids (null ids last, equal ids by vector; fewer
    rows: fewer entries).  Nearest entries are by squared distance, ties to the lowest index.  Columns: ``id_col``, label, code
    (array of indexes, null without code), error (long).

    Rows with a null vector, null or non-finite entries have no result.  Repeated rows and ids keep a result each.  Vectors of
    another length than the most frequent one (the longer of two) aren't coded: code and error are null; so are those of vectors without entries.
    An empty table gives no rows and an empty codebook.  Other columns, whatever their names, aren't read.  Entries beyond 2**26 after scaling are an error.
    """
    spark = rows.sparkSession
    label = F.lit(None).cast("int") if label_col is None else F.col(label_col)
    salts = max(LEAST_SALTS, shuffle_partitions(rows))
    kept = usable(rows.withColumn("_label", label), id_col, vector_col, "_label").withColumnRenamed("_label", "label")
    kept = kept.withColumn("n_dims", F.size("vector"))
    dims = main_length(kept)
    same = kept.where(F.col("n_dims") == dims)
    other = kept.where(F.col("n_dims") != dims) if dims else kept
    out = [F.col("id").alias(id_col), "label", "code", "error"]
    bare = other.select("id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
    if not dims:
        return bare.select(*out), np.zeros((parts, 0, 0), np.int64)
    width = -(-dims // parts)
    seeds = same.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    first = np.zeros((len(seeds), parts * width), np.int64)
    first[:, :dims] = whole(np.array([r["vector"] for r in seeds]), scale, LARGEST)
    book = np.ascontiguousarray(first.reshape(len(seeds), parts, width).transpose(1, 0, 2))

    numbered = same.withColumn("row", F.monotonically_increasing_id())  # numbered in the one pass that writes the first state
    state, path = _write(_dealt(_split(numbered, dims, parts, scale, book), salts))
    columns = state.columns
    for step in range(rounds):
        book = _updated(state, book)
        if step == rounds - 1:
            break
        held = _assigned(state, book)
        stay = held.where("next = entry").select(columns)
        move = held.where("next <> entry").withColumn("entry", F.col("next")).select(columns)
        old = path
        state, path = _write(stay.unionAll(_dealt(move, salts)))
        _remove(spark, old)
    last = _assigned(state, book).select("row", "position", "next", "distance", "id", "label")
    coded = last.groupBy("row").agg(
        F.max("id").alias("id"), F.max("label").alias("label"),
        F.transform(F.sort_array(F.collect_list(F.struct("position", "next"))), lambda s: s["next"]).alias("code"),
        F.sum("distance").alias("error"),
    )
    return coded.select("id", "label", "code", "error").unionAll(bare).select(*out), book


def group_errors(coded: DataFrame, salts: int | None = None) -> DataFrame:
    """``coded`` with ``label_error``, the error summed over equal labels, nulls together.

    A label is summed and joined back in as many places as there are salts.
    """
    salts = salts or max(LEAST_SALTS, shuffle_partitions(coded))
    rows = coded.withColumn("_salt", F.pmod(F.xxhash64(*(c for c, t in coded.dtypes if not t.startswith("map"))), F.lit(salts)).cast("int"))
    part = rows.groupBy("label", "_salt").agg(F.sum("error").alias("error"))
    total = part.groupBy("label").agg(F.sum("error").alias("label_error"), F.collect_set("_salt").alias("salts"))
    each = total.select(F.col("label").alias("_label"), F.explode("salts").alias("_at"), "label_error")
    same: Column = rows["label"].eqNullSafe(each["_label"]) & (rows["_salt"] == each["_at"])
    return rows.join(each, same, "left").drop("_label", "_at", "_salt")

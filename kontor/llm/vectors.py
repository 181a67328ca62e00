"""Shared by the operators on embedding vectors: rows that can be used, whole-number forms, packed keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole-number forms beyond this don't fit the exact sums of doubles.
LARGEST = 1 << 52


def usable(rows: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """``id``, ``vector`` as doubles and the columns ``more``, of rows whose vector has no null and only finite entries."""
    slim = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), *more)
    return slim.where(F.col("vector").isNotNull() & F.forall("vector", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))


def main_length(rows: DataFrame, size_col="n_dims") -> int:
    """The most frequent length, the longer one of two; 0 for an empty table."""
    found = rows.groupBy(size_col).count().orderBy(F.desc("count"), F.desc(size_col)).limit(1).collect()
    return found[0][0] if found else 0


def whole(values: np.ndarray, scale: int, largest: int = LARGEST) -> np.ndarray:
    """floor(scale * value) as 64-bit numbers; entries beyond ``largest`` are an error, as they would lose exactness."""
    x = np.floor(values * scale)
    if x.size and not np.abs(x).max() <= largest:
        raise OverflowError(f"a vector entry times {scale} is beyond {largest}")
    return x.astype(np.int64)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Entries and bounds of a column of lists without nulls."""
    bounds = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), bounds


def pack(x: np.ndarray) -> bytes:
    """One key per vector of whole numbers: the width that holds all entries, then the entries."""
    top = int(np.abs(x).max(initial=0))
    width = 1 if top < 1 << 7 else 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def unpack(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of ``dims`` entries that ``pack`` made, one per row."""
    out = np.empty((len(column), dims), dtype=np.int64)
    for i, key in enumerate(column):
        raw = key.as_buffer().to_pybytes()
        out[i] = np.frombuffer(raw, dtype=f"<i{raw[0]}", offset=1)
    return out

"""String similarity on a 0-100 scale: ``round(100 * 2*LCS / (len a + len b))``.

Spark has no LCS expression, so the exact value comes from one Arrow-batched
function that handles a whole batch of pairs with numpy bit operations.
``token_sort_key`` is native and computed once per row, before any join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.functions.text import strip

WORD_BITS = 64


def token_sort_key(c: Column) -> Column:
    """Lower-case word tokens in sorted order; Latin-1 accented letters are dropped."""
    ascii_only = F.regexp_replace(c, "[\\u0080-\\u00ff]", "")
    words = strip(F.lower(F.regexp_replace(ascii_only, r"(?U)\W", " ")))
    return F.array_join(F.array_sort(F.filter(F.split(words, r"\s+"), lambda w: w != "")), " ")


def _codes(values: list[str]) -> np.ndarray:
    table = np.asarray(values, dtype=np.str_)
    return table.view(np.uint32).reshape(len(values), -1)


def _lcs_short(a: list[str], b: list[str]) -> np.ndarray:
    """LCS lengths where every ``a`` has at most 64 characters."""
    left, right = _codes(a), _codes(b)
    present = left != 0
    bits = np.left_shift(np.uint64(1), np.arange(left.shape[1], dtype=np.uint64))
    state = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for j in range(right.shape[1]):
        same = (left == right[:, j : j + 1]) & present
        match = np.where(same, bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        hit = state & match
        state = (state + hit) | (state - hit)
    lengths = present.sum(axis=1)
    low = np.where(
        lengths >= WORD_BITS,
        np.iinfo(np.uint64).max,
        np.left_shift(np.uint64(1), np.minimum(lengths, WORD_BITS - 1).astype(np.uint64)) - np.uint64(1),
    )
    return np.bitwise_count(~state & low).astype(np.int64)


def _lcs_long(a: str, b: str) -> int:
    """The same recurrence on one arbitrarily long integer."""
    match: dict[str, int] = {}
    for i, ch in enumerate(a):
        match[ch] = match.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & match.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return (~state & full).bit_count()


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """LCS length of every pair ``(a[i], b[i])``."""
    swap = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    out = np.zeros(len(swap), dtype=np.int64)
    same = [i for i, (x, y) in enumerate(swap) if x == y]
    out[same] = [len(swap[i][0]) for i in same]
    done = set(same)
    short = [i for i, (x, y) in enumerate(swap) if i not in done and 0 < len(x) <= WORD_BITS and "\0" not in x + y]
    # similar lengths share a padded matrix, so one long string does not widen all
    short.sort(key=lambda i: len(swap[i][1]))
    for start in range(0, len(short), 2048):
        part = short[start : start + 2048]
        out[part] = _lcs_short([swap[i][0] for i in part], [swap[i][1] for i in part])
    done |= set(short)
    for i, (x, y) in enumerate(swap):
        if i not in done and x:
            out[i] = _lcs_long(x, y)
    return out


def ratio_values(left: list[str], right: list[str]) -> np.ndarray:
    """Similarity 0-100 of each pair of strings; two empty ones are equal."""
    total = np.array([len(x) + len(y) for x, y in zip(left, right)], dtype=np.float64)
    common = lcs_lengths(left, right) if left else np.zeros(0)
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.where(total > 0, 2.0 * common / total, 1.0)
    return np.rint(100.0 * share).astype(np.int32)


@F.pandas_udf(T.IntegerType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    known = a.notna() & b.notna()
    result = pd.Series(pd.array([pd.NA] * len(a), dtype="Int32"), index=a.index)
    result[known] = ratio_values(a[known].tolist(), b[known].tolist())
    return result


# Declared non-deterministic so that a filter on the result is not evaluated by a
# second call below the projection.
_ratio = _ratio.asNondeterministic()


def ratio(a: Column, b: Column) -> Column:
    """Similarity 0-100 of two strings, NULL if either is NULL."""
    return _ratio(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return _ratio(token_sort_key(a), token_sort_key(b))

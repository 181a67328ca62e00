"""Vectorised word helpers over the buffers of Arrow string columns.

A word is ``[^\\x20\\x09-\\x0D]+``.  Hashes are 64-bit and depend on the bytes alone, so
they agree between tasks, executors and runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes hashed at once; per-byte arrays of this many 64-bit numbers are alive.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODES = [mix(np.arange(1 + 256 * i, 257 + 256 * i, dtype=np.uint64) * _BASE) for i in range(2)]


def powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(max(count, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n, first = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[first : first + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true in ``inside`` that don't cross a text's bounds."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens, closes = np.empty(n, bool), np.empty(n, bool)
    opens[0], closes[-1] = True, True
    np.logical_not(inside[:-1], out=opens[1:])
    np.logical_not(inside[1:], out=closes[:-1])
    bounds = offsets[(offsets > 0) & (offsets < n)]
    opens[bounds] = True
    closes[bounds - 1] = True
    return np.flatnonzero(inside & opens), np.flatnonzero(inside & closes) + 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the number of words before each text's start (one more at the end)."""
    starts, ends = spans(~SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; the two families are independent."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES)))
        first, last = int(starts[i]), int(ends[j - 1])
        at = starts[i:j] - first
        reach = np.diff(np.append(at, last - first))
        position = np.arange(last - first) - np.repeat(at, reach)
        length = (ends[i:j] - starts[i:j]).astype(np.int64)
        code = _BYTE_CODES[family][data[first:last]]
        code *= powers(_BASE, int(reach.max()))[position]
        code[position >= np.repeat(length, reach)] = 0
        out[i:j] = mix(np.add.reduceat(code, at) + length.astype(np.uint64))
        i = j
    return out


def windows(codes: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, factor in enumerate(powers(np.uint64(base), width)):
        out += codes[k : k + n] * factor
    return mix(out)


def window_starts(counts: np.ndarray, width: int) -> np.ndarray:
    """Positions in a flat word list where a window fits into its text; ``counts``: words per text."""
    firsts = np.cumsum(counts) - counts
    fits = np.maximum(counts - width + 1, 0)
    total = int(fits.sum())
    return np.arange(total) + np.repeat(firsts - (np.cumsum(fits) - fits), fits)


def pieces(offsets: np.ndarray, size: int):
    """Ranges of texts that hold about ``size`` bytes, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = j

"""Compare the two sides of a tile: groups of alike rows first, then pairs by matrix products, then letter by letter.

Spark deals tiles out and sorts each task's rows by tile; here the rows of one tile, or of several
small ones, are held against each other.  Counts of characters are written as rows of zeros and ones, so a
product of two such matrices counts the characters that all pairs have in common.  That bounds
the longest common subsequence from above, and with it the weighted score.  Alike rows are put side by side and cut into
leaves; the columns that all rows of a leaf have, and those that none has, bound the score of two leaves, and leaves that
are too far apart are never multiplied.  Leaves that are near come first.  Only pairs that can
still reach the threshold, and the best of one of their rows, are compared letter by letter, those with
the highest bound and the heaviest field first.  A row takes at most its ``best`` partners out of a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from kontor.functions.similarity import WORD_BITS, ratio_values

CLASSES = 64
#: Repeats of a character class that are told apart.
LEVELS = 4
#: Rows of a leaf, pairs that are compared letter by letter at once, and bytes of the tables that this takes.
LEAF, PAIRS, TABLE = 256, 1 << 13, 1 << 24
#: Tiles are put together up to so many rows of a side, since a call has a price of its own.
PACKED = 256
#: Rows by which the direction of a cut between alike rows is found (it only orders the rows).
SEEN = 1024


def unary(values: list[str | None]) -> np.ndarray:
    """Row i, column (class, level): 1 if the value has more than ``level`` characters of the class."""
    codes = [np.frombuffer((v or "").encode("utf-32-le"), np.uint32) % CLASSES for v in values]
    counts = np.zeros((len(values), CLASSES), np.int32)
    rows = np.repeat(np.arange(len(values)), [len(c) for c in codes])
    np.add.at(counts, (rows, np.concatenate(codes) if codes else np.zeros(0, np.int64)), 1)
    return np.concatenate([counts > level for level in range(LEVELS)], axis=1)


def _alike(x: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """``at`` in groups of at most ``LEAF`` rows: cut in halves across the direction in which the rows differ most."""
    if len(at) <= LEAF:
        yield at
        return
    seen = x[at[:: -(-len(at) // SEEN)]]
    seen = seen - seen.mean(axis=0)
    way = seen[np.argmax((seen * seen).sum(axis=1))]
    for _ in range(4):
        way = (seen @ way) @ seen
        way = way / max(float(np.linalg.norm(way)), 1e-20)
    order = at[np.argsort(x[at] @ way, kind="stable")]
    # a multiple of whole leaves on the left
    half = -(-len(at) // LEAF) // 2 * LEAF
    yield from _alike(x, order[:half])
    yield from _alike(x, order[half:])


class Side:
    """Rows of one side of a tile: group number, key, and per field values, lengths and character counts.

    ``least``: the lowest id that a row offers as a candidate, ``offers``: whether it has one, and ``first`` and ``last``:
    the lowest and highest id that asks (for searches in which a candidate has to have a lower id).
    Rows of a single group are put into an order in which alike ones are neighbours, those that ask (``probe``) first.
    """

    def __init__(self, group, key: list[bytes], probe, fields: list[list[str | None]], least=None, offers=None, first=None, last=None):
        bits = [unary(f) for f in fields]
        n = len(key)
        if n > LEAF and (group == group[0]).all():
            mean = [max(b.sum(dtype=np.float64) / n, 1) for b in bits]
            x = np.concatenate([b[:, b.any(axis=0)] / np.float32(np.sqrt(m)) for b, m in zip(bits, mean)], axis=1, dtype=np.float32)
            order = np.concatenate([part for half in (probe, ~probe) for part in _alike(x, np.flatnonzero(half))])
            key = [key[i] for i in order]
            fields = [[f[i] for i in order] for f in fields]
            bits = [b[order] for b in bits]
            group, probe, least, offers, first, last = (None if v is None else v[order] for v in (group, probe, least, offers, first, last))
        self.group, self.key, self.probe, self.fields = group, key, probe, fields
        self.least, self.offers, self.first, self.last = least, offers, first, last
        self.name = np.unique(np.array(key, object), return_inverse=True)[1] if n else np.zeros(0, np.int64)
        self.known = [np.array([v is not None for v in f], bool) for f in fields]
        self.length = [np.array([len(v or "") for v in f], np.float32) for f in fields]
        self.bits = bits
        self.size = [b.sum(axis=1, dtype=np.float32) for b in bits]
        self.used = [b.any(axis=0) for b in bits]
        self.packed = [np.packbits(b, axis=1).view(np.uint64) for b in bits]
        self.starts = np.arange(0, n, LEAF)
        self.leaves = [slice(s, min(s + LEAF, n)) for s in self.starts]


def _leaf_ceilings(a: Side, b: Side, weights: list[float]) -> np.ndarray:
    """Upper bounds of the score of any pair of two leaves: characters that all rows of one have and none of the other."""
    total = np.zeros((len(a.leaves), len(b.leaves)), np.float32)
    for f, weight in enumerate(weights):
        (all_a, any_a, long_a, known_a), (all_b, any_b, long_b, known_b) = (
            (
                np.logical_and.reduceat(s.bits[f], s.starts, axis=0).astype(np.float32), np.logical_or.reduceat(s.bits[f], s.starts, axis=0).astype(np.float32),
                np.maximum.reduceat(s.length[f], s.starts), np.logical_or.reduceat(s.known[f], s.starts),
            )
            for s in (a, b)
        )
        apart = all_a @ (1 - any_b).T + (1 - any_a) @ all_b.T
        total += weight * (100.5 - 100 * apart / np.maximum(long_a[:, None] + long_b[None, :], 1)) * (known_a[:, None] & known_b[None, :])
    return total


def _shared(a: Side, b: Side) -> tuple[list[np.ndarray], np.ndarray]:
    """Character counts that both sides have (others are in common nowhere): those of a by field, those of b with sizes and known ones in one matrix."""
    both = [p & q for p, q in zip(a.used, b.used)]
    right = [np.column_stack([b.bits[f][:, both[f]], b.size[f], b.known[f]]).astype(np.float32) for f in range(len(both))]
    return [a.bits[f][:, both[f]] for f in range(len(both))], np.concatenate(right, axis=1)


def _ceilings(a: Side, b: Side, rows: slice, weights: list[float], cols: slice = slice(None), shared=None) -> np.ndarray:
    """Upper bounds of the weighted score of ``rows`` of a against ``cols`` of b, by one matrix product.

    The bound of a field is 100.5 - 100 * (number that is never above the insert/delete distance) / (sum of the lengths).
    The length on the side of b is taken as its longest among ``cols``, so that the divisor is a factor of the row of a.
    """
    left, right = shared or _shared(a, b)
    parts = []
    for f, weight in enumerate(weights):
        known = a.known[f][rows]
        factor = (100 * weight * known / np.maximum(a.length[f][rows] + b.length[f][cols].max(initial=0), 1)).astype(np.float32)
        most = (100.5 * weight * known - factor * a.size[f][rows]).astype(np.float32)
        parts += [left[f][rows] * (2 * factor)[:, None], -factor[:, None], most[:, None]]
    return np.concatenate(parts, axis=1) @ right[cols].T


class Letters:
    """Exact similarities of a field: values of up to 64 characters by bit operations, one letter of all pairs at a time."""

    def __init__(self, a: list[str | None], b: list[str | None]):
        self.a, self.b = a, b
        short = lambda values: [v if v is not None and len(v) <= WORD_BITS else "" for v in values]
        sides = [[np.frombuffer(v.encode("utf-32-le"), np.uint32) for v in short(values)] for values in ((a,) if a is b else (a, b))]
        used = np.unique(np.concatenate([np.zeros(0, np.uint32), *(c for side in sides for c in side)]))
        self.width = len(used) + 1
        padded = []
        for side in sides:
            sizes = np.array([len(c) for c in side], np.int64)
            table = np.zeros((max(int(sizes.max(initial=0)), 1), len(side)), np.int32)
            ends = np.cumsum(sizes)
            place = np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes)
            table[place, np.repeat(np.arange(len(side)), sizes)] = np.searchsorted(used, np.concatenate([np.zeros(0, np.uint32), *side])) + 1
            padded.append((table, sizes))
        (self.left, self.size_a), (self.right, self.size_b) = padded[0], padded[-1]
        self.whole_a, self.whole_b = (np.array([len(v or "") for v in values], np.int64) for values in (a, b))

    def _common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences."""
        out = np.zeros(len(i), np.int64)
        rows, number = np.unique(i, return_inverse=True)
        step = max(TABLE // (8 * self.width), 1)
        for top in range(0, len(rows), step):
            part = rows[top : top + step]
            place = np.zeros(len(part) * self.width, np.uint64)  # (row, letter): the places of the letter
            base = np.arange(len(part)) * self.width
            for p in range(int(self.size_a[part].max(initial=0))):
                place[base + self.left[p, part]] |= np.uint64(1 << p)
            place[base] = 0  # the padding
            mine = slice(None) if step >= len(rows) else np.flatnonzero((number >= top) & (number < top + step))
            at, partner = (number[mine] - top) * self.width, j[mine]
            state = np.full(len(at), np.iinfo(np.uint64).max, np.uint64)
            for p in range(int(self.size_b[partner].max(initial=0))):
                match = place[at + self.right[p, partner]]
                hit = state & match
                state = (state + hit) | (state ^ hit)
            size = self.size_a[i[mine]].astype(np.uint64)
            low = np.where(size >= WORD_BITS, np.iinfo(np.uint64).max, (np.uint64(1) << np.minimum(size, np.uint64(WORD_BITS - 1))) - np.uint64(1))
            out[mine] = np.bitwise_count(~state & low)
        return out

    def ratios(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """``ratio_values`` of the pairs."""
        total = self.whole_a[i] + self.whole_b[j]
        with np.errstate(invalid="ignore", divide="ignore"):
            out = np.rint(100.0 * np.where(total > 0, 2.0 * self._common(i, j) / total, 1.0)).astype(np.int64)
        for k in [np.flatnonzero((self.whole_a[i] > WORD_BITS) | (self.whole_b[j] > WORD_BITS))]:
            if len(k):
                out[k] = ratio_values([self.a[x] for x in i[k]], [self.b[y] for y in j[k]])
        return out


class Best:
    """The best partners of every row of one side, and the score below which nothing counts for the row."""

    def __init__(self, asks: Side, offers: Side, best: int, threshold: float, earlier: bool, fields: int):
        self.asks, self.offers, self.best, self.earlier = asks, offers, best, earlier
        n = len(asks.key)
        # a row that doesn't ask wants none
        self.floor = np.where(asks.probe, float(threshold), np.inf)
        self.partner = np.full((n, best), -1, np.int64)
        self.score = np.zeros((n, best))
        self.sims = np.zeros((n, best, fields), np.int16)
        # partners that only some of the askers of a row may have: they take no place
        self.more: list[tuple[np.ndarray, ...]] = []
        self.size, self.limit = 0, 1 << 16

    def wanted(self, row: np.ndarray, partner: np.ndarray) -> np.ndarray:
        ok = self.offers.offers[partner]
        return ok & (self.offers.least[partner] < self.asks.last[row]) if self.earlier else ok

    def add(self, row: np.ndarray, partner: np.ndarray, score: np.ndarray, sims: np.ndarray) -> None:
        """Keep the best of each row; ties go to the lower id."""
        keep = (score >= self.floor[row]) & self.wanted(row, partner)
        row, partner, score, sims = row[keep], partner[keep], score[keep], sims[:, keep].T.astype(np.int16)
        if self.earlier:
            sure = self.offers.least[partner] < self.asks.first[row]
            if not sure.all():
                self.more.append((row[~sure], partner[~sure], score[~sure], sims[~sure]))
                self.size += int((~sure).sum())
                row, partner, score, sims = row[sure], partner[sure], score[sure], sims[sure]
        if len(row):
            touched = np.unique(row)
            old, nth = np.nonzero(self.partner[touched] >= 0)
            old = touched[old]
            row, partner = np.concatenate([old, row]), np.concatenate([self.partner[old, nth], partner])
            score, sims = np.concatenate([self.score[old, nth], score]), np.concatenate([self.sims[old, nth], sims])
            order = np.lexsort((self.offers.name[partner], self.offers.least[partner], -score, row))
            row, partner, score, sims = row[order], partner[order], score[order], sims[order]
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
            keep = rank < self.best
            row, rank = row[keep], rank[keep]
            self.partner[row, rank], self.score[row, rank], self.sims[row, rank] = partner[keep], score[keep], sims[keep]
            last = rank == self.best - 1
            self.floor[row[last]] = np.maximum(self.floor[row[last]], score[keep][last])
        if self.size > self.limit:
            self.trim()

    def trim(self) -> None:
        if self.more:
            row, partner, score, sims = (np.concatenate(x) for x in zip(*self.more))
            keep = score >= self.floor[row]
            self.more = [(row[keep], partner[keep], score[keep], sims[keep])]
            self.size = int(keep.sum())
            self.limit = max(2 * self.size, 1 << 16)

    @property
    def held(self) -> list[np.ndarray]:
        """Rows, partners, scores and similarities."""
        self.trim()
        row, nth = np.nonzero(self.partner >= 0)
        return [np.concatenate(x) for x in zip((row, self.partner[row, nth], self.score[row, nth], self.sims[row, nth]), *self.more)]


class Scores:
    """Pairs compared letter by letter, the heaviest field first; a field that is still to come counts as its bound."""

    def __init__(self, a: Side, b: Side, weights: list[float]):
        self.a, self.b, self.weights = a, b, weights
        self.letters = [Letters(a.fields[f], b.fields[f]) for f in range(len(weights))]

    def _bound(self, f: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper bounds of the rounded similarities of a field."""
        a, b = self.a, self.b
        common = np.bitwise_count(a.packed[f][i] & b.packed[f][j]).sum(axis=1, dtype=np.int64)
        apart = a.size[f][i].astype(np.int64) + b.size[f][j].astype(np.int64) - 2 * common
        total = np.maximum(a.length[f][i].astype(np.int64) + b.length[f][j].astype(np.int64), 1)
        return np.floor(100.5 - 100.0 * apart / total + 1e-9) * (a.known[f][i] & b.known[f][j])

    def of(self, i: np.ndarray, j: np.ndarray, floor: np.ndarray):
        """Pairs (rows of a, rows of b, score, similarities) that reach their floor."""
        sims = np.zeros((len(self.weights), len(i)))
        most = np.zeros(len(i))
        for f, weight in enumerate(self.weights):
            sims[f] = self._bound(f, i, j)
            most += weight * sims[f]
        for f in [None, *sorted(range(len(self.weights)), key=lambda f: -self.weights[f])]:
            if f is not None:
                known = np.flatnonzero(self.a.known[f][i] & self.b.known[f][j])
                exact = np.zeros(len(i))
                exact[known] = self.letters[f].ratios(i[known], j[known])
                most = most + self.weights[f] * (exact - sims[f])
                sims[f] = exact
            keep = most >= floor - 1e-6
            i, j, most, sims, floor = i[keep], j[keep], most[keep], sims[:, keep], floor[keep]
        score = np.zeros(len(i))
        for f, weight in enumerate(self.weights):
            score = score + weight * sims[f]
        return i, j, score, sims.astype(np.int64)


def best_pairs(a: Side, b: Side, weights: list[float], threshold: float, best: int, same: bool, earlier: bool) -> list[Best]:
    """The best partners of the rows of a that ask, and of those of b (unless they are the same)."""
    there = Best(a, b, best, threshold, earlier, len(weights))
    back = there if same else Best(b, a, best, threshold, earlier, len(weights))
    ways = [there] if same else [there, back]
    if not (len(a.key) and len(b.key) and any(way.asks.probe.any() for way in ways)):
        return ways
    shared, scores = _shared(a, b), Scores(a, b, weights)

    def floors(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """What a pair has to reach to count for one of its rows."""
        return np.minimum(np.where(there.wanted(i, j), there.floor[i], np.inf), np.where(back.wanted(j, i), back.floor[j], np.inf))

    ceilings = _leaf_ceilings(a, b, weights)
    p, q = np.nonzero(ceilings >= threshold - 1e-2)
    if same:
        p, q = p[p <= q], q[p <= q]
    order = np.lexsort((q, p, -ceilings[p, q], (p != q) if same else np.zeros(len(p), bool)))
    for p, q in zip(p[order], q[order]):
        rows, cols = a.leaves[p], b.leaves[q]
        low, high = there.floor[rows] - 1e-2, back.floor[cols] - 1e-2
        if ceilings[p, q] < min(low.min(), high.min()):
            continue
        bound = _ceilings(a, b, rows, weights, cols, shared)
        at = np.flatnonzero(bound >= np.minimum(low.astype(np.float32)[:, None], high.astype(np.float32)[None, :]))
        i, j = np.divmod(at, bound.shape[1])
        bound = bound.ravel()[at]
        i, j = i + rows.start, j + cols.start
        fit = (a.group[i] == b.group[j]) & (bound >= floors(i, j) - 1e-2)
        if same and p == q:
            fit &= i < j
        near = np.flatnonzero(fit)
        near = near[np.argsort(-bound[near], kind="stable")]
        i, j, bound = i[near], j[near], bound[near]
        while len(i):
            x, y, score, sims = scores.of(i[:PAIRS], j[:PAIRS], floors(i[:PAIRS], j[:PAIRS]))
            i, j, bound = i[PAIRS:], j[PAIRS:], bound[PAIRS:]
            if same:
                there.add(np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([score, score]), np.concatenate([sims, sims], axis=1))
            else:
                there.add(x, y, score, sims)
                back.add(y, x, score, sims)
            if len(i):
                go = bound >= floors(i, j) - 1e-2
                i, j, bound = i[go], j[go], bound[go]
    return ways


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """Rows of whole tiles from a stream sorted by tile; small diagonal tiles together (told by true)."""
    waiting: list[pa.Table] = []
    part: list[pa.Table] = []
    last = None
    held = 0

    def done() -> Iterator[tuple[pa.Table, bool]]:
        nonlocal waiting, held
        if not part:
            return
        tile = pa.concat_tables(part)
        if tile.num_rows > PACKED or tile.column("ti")[0].as_py() != tile.column("tj")[0].as_py():
            yield tile, False
            return
        waiting.append(tile)
        held += tile.num_rows
        if held >= PACKED:
            yield pa.concat_tables(waiting), True
            waiting, held = [], 0

    for batch in batches:
        table = pa.Table.from_batches([batch])
        marks = list(zip(*(table.column(c).to_pylist() for c in ("block", "ti", "tj"))))
        start = 0
        for at in range(1, len(marks) + 1):
            if at < len(marks) and marks[at] == marks[at - 1]:
                continue
            if last is not None and marks[start] != last:
                yield from done()
                part = []
            part.append(table.slice(start, at - start))
            last, start = marks[start], at
    yield from done()
    if waiting:
        yield pa.concat_tables(waiting), True


def compare(fields: list[str], weights: list[float], threshold: float, best: int, earlier: bool):
    """An Arrow function from rows (block, ti, tj, side, pkey, probe, least, offers, first, last, keys), sorted by tile, to the best partners of the rows that ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, _ in _cut(batches):
            number: dict[tuple, int] = {}
            marks = zip(*(tile.column(c).to_pylist() for c in ("block", "ti", "tj")))
            group = np.array([number.setdefault(m, len(number)) for m in marks])
            side = tile.column("side").to_numpy()
            key = tile.column("pkey").to_pylist()
            probe, offers = (tile.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("probe", "offers"))
            least, first, last = (tile.column(c).to_numpy() for c in ("least", "first", "last"))
            values = [tile.column(f"{f}_key").to_pylist() for f in fields]

            def take(which: np.ndarray) -> Side:
                at = np.flatnonzero(which)
                return Side(group[at], [key[i] for i in at], probe[at], [[v[i] for i in at] for v in values], least[at], offers[at], first[at], last[at])

            both = side == 2  # a diagonal tile: one set of rows for both sides
            a = take((side == 0) | both)
            b = a if both.any() else take(side == 1)
            for way in best_pairs(a, b, weights, threshold, best, a is b, earlier):
                row, partner, _, sims = way.held
                for at in range(0, len(row), PAIRS):
                    cut = slice(at, at + PAIRS)
                    yield _batch(way, row[cut], partner[cut], sims[cut], fields)

    return run


def _batch(way: Best, row: np.ndarray, partner: np.ndarray, sims: np.ndarray, fields: list[str]) -> pa.RecordBatch:
    columns = [pa.array([way.asks.key[i] for i in row], pa.binary()), pa.array([way.offers.key[j] for j in partner], pa.binary()), pa.array(way.offers.least[partner], pa.int64())]
    columns += [pa.array(sims[:, f].astype(np.int32)) for f in range(len(fields))]
    return pa.RecordBatch.from_arrays(columns, names=["src", "dst", "least", *(f"{f}_sim" for f in fields)])

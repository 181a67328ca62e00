"""SimHash near-duplicates by a binary trie self-join.

1. One pass gives every document a 64-bit fingerprint of its word shingles.
2. Distinct fingerprints are the leaves of a binary trie.  At most three differing bits
   leave at most one for one of the two halves, so the trie is built twice, once with
   each half first, and the traversal may spend one bit on the first half.
3. The first levels are an exchange: a node is a prefix, and a fingerprint is sent to its
   own node and as a visitor to the nodes that differ from it in one bit.  Tasks then
   descend from pairs of nodes, bit by bit, add up differing bits and drop a pair of
   nodes whose budget is spent.
4. Every task reports a spanning forest of its links, which has fewer rows than leaves;
   components come from Spark joins.

Copies of one text share a fingerprint and cost nothing after step 2.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.graph import components
from kontor.llm.tables import shuffle_partitions
from kontor.session import checkpoint_cut

WORDS = 3
SEED = 42
MAX_BITS = 3
#: Levels of the trie that the exchange takes; visitors differ within them by one bit.
ROOT_BITS = 24
#: Rows that a task of the traversal should hold; more fingerprints mean more tasks.
TASK_ROWS = 400_000
#: Node pairs that are opened at once.
FRONTIER = 1 << 18
#: Shingles whose bits are counted at once.
COUNT_ROWS = 1 << 14

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, width: int = WORDS) -> int:
    """SimHash of one text: bit i is set if it is set in over half of the shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends + 1 - lengths
    last = max(len(words) - width, 0)
    firsts, lasts = starts[: last + 1].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(firsts), COUNT_ROWS):
        codes = [digest(joined[a:b], SEED) for a, b in zip(firsts[i : i + COUNT_ROWS], lasts[i : i + COUNT_ROWS])]
        bits = np.unpackbits(np.array(codes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(firsts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``code`` (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], names=["doc_id", "code"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, code long")


def _forest(a: np.ndarray, b: np.ndarray, n: int, parent: np.ndarray | None = None) -> tuple[np.ndarray, list]:
    """Add links to a union-find; returns it and the links that joined two trees."""
    parent = np.arange(n) if parent is None else parent
    kept = []
    while len(a):
        while True:  # roots of all leaves
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            break
        high, low = np.maximum(ra, rb), np.minimum(ra, rb)
        roots, first = np.unique(high, return_index=True)  # one link for each upper root
        parent[roots] = low[first]
        kept.append((a[first], b[first]))
    return parent, kept


def trie_join(node: np.ndarray, code: np.ndarray, home: np.ndarray, max_bits: int = MAX_BITS, root_bits: int = ROOT_BITS):
    """Spanning forest of the links found below the nodes of one task.

    ``code`` has the half that comes first in its upper 32 bits.  Pairs are a home leaf
    with a home leaf or a visitor of the same node; visitors have spent one bit already.
    Visitors of a node come from several others, and those of each are a range of their own.
    """
    order = np.lexsort((code, ~home, node))
    node, code, home = node[order], code[order], home[order]
    n = len(code)
    if not n:
        return code[:0], code[:0]
    # ranges of one node and one origin, which are nodes of the trie: those of home leaves come before their visitors
    origin = code >> np.uint64(64 - root_bits)
    opens = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (home[1:] != home[:-1]) | (origin[1:] != origin[:-1])))
    lasts, at_home = np.append(opens[1:], n), home[opens]
    h0, h1, v0, v1 = opens[at_home], lasts[at_home], opens[~at_home], lasts[~at_home]
    if not len(h0):
        return code[:0], code[:0]
    host = np.minimum(np.searchsorted(node[h0], node[v0]), len(h0) - 1)
    met = node[h0[host]] == node[v0]
    host, v0, v1 = host[met], v0[met], v1[met]
    several = h1 - h0 > 1
    stack = []
    for a0, a1, b0, b1, spent in ((h0[several], h1[several], h0[several], h1[several], 0), (h0[host], h1[host], v0, v1, 1)):
        for i in range(0, len(a0), FRONTIER):
            cut = slice(i, i + FRONTIER)
            stack.append((root_bits, a0[cut], a1[cut], b0[cut], b1[cut], np.full(len(a0[cut]), spent, np.int8)))
    parent, found = None, []
    while stack:
        depth, a0, a1, b0, b1, spent = stack.pop()
        if depth == 64:  # leaves: one code on either side
            alike = a0 != b0
            parent, kept = _forest(a0[alike], b0[alike], n, parent)
            found += kept
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        am, bm = _split(code, a0, a1, bit), _split(code, b0, b1, bit)
        budget = min(1, max_bits) if depth < 32 else max_bits
        parts = []
        same = a0 == b0  # a node with itself: its two crossed pairs are one
        for x0, x1, y0, y1, cost, twice in (
            (a0, am, b0, bm, 0, False),
            (am, a1, bm, b1, 0, False),
            (a0, am, bm, b1, 1, False),
            (am, a1, b0, bm, 1, True),
        ):
            go = (x1 > x0) & (y1 > y0) & (spent + cost <= budget)
            if twice:
                go &= ~same
            go &= (x0 != y0) | (x1 - x0 > 1)  # a single leaf has no pair with itself
            parts.append((x0[go], x1[go], y0[go], y1[go], (spent[go] + cost).astype(np.int8)))
        a0, a1, b0, b1, spent = (np.concatenate(x) for x in zip(*parts))
        for i in range(0, len(a0), FRONTIER):
            cut = slice(i, i + FRONTIER)
            stack.append((depth + 1, a0[cut], a1[cut], b0[cut], b1[cut], spent[cut]))
    if not found:
        return code[:0], code[:0]
    return code[np.concatenate([x for x, _ in found])], code[np.concatenate([y for _, y in found])]


def _split(code: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First place in each sorted range [lo, hi) whose code has the bit set (binary search side by side)."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        is_set = (code[np.minimum(mid, len(code) - 1)] & bit) != 0
        hi = np.where(open_ & is_set, mid, hi)
        lo = np.where(open_ & ~is_set, mid + 1, lo)


def links(distinct: DataFrame, n: int, max_bits: int = MAX_BITS, root_bits: int = ROOT_BITS) -> DataFrame:
    """Links (``a``, ``b``) between fingerprints within ``max_bits`` (3 at most): a spanning forest per task.

    ``distinct``: one row for each ``code``; ``n``: their number, which sets the number of tasks only.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves share at most three bits")
    tasks = max(shuffle_partitions(distinct), math.ceil(n * (root_bits + 2) / TASK_ROWS))
    swapped = F.shiftleft("code", 32).bitwiseOR(F.shiftrightunsigned("code", 32))
    both = distinct.select(F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("code").alias("key")), F.struct(F.lit(1).alias("half"), swapped.alias("key")))).alias("t")).select("t.*")
    prefix = F.shiftrightunsigned("key", 64 - root_bits)
    # of two nodes that differ in one bit, the leaves of the one without it visit the other
    visits = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(root_bits - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)),
        lambda b: F.col("prefix").bitwiseAND(b) == 0,
    )
    rows = both.withColumn("prefix", prefix).select(
        "half", "key", F.explode(F.concat(F.array(F.lit(0).cast("long")), visits)).alias("flip"), "prefix"
    )
    rows = rows.select(
        "key",
        F.col("prefix").bitwiseXOR(F.col("flip")).bitwiseOR(F.shiftleft(F.col("half").cast("long"), 62)).alias("node"),
        (F.col("flip") == 0).alias("home"),
    )

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        code = table.column("key").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        out = [[], []]
        for half in (0, 1):
            own = (node >> 62) == half
            pair = trie_join(node[own], code[own], home[own], max_bits, root_bits)
            for side, x in zip(out, pair):
                side.append(x if not half else (x << np.uint64(32)) | (x >> np.uint64(32)))
        return pa.table([np.concatenate(x).view(np.int64) for x in out], names=["a", "b"])

    return rows.groupBy(F.pmod(F.xxhash64("node"), F.lit(tasks)).alias("task")).applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row of ``docs``.

    Documents are linked if their fingerprints differ in at most ``max_bits`` bits;
    ``component_id`` is the smallest id reachable over links.  A null or blank text has
    fingerprint zero, which is linked like any other.  A row without an id keeps its
    place in a component; a component without any id has a null ``component_id``.
    Repeated rows come back as often as they came.  Other columns are not read.
    """
    codes = checkpoint_cut(fingerprints(docs, id_col, text_col))
    distinct = checkpoint_cut(codes.groupBy("code").agg(F.min("doc_id").alias("least")))
    edges = links(distinct.select("code"), distinct.count(), max_bits)
    groups = components(edges)  # node, root: nodes that have a link
    named = distinct.join(groups, distinct.code == groups.node, "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    table = named.select("code", "root").join(least, "root").select("code", "component_id")
    return codes.join(table, "code").select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id"
    )

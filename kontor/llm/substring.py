"""Removal of repeated word windows by a compacted de Bruijn graph of word k-mers.

A window of ``width`` words is an edge of the graph.  Only edges that several documents
share matter, and finding them takes few bytes for each word:

1. Documents are dealt once into pieces of some megabytes; all steps that read texts
   work on that one exchange.
2. Every window is stood for by its minimizer, the least hash of the shorter k-mers in
   it; equal windows have equal minimizers, and neighbouring windows mostly share one.
   A piece sends each of its minimizers once; those met in two documents go back.
3. Windows with such a minimizer are the candidate edges.  A piece sends each of them
   once, under a 96-bit key, with the coordinates of its first document; the join of
   equal edges finds the source coordinates, which go back to the pieces.
4. Edges whose source coordinates follow one another are one unbranched path: a span of
   the document that repeats a span of its source.

What is sent for an edge or a minimizer is one row entry for each piece, whatever number
of documents holds it, so passages that a third of all documents share cost little.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm import kernels
from kontor.llm.tables import shuffle_partitions

WIDTH = 13
MINIMIZER = 7
#: Bytes of text in a piece, and of hashes in a task that joins equal ones.
PIECE_BYTES = 8 << 20
JOIN_BYTES = 8 << 20

_SECOND = 0xA0761D6478BD642F
#: Bytes of the parts of a window's key where they aren't eight.
_WIDTH = {"second": 4}
SPAN = "struct<start: long, n_words: long, source_id: long, source_start: long>"


class _Piece:
    """Words and windows of the documents of one piece; rows without an id have no windows."""

    def __init__(self, table: pa.Table, width: int):
        self.width = width
        self.ids = table.column("doc_id").combine_chunks() if table.num_rows else pa.array([], pa.int64())
        self.data, self.offsets = kernels.utf8(table.column("text"))
        self.starts, self.ends, self.bounds = kernels.word_spans(self.data, self.offsets)
        self.doc = np.asarray(self.ids.fill_null(0)).astype(np.int64)
        has_id = ~np.asarray(self.ids.is_null())
        counts = np.diff(self.bounds)
        self.at = kernels.window_starts(counts, width)  # first word of every window
        fits = np.maximum(counts - width + 1, 0)
        self.row = np.repeat(np.arange(len(counts)), fits)  # its document's row
        keep = has_id[self.row] if len(self.row) else np.zeros(0, bool)
        if not keep.all():
            self.at, self.row = self.at[keep], self.row[keep]
        self.words = kernels.hash_spans(self.data, self.starts, self.ends)

    def minimizers(self, size: int) -> np.ndarray:
        grams = kernels.windows(self.words, size)
        least = grams[self.at]
        for k in range(1, self.width - size + 1):
            np.minimum(least, grams[self.at + k], out=least)
        return least

    def keys(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both parts of the 96-bit keys of some windows; the second hashes only the words in them."""
        if not len(which):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        at = self.at[which]
        first = kernels.windows(self.words, self.width)[at]
        inside = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(inside, at, 1)
        np.add.at(inside, at + self.width, -1)
        held = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
        words = np.zeros(len(self.starts), np.uint64)
        words[held] = kernels.hash_spans(self.data, self.starts[held], self.ends[held], family=1)
        return first, kernels.windows(words, self.width, _SECOND)[at] >> np.uint64(64 - 8 * _WIDTH["second"])


def _bytes(x: np.ndarray, width: int = 8) -> bytes:
    """Numbers as one plane for each byte, which compresses well where they are sorted or small."""
    return np.ascontiguousarray(x.astype(f">u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _numbers(blob: bytes, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f">u{width}").ravel().astype(np.uint64)


def _read(table: pa.Table, name: str) -> list[np.ndarray]:
    return [_numbers(x.as_py(), _WIDTH.get(name, 8)) for x in table.column(name)]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _dealt(key: np.ndarray, tasks: int) -> list[tuple[int, slice]]:
    """Bounds of the tasks in keys that are sorted by ``key % tasks``."""
    task = (key % np.uint64(tasks)).astype(np.int64)
    edges = np.flatnonzero(np.append(True, task[1:] != task[:-1])) if len(task) else np.zeros(0, np.int64)
    return [(int(task[a]), slice(a, b)) for a, b in zip(edges, np.append(edges[1:], len(task)))]


def _rows(rows: list[tuple], names: dict[str, pa.DataType]) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.table({n: pa.array(list(c), t) for (n, t), c in zip(names.items(), columns)})


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, minimizer: int = MINIMIZER
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept`` (words joined by one space) and ``spans`` of every row.

    A word goes if a window of ``width`` words that covers it also starts in a document
    with a smaller id; windows are judged on the input.  ``spans``: runs of repeated
    windows by place of their first word, with the least document and place that have
    them.  A null text has no words.  A row without an id neither takes nor gives; rows
    that repeat an id are one document in this order and each come back.  An empty table
    gives an empty table; other columns are not read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    n_pieces = max(shuffle_partitions(docs), math.ceil(size / PIECE_BYTES))
    tasks = max(shuffle_partitions(docs), math.ceil(size / JOIN_BYTES))
    slim = slim.withColumn("piece", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), "text")), F.lit(n_pieces)).cast("long"))
    texts = slim.groupBy("piece")
    codes = {"task": pa.int64(), "piece": pa.int64(), "once": pa.binary(), "more": pa.binary()}

    def send_minimizers(key: tuple, table: pa.Table) -> pa.Table:
        piece = _Piece(table, width)
        least, doc = piece.minimizers(minimizer), piece.doc[piece.row]
        turn = np.append(True, (least[1:] != least[:-1]) | (piece.row[1:] != piece.row[:-1]))[: len(least)]
        code, doc = kernels.mix(least[turn]), doc[turn]
        order = np.argsort(code, kind="stable")
        code, doc = code[order], doc[order]
        firsts = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
        many = np.minimum.reduceat(doc, firsts) != np.maximum.reduceat(doc, firsts) if len(firsts) else np.zeros(0, bool)
        code = code[firsts]
        order = np.argsort(code % np.uint64(tasks), kind="stable")
        code, many = code[order], many[order]
        rows = [(t, key[0].as_py(), _bytes(code[s][~many[s]]), _bytes(code[s][many[s]])) for t, s in _dealt(code, tasks)]
        return _rows(rows, codes)

    def join_minimizers(table: pa.Table) -> pa.Table:
        pieces = table.column("piece").to_numpy()
        once, more = _read(table, "once"), _read(table, "more")
        code = _joined(once + more)
        where = np.repeat(np.concatenate([pieces, pieces]), [len(x) for x in once + more])
        sure = np.arange(len(code)) >= sum(map(len, once))
        order = np.argsort(code, kind="stable")
        code, where, sure = code[order], where[order], sure[order]
        firsts = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
        shared = np.append(firsts[1:], len(code)) - firsts > 1
        shared |= np.logical_or.reduceat(sure, firsts) if len(firsts) else shared
        keep = np.repeat(shared, np.diff(np.append(firsts, len(code))))
        code, where = code[keep], where[keep]
        order = np.argsort(where, kind="stable")
        code, where = code[order], where[order]
        edges = np.flatnonzero(np.append(True, where[1:] != where[:-1])[: len(where)])
        rows = [(int(where[a]), _bytes(code[a:b])) for a, b in zip(edges, np.append(edges[1:], len(where)))]
        return _rows(rows, {"piece": pa.int64(), "codes": pa.binary()})

    edge = {"task": pa.int64(), "piece": pa.int64(), **dict.fromkeys(["first", "second", "doc", "place"], pa.binary()), "many": pa.binary()}

    def send_edges(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        shared = np.sort(_joined(_read(answers, "codes")))
        if not table.num_rows or not len(shared):
            return _rows([], edge)
        piece = _Piece(table, width)
        which = np.flatnonzero(np.isin(kernels.mix(piece.minimizers(minimizer)), shared))
        first, second = piece.keys(which)
        doc = piece.doc[piece.row[which]]
        place = piece.at[which] - piece.bounds[piece.row[which]]
        order = np.lexsort((place, doc, second, first))
        first, second, doc, place = first[order], second[order], doc[order], place[order]
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))[: len(first)]
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts[1:], len(first)) - 1
        many = doc[firsts] != doc[lasts]
        first, second, doc, place = first[firsts], second[firsts], doc[firsts], place[firsts]
        order = np.argsort(first % np.uint64(tasks), kind="stable")
        first, second, doc, place, many = (x[order] for x in (first, second, doc, place, many))
        rows = [
            (t, key[0].as_py(), _bytes(first[s]), _bytes(second[s], _WIDTH["second"]), _bytes(doc[s].view(np.uint64)), _bytes(place[s].view(np.uint64)), many[s].tobytes())
            for t, s in _dealt(first, tasks)
        ]
        return _rows(rows, edge)

    source = {"piece": pa.int64(), **dict.fromkeys(["first", "second", "doc", "place"], pa.binary())}

    def join_edges(table: pa.Table) -> pa.Table:
        parts = {n: _read(table, n) for n in ("first", "second", "doc", "place")}
        where = np.repeat(table.column("piece").to_numpy(), [len(x) for x in parts["first"]])
        many = np.concatenate([np.frombuffer(x.as_py(), bool) for x in table.column("many")])
        first, second = _joined(parts["first"]), _joined(parts["second"])
        doc, place = _joined(parts["doc"]).view(np.int64), _joined(parts["place"]).view(np.int64)
        order = np.lexsort((place, doc, second, first))
        first, second, doc, place, where, many = (x[order] for x in (first, second, doc, place, where, many))
        firsts = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))[: len(first)])
        counts = np.diff(np.append(firsts, len(first)))
        doc, place = np.repeat(doc[firsts], counts), np.repeat(place[firsts], counts)  # the source's
        keep = np.repeat(counts > 1, counts) | many
        first, second, doc, place, where = (x[keep] for x in (first, second, doc, place, where))
        order = np.argsort(where, kind="stable")
        first, second, doc, place, where = (x[order] for x in (first, second, doc, place, where))
        edges = np.flatnonzero(np.append(True, where[1:] != where[:-1])[: len(where)])
        rows = []
        for a, b in zip(edges, np.append(edges[1:], len(where))):
            s = slice(a, b)
            rows.append((int(where[a]), _bytes(first[s]), _bytes(second[s], _WIDTH["second"]), _bytes(doc[s].view(np.uint64)), _bytes(place[s].view(np.uint64))))
        return _rows(rows, source)

    def remove(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        piece = _Piece(table, width)
        covered = np.zeros(len(piece.starts) + 1, np.int64)
        spans: list[list] = [[] for _ in range(table.num_rows)]
        first = _joined(_read(answers, "first"))
        if len(first):
            second, doc, place = (_joined(_read(answers, n)) for n in ("second", "doc", "place"))
            doc, place = doc.view(np.int64), place.view(np.int64)
            order = np.lexsort((second, first))
            first, second, doc, place = first[order], second[order], doc[order], place[order]
            which = np.flatnonzero(np.isin(kernels.windows(piece.words, width)[piece.at], first))
            a, b = piece.keys(which)
            slot = _find(first, second, a, b)
            own = piece.doc[piece.row[which]]
            hit = (slot >= 0) & (own > doc[np.maximum(slot, 0)])
            which, slot = which[hit], slot[hit]
            at, row = piece.at[which], piece.row[which]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + width, -1)
            src, there = doc[slot], place[slot]
            joint = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1) & (src[1:] == src[:-1]) & (there[1:] == there[:-1] + 1)
            begins = np.flatnonzero(np.append(True, ~joint)[: len(at)])
            lasts = np.append(begins[1:], len(at)) - 1
            for i, j in zip(begins, lasts):
                spans[row[i]].append(
                    {"start": int(at[i] - piece.bounds[row[i]]), "n_words": int(at[j] - at[i] + width), "source_id": int(src[i]), "source_start": int(there[i])}
                )
        gone = np.cumsum(covered)[:-1] > 0
        n_words = np.diff(piece.bounds)
        total = np.concatenate([[0], np.cumsum(gone)])
        n_removed = total[piece.bounds[1:]] - total[piece.bounds[:-1]]
        kept = []
        raw = piece.data.tobytes()
        for i in range(table.num_rows):
            words = raw[piece.offsets[i] : piece.offsets[i + 1]].split()
            if n_removed[i]:
                there = ~gone[piece.bounds[i] : piece.bounds[i + 1]]
                words = [words[k] for k in np.flatnonzero(there)]
            kept.append(b" ".join(words))
        return pa.table(
            {
                "doc_id": piece.ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                "spans": pa.array(spans, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "n_words", "source_id", "source_start")]))),
            }
        )

    sent = texts.applyInArrow(send_minimizers, "task long, piece long, once binary, more binary")
    shared = sent.groupBy("task").applyInArrow(join_minimizers, "piece long, codes binary")
    edges = texts.cogroup(shared.groupBy("piece")).applyInArrow(
        send_edges, "task long, piece long, first binary, second binary, doc binary, place binary, many binary"
    )
    sources = edges.groupBy("task").applyInArrow(join_edges, "piece long, first binary, second binary, doc binary, place binary")
    return texts.cogroup(sources.groupBy("piece")).applyInArrow(
        remove, f"doc_id long, n_words long, n_removed long, kept string, spans array<{SPAN}>"
    )


def _find(first: np.ndarray, second: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row of each key (a, b) in keys sorted by (first, second), or -1."""
    out = np.full(len(a), -1)
    slot = np.searchsorted(first, a)
    most = int(np.unique(first, return_counts=True)[1].max(initial=0))  # keys that share their first half
    for k in range(most):
        at = np.minimum(slot + k, len(first) - 1)
        out = np.where((slot + k < len(first)) & (first[at] == a) & (second[at] == b), at, out)
    return out

"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: numbers, names and units of measure are replaced by typed
placeholders.  Windows of template tokens of the documents and of the benchmark meet in
a hash join; aligned windows then have to agree in every literal token, and the values
that fill the slots have to be renamed consistently: one benchmark value has one value
in the document, and two names have two.  That finds copies and questions with other
numbers or names.  Names or number words in a row ('New York', 'twenty five') are one
slot.  A capital word that opens a sentence may be a name or not; its windows are looked
for either way.  Windows of plain lower-cased tokens are joined as well, for copies in
another case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm import kernels

#: Tokens in a window; shorter benchmark items are one window.
WIDTH = 13
#: Items of fewer tokens are in many texts by chance: they match only as whole sentences or lines.
SHORTEST = 5
#: Share of literal tokens that a template window must have.
LITERAL = 0.5
#: Bits of the table of benchmark windows that tasks test against (fixed, whatever the benchmark's size).
TABLE_BITS = 23
PIECE_BYTES = 2 << 20

# Words that are a unit after a number, and number words.
UNITS = """
mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds lb
lbs ounce ounces oz ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours h day
days week weeks month months year years percent cent cents dollar dollars usd euro euros eur degree degrees mph kmh
""".split()
NUMBER_WORDS = """
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen
nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million
""".split()

# Endings of a number, and words that are no name where they open a sentence.
ORDINALS = "st nd rd th".split()
FUNCTION_WORDS = """
a an the this that these those and or but if so as at by for from in into of off on to up with without about after before
between during over under until while since because although though when where who whom whose which what why how is are was
were be been being am do does did has have had can could will would shall should may might must not no nor yes he she it its
they them their his her him we us our you your i me my mine there here then than thus hence each every all any both some many
much more most few several other another such only also find let given suppose assume calculate compute determine
der die das den dem des ein eine einer eines einem einen und oder aber wenn als wie was wer wo warum ist sind war waren im in
an am auf aus bei mit nach von vom zu zum zur er sie es wir ihr ich du nicht kein keine
le la les un une des du de et ou mais si que qui quoi quand comment est sont dans sur avec pour par il elle ils elles on nous vous ne pas
el los las una unos unas y o pero como donde cuando es son en con por para del al se su sus no
""".split()

LITERAL_TOKEN, NUMBER, UNIT, NAME = 0, 1, 2, 3
#: Readings of a text: plain tokens, templates, templates with sentence openers as names.
PLAIN, STRICT, LOOSE = 0, 1, 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_WORD = _DIGIT | _UPPER
_WORD[97:123] = True
_WORD[128:] = True
_POINT = np.zeros(256, bool)
_POINT[[44, 46]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 58, 63]] = True  # a name is told by its capital letter only within a sentence
_JOINT = np.zeros(256, bool)
_JOINT[[32, 45]] = True  # what may be within a name or a number in words
#: Bytes of a character by its first one.
_WIDTHS = np.ones(256, np.int64)
_WIDTHS[0xC0:0xE0], _WIDTHS[0xE0:0xF0], _WIDTHS[0xF0:] = 2, 3, 4
#: Punctuation beyond ASCII.
_MARKS = "[\u00a0-\u00bf\u00d7\u00f7\u2000-\u206f\u3000-\u303f]+"
_RUN = np.uint64(0xA0761D6478BD642F)
_PLACEHOLDER = kernels.mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def _known(words: list[str]) -> np.ndarray:
    data, offsets = kernels.utf8(pa.array(words))
    return np.sort(kernels.hash_spans(data, offsets[:-1], offsets[1:]))


_UNIT_CODES, _NUMBER_CODES = _known(UNITS), _known(NUMBER_WORDS)
_ORDINAL_CODES, _FUNCTION_CODES = _known(ORDINALS), _known(FUNCTION_WORDS)


def _inside(raw: np.ndarray) -> np.ndarray:
    """Bytes of tokens: letters, digits, what isn't ASCII, and points and commas between digits."""
    inside = _WORD[raw]
    if len(raw) > 2:
        digit = _DIGIT[raw]
        inside[1:-1] |= _POINT[raw[1:-1]] & digit[:-2] & digit[2:]
    return inside


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of tokens; digits that open one are a token of their own ('5kg')."""
    starts, ends = kernels.spans(_inside(raw), offsets)
    if not len(starts):
        return starts, ends
    other = np.append(np.flatnonzero(~(_DIGIT[raw] | _POINT[raw])), len(raw))
    cut = other[np.searchsorted(other, starts)]
    split = (cut > starts) & (cut < ends)
    return np.sort(np.concatenate([starts, cut[split]])), np.sort(np.concatenate([ends, cut[split]]))


def _capital(raw: np.ndarray, at: np.ndarray, lower: np.ndarray, lower_at: np.ndarray) -> np.ndarray:
    """Whether the characters at some places differ from the small letters at theirs."""
    out = np.zeros(len(at), bool)
    for k in range(4):
        mine, theirs = np.minimum(at + k, len(raw) - 1), np.minimum(lower_at + k, len(lower) - 1)
        out |= (k < _WIDTHS[raw[at]]) & (raw[mine] != lower[theirs])
    return out


class Reading:
    """A sequence of tokens of a column of texts: ``code``, ``kind``, ``first`` (place among all tokens) and ``counts`` per text."""

    def __init__(self, code: np.ndarray, kind: np.ndarray, bounds: np.ndarray, joint: np.ndarray | None = None):
        first = np.arange(len(code))
        if joint is not None and len(code):  # a run of names, or of numbers, is one slot with a code of its own
            goes_on = np.zeros(len(code), bool)
            goes_on[1:] = joint[1:] & (kind[1:] == kind[:-1]) & np.isin(kind[1:], (NAME, NUMBER))
            first = np.flatnonzero(~goes_on)
            place = np.arange(len(code)) - first[np.cumsum(~goes_on) - 1]
            code = np.add.reduceat(code * kernels.powers(_RUN, int(place.max()) + 1)[place], first)
            kind, bounds = kind[first], np.searchsorted(first, bounds)
        self.code, self.kind, self.first, self.bounds = code, kind, first, bounds
        self.counts = np.diff(bounds)

    def windows(self, width: int, template: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First token, row and hash (0: too few literal tokens) of every window."""
        at = kernels.window_starts(self.counts, width)
        row = np.repeat(np.arange(len(self.counts)), np.maximum(self.counts - width + 1, 0))
        if not template:
            return at, row, kernels.windows(self.code, width, 0xE7037ED1A0B428DB)[at]
        slots = np.concatenate([[0], np.cumsum(self.kind > 0)])
        literal = width - (slots[at + width] - slots[at])
        code = kernels.windows(np.where(self.kind > 0, _PLACEHOLDER[self.kind], self.code), width)[at]
        return at, row, np.where(literal >= LITERAL * width, code, np.uint64(0))


class Tokens:
    """Readings of a column of texts; ``opens``: tokens that open a sentence or a line (and one more at the end)."""

    def __init__(self, column: pa.Array):
        column = pc.replace_substring_regex(column.fill_null("").cast(pa.string()), _MARKS, " ")
        raw, offsets = kernels.utf8(column)
        starts, ends = _tokens(raw, offsets)
        lower, lower_offsets = kernels.utf8(pc.utf8_lower(column))
        lower_starts, lower_ends = _tokens(lower, lower_offsets)
        if len(lower_starts) != len(starts):  # a letter without a lower-case letter of its own: fold A-Z only
            lower, lower_starts, lower_ends = _LOWER[raw], starts, ends
        code = kernels.hash_spans(lower, lower_starts, lower_ends)
        bounds = np.searchsorted(starts, offsets)
        n = len(starts)
        kind = np.zeros(n, np.int8)
        opens, joint, loose = np.zeros(n + 1, bool), np.zeros(n, bool), kind
        opens[bounds] = True
        if n:
            digits = np.add.reduceat(np.append(_DIGIT[raw] | _POINT[raw], False).astype(np.int32), np.stack([starts, ends], 1).ravel())[::2]
            number = _DIGIT[raw[starts]] & (digits == ends - starts)
            number |= np.isin(code, _NUMBER_CODES)
            stops, joints = (np.concatenate([[0], np.cumsum(x[raw])]) for x in (_STOP, _JOINT))
            opens[1:-1] |= stops[starts[1:]] > stops[ends[:-1]]
            gap = starts[1:] - ends[:-1]
            joint[1:] = ~opens[1:-1] & (gap > 0) & (joints[starts[1:]] - joints[ends[:-1]] == gap)
            head, lower_head = _WIDTHS[raw[starts]], _WIDTHS[lower[lower_starts]]
            more = ends - starts > head
            second, lower_second = (np.where(more, x + y, x) for x, y in ((starts, head), (lower_starts, lower_head)))
            capital = _capital(raw, starts, lower, lower_starts) & more & ~_capital(raw, second, lower, lower_second)
            kind[capital & ~opens[:-1]] = NAME
            kind[number] = NUMBER
            unit = np.zeros(n, bool)
            unit[1:] = number[:-1] & ~opens[1:-1] & np.isin(code[1:], _UNIT_CODES)
            attached = np.zeros(n, bool)
            attached[1:] = number[:-1] & (starts[1:] == ends[:-1])
            unit |= attached & np.isin(code, _ORDINAL_CODES)
            kind[unit] = UNIT
            loose = np.where(capital & opens[:-1] & (kind == LITERAL_TOKEN) & ~np.isin(code, _FUNCTION_CODES), NAME, kind).astype(np.int8)
        self.bounds, self.opens = bounds, opens
        opened = np.concatenate([[0], np.cumsum(kind != loose)])
        #: Texts whose loose reading is another one.
        self.loosened = opened[bounds[1:]] > opened[bounds[:-1]]
        self.readings = {PLAIN: Reading(code, np.zeros(n, np.int8), bounds), STRICT: Reading(code, kind, bounds, joint), LOOSE: Reading(code, loose, bounds, joint)}


_SCHEMA = "id long, place long, token long, width int, mode byte, hash long, codes array<long>, kinds array<tinyint>"


def _windows(table: DataFrame, widths: list[int], known: np.ndarray | None, whole_if_short: int | None) -> DataFrame:
    """Windows of a table (``id``, ``text``) that are in the table of bits ``known`` (all without one).

    ``place``: of the first token in its reading, ``token``: among all tokens of the text.
    """
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def rows(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        tokens = Tokens(texts)
        found = []
        for mode, reading in tokens.readings.items():
            for width in widths:
                if width < SHORTEST and mode != PLAIN:
                    continue
                at, row, code = reading.windows(width, mode != PLAIN)
                hit = code != 0
                if whole_if_short is not None and width != whole_if_short:
                    hit &= reading.counts[row] == width
                elif width < SHORTEST:  # a whole sentence or line
                    hit &= tokens.opens[at] & tokens.opens[at + width]
                if mode == LOOSE:
                    hit &= tokens.loosened[row]
                if known is not None:
                    hit &= (known[(code >> np.uint64(70 - TABLE_BITS)).astype(np.int64)] >> ((code >> np.uint64(64 - TABLE_BITS)) & np.uint64(63))) & np.uint64(1) > 0
                hit = np.flatnonzero(hit)
                at, row = at[hit], row[hit]
                flat = np.repeat(at, width) + np.tile(np.arange(width), len(at))
                found.append((
                    row, at - reading.bounds[row], reading.first[at] - tokens.bounds[row], np.full(len(at), width), np.full(len(at), mode), code[hit],
                    reading.code[flat], reading.kind[flat],
                ))
        row, place, token, width, mode, code, codes, kinds = (np.concatenate(x) for x in zip(*found))
        ends = np.concatenate([[0], np.cumsum(width)])
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(row)), pa.array(place, pa.int64()), pa.array(token, pa.int64()), pa.array(width, pa.int32()), pa.array(mode, pa.int8()),
                pa.array(code.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes.view(np.int64))),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(kinds)),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for i, j in kernels.pieces(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), PIECE_BYTES):
                yield rows(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i))

    return table.mapInArrow(run, _SCHEMA)


def _bit_table(windows: DataFrame) -> np.ndarray:
    """The hashes' leading bits as a table of 2 ** TABLE_BITS bits: its size is fixed, so tasks can be given it."""
    word = F.shiftrightunsigned("hash", 70 - TABLE_BITS)
    bit = F.shiftrightunsigned("hash", 64 - TABLE_BITS).bitwiseAND(63).cast("int")
    parts = windows.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).toPandas()
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    table[parts["word"].to_numpy(np.int64)] = parts["bits"].to_numpy(np.int64).view(np.uint64)
    return table


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", width: int = WIDTH
) -> DataFrame:
    """One row for every document and benchmark item with a common window that is filled consistently.

    ``doc_id``, ``item_id``, ``n_windows`` (window places of the document), ``first_token``
    (of the first window) and ``renamed`` (true if no window agrees word for word).
    Tokens are runs of letters and digits.  An item shorter than ``width`` tokens is one
    window; one of fewer than five tokens has to be a whole sentence or line, word for
    word.  Texts of any length are read whole.  Where several alignments or readings
    agree, each window place counts once, and the first of them is told.  Null texts are
    empty and rows without an id are left out, on both sides; repeated rows count as one
    document.  Empty tables give an empty result; other columns are not read.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).where("id is not null")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    key = ["id", "place", "width", "mode", "hash"]
    theirs = _windows(items, list(range(1, width + 1)), None, width).dropDuplicates(key)
    present = sorted(r["width"] for r in theirs.select("width").distinct().collect())  # at most thirteen widths
    if not present:
        present = [width]
    ours = _windows(slim, present, _bit_table(theirs), None).dropDuplicates(key)
    plain = (F.col("mode") == PLAIN).alias("plain")
    theirs = theirs.select(
        "width", plain, "hash", F.col("id").alias("item_id"), F.col("place").alias("item_place"), F.col("mode").alias("item_mode"),
        F.col("codes").alias("item_codes"), F.col("kinds").alias("item_kinds"),
    )
    ours = ours.select("width", plain, "hash", F.col("id").alias("doc_id"), "place", "token", "mode", "codes", "kinds")
    met = ours.join(theirs, ["width", "plain", "hash"])
    pairs = F.arrays_zip("kinds", "item_kinds", "codes", "item_codes")
    filled = lambda t: (t["kinds"] > 0) & (t["kinds"] == t["item_kinds"])
    met = met.where(F.forall(pairs, lambda t: (t["codes"] == t["item_codes"]) | filled(t))).select(
        "doc_id", "item_id", "mode", "item_mode", (F.col("place") - F.col("item_place")).alias("shift"), "token",
        (F.col("codes") == F.col("item_codes")).alias("same"),
        F.transform(F.filter(pairs, filled), lambda t: F.struct(t["kinds"].alias("kind"), t["item_codes"].alias("a"), t["codes"].alias("b"))).alias("slots"),
    )
    # one alignment of two readings: as many windows as the item has at most
    aligned = met.groupBy("doc_id", "item_id", "mode", "item_mode", "shift").agg(
        F.collect_set(F.struct("token", "same")).alias("windows"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")
    )
    single = lambda slots, *fields: F.size(F.array_distinct(F.transform(slots, lambda t: F.struct(*(t[f] for f in fields))))) == F.size(slots)
    renames = single(F.col("slots"), "kind", "a") & single(F.filter("slots", lambda t: t["kind"] == NAME), "b")
    places = aligned.select("doc_id", "item_id", renames.alias("renames"), F.explode("windows").alias("window"))
    places = places.where(F.col("window.same") | F.col("renames")).groupBy("doc_id", "item_id", "window.token").agg(F.max("window.same").alias("same"))
    return places.groupBy("doc_id", "item_id").agg(
        F.count("*").cast("int").alias("n_windows"), F.min("token").alias("first_token"), (~F.max("same")).alias("renamed")
    )

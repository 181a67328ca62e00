"""Near-duplicate lines by an exact set-similarity join.

Native DataFrame operations only.  A line is the set of its lower-cased words; a line
goes if an earlier one (by document id, then place) has a Jaccard similarity of at least
``threshold``.

1. Words are counted in a table of fixed size, and the words of every line are ordered
   by rarity.  Lines with equal sets are one class, whose first line stands for it.
2. A line has a least hash among the rarest quarter, and among all, of its words, under an order each (``HEADS``).  The lines of a hash are dealt to
   ``SHARES``; the first lines of these are the heads, and a line is compared with the head whose bitmap is nearest.  Rare words keep unrelated lines apart, so
   this settles most members of a large group of variants in one row a line.
3. Two similar sets share a word among their rarest ones (prefix filter), so the prefix
   words are joined.  Length, positional and bitmap bounds drop a pair within the join.
   Pairs whose later line is settled already are of no interest.
4. Pairs that are left are verified on 64-bit hashes of all words of both lines; equal sets are told by
   128 bits over such hashes as well.  The likeliest partner of a line comes first; other partners are verified
   only for lines that it doesn't settle.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.llm.tables import SPACES
from kontor.session import checkpoint_cut

THRESHOLD = Fraction(4, 5)
#: Rows of the table of word counts; its size does not depend on the data.
COUNT_BITS = 18
#: Bits of the table that tells which lines may have to be verified (fixed size as well).
LINE_BITS = 22

#: Orders of the words' hashes (nearest to a number, bit by bit), and the rarest part of a line's words that each is taken over.
HEADS = ((0, 4), (0x7314C8A95F6D, 1))
#: Words of a line whose second bitmap is of a part of them.
LONG = 96
#: Heads of a hash.
SHARES = 8

_LINE = 1 << 31  # lines of a document; a line's place is doc_id * _LINE + line_no


def _plain(text: Column) -> Column:
    """A text in lower case with blanks and line feeds as its only white space, since a plain split at single blanks is far cheaper than one at a pattern."""
    text = F.lower(text)
    for space in "\t\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return text


def _words(plain: Column) -> Column:
    return F.array_remove(F.split(plain, " "), "")


def _ranks(texts: DataFrame) -> DataFrame:
    """One row: the rank by frequency, as leading bits of a key, of each of 2 ** COUNT_BITS groups of words."""
    code = F.shiftrightunsigned(F.xxhash64("w"), 64 - COUNT_BITS).cast("int")
    counts = texts.select(F.explode(_words(F.replace(_plain(F.col("text")), F.lit("\n"), F.lit(" ")))).alias("w")).groupBy(code.alias("b")).agg(F.count("*").alias("c"))
    everything = texts.sparkSession.range(1 << COUNT_BITS).select(F.col("id").cast("int").alias("b"))
    counts = checkpoint_cut(everything.join(counts, "b", "left").select("b", F.coalesce("c", F.lit(0)).alias("c")))
    # the whole table is 262,144 small rows, whatever the number of words
    by_count = F.transform(F.array_sort(F.collect_list(F.struct("c", "b"))), lambda t: t["b"])
    order = counts.agg(by_count.alias("o")).select(F.posexplode("o").alias("rank", "b"))
    ranks = order.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "rank"))), lambda t: F.shiftleft(t["rank"].cast("long"), 63 - COUNT_BITS)).alias("ranks"))
    return checkpoint_cut(ranks)


def _place(doc_id: Column, line_no: Column) -> Column:
    return (doc_id.cast("decimal(19,0)") * F.lit(_LINE).cast("decimal(10,0)") + line_no).cast("decimal(31,0)")


def _line_of(place: Column) -> tuple[Column, Column]:
    line = F.pmod(place, F.lit(_LINE).cast("decimal(31,0)"))
    return ((place - line) / F.lit(_LINE).cast("decimal(31,0)")).cast("long"), line.cast("int")


def _lines(texts: DataFrame) -> DataFrame:
    """``line_no`` (from 0) and ``line`` (plain)."""
    return texts.select("doc_id", F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("line_no", "line"))


def _coded(texts: DataFrame, threshold: Fraction) -> DataFrame:
    """Lines with a word: document, number, size, set hashes, bitmap, least hash and prefix of words by rarity."""
    low = (1 << (63 - COUNT_BITS)) - 1
    blank = F.length(F.btrim("line")) == 0
    # a word's key: its group's rank, then the hash's other bits.  The table meets the words in one projection
    # and is used once there, so that Spark doesn't copy it into every row.
    # Keys are never null for Spark either, so that it sorts plain numbers.
    rank = lambda w: F.element_at("ranks", F.shiftrightunsigned(F.xxhash64(w), 64 - COUNT_BITS).cast("int") + 1)
    key = lambda w: F.coalesce(rank(w), F.lit(0).cast("long")).bitwiseOR(F.xxhash64(w).bitwiseAND(low))
    lines = _lines(texts).where(~blank).select("*", _ranks(texts).select("ranks").scalar().alias("ranks"))
    lines = lines.select("doc_id", "line_no", F.array_distinct(F.transform(_words(F.col("line")), key)).alias("k"))
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(63).cast("int"))

    def bitmap(k: Column) -> Column:
        return F.aggregate(k, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(one(k)))

    # of all words, and of half of a long line's; a word turns its bit, so that a bitmap is never full
    half = F.when(F.size("k") < LONG, F.lit(0).cast("long")).otherwise(bitmap(F.filter("k", lambda k: k.bitwiseAND(64) == 64)))
    lines = lines.select("doc_id", "line_no", F.size("k").alias("n"), bitmap(F.col("k")).alias("bits0"), half.alias("bits1"), F.sort_array("k").alias("k"))

    def head(near: int, part: int) -> Column:
        rare = F.slice("k", F.lit(1), F.ceil(F.col("n") / part).cast("int"))
        return F.array_min(F.transform(rare, lambda k: k.bitwiseAND(low).bitwiseXOR(F.lit(near).cast("long"))))

    least = [head(near, part) for near, part in HEADS]
    # the number of the order stands above the hash
    least = F.array(*(v.bitwiseOR(F.lit(i << (63 - COUNT_BITS)).cast("long")) for i, v in enumerate(least)))
    return lines.select(
        F.monotonically_increasing_id().alias("line"), F.col("doc_id").alias("doc"), F.col("line_no").alias("no"), "n", "bits0", "bits1", least.alias("least"),
        F.xxhash64("k").alias("h1"), F.xxhash64("k", F.lit(1)).alias("h2"),
        F.slice("k", F.lit(1), F.col("n") - F.ceil(F.col("n") * F.lit(threshold.numerator) / threshold.denominator).cast("int") + 1).alias("prefix"),
    )


def _hashed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """64-bit hashes of the words (``w``) of the lines that stand in ``pairs`` (``doc_a``, ``no_a``, ``doc_b``, ``no_b``), and of a few others."""
    ends = pairs.select(F.explode(F.array(*(F.struct(F.col(f"doc_{e}").alias("doc"), F.col(f"no_{e}").alias("no")) for e in "ab"))).alias("end")).select("end.*")

    def place(*key: str) -> tuple[Column, Column]:
        code = F.xxhash64(*key).bitwiseAND((1 << LINE_BITS) - 1)
        return F.shiftright(code, 6).cast("int"), code.bitwiseAND(63).cast("int")

    # one table for documents and lines: texts without such a line aren't split
    keys = (("doc",), ("doc", "no"))
    places = [F.struct(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")) for word, bit in (place(*key) for key in keys)]
    asked = ends.select(F.explode(F.array(*places)).alias("p")).select("p.*").groupBy("w").agg(F.bit_or("b").alias("b"))
    everything = texts.sparkSession.range(1 << (LINE_BITS - 6)).select(F.col("id").cast("int").alias("w"))
    table = everything.join(asked, "w", "left").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))), lambda t: t["b"]).alias("t")
    )
    table = checkpoint_cut(table)

    def among(rows: DataFrame, *key: str) -> DataFrame:
        word, bit = place(*key)
        return rows.where(F.getbit(F.element_at(table.select("t").scalar(), word + 1), bit) == 1)

    lines = among(_lines(among(texts, "doc_id")).withColumnsRenamed({"doc_id": "doc", "line_no": "no"}), "doc", "no")
    # words are hashed once a line and not once a pair
    return checkpoint_cut(lines.select("doc", "no", F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w))).alias("w")))


def _verified(pairs: DataFrame, hashed: DataFrame, threshold: Fraction) -> DataFrame:
    """Later lines (``doc``, ``no``) of the pairs that are similar enough, by 64-bit hashes of their whole word sets."""
    a, b = (hashed.select(F.col("doc").alias(f"doc_{e}"), F.col("no").alias(f"no_{e}"), F.col("w").alias(f"w_{e}")) for e in "ab")
    both = pairs.select("doc_a", "no_a", "doc_b", "no_b").join(a, ["doc_a", "no_a"]).join(b, ["doc_b", "no_b"])
    both = both.select("doc_a", "no_a", F.size(F.array_intersect("w_a", "w_b")).alias("common"), (F.size("w_a") + F.size("w_b")).alias("sum"))
    both = both.where(F.col("common") * threshold.denominator >= F.lit(threshold.numerator) * (F.col("sum") - F.col("common")))
    return both.select(F.col("doc_a").alias("doc"), F.col("no_a").alias("no"))


def _apart(n: Column, m: Column) -> Column:
    """Differing bits of the two bitmaps; every one is a word that isn't shared.  Halves are told apart if both lines are long."""
    every, half = (F.col(f"bits{k}_a").bitwiseXOR(F.col(f"bits{k}_b")) for k in (0, 1))
    return F.when((n < LONG) == (m < LONG), F.bit_count(every.bitwiseXOR(half)) + F.bit_count(half)).otherwise(F.bit_count(every))


def _bounds(n: Column, m: Column, num: int, den: int) -> Column:
    """Length bound, and the bound by the bitmaps."""
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & ((n + m - _apart(n, m)) * (num + den) >= 2 * num * (n + m))


def similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction | float = THRESHOLD) -> DataFrame:
    """``doc_id`` and ``line_no`` (from 0) of every line that has an earlier similar line.

    Lines end at a line feed; blank lines and null texts have no words and never match.
    Lines of rows without an id are left alone and match nothing.  Rows that repeat an
    id share their places: the same line of both is one, and ``line_no`` holds for each
    of them.
    """
    threshold = Fraction(threshold).limit_denominator(10_000)
    num, den = threshold.numerator, threshold.denominator
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    coded = checkpoint_cut(_coded(texts, threshold))
    place = _place(F.col("doc"), F.col("no")).alias("place")
    firsts = coded.select("h1", "h2", "line", place).groupBy("h1", "h2").agg(F.min("place").alias("first"), F.min_by("line", "place").alias("line"))
    doc, no = _line_of(F.col("first"))
    firsts = checkpoint_cut(firsts.select("line", doc.alias("doc"), no.alias("no")))
    copies = coded.select("line", "doc", "no").join(firsts.select("line"), "line", "left_anti").select("doc", "no")
    copies = copies.join(firsts.select("doc", "no"), ["doc", "no"], "left_anti")

    # step 2: the first lines of each least hash, in each order.  Copies may take part: what is similar to one has the first line as well
    keyed = coded.select(place, "n", F.col("bits0").alias("bits0_a"), F.col("bits1").alias("bits1_a"), "least")
    keyed = keyed.select("place", "n", "bits0_a", "bits1_a", F.explode("least").alias("least"))
    heads = keyed.groupBy("least", F.pmod(F.xxhash64("place"), F.lit(SHARES)).alias("share")).agg(
        F.min("place").alias("y"), F.min_by("n", "place").alias("n_b"), *(F.min_by(f"bits{k}_a", "place").alias(f"bits{k}_b") for k in (0, 1))
    )
    n, m = F.col("n"), F.col("n_b")
    met = keyed.join(heads, "least").where((F.col("place") > F.col("y")) & _bounds(n, m, num, den))
    # a head that looks the same is most likely a copy and settles nothing new
    met = met.select("place", "y", (_apart(n, m) / (n + m)).alias("apart"), (n == m).alias("even")).where("apart > 0 or not even")
    met = met.groupBy(F.col("place").alias("x")).agg(F.min_by("y", "apart").alias("y"))
    ends = (("a", *_line_of(F.col("x"))), ("b", *_line_of(F.col("y"))))
    met = checkpoint_cut(met.select(*(c.alias(f"{of}_{end}") for end, *both in ends for of, c in zip(("doc", "no"), both))))
    settled = checkpoint_cut(_verified(met, _hashed(met, texts), threshold))

    # step 3: prefix words; a row holds its line's document and number, so that pairs know which line is later
    known = firsts.join(settled.distinct().withColumn("s", F.lit(1).cast("long")), ["doc", "no"], "left")
    known = coded.select("line", "n", "bits0", "bits1", "prefix").join(known, "line")
    packed = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.coalesce("s", F.lit(0).cast("long")))
    rows = known.select("doc", "no", "bits0", "bits1", packed.alias("meta"), "prefix").select("doc", "no", "bits0", "bits1", "meta", F.posexplode("prefix").alias("i", "word"))
    rows = rows.select("word", "doc", "no", "bits0", "bits1", F.col("meta").bitwiseOR(F.shiftleft(F.col("i").cast("long"), 1)).alias("meta"))
    # both sides are renamed alike, so that Spark sees one exchange and deals the rows once
    a, b = (rows.select("word", *(F.col(c).alias(f"{c}_{side}") for c in ("doc", "no", "bits0", "bits1", "meta"))) for side in "ab")
    n, m = F.shiftright("meta_a", 32), F.shiftright("meta_b", 32)
    i, j = (F.shiftright(F.col(c).bitwiseAND(0xFFFFFFFF), 1) for c in ("meta_a", "meta_b"))
    later = (F.col("doc_a") > F.col("doc_b")) | ((F.col("doc_a") == F.col("doc_b")) & (F.col("no_a") > F.col("no_b")))
    # true unless the later line is settled; named over both sides, as a filter on one would part their exchange in two
    wanted = F.col("meta_a").bitwiseAND(1) * 2 <= F.col("meta_b").bitwiseAND(1)
    # the words before the first shared word of a pair aren't shared, and a similar pair has few of these; where they are too many, either
    # it isn't the first or the pair isn't similar, so what is left of a pair are its first shared words, without a gap
    enough = ((i + j) * (num + den) <= (n + m) * (den - num)) & ((1 + F.least(n - 1 - i, m - 1 - j)) * (num + den) >= num * (n + m))
    met = a.join(b, "word").where(later & wanted & enough & _bounds(n, m, num, den))
    # their number, and the place of the last of them, bound what can be shared at all
    # (size and bitmap keep lines apart that share a place, as an id is repeated)
    met = met.groupBy("doc_a", "no_a", "doc_b", "no_b", "bits0_a", "bits0_b", n.alias("n"), m.alias("m")).agg(
        F.count("*").alias("c"), F.max(i).alias("i"), F.max(j).alias("j")
    )
    beyond = F.least(F.col("n") - 1 - F.col("i"), F.col("m") - 1 - F.col("j"))
    alone = F.col("i") + F.col("j") + 2 - 2 * F.col("c")
    possible = met.where((F.col("c") + beyond) * (num + den) >= num * (F.col("n") + F.col("m")))
    possible = possible.where(alone * (num + den) <= (F.col("n") + F.col("m")) * (den - num))
    pairs = checkpoint_cut(possible.select("doc_a", "no_a", "doc_b", "no_b", (F.col("c") / (F.col("n") + F.col("m"))).alias("share")))
    hashed = _hashed(pairs, texts)
    # one earlier line is enough: the likeliest first, and all the others of a line that it didn't settle
    best = pairs.groupBy("doc_a", "no_a").agg(F.max_by(F.struct("doc_b", "no_b"), F.struct("share", "doc_b", "no_b")).alias("b"))
    best = checkpoint_cut(best.select("doc_a", "no_a", "b.*"))
    sure = checkpoint_cut(_verified(best, hashed, threshold))
    open_ = pairs.join(sure.select(F.col("doc").alias("doc_a"), F.col("no").alias("no_a")), ["doc_a", "no_a"], "left_anti")
    open_ = open_.join(best, ["doc_a", "no_a", "doc_b", "no_b"], "left_anti")
    rest = _verified(open_, hashed, threshold)

    gone = copies.union(settled).union(sure).union(rest).distinct()
    return gone.select(F.col("doc").alias("doc_id"), F.col("no").alias("line_no"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction | float = THRESHOLD) -> DataFrame:
    """``docs`` without their similar later lines: all rows and columns stay, ``text_col`` is rewritten.

    A document whose lines all go keeps an empty text.
    """
    gone = similar_lines(docs, id_col, text_col, threshold).groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone"))
    gone = gone.withColumnRenamed("doc_id", "_gone_id")
    kept = F.filter(F.split(docs[text_col], "\n"), lambda _, i: ~F.array_contains(gone["_gone"], i))
    joined = docs.join(gone, docs[id_col].cast("long") == gone["_gone_id"], "left")
    text = F.when(gone["_gone"].isNull(), docs[text_col]).otherwise(F.array_join(kept, "\n"))
    return joined.select(*(text.alias(c) if c == text_col else docs[c] for c in docs.columns))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction | float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_removed`` and ``removed`` (places from 0, rising) of every row."""
    gone = similar_lines(docs, id_col, text_col, threshold).groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    n_lines = F.coalesce(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), n_lines.alias("n_lines"))
    return sizes.join(gone, "doc_id", "left").select(
        "doc_id", "n_lines", F.size(F.coalesce("removed", F.array())).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )

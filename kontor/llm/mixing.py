"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Native DataFrame operations only.  Every source is a stream: its documents in the order
of a keyed hash, one after the other, cut into blocks of ``block_words`` words, and read
again from the start when it ends.  Van der Corput points, mapped through the cumulative
targets, deal out slots to sources; the r-th slot of a source takes its r-th block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.llm.tables import n_words, shuffle_partitions
from kontor.session import checkpoint_cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 64
#: Cells of the unit interval in which points meet sources.
CELLS = 4096
#: Slots that are ranked in one sort.
RUN = 1 << 16
SEED = "mix"
#: Binary digits of a van der Corput point.
DIGITS = 48


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``target`` of every source: ``share`` of all words by weight, at most ``most`` times its size.

    ``sizes``: one row for each ``source`` with ``source_size``.  The level L with
    sum(min(most * size, L * weight)) = share * all words is the greatest that any set of
    filled sources, taken by rising size per weight, asks of the others.  The windows run
    over one row per source, not over documents.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    table = sizes.withColumn("n", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    )
    table = table.withColumn("cap", (F.col("source_size") * most).cast("long"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    everything = Window.partitionBy()
    left_words = share * F.sum("source_size").over(everything) - (F.sum("cap").over(filling) - F.col("cap"))
    left_weight = F.sum("weight").over(everything) - (F.sum("weight").over(filling) - F.col("weight"))
    table = table.withColumn("asked", left_words / left_weight)
    return table.select(
        "source", "source_size", "n",
        F.least(F.col("cap").cast("double"), F.max("asked").over(everything) * F.col("weight")).alias("target"),
    )


def van_der_corput(i: Column) -> Column:
    digits = F.reverse(F.lpad(F.bin(i), DIGITS, "0"))
    return F.conv(digits, 2, 10).cast("double") / float(2**DIGITS)


def slots(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``n`` (source), ``rank`` and ``slot`` (place in the mix) of every block that the mix takes.

    ``sources``: ``n`` and ``words`` (words to take).  Slots that a source is dealt beyond
    its blocks are left out, blocks that it is dealt no slot for follow at the end.
    """
    need = sources.withColumn("blocks", F.ceil(F.col("words") / block_words))
    everything, order = Window.partitionBy(), Window.orderBy("n")
    total = F.sum("blocks").over(everything)
    need = checkpoint_cut(
        need.withColumns({"all_blocks": total, "high": F.sum("blocks").over(order) / total}).withColumn(
            "low", F.coalesce(F.lag("high").over(order), F.lit(0.0))
        )
    )
    runs = need.groupBy().agg(F.max("all_blocks").alias("m")).where("m > 0")
    points = runs.select("m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / RUN))).alias("run"))
    points = points.repartition(shuffle_partitions(sources), "run").select(
        "run", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("m")) - 1)).alias("slot")
    )
    points = points.withColumn("u", van_der_corput(F.col("slot"))).withColumn("cell", F.floor(F.col("u") * CELLS))
    # a source is in every cell that it overlaps: CELLS rows and one more for each source
    held = need.where("blocks > 0").select(
        "n", "low", "high",
        F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"),
    )
    dealt = points.join(held, "cell").where("u >= low and u < high").select("n", "run", "slot")
    # rank in two steps: slots of a source before this run, then within it
    dealt = checkpoint_cut(dealt)
    counts = dealt.groupBy("n", "run").agg(F.count("*").alias("c"))
    before = Window.partitionBy("n").orderBy("run")
    counts = counts.withColumn("before", F.sum("c").over(before) - F.col("c"))
    within = Window.partitionBy("n", "run").orderBy("slot")
    ranked = dealt.withColumn("k", F.row_number().over(within) - 1).join(counts, ["n", "run"])
    ranked = ranked.select("n", (F.col("before") + F.col("k")).alias("rank"), "slot")
    taken = ranked.join(need.select("n", "blocks"), "n").where("rank < blocks").select("n", "rank", "slot")
    got = counts.groupBy("n").agg(F.sum("c").alias("got"))
    late = need.join(got, "n", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < blocks")
    late = late.select("n", F.explode(F.sequence("got", F.col("blocks") - 1)).alias("rank"), "all_blocks")
    return taken.union(late.select("n", "rank", (F.col("all_blocks") + F.col("rank")).alias("slot")))


def mix(
    docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, seed: str = SEED,
) -> DataFrame:
    """One row per row of ``docs``: ``size``, ``source_size``, ``target`` (of its source), ``taken``, ``first_slot``.

    ``taken``: words of the document that the mix takes, repeats counted, at most ``most``
    (two here) times its size; a source's sum is its target to the nearest word.
    ``first_slot``: place in the mix of the block that holds its first word, null where
    none does.  A null or blank text has size 0 and is never taken; null sources are one
    source, last in order; a null id is ordered like an empty one.  Repeated rows are
    documents of their own.  The same rows give the same result in any order.
    """
    sized = checkpoint_cut(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    )
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    sources = checkpoint_cut(sources.withColumn("words", F.floor(F.col("target") + 0.5)))
    # streams: words of a source before each document, in two steps
    code = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = sized.withColumn("code", code).withColumn("part", F.substring("code", 1, 3))
    parts = placed.groupBy("source", "part").agg(F.sum("size").alias("s"))
    parts = parts.withColumn("before", F.sum("s").over(Window.partitionBy("source").orderBy("part")) - F.col("s"))
    parts = parts.join(sources, parts.source.eqNullSafe(sources.source)).select(parts.source, "part", "before", "n", "source_size", "target", "words")
    within = Window.partitionBy("source", "part").orderBy("code", F.asc_nulls_last("doc_id"), "size")
    placed = placed.withColumns({"at": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), "row": F.row_number().over(within)})
    placed = placed.withColumnRenamed("source", "src").withColumnRenamed("part", "of")
    placed = placed.join(parts, F.col("src").eqNullSafe(F.col("source")) & (F.col("of") == F.col("part"))).select(
        "doc_id", "n", "of", "row", "size", "source_size", "target", "words", (F.col("before") + F.coalesce("at", F.lit(0))).alias("at")
    )
    placed = checkpoint_cut(placed)
    # blocks of both passes over the stream that a document lies in, as far as the mix goes
    starts = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.col("at") + e * F.col("source_size"))
    pieces = placed.where("size > 0").select("n", "of", "row", "size", "words", F.explode(starts).alias("from"))
    pieces = pieces.where(F.col("from") < F.col("words")).select(
        "n", "of", "row", "from", F.least(F.col("from") + F.col("size"), F.col("words")).alias("to")
    )
    blocks = pieces.select(
        "*", F.explode(F.sequence(F.floor(F.col("from") / block_words), F.floor((F.col("to") - 1) / block_words))).alias("rank")
    )
    met = blocks.join(slots(sources.select("n", "words"), block_words), ["n", "rank"])
    words = F.least(F.col("to"), (F.col("rank") + 1) * block_words) - F.greatest(F.col("from"), F.col("rank") * block_words)
    got = met.groupBy("n", "of", "row").agg(
        F.sum(words).alias("got"), F.min(F.struct("from", "rank", "slot")).getField("slot").alias("first_slot")
    )
    return placed.join(got, ["n", "of", "row"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"), "first_slot"
    )

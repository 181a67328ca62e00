"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.session import checkpoint_cut


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of the component) of every node that has an edge.

    ``edges``: longs ``a`` and ``b``.  Each round links every node's larger neighbours to
    its least neighbour and then its smaller ones; rounds end when nothing changes, after
    about the logarithm of the longest path.  Every step is an aggregate with map-side
    combine and a join, so a node with very many edges is met by skew splitting.
    """
    now = checkpoint_cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        grown = checkpoint_cut(_small_star(_large_star(now)))
        changed = grown.exceptAll(now).limit(1).count() + now.exceptAll(grown).limit(1).count()
        now = grown
        if not changed:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

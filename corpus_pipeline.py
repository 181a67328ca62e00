"""Cleaning pipeline over ``documents``: each stage works on what the one before has kept.

Rows without an id can't be named by a decision; filtering stages keep them, except where
the quality stage's rules need none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.llm import decontaminate, lines, mixing, quality, simhash
from kontor.llm.tables import read
from kontor.session import checkpoint_cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _without(docs, quality.quality(docs).where("not kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later similar lines go; ``n_chars`` follows the text."""
    out = lines.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return _without(docs, simhash.near_duplicates(docs).where("component_id < doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return _without(docs, decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document that is left."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("source mix", source_mix),
]

#: The quality, SimHash and template stages can't be told in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint_cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

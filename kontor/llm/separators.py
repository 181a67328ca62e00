"""Token counts from flat token files by a scan for end-of-document identifiers.

A token file is a run of fixed-width identifiers without an index; every document ends
with one separator.  Files are read as blocks of a fixed number of tokens.  Tasks find
the separators of a block with one vector comparison; a prefix scan over one small row
per block (tokens, separators and last separator before it) then stitches documents that
cross blocks.  Texts are not needed.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontor.session import scratch_dir

#: Ranks of a public byte-level vocabulary; a path that every executor can read.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's separator, and its public rule for splitting texts.
SEPARATOR = 50256
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
TOKEN_BYTES = 2
BLOCK_TOKENS = 1 << 18


def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Token files of ``docs``: ``file``, ``block``, ``data`` (little-endian identifiers), and ``ids``.

    Each partition is a file; ``ids`` are those of the documents that end in the block,
    in order (a side list; the scan doesn't read it).  A null text is an empty document.
    """
    kind = np.dtype(f"<u{TOKEN_BYTES}")
    names = ["file", "block", "data", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode_ordinary
        file = TaskContext.get().partitionId()
        block, held, count, ids = 0, [], 0, []

        def row(data: np.ndarray, ids: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([data.tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names=names
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                tokens = encode(text.as_py() or "")
                tokens.append(separator)
                held.append(np.array(tokens, kind))
                count += len(tokens)
                while count > block_tokens:  # a full block that this document doesn't end
                    flat = np.concatenate(held)
                    yield row(flat[:block_tokens], ids)
                    held, count, ids, block = [flat[block_tokens:]], count - block_tokens, [], block + 1
                ids.append(doc_id.as_py())
        if count:
            yield row(np.concatenate(held), ids)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "file long, block long, data binary, ids array<long>")


def write_files(blocks: DataFrame) -> DataFrame:
    """``blocks`` written to the shared folder and read again."""
    path = f"{scratch_dir(blocks.sparkSession)}/tokens-{uuid.uuid4().hex}"
    blocks.write.option("compression", "zstd").parquet(path)
    return blocks.sparkSession.read.schema(blocks.schema).parquet(path)


def read_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, token_bytes: int = TOKEN_BYTES) -> DataFrame:
    """``file`` (its path), ``block`` and ``data`` of flat token files in a store that Spark reads.

    Spark's binary source holds one file in memory, so files should be shards of at most
    some hundred megabytes; beyond a block nothing else is held in a task.
    """
    size = block_tokens * token_bytes
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    blocks = files.select(F.col("path").alias("file"), "content", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block"))
    return blocks.select("file", "block", F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("data"))


def documents(blocks: DataFrame, separator: int = SEPARATOR, token_bytes: int = TOKEN_BYTES) -> DataFrame:
    """``file``, ``ordinal``, ``start``, ``n_tokens`` and ``closed`` of every document of the files.

    ``start`` counts tokens from the file's first; ``n_tokens`` leaves the separator out.
    Tokens after a file's last separator are a document with ``closed`` false.  Separators
    next to each other enclose an empty document.  Blocks may come in any order, may be
    of unlike size and must not repeat; a null or empty ``data`` has no tokens.
    """
    kind = np.dtype(f"<u{token_bytes}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(d.as_py() or b"", kind) for d in batch.column(2)]
            ends = [np.flatnonzero(x == separator) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in found], pa.int64()), pa.array(ends, pa.list_(pa.int64()))],
                names=["file", "block", "n", "ends"],
            )

    file_type = dict(blocks.dtypes)["file"]
    scanned = blocks.select("file", "block", "data").mapInArrow(run, f"file {file_type}, block long, n long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = scanned.withColumns(
        {"offset": F.coalesce(F.sum("n").over(before), F.lit(0)), "ordinal": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long")}
    ).withColumn("ends", F.transform("ends", lambda e: e + F.col("offset")))
    placed = placed.withColumn("last", F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(-1)) + 1)
    closed = placed.select("file", "ordinal", "ends", "last", F.posexplode("ends").alias("i", "end")).select(
        "file", (F.col("ordinal") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("last")).otherwise(F.element_at("ends", F.greatest("i", F.lit(1))) + 1).alias("start"), "end",
    )
    closed = closed.select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("closed"))
    ends = placed.groupBy("file").agg(
        F.sum(F.size("ends")).cast("long").alias("ordinal"), F.coalesce(F.max(F.array_max("ends")) + 1, F.lit(0).cast("long")).alias("start"), F.sum("n").alias("all")
    )
    rest = ends.where("all > start").select("file", "ordinal", "start", (F.col("all") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(rest)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` packed into token files, scanned, and matched with the packing's side list: ``doc_id`` and its document."""
    blocks = write_files(pack(docs, id_col, text_col, vocabulary, separator, block_tokens))
    found = documents(blocks, separator).where("closed").drop("closed")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sides = blocks.select("file", "block", "ids").withColumn("first", F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)).cast("long"))
    sides = sides.select("file", "first", F.posexplode("ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return sides.join(found, ["file", "ordinal"], "full").select("doc_id", "file", "ordinal", "start", "n_tokens")

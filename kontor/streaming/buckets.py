"""A copy-on-write table of companies in buckets.

A row lies in the bucket (hash of its city, hash of its name).  A batch writes new versions of the
buckets whose rows it changes and leaves the files of all others alone; the manifest of a batch names the version
of every bucket.  What is compared for duplicates is in one city, so a batch reads the buckets of its
cities only.  A manifest has one row a bucket, whatever the table's size.

``data/batch=<id>`` belongs to one batch and is overwritten on a retry; the manifest is
written last and marks the batch as done.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Buckets by city, and by name within a city's bucket.  A table keeps the numbers it was made with.
CITIES, NAMES = 32, 8

_MANIFEST = "cb int, nb int, version bigint, rows bigint, top bigint, cities int, names int, batch bigint"


def place(df: DataFrame, cities: int, names: int) -> DataFrame:
    """``df`` with its bucket (cb, nb)."""
    return df.withColumns({
        "cb": F.pmod(F.xxhash64("city"), F.lit(cities)).cast("int"), "nb": F.pmod(F.xxhash64("company_name"), F.lit(names)).cast("int"),
    })


def manifest(spark: SparkSession, root: str, before: int | None = None) -> list[Row] | None:
    """The buckets of the newest finished batch, or of the newest one older than ``before``.

    Only at the first batch a missing folder means that nothing is written yet; later
    on, and for any other fault, reading fails rather than starting from an empty table.
    """
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        newest = rows.agg(F.max("batch")).first()[0]
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND" or (before or 0) > 0:
            raise
        newest = None
    return None if newest is None else rows.filter(F.col("batch") == newest).filter("cb >= 0").collect()


def read(spark: SparkSession, root: str, buckets: list[Row], schema: StructType) -> DataFrame:
    """Rows of the given buckets of a manifest."""
    if not buckets:
        return spark.createDataFrame([], schema)
    paths = [f"{root}/data/batch={b.version}/cb={b.cb}/nb={b.nb}" for b in buckets]
    return spark.read.schema(schema).parquet(*paths)


def write(rows: DataFrame, root: str, batch: int, old: list[Row], touched: set[tuple[int, int]] | None, cities: int, names: int) -> None:
    """New versions of the ``touched`` buckets (None: all) from ``rows``, then the manifest.

    ``rows`` holds every row of a touched bucket; rows of other buckets are left out.
    """
    spark = rows.sparkSession
    placed = place(rows, cities, names)
    if touched is not None:
        wanted = F.array(*(F.lit(cb * names + nb) for cb, nb in sorted(touched))) if touched else F.array().cast("array<int>")
        placed = placed.filter(F.array_contains(wanted, F.col("cb") * names + F.col("nb")))
    folder = f"{root}/data/batch={batch}"
    placed.repartition("cb", "nb").write.mode("overwrite").partitionBy("cb", "nb").parquet(folder)
    kept = [(b.cb, b.nb, b.version, b.rows, b.top) for b in old if touched is not None and (b.cb, b.nb) not in touched]
    # a batch without buckets still has to be told from one that isn't finished
    kept.append((-1, -1, batch, 0, -1))
    new = []
    if touched is None or touched:
        schema = StructType([*rows.schema.fields, StructField("cb", IntegerType()), StructField("nb", IntegerType())])
        found = spark.read.schema(schema).parquet(folder).groupBy("cb", "nb").agg(F.count("*"), F.max("id"))
        new = [(r[0], r[1], batch, r[2], r[3]) for r in found.collect()]  # one row a bucket
    entries = [(*row, cities, names) for row in kept + new]
    spark.createDataFrame(entries, _MANIFEST.removesuffix(", batch bigint")).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/batch={batch}")


def seed(rows: DataFrame, root: str, batch: int = 0, cities: int = CITIES, names: int = NAMES) -> None:
    """Write a whole table as the first batch."""
    write(rows, root, batch, [], None, cities, names)

"""Running sums and carried values that do not put a whole key into one task.

A plain ordered window sends all rows of a key to one task, so a key that holds a
third of the table does too.  Here the rows are cut into ranges of the total order (keys,
order) of about equal size, whatever the keys and however close the times lie; the window runs inside (keys, range), and a
prefix scan over one small row per key and range supplies what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.session import checkpoint_cut

RANGE = "_range"


def _ordered(order: list[str], reverse: bool) -> list[Column]:
    return [F.desc(c) if reverse else F.asc(c) for c in order]


def in_ranges(df: DataFrame, keys: list[str], order: list[str], reverse: bool = False) -> DataFrame:
    """``df`` with its range, written once: bounds come from a sample, so they must not be drawn again.

    There are as many ranges as shuffle partitions.  Rows that are equal in ``keys`` and ``order`` are in one range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *_ordered(order, reverse))
    return checkpoint_cut(ranged.withColumn(RANGE, F.spark_partition_id()))


def carry(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    reverse: bool = False,
) -> DataFrame:
    """Add running values in the total order ``order`` (falling if ``reverse``) within ``keys``.

    ``sums``: inclusive running sum of each expression.  ``lasts``: last non-NULL
    value of each expression in the rows strictly before the current one.  Null keys are equal.
    A table that is in ranges of this order stays so, for further calls.
    """
    sums, lasts = sums or {}, lasts or {}
    held = RANGE in df.columns
    base = df if held else in_ranges(df, keys, order, reverse)
    work = base.withColumns({f"_s_{n}": c for n, c in sums.items()} | {f"_l_{n}": c for n, c in lasts.items()})
    position = F.struct(*[F.col(c) for c in order])
    newest = F.min_by if reverse else F.max_by
    per_range = work.groupBy(*keys, RANGE).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums],
        *[newest(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), position)).alias(f"_e_{n}") for n in lasts],
    )
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *[F.col(c).alias(f"_k_{c}") for c in [*keys, RANGE]],
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.last(f"_e_{n}", ignorenulls=True).over(earlier).alias(f"_p_{n}") for n in lasts],
    )
    inside = Window.partitionBy(*keys, RANGE).orderBy(*_ordered(order, reverse))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = work.withColumns(
        {f"_s_{n}": F.sum(f"_s_{n}").over(upto) for n in sums}
        | {f"_l_{n}": F.last(f"_l_{n}", ignorenulls=True).over(before) for n in lasts}
    )
    met = F.lit(True)
    for c in [*keys, RANGE]:
        met = met & local[c].eqNullSafe(offsets[f"_k_{c}"])
    return local.join(offsets, met).select(
        *[local[c] for c in df.columns],
        *[(F.coalesce(F.col(f"_s_{n}"), F.lit(0)) + F.col(f"_o_{n}")).alias(n) for n in sums],
        *[F.coalesce(f"_l_{n}", f"_p_{n}").alias(n) for n in lasts],
    )


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 1 in the total order ``order``."""
    return carry(df, [], order, sums={name: F.lit(1).cast("bigint")})


def following(df: DataFrame, keys: list[str], us: str, order: str, ahead: int, value: str, name: str) -> DataFrame:
    """Add ``name``: ``value`` of the key's first row at least ``ahead`` later (in units of ``us``), in the order (us, order).

    An as-of join by a scan: rows and questions stand in one falling order, a question after all rows that are late enough.
    """
    kinds = dict(df.dtypes)
    rows = df.select(*keys, F.col(us).alias("_at"), F.lit(1).alias("_row"), F.col(order).alias("_order"), F.col(value).alias("_value"), F.lit(None).cast(kinds[value]).alias("_asks"))
    asks = df.select(
        *keys, (F.col(us) + ahead).alias("_at"), F.lit(0).alias("_row"), F.col(order).alias("_order"), F.lit(None).cast(kinds[value]).alias("_value"), F.col(value).alias("_asks")
    )
    seen = carry(rows.unionByName(asks), keys, ["_at", "_row", "_order"], lasts={name: F.col("_value")}, reverse=True)
    return seen.filter("_row = 0").select(*keys, F.col("_asks").alias(value), name)

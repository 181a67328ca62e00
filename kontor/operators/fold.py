"""Ordered per-key folds for rules that depend on their own earlier decisions.

Rows are cut into ranges of (key, time), so a key that never pauses is spread over many tasks.
A piece (the rows of a key in one range) is run from the state that the piece before it ends in.  Since that is not known
at first, all pieces start from nothing; then those whose entry turns out to be another one are run
again, until no entry changes.  States that a pause or the rule itself makes equal stop the correction; what is left
is a wave that passes each piece once.  Only the states go from piece to piece.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.operators.prefix import RANGE, carry, in_ranges
from kontor.session import checkpoint_cut

Step = Callable[[int], tuple[bool, int]]


def segments(df: DataFrame, key: str, ts: str, order: str, pause_seconds: int) -> DataFrame:
    """Add ``segment``: it grows whenever the key has paused for ``pause_seconds`` or more."""
    micros = F.unix_micros(ts)
    seen = carry(in_ranges(df, [key], [ts, order]), [key], [ts, order], lasts={"_prev": micros})
    starts = F.col("_prev").isNull() | (micros - F.col("_prev") >= F.lit(pause_seconds * 1_000_000))
    # every ``carry`` reads its input twice, so the first result is written once
    return carry(checkpoint_cut(seen), [key], [ts, order], sums={"segment": starts.cast("bigint")}).drop("_prev", RANGE)


def fold_pieces(df: DataFrame, key: str, ts: str, order: str, memory_seconds: int, make_step: Callable[[list[int]], tuple[Step, Callable[[], list[int]]]]) -> DataFrame:
    """Run a step function over every key in time order; the result is ``df`` plus ``accepted`` and ``in_window``.

    ``make_step(entry)`` gives a step, which takes a row's time in microseconds and returns (decision, count), and a function
    that tells the state so far: times, none of which counts ``memory_seconds`` later.  ``entry`` is such a state.
    """
    memory = memory_seconds * 1_000_000
    base = in_ranges(df.withColumn("_us", F.unix_micros(ts)), [key], [ts, order])
    spans = base.groupBy(key, RANGE).agg(F.min("_us").alias("first"), F.max("_us").alias("last"))
    by_key = Window.partitionBy(key).orderBy(RANGE)  # a row a range
    spans = spans.withColumns({"from": F.lag(RANGE).over(by_key), "until": F.lag("last").over(by_key)})
    leaning = checkpoint_cut(spans.filter(F.col("first") < F.col("until") + memory).select(key, RANGE, "from", "first"))
    entries = leaning.limit(0).select(key, RANGE, F.array().cast("array<bigint>").alias("entry"))
    if not leaning.isEmpty():
        sources = checkpoint_cut(leaning.select(key, F.col("from").alias(RANGE)).distinct())
        exits = checkpoint_cut(_run(_of(base, sources, key), entries, key, ts, order, make_step, states=True))
        while True:
            left = exits.select(F.col(key).alias("_k"), F.col(RANGE).alias("_r"), "state")
            met = leaning[key].eqNullSafe(left["_k"]) & (leaning["from"] == left["_r"])
            alive = F.filter("state", lambda t: t > F.col("first") - memory)
            now = checkpoint_cut(leaning.join(left, met).select(key, RANGE, alive.alias("entry")).filter(F.size("entry") > 0))
            # a piece whose entry is no longer what it was run from; an entry that is gone counts as well
            moved = now.exceptAll(entries).unionByName(entries.exceptAll(now)).select(key, RANGE).distinct()
            entries, todo = now, checkpoint_cut(_of(moved, sources, key))
            if todo.isEmpty():
                break
            again = _run(_of(base, todo, key), entries, key, ts, order, make_step, states=True)
            exits = checkpoint_cut(_of(exits, todo, key, "left_anti").unionByName(again))
    return _run(base, entries, key, ts, order, make_step, states=False).drop(RANGE, "_us")


def _of(rows: DataFrame, pieces: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    other = pieces.select(F.col(key).alias("_k"), F.col(RANGE).alias("_r"))
    return rows.join(other, rows[key].eqNullSafe(other["_k"]) & (rows[RANGE] == other["_r"]), how)


def _run(rows: DataFrame, entries: DataFrame, key: str, ts: str, order: str, make_step, states: bool) -> DataFrame:
    """Decisions of every row, or the last state of every piece."""
    given = entries.select(F.col(key).alias("_k"), F.col(RANGE).alias("_r"), F.col("entry").alias("_entry"))
    work = rows.select(key, RANGE, ts, order, "_us") if states else rows
    ready = work.join(given, work[key].eqNullSafe(given["_k"]) & (work[RANGE] == given["_r"]), "left").drop("_k", "_r")
    if states:
        schema = T.StructType([work.schema[key], work.schema[RANGE], T.StructField("state", T.ArrayType(T.LongType()))])
    else:
        schema = T.StructType([*work.schema.fields, T.StructField("accepted", T.BooleanType()), T.StructField("in_window", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step, state = None, None, None
        for batch in batches:
            decisions, ends = [], []
            for k, piece, us, entry in zip(batch[key], batch[RANGE], batch["_us"], batch["_entry"]):
                mark = (None if pd.isna(k) else k, piece)
                if mark != current:
                    if states and current is not None:
                        ends.append((*current, state()))
                    current = mark
                    step, state = make_step([] if entry is None else [int(t) for t in entry])
                decisions.append(step(us))
            if not states:
                yield batch.drop(columns="_entry").assign(accepted=[d[0] for d in decisions], in_window=[d[1] for d in decisions])
            elif ends:
                yield pd.DataFrame(ends, columns=[key, RANGE, "state"])
        if states and current is not None:
            yield pd.DataFrame([(*current, state())], columns=[key, RANGE, "state"])

    placed = ready.repartition(key, RANGE).sortWithinPartitions(key, RANGE, ts, order)
    return placed.mapInPandas(run, schema)


def admission_step(limit: int, width_seconds: int) -> Callable[[list[int]], tuple[Step, Callable[[], list[int]]]]:
    """Accept a row while fewer than ``limit`` rows were accepted in the last window."""
    width = width_seconds * 1_000_000

    def make(entry: list[int]) -> tuple[Step, Callable[[], list[int]]]:
        admitted = deque(entry)

        def step(us: int) -> tuple[bool, int]:
            while admitted and admitted[0] <= us - width:
                admitted.popleft()
            used = len(admitted)
            if used >= limit:
                return False, used
            admitted.append(us)
            return True, used

        return step, lambda: list(admitted)

    return make

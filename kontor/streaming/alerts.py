"""Alert rules on streams: the batch window expressions plus a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kontor.operators.monitor import _seconds


def windowed_stream(
    df: DataFrame, ts: str, width: str, slide: str, keys: list[str], watermark: str = "10 minutes", **aggs: Column
) -> DataFrame:
    """Sliding-window aggregate; a window is emitted once the watermark passes its end."""
    grouped = df.withWatermark(ts, watermark).groupBy(F.window(ts, width, slide).alias("w"), *keys)
    return grouped.agg(*[c.alias(n) for n, c in aggs.items()])


def held_stream(windows: DataFrame, breached: Column, width: str, slide: str, hold: str, keys: list[str]) -> DataFrame:
    """``firing`` per window: the condition held in every window of the hold time.

    A second event-time aggregation counts breached windows; both run in one query.
    """
    need = max(1, _seconds(hold) // _seconds(slide))
    counted = windows.groupBy(F.window("w", hold, slide).alias("h"), *keys).agg(
        F.count_if(breached).alias("breached_windows")
    )
    start = F.col("h.start") + F.expr(f"INTERVAL {_seconds(hold) - _seconds(width)} SECONDS")
    return counted.select(start.alias("window_start"), *keys, (F.col("breached_windows") >= need).alias("firing"))


def ratio_alert_stream(
    df: DataFrame, ts: str, bad: Column, threshold: float, width: str = "5 minutes", slide: str = "1 minute",
    hold: str = "5 minutes", keys: list[str] | None = None, watermark: str = "10 minutes",
) -> DataFrame:
    """Windows in which a ratio alert fires."""
    keys = keys or []
    w = windowed_stream(df, ts, width, slide, keys, watermark, total=F.count(F.lit(1)), errors=F.count_if(bad))
    return held_stream(w, F.col("errors") / F.col("total") > threshold, width, slide, hold, keys).filter("firing")


def level_alert_stream(
    df: DataFrame, ts: str, measure: Column, threshold: float, width: str = "5 minutes", slide: str = "1 minute",
    hold: str = "5 minutes", keys: list[str] | None = None, watermark: str = "10 minutes",
) -> DataFrame:
    """Windows in which a level alert fires.  Use ``percentile_approx`` for latencies: its state is bounded."""
    keys = keys or []
    w = windowed_stream(df, ts, width, slide, keys, watermark, level=measure)
    return held_stream(w, F.col("level") > threshold, width, slide, hold, keys).filter("firing")


def absence_stream(df: DataFrame, key: str, ts: str, silence: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """One row (key, last_seen) whenever a key has been silent for ``silence``.

    The state per key is one time stamp; an event-time timer fires the alert.
    """
    wait = _seconds(silence) * 1000
    key_type = dict(df.dtypes)[key]

    def watch(group: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [group[0]], "last_seen": [pd.Timestamp(last, unit="us")]})
            return
        last = state.get[0] if state.exists else 0
        for chunk in chunks:
            last = max(last, int(chunk["_us"].max()))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + wait, state.getCurrentWatermarkMs() + 1))

    marked = df.withWatermark(ts, watermark).withColumn("_us", F.unix_micros(ts))
    return marked.groupBy(key).applyInPandasWithState(
        watch, f"{key} {key_type}, last_seen timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def sessions_stream(df: DataFrame, user: str, ts: str, gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    out = df.withWatermark(ts, watermark).groupBy(user, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def dedup_stream(df: DataFrame, key: list[str], ts: str, within: str = "5 minutes") -> DataFrame:
    """Cheap built-in form of alert suppression: repeats within the watermark are dropped."""
    return df.withWatermark(ts, within).dropDuplicatesWithinWatermark(key)

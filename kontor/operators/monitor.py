"""Alert rules, gauges and per-key guards over event tables (batch form).

The window expressions are the ones the streaming package uses.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.operators import fold
from kontor.operators.prefix import RANGE, carry, following, in_ranges
from kontor.operators.rollup import percentiles
from kontor.operators.skew import planned_join
from kontor.session import checkpoint_cut

# Alert thresholds and hold times.
HTTP_ERROR_RATIO = 0.05
JOB_FAILURE_RATIO = 0.20
RESULT_ERROR_RATIO = 0.10
LATENCY_P95_SECONDS = 2.0
LOCK_AFTER = 5
LOCK_SECONDS = 3600
ALERT_TTL_SECONDS = 300
CRITICAL_COMPONENTS = ["database", "redis"]


def _seconds(text: str) -> int:
    value, unit = text.split()
    return int(value) * {"second": 1, "minute": 60, "hour": 3600}[unit.rstrip("s")]


def windowed(df: DataFrame, ts: str, width: str, slide: str, keys: list[str], **aggs: Column) -> DataFrame:
    """Sliding-window aggregate with a plain ``window_start`` column."""
    grouped = df.groupBy(F.window(ts, width, slide).alias("w"), *keys)
    return grouped.agg(*[c.alias(n) for n, c in aggs.items()]).select(F.col("w.start").alias("window_start"), *keys, *aggs)


def held(breaches: DataFrame, slide: str, hold: str, keys: list[str], flag: str = "breached") -> DataFrame:
    """``firing``: the condition was true in every window of the hold time.

    Works on aggregated windows, whose number depends on the time span only.
    """
    step, need = _seconds(slide), max(1, _seconds(hold) // _seconds(slide))
    span = (
        Window.partitionBy(*keys)
        .orderBy(F.col("window_start").cast("bigint"))
        .rangeBetween(-(need - 1) * step, 0)
    )
    return breaches.withColumn("firing", F.sum(F.col(flag).cast("int")).over(span) >= need)


def ratio_alert(
    df: DataFrame, ts: str, bad: Column, threshold: float, width: str = "5 minutes", slide: str = "1 minute",
    hold: str = "5 minutes", keys: list[str] | None = None,
) -> DataFrame:
    keys = keys or []
    w = windowed(df, ts, width, slide, keys, total=F.count(F.lit(1)), errors=F.count_if(bad))
    w = w.withColumn("ratio", F.col("errors") / F.col("total"))
    return held(w.withColumn("breached", F.col("ratio") > threshold), slide, hold, keys)


def level_alert(
    df: DataFrame, ts: str, measure: Column, threshold: float, width: str = "5 minutes", slide: str = "1 minute",
    hold: str = "5 minutes", keys: list[str] | None = None,
) -> DataFrame:
    """Alert on any windowed aggregate, such as a percentile, a rate or a backlog maximum."""
    keys = keys or []
    w = windowed(df, ts, width, slide, keys, level=measure)
    return held(w.withColumn("breached", F.col("level") > threshold), slide, hold, keys)


def quantile_alert(
    df: DataFrame, ts: str, value: str, share: float, threshold: float, width: str = "5 minutes", slide: str = "1 minute",
    hold: str = "5 minutes",
) -> DataFrame:
    """Alert on an exact windowed percentile; a busy window is spread over many tasks.

    Windows are put together from panes that divide both width and slide: rows are counted by
    pane, and only the few rows near the wanted rank meet the windows that they are in.
    """
    long, step = _seconds(width), _seconds(slide)
    pane = math.gcd(long, step)
    rows = df.select((F.floor(F.unix_micros(ts) / (pane * 1_000_000)) * pane).alias("pane"), value)
    # one row a pane and window: their number depends on the time span only
    last = F.floor(F.col("pane") / step) * step
    starts = F.filter(F.sequence(last - (long // step) * step, last, F.lit(step).cast("bigint")), lambda w: w + long > F.col("pane"))
    groups = rows.select("pane").distinct().select("pane", F.explode(starts).alias("w")).select("pane", F.timestamp_seconds("w").alias("window_start"))
    ranks = percentiles(rows, ["window_start"], value, [share], "level", ["pane"], groups).drop("n")
    w = ranks.select("window_start", F.col(ranks.columns[-1]).alias("level"))
    return held(w.withColumn("breached", F.col("level") > threshold), slide, hold, [])


def absence_alert(df: DataFrame, ts: str, wanted: Column, width: str = "1 hour", running: Column | None = None) -> DataFrame:
    """Tumbling windows over the covered time in which nothing wanted happened.

    With ``running`` the window must also hold a row for which it is true (work was
    going on but nothing completed).  The time spine has one row per window.
    """
    seconds = _seconds(width)
    slot = F.floor(F.col(ts).cast("bigint") / seconds) * seconds
    alive = running if running is not None else F.lit(True)
    per_slot = df.groupBy(slot.alias("slot")).agg(F.count_if(wanted).alias("n"), F.max(alive.cast("int")).alias("running"))
    spine = per_slot.agg(F.min("slot").alias("a"), F.max("slot").alias("b")).select(
        F.explode(F.sequence("a", "b", F.lit(seconds).cast("bigint"))).alias("slot")
    )
    filled = spine.join(per_slot, "slot", "left").select(
        F.timestamp_seconds("slot").alias("window_start"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("running", F.lit(0 if running is not None else 1)).alias("running"),
    )
    return filled.withColumn("firing", (F.col("n") == 0) & (F.col("running") > 0)).drop("running")


def in_progress(df: DataFrame, ts: str, order: str, start: Column, end: Column, keys: list[str] | None = None) -> DataFrame:
    """Running gauge: +1 on start, -1 on end.  Ranges of rows are added up apart, so no key or day is one task."""
    delta = F.when(start, 1).when(end, -1).otherwise(0).cast("bigint")
    return carry(df, keys or [], [ts, order], sums={"in_progress": delta})


def counter_delta(df: DataFrame, keys: list[str], ts: str, order: str, value: str) -> DataFrame:
    """Increase since the previous sample; after a reset the sample itself."""
    seen = carry(df, keys, [ts, order], lasts={"previous": F.col(value)})
    before = F.coalesce("previous", F.lit(0))
    return seen.withColumn("delta", F.when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))).drop("previous")


def lockouts(
    df: DataFrame, user: str, ts: str, order: str, ok: Column, n: int = LOCK_AFTER, lock_seconds: int = LOCK_SECONDS
) -> DataFrame:
    """Failed-login counter and lock state after every event, exact and without a fold.

    A success an hour or more after the last failure always resets (no lock can be
    active), so such rows cut a user's history into independent stretches.  Within a
    stretch the counter is the failures since the last success until it first
    reaches ``n``; from then on every success is refused and the counter only grows.
    Adds ``failed_attempts``, ``refused`` and ``locked_until`` (of failures).
    """
    by = [ts, order]
    base = in_ranges(df.withColumns({"_ok": F.coalesce(ok, F.lit(False)), "_us": F.unix_micros(ts)}), [user], by)
    # each step reads the one before several times, so the steps are written once
    seen = checkpoint_cut(
        carry(
            base, [user], by,
            sums={"_fails": (~F.col("_ok")).cast("bigint")},
            lasts={"_fail_us": F.when(~F.col("_ok"), F.col("_us"))},
        )
    )
    quiet = F.col("_fail_us").isNull() | (F.col("_us") - F.col("_fail_us") >= F.lit(lock_seconds * 1_000_000))
    marked = carry(
        seen, [user], by,
        sums={"_stretch": (F.col("_ok") & quiet).cast("bigint")},
        lasts={"_at_ok": F.when(F.col("_ok"), F.col("_fails"))},
    )
    cut = checkpoint_cut(marked.withColumn("_since_ok", F.col("_fails") - F.coalesce("_at_ok", F.lit(0))))
    trips = (
        cut.filter(~F.col("_ok") & (F.col("_since_ok") >= n))
        .groupBy(user, "_stretch")
        .agg(F.min("_fails").alias("_trip"))
    )
    judged = cut.join(trips, [user, "_stretch"], "left")
    tripped = F.coalesce(F.col("_fails") >= F.col("_trip"), F.lit(False))
    count = F.when(tripped, F.lit(n) + F.col("_fails") - F.col("_trip")).otherwise(
        F.when(F.col("_ok"), F.lit(0)).otherwise(F.col("_since_ok"))
    )
    locks = ~F.col("_ok") & (F.col("failed_attempts") >= n)
    return (
        judged.withColumn("failed_attempts", count.cast("bigint"))
        .withColumn("refused", F.col("_ok") & tripped)
        .withColumn("locked_until", F.when(locks, F.timestamp_micros(F.col("_us") + lock_seconds * 1_000_000)))
        .select(*df.columns, "failed_attempts", "refused", "locked_until")
    )


def suppress(df: DataFrame, key: str, ts: str, order: str, ttl: int = ALERT_TTL_SECONDS) -> DataFrame:
    """Add ``sent``: no alert of the key was sent in the last ``ttl`` seconds.

    The alert sent after an alert is the first one at least ``ttl`` later.  These pointers are found by one scan;
    an alert after a pause of ``ttl`` is always sent, and whatever the pointers reach from
    those is.  Pointers are doubled in each round, so a key that never pauses takes rounds by the logarithm of its sent alerts and is spread by row.
    """
    span = ttl * 1_000_000
    ranged = in_ranges(df.withColumn("_us", F.unix_micros(ts)), [key], [ts, order])
    seen = checkpoint_cut(carry(ranged, [key], [ts, order], lasts={"_prev": F.col("_us")}))
    rows = checkpoint_cut(carry(seen, [], [key, ts, order], sums={"_id": F.lit(1).cast("bigint")}).drop(RANGE))
    opens = rows.filter(F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") >= span)).select("_id")
    pointers = checkpoint_cut(following(rows, [key], "_us", order, span, "_id", "_next").filter("_next is not null").select("_id", "_next"))
    # only alerts that something points to, or that open a stretch, can be on a way
    on_way = opens.unionByName(pointers.select(F.col("_next").alias("_id"))).distinct()
    jumps = checkpoint_cut(pointers.join(on_way, "_id", "left_semi"))
    reached = checkpoint_cut(opens)
    while True:
        further = reached.join(jumps, "_id").select(F.col("_next").alias("_id")).distinct()
        new = checkpoint_cut(further.join(reached, "_id", "left_anti"))
        if new.isEmpty():
            break
        reached = checkpoint_cut(reached.unionByName(new))
        target = jumps.select(F.col("_id").alias("_next"), F.col("_next").alias("_after"))
        jumps = checkpoint_cut(jumps.join(target, "_next").select("_id", F.col("_after").alias("_next")))
    sent = reached.withColumn("sent", F.lit(True))
    return rows.join(sent, "_id", "left").withColumn("sent", F.coalesce("sent", F.lit(False))).select(*df.columns, "sent")


def admission(df: DataFrame, key: str, ts: str, order: str, limit: int = 10, width: int = 60) -> DataFrame:
    """Add ``admitted`` and ``remaining``: at most ``limit`` admitted rows per key and window."""
    folded = fold.fold_pieces(df, key, ts, order, width, fold.admission_step(limit, width))
    remaining = F.greatest(F.lit(0), F.lit(limit) - F.col("in_window") - F.col("accepted").cast("bigint"))
    return folded.withColumn("remaining", remaining).withColumnRenamed("accepted", "admitted").drop("in_window")


def observed_load(df: DataFrame, key: str, ts: str, width: int = 60) -> DataFrame:
    """Requests of the key in the window up to each row, whether admitted or not.

    The count is that of all rows up to the row's time less that up to a window before.  Both are
    read off one running count in which every row asks twice, so a busy key or hour is spread by row.
    """
    span = width * 1_000_000
    ranged = in_ranges(df.withColumn("_us", F.unix_micros(ts)), [key], ["_us"])
    rows = checkpoint_cut(carry(ranged, [], [key, "_us"], sums={"_id": F.lit(1).cast("bigint")}).drop(RANGE))

    def mark(at: Column, asks: int, sign: int) -> DataFrame:
        return rows.select(key, at.alias("_at"), F.lit(asks).alias("_asks"), "_id", F.lit(1 - asks).cast("bigint").alias("_one"), F.lit(sign).alias("_sign"))

    marks = mark(F.col("_us"), 0, 0).unionByName(mark(F.col("_us"), 1, 1)).unionByName(mark(F.col("_us") - span, 1, -1))
    counted = carry(marks, [key], ["_at", "_asks", "_id"], sums={"_upto": F.col("_one")}).filter("_asks = 1")
    observed = counted.groupBy("_id").agg(F.sum(F.col("_upto") * F.col("_sign")).alias("observed"))
    return rows.join(observed, "_id").select(*df.columns, "observed")


def fan_out(events: DataFrame, subscriptions: DataFrame, event: str = "event") -> DataFrame:
    """One delivery per event and active subscription that lists the event name.

    ``subscriptions``: webhook_id, url, active, events (array).  There are few names, so
    the join is planned: a name that most events have is spread over many tasks.
    """
    wanted = subscriptions.filter("active").select(
        "webhook_id", "url", F.explode(F.array_distinct("events")).alias(event)
    )
    return planned_join(events, wanted, event)


def health_rollup(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Overall state and failing components per check round.

    ``checks``: keys, component, status.  The components are a small fixed set.
    """
    healthy = F.col("status") == "healthy"
    return checks.groupBy(*keys).agg(
        F.when(F.bool_and(healthy), "healthy").otherwise("degraded").alias("status"),
        F.array_sort(F.collect_set(F.when(~healthy, F.col("component")))).alias("failing"),
        F.coalesce(F.bool_or(~healthy & F.col("component").isin(CRITICAL_COMPONENTS)), F.lit(False)).alias("critical"),
    )


def component_alerts(checks: DataFrame) -> DataFrame:
    """One alert row per failing component with its severity."""
    return checks.filter(F.col("status") != "healthy").withColumns(
        {
            "alert_type": F.concat("component", F.lit("_issue")),
            "severity": F.when(F.col("component").isin(CRITICAL_COMPONENTS), "critical").otherwise("warning"),
            "issue_type": F.when(F.col("status").contains("unhealthy"), F.col("status")).otherwise("health_check_failed"),
        }
    )


def sessionize(df: DataFrame, user: str, ts: str, gap: str = "30 minutes", order: str | None = None, **aggs: Column) -> DataFrame:
    """Sessions of activity: rows of a user less than ``gap`` apart.

    Sessions are numbered first and then aggregated, so a user who holds a large
    share of the table is spread over many tasks.
    """
    seconds = _seconds(gap)
    cut = fold.segments(df, user, ts, order or ts, seconds)
    end = F.timestamp_micros(F.unix_micros(F.max(ts)) + F.lit(seconds * 1_000_000))
    out = cut.groupBy(user, "segment").agg(
        F.min(ts).alias("session_start"), end.alias("session_end"), F.count(F.lit(1)).alias("events"), *[c.alias(n) for n, c in aggs.items()]
    )
    return out.drop("segment")

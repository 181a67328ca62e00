"""Exact per-key guards on streams: lockout, alert suppression, admission.

Rows wait in the state store until the watermark has passed them and are then judged in the order of
their time, whatever the order in which they came; a row that comes behind the watermark is late and dropped.  What the stream has given
by then is what the batch operators give for the same rows.  An event-time timer judges the waiting rows, and another one
removes a key's state when it has no effect any more, so silent keys cost nothing.  (A counter of failed
logins has an effect until a login succeeds; such keys stay.)

The session needs the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SECOND = 1_000_000
DELAY = "10 minutes"


def _millis(us: int) -> int:
    return -(-us // 1000)


class Guard(StatefulProcessor):
    """Judge rows in time order: ``step(state, us, extras)`` gives the next state and the outputs, ``ends(state)`` when it is void."""

    def __init__(self, names: list[str], waiting: T.StructType, state: T.StructType, step: Callable, ends: Callable):
        self.names, self.waiting_type, self.state_type, self.step, self.ends = names, waiting, state, step, ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_type)
        self.state = handle.getValueState("state", self.state_type)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = [tuple(r[name] for name in self.waiting_type.fieldNames()) for r in rows]
        if came:
            self.waiting.appendList(came)
            self.handle.registerTimer(_millis(min(r[0] for r in came)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(map(tuple, self.waiting.get()))
        due = [r for r in held if r[0] <= passed]
        state = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for us, order, *extras in due:
            state, result = self.step(state, us, extras)
            out.append(Row(*self.names)(key[0], order, *result))
        rest = held[len(due) :]
        if due:
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(_millis(rest[0][0]))
            else:
                self.waiting.clear()
        end = self.ends(state) if state is not None else None
        if end is not None and end <= passed:  # rows that still wait are later
            self.state.clear()
        elif due:
            self.state.update(state)
        if end is not None and end > passed:
            self.handle.registerTimer(_millis(end))
        return iter(out)

    def close(self) -> None:
        pass


def _guarded(
    df: DataFrame, key: str, ts: str, order: str, delay: str, extra: dict[str, Column], out: str, state: str, step: Callable, ends: Callable
) -> DataFrame:
    """The key, ``order`` and the outputs of ``step`` for every row that the watermark has passed."""
    kinds = dict(df.dtypes)
    work = df.withWatermark(ts, delay).withColumns({"us": F.unix_micros(ts), **extra}).select(key, ts, "us", order, *extra)
    waiting = T.StructType([f for f in work.schema.fields if f.name in ("us", order, *extra)])
    output = f"{key} {kinds[key]}, {order} {kinds[order]}, {out}"
    names = [key, order, *(part.split()[0] for part in out.split(", "))]
    guard = Guard(names, waiting, T.StructType.fromDDL(state), step, ends)
    return work.groupBy(key).transformWithState(guard, output, "append", "eventTime")


def lockouts_stream(
    df: DataFrame, user: str, ts: str, order: str, ok: Column, n: int = 5, lock_seconds: int = 3600, delay: str = DELAY
) -> DataFrame:
    """Failed attempts, refusal and lock state after every login event."""

    def step(state, us, extras):
        fails, until = state or (0, 0)
        refused = False
        if extras[0]:
            refused = until > us
            fails = fails if refused else 0
        else:
            fails += 1
            if fails >= n:
                until = us + lock_seconds * SECOND
        return (fails, until), (fails, refused)

    # without failures nothing is remembered, as a lock comes from failures and a success ends both
    return _guarded(
        df, user, ts, order, delay, {"passed": F.coalesce(ok, F.lit(False))}, "failed_attempts bigint, refused boolean",
        "fails bigint, until bigint", step, lambda state: None if state[0] else state[1],
    )


def suppress_stream(df: DataFrame, key: str, ts: str, order: str, ttl: int = 300, delay: str = DELAY) -> DataFrame:
    """``sent`` is false while an alert of the key was sent less than ``ttl`` seconds ago."""

    def step(state, us, extras):
        sent = state is None or us - state[0] >= ttl * SECOND
        return (us if sent else state[0],), (sent,)

    return _guarded(df, key, ts, order, delay, {}, "sent boolean", "last bigint", step, lambda state: state[0] + ttl * SECOND)


def admission_stream(df: DataFrame, key: str, ts: str, order: str, limit: int = 10, width: int = 60, delay: str = DELAY) -> DataFrame:
    """At most ``limit`` admitted rows per key and window; the state holds that many times at most."""

    def step(state, us, extras):
        kept = [t for t in (state[0] if state else []) if t > us - width * SECOND]
        admitted = len(kept) < limit
        if admitted:
            kept.append(us)
        return (kept,), (admitted, max(0, limit - len(kept)))

    def ends(state):
        return max(state[0], default=0) + width * SECOND

    return _guarded(df, key, ts, order, delay, {}, "admitted boolean, remaining bigint", "kept array<bigint>", step, ends)

"""Streams whose keys have a life: jobs as state machines, and arrivals that point to their first copy.

State ends. A finished job's is cleared at once, an abandoned one's by a timer, and a content's when it hasn't arrived
for the time it is kept. What an event does depends on the time between events, never on when a timer fires, so a run in
many batches, or one that was stopped and started again, gives the rows of a run in one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from foliant.operators.lifecycle import ROW, Life

#: The store that typed states and timers need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
COLUMNS = [c.split(" ")[0] for c in ROW.split(", ")]


def typed_states(spark: SparkSession) -> None:
    """Let this session's streams have typed states."""
    spark.conf.set(*PROVIDER)


def _replaced_timer(handle: StatefulProcessorHandle, old_ms: int | None, at_ms: int | None) -> None:
    """Let the key have one timer, or none, instead of the one it has. Each call goes to the JVM and back, so that timers aren't listed."""
    if old_ms != at_ms:
        if old_ms is not None:
            handle.deleteTimer(old_ms)
        if at_ms is not None:
            handle.registerTimer(at_ms)


class JobLives(StatefulProcessor):
    """One value with a job's state, one list with its finished steps, one timer for its expiry."""

    def __init__(self, expiry: float):
        self.expiry = expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "status string, started double, step string, step_at double, last double")
        self.steps = handle.getListState("steps", "step string, seconds double")

    def _read(self) -> Life:
        life, now = Life(self.expiry), self.now.get()
        if now is not None:
            life.status, life.started, life.step, life.step_at, life.last = now
            life.done = [tuple(s) for s in self.steps.get()]
        return life

    def _ends(self, life: Life) -> int | None:
        """When a job's timer fires."""
        return None if life.status is None else int((life.last + self.expiry) * 1000) + 1

    def _write(self, life: Life, old_ms: int | None, had: list) -> None:
        """Keep a job that had a timer and finished steps."""
        if life.status is not None:
            self.now.update((life.status, life.started, life.step, life.step_at, life.last))
        elif old_ms is not None:
            self.now.clear()
        if life.done and life.done != had:
            self.steps.put(life.done)
        elif had and not life.done:
            self.steps.clear()
        _replaced_timer(self.handle, old_ms, self._ends(life))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        life, out = self._read(), []
        old_ms, had = self._ends(life), list(life.done)
        events = sorted((t, i, e, s) for part in rows for t, i, e, s in zip(part["second"], part["event_id"], part["event"], part["step"], strict=True))
        for at, event_id, name, step in events:
            out += life.event(int(key[0]), int(event_id), float(at), name, step)
        self._write(life, old_ms, had)
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        life = self._read()
        old_ms, had = self._ends(life), list(life.done)
        out = life.given_up(int(key[0]), expiredTimerInfo.getExpiryTimeInMs() / 1000)
        if out:
            self._write(life, old_ms, had)
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def job_lives(events: DataFrame, expiry: float) -> DataFrame:
    """The rows of `operators.lifecycle` of events (job_id, event_id, ts, event, step), a stream with a watermark on ts. Events of a job in one batch are taken in the order of ts."""
    typed_states(events.sparkSession)
    rows = events.select("job_id", "event_id", "ts", (F.unix_micros("ts") / 1e6).alias("second"), "event", F.coalesce("step", F.lit("")).alias("step"))
    return rows.groupBy("job_id").transformWithStateInPandas(JobLives(expiry), ROW, "append", "EventTime")


class FirstCopies(StatefulProcessor):
    """One value with a content's first arrival and its last moment, one timer."""

    def __init__(self, keep: float):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "id long, last double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        first, last = self.first.get() or (None, None)
        old_ms = None if last is None else int((last + self.keep) * 1000) + 1
        arrived = sorted((float(t), int(i)) for part in rows for t, i in zip(part["second"], part["id"], strict=True))
        out = []
        for at, i in arrived:
            if first is None or at - last >= self.keep:
                first = i
            out.append((i, None if i == first else first))
            last = at if last is None else max(last, at)
        self.first.update((first, last))
        _replaced_timer(self.handle, old_ms, int((last + self.keep) * 1000) + 1)
        yield pd.DataFrame({"id": [i for i, _ in out], "duplicate_of": pd.array([d for _, d in out], "Int64")})

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.first.clear()
        yield pd.DataFrame({"id": pd.array([], "Int64"), "duplicate_of": pd.array([], "Int64")})

    def close(self) -> None:
        pass


def first_copies(arrivals: DataFrame, keep: float) -> DataFrame:
    """(id, duplicate_of) of arrivals (id, key, ts), a stream with a watermark on ts: the first arrival of the same key, null for that itself. A key that didn't arrive for `keep` seconds is forgotten."""
    typed_states(arrivals.sparkSession)
    rows = arrivals.select("id", "key", "ts", (F.unix_micros("ts") / 1e6).alias("second"))
    return rows.groupBy("key").transformWithStateInPandas(FirstCopies(keep), "id long, duplicate_of long", "append", "EventTime")

"""A job's life as a state machine: what each event does to it, its steps' times, and its record when it ends.

The machine is one class, which the batch fold here and the stream in `streaming.lifecycle` both run. A job is uploaded,
may be queued, is processed step by step, and is completed or fails; an event that its state doesn't allow changes
nothing and becomes a row of its own. When a job ends, so does its state, and its id may begin anew. A job without events
for the time of expiry is given up, which shows as a row at the moment when that time was over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.telemetry import FIRST_STEP
from foliant.operators.uploads import fold

UPLOAD, QUEUE, START, STEP, COMPLETE, FAIL = "upload", "queue", "start", "step", "complete", "fail"
#: For each event the states in which it is allowed and the state that it leads to; None is a job that isn't there.
MOVES = {
    UPLOAD: ((None,), "uploaded"),
    QUEUE: (("uploaded",), "queued"),
    START: (("uploaded", "queued"), "processing"),
    STEP: (("processing",), "processing"),
    COMPLETE: (("processing",), "completed"),
    FAIL: (("uploaded", "queued", "processing"), "failed"),
}
ENDS = ("completed", "failed")
ROW = "job_id long, event_id long, second double, kind string, before string, after string, step string, seconds double, steps long, longest double"


class Life:
    """The state of one job. `done` holds the seconds of its finished steps; others may read and set all fields."""

    def __init__(self, expiry: float):
        self.expiry = expiry
        self.end()

    def end(self) -> None:
        self.status: str | None = None
        self.started: float | None = None
        self.step: str | None = None
        self.step_at: float | None = None
        self.last: float | None = None
        self.done: list[tuple[str, float]] = []

    def given_up(self, job: int, now: float) -> list[tuple]:
        """The row of a job whose time is over at this moment, and its state gone; none if it isn't."""
        if self.status is None or now - self.last < self.expiry:
            return []
        row = (job, None, self.last + self.expiry, "expired", self.status, None, self.step, None, *self._steps())
        self.end()
        return [row]

    def _steps(self) -> tuple[int, float | None]:
        return len(self.done), max((s for _, s in self.done), default=None)

    def event(self, job: int, event_id: int, at: float, name: str, step: str | None) -> list[tuple]:
        """The rows that an event gives."""
        rows = self.given_up(job, at)
        states, after = MOVES.get(name, ((), None))
        if self.status not in states:
            return [*rows, (job, event_id, at, "illegal", self.status, self.status, step, None, None, None)]
        before, took = self.status, None
        if name == START:
            self.started, self.step = at, FIRST_STEP
        elif name == STEP:
            if self.step != FIRST_STEP:
                took = at - self.step_at
                self.done.append((self.step, took))
            self.step, self.step_at = step, at
        self.status, self.last = after, at
        rows.append((job, event_id, at, "transition", before, after, self.step, took, None, None))
        if after in ENDS:
            rows.append((job, event_id, at, "final", before, after, self.step, None if self.started is None else at - self.started, *self._steps()))
            self.end()
        return rows


def histories(events: DataFrame, expiry: float, until: float | None = None) -> DataFrame:
    """The rows of all events (job_id, event_id, at, event, step), job by job in the order of `at`; with until, also those of jobs whose time is over by then."""
    rows = events.select("job_id", (F.unix_micros("at") / 1e6).alias("second"), "event_id", "event", "step")
    if until is not None:
        none = lambda kind: F.lit(None).cast(kind)
        ends = rows.groupBy("job_id").agg(F.greatest(F.max("second"), F.lit(float(until))).alias("second"))
        rows = rows.unionByName(ends.where(F.col("second") <= until).select("job_id", "second", none("long").alias("event_id"), none("string").alias("event"), none("string").alias("step")))
    begin: Callable[[], Life] = lambda: Life(expiry)

    def step(life: Life, job: int, at: float, event_id: int | None, name: str | None, what: str | None) -> list[tuple]:
        return life.event(job, event_id, at, name, what) if event_id is not None else life.given_up(job, at)

    return fold(rows, "job_id", [F.col("second"), F.asc_nulls_last("event_id")], begin, step, ROW)

"""What depends on the order of events of one key: upload limits and circuit breakers.

Each decision changes what later ones see, so no window frame can say it. Both are folds over a key's events in order.
The folds carry a bounded state and are written as generators over sorted partitions: rows of a key come one after
another, in batches, so that a key with very many events is never held whole.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOUR, DAY = 3600, 86_400
CLOSED, OPEN, HALF_OPEN = "CLOSED", "OPEN", "HALF_OPEN"
FORCE_OPEN, FORCE_CLOSE, RESET = "force_open", "force_close", "reset"
#: Failures that open, seconds until a new try, successes that close, by service; fixed values.
BREAKERS = {"quality": (3, 300, 2), "layout": (3, 300, 2), "metadata": (2, 180, 1)}


SLICE = 3600


def _second_counts(events: DataFrame) -> DataFrame:
    """(client, second_, slice_, n, last_hour, last_day): a client's events of each second that has any, and those of the hour and day before it.

    What lies between two moments is the count of whole slices, and what stands before a moment within its slice. Events
    counted again at the moment they fall out of reach give the part of the first slice that is too old. So a window
    holds the seconds of one slice of a client, or one row for each of its slices, never its whole history.
    """
    at = F.unix_timestamp("at")
    seconds = events.groupBy("client", at.alias("second_")).agg(F.count("*").alias("n")).withColumn("slice_", F.floor(F.col("second_") / SLICE))
    slices = seconds.groupBy(F.col("client").alias("of_"), F.col("slice_").alias("at_")).agg(F.sum("n").alias("n_"))
    gone = lambda back, name: seconds.select("client", (F.col("second_") + back).alias("second_"), F.lit(0).cast("long").alias("n"), F.col("n").alias(name))
    every = seconds.select("client", "second_", "n").unionByName(gone(HOUR, "hour_"), allowMissingColumns=True).unionByName(gone(DAY, "day_"), allowMissingColumns=True)
    every = every.withColumn("slice_", F.floor(F.col("second_") / SLICE))
    inside = Window.partitionBy("client", "slice_").orderBy("second_").rangeBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
    own = every.withColumn("within", earlier("n")).withColumn("hour_", earlier("hour_")).withColumn("day_", earlier("day_")).where("n > 0")
    whole = lambda back: F.coalesce(F.sum("n_").over(Window.partitionBy("of_").orderBy("at_").rangeBetween(-back // SLICE, -1)), F.lit(0))
    totals = slices.select("of_", "at_", whole(HOUR).alias("hours_"), whole(DAY).alias("days_"))
    both = own.join(totals, F.col("client").eqNullSafe(F.col("of_")) & (F.col("slice_") == F.col("at_")))
    return both.select("client", "second_", "slice_", "n", (F.col("within") + F.col("hours_") - F.col("hour_")).alias("last_hour"), (F.col("within") + F.col("days_") - F.col("day_")).alias("last_day"))


def _with_seconds(events: DataFrame, counts: DataFrame, *names: str) -> DataFrame:
    """events with columns of their client's second."""
    known = counts.select(F.col("client").alias("of_"), F.col("second_").alias("at_"), *names)
    return events.withColumn("second_", F.unix_timestamp("at")).join(known, F.col("client").eqNullSafe(F.col("of_")) & F.col("second_").eqNullSafe(F.col("at_"))).drop("of_", "at_")


def trailing_counts(events: DataFrame) -> DataFrame:
    """events (client, at) with the number of the client's events in the hour and day before, all of them counted."""
    return _with_seconds(events.where("at IS NOT NULL"), _second_counts(events.where("at IS NOT NULL")), "last_hour", "last_day")


class Limiter:
    """Accepts while fewer than the limits were accepted in the hour and day before."""

    def __init__(self, per_hour: int, per_day: int):
        self.per_hour, self.per_day, self.accepted = per_hour, per_day, deque()

    def __call__(self, at: float) -> bool:
        while self.accepted and self.accepted[0] <= at - DAY:
            self.accepted.popleft()
        hour = sum(1 for t in self.accepted if t > at - HOUR)
        ok = hour < self.per_hour and len(self.accepted) < self.per_day
        if ok:
            self.accepted.append(at)
        return ok


class Breaker:
    """CLOSED opens at the n-th failure, which successes between don't undo; OPEN lets a call through after a while; HALF_OPEN closes after m successes and opens at a failure. While it is forced, it is open whatever happens."""

    def __init__(self, failures: int, seconds: float, successes: int):
        self.limit, self.wait, self.needed = failures, seconds, successes
        self.command(RESET)

    def command(self, action: str) -> None:
        """force_open holds it open, force_close closes it and ends that, reset makes it new."""
        if action == FORCE_OPEN:
            self.state, self.forced = OPEN, True
            return
        if action not in (FORCE_CLOSE, RESET):
            raise ValueError(f"unknown action {action}")
        self.state, self.failures, self.successes, self.forced = CLOSED, 0, 0, False
        if action == RESET:
            self.failed_at = None

    def allows(self, at: float) -> bool:
        if not self.forced and self.state == OPEN and self.failed_at is not None and at - self.failed_at >= self.wait:
            self.state, self.successes = HALF_OPEN, 0
        return self.state != OPEN

    def call(self, at: float, ok: bool) -> tuple[bool, str]:
        """Whether the call was let through, and the state after it."""
        if not self.allows(at):
            return False, self.state
        if ok and self.state == HALF_OPEN:
            self.successes += 1
            if self.successes >= self.needed:
                self.state, self.failures = CLOSED, 0
        elif not ok:
            self.failures += 1
            self.failed_at = at
            if self.state == HALF_OPEN or self.failures >= self.limit:
                self.state = OPEN
        return True, self.state

    def next_attempt(self) -> float | None:
        return self.failed_at + self.wait if self.state == OPEN and not self.forced and self.failed_at is not None else None

    def held(self) -> tuple:
        return self.state, self.failures, self.successes, self.failed_at, self.forced

    def take(self, held: tuple) -> None:
        self.state, self.failures, self.successes, self.failed_at, self.forced = held


def fold(events: DataFrame, key: str, order: list[str | Column], begin: Callable[[], Callable], step: Callable[..., tuple], schema: str) -> DataFrame:
    """Rows of step(state, *values of a row) for each row (one, or a list of them), in order within its key; begin() makes a key's first state. Keys are dealt to tasks; within a key each row needs what the one before it left, so a key's rows pass through one task, as a stream."""
    names, kinds = zip(*[part.split(" ") for part in schema.split(", ")], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = None, object()
        for batch in batches:
            out = []
            keys = batch[key].to_pylist()
            for k, *row in zip(keys, *[c.to_pylist() for c in batch.columns], strict=True):
                if k != now:
                    state, now = begin(), k
                rows = step(state, *row)
                out += rows if isinstance(rows, list) else [rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], KINDS[kind]) for i, kind in enumerate(kinds)], names=names)

    return events.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}


def decisions(events: DataFrame, per_hour: int = 50, per_day: int = 200) -> DataFrame:
    """(event_id, client, second, accepted): only accepted uploads count against later ones.

    A day without uploads parts a client's history into runs that can't affect each other. In most runs even all uploads
    together never reach a limit, and all are accepted; only the others are folded, each by itself.
    """
    counts = _second_counts(events)
    start = F.when(F.col("last_day") == 0, F.col("second_"))
    inside = Window.partitionBy("client", "slice_").orderBy("second_").rowsBetween(Window.unboundedPreceding, 0)
    near = (F.col("last_hour") + F.col("n") > per_hour) | (F.col("last_day") + F.col("n") > per_day)
    counts = counts.withColumn("run_", F.max(start).over(inside)).withColumn("near_", near)
    slices = counts.groupBy(F.col("client").alias("of_"), F.col("slice_").alias("at_")).agg(F.max("run_").alias("last_"))
    slices = slices.withColumn("last_", F.max("last_").over(Window.partitionBy("of_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)))
    counts = counts.join(slices, F.col("client").eqNullSafe(F.col("of_")) & (F.col("slice_") == F.col("at_"))).withColumn("run_", F.coalesce("run_", "last_")).drop("of_", "at_", "last_")
    judged = counts.groupBy(F.col("client").alias("of_"), F.col("run_").alias("at_")).agg(F.bool_or("near_").alias("folds_"))
    counts = counts.join(judged, F.col("client").eqNullSafe(F.col("of_")) & (F.col("run_") == F.col("at_"))).select("client", "second_", "run_", "folds_")
    rows = _with_seconds(events, counts, "run_", "folds_").select("event_id", "client", (F.unix_micros("at") / 1e6).alias("second"), F.struct("client", "run_").alias("key_"), "folds_")
    free = rows.where(~F.col("folds_")).select("event_id", "client", "second", F.lit(True).alias("accepted"))
    part = rows.where("folds_").select("event_id", "client", "second", F.to_json("key_").alias("key_"))
    folded = fold(part, "key_", ["second", "event_id"], lambda: Limiter(per_hour, per_day), lambda s, i, c, t, _: (i, c, t, s(t)), "event_id long, client long, second double, accepted boolean")
    return free.unionByName(folded)


def breaker(calls: DataFrame, failures: int = 3, seconds: float = 300, successes: int = 2, controls: DataFrame | None = None) -> DataFrame:
    """(event_id, service, second, allowed, state, next_attempt) of calls (event_id, service, at, ok), between which controls (event_id, service, at, action) set a breaker by hand. With one success the breaker is the simple one of a threshold and a reset."""
    rows = calls.select("event_id", "service", (F.unix_micros("at") / 1e6).alias("second"), "ok", F.lit(None).cast("string").alias("action"))
    if controls is not None:
        rows = rows.unionByName(controls.select("event_id", "service", (F.unix_micros("at") / 1e6).alias("second"), F.lit(None).cast("boolean").alias("ok"), "action"))

    def step(s: Breaker, i: int, service: str, t: float, ok: bool | None, action: str | None) -> tuple:
        if action is not None:
            s.command(action)
            return (i, service, t, None, s.state, s.next_attempt())
        return (i, service, t, *s.call(t, ok), s.next_attempt())

    return fold(rows, "service", ["second", "event_id"], lambda: Breaker(failures, seconds, successes), step, "event_id long, service string, second double, allowed boolean, state string, next_attempt double")


def status_of(traced: DataFrame) -> DataFrame:
    """(service, state, next_attempt) after each service's last call."""
    last = traced.groupBy("service").agg(F.max_by(F.struct("state", "next_attempt"), F.struct("second", "event_id")).alias("s"))
    return last.select("service", "s.state", "s.next_attempt")


def attempts(log: DataFrame, most: int, fatal: tuple[str, ...] = ()) -> DataFrame:
    """The end of each task's attempts (task, attempt, ok, error): done, given up at once on a fatal error, or after the most attempts."""
    w = Window.partitionBy("task").orderBy("attempt")
    ends = F.col("ok") | F.col("error").isin(*fatal) | (F.col("attempt") >= most) if fatal else F.col("ok") | (F.col("attempt") >= most)
    first = log.withColumn("ends", ends).where("ends").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    outcome = F.when(F.col("ok"), "done").when(F.col("error").isin(*fatal) if fatal else F.lit(False), "fatal").otherwise("exhausted")
    return first.select("task", "attempt", outcome.alias("outcome"), "error")

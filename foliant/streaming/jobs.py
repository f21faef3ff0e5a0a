"""Job events as streams: windowed counts, latest states, and decisions with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.operators.uploads import DAY, Breaker, Limiter
from foliant.session import scratch

#: Files of a batch at most, so that a backlog comes in parts.
FILES = 64
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, delay: str = "1 day") -> DataFrame:
    """Arriving event files, with a zoned `ts` under a watermark."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", FILES).parquet(f"{sf_dir}/ev*.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def window_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events and mean value of each window and type."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    found = events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "avg_value")


def latest_states(events: DataFrame) -> DataFrame:
    """The last step of each job so far."""
    return events.groupBy(F.col("user_id").alias("job_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("step"), F.count("*").alias("steps"))


def upload_decisions(uploads: DataFrame, per_hour: int = 50, per_day: int = 200) -> DataFrame:
    """(event_id, client, accepted) of uploads (event_id, client, ts) as they arrive, in the order of `ts` within a batch.

    A client's state is the seconds of its accepted uploads of the last day, at most per_day of them. It is dropped once
    the watermark is a day past the last one, when it can't count against anything that may still come.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        limit = Limiter(per_hour, per_day)
        limit.accepted.extend(held.get[0] if held.exists else [])
        rows = sorted((t.timestamp(), i) for part in batches for t, i in zip(part["ts"], part["event_id"], strict=True))
        yield pd.DataFrame({"event_id": [i for _, i in rows], "client": key[0], "accepted": [limit(t) for t, _ in rows]})
        held.update((list(limit.accepted),))
        last = max([*limit.accepted, rows[-1][0]])
        held.setTimeoutTimestamp(max(int((last + DAY) * 1000), held.getCurrentWatermarkMs() + 1))

    return uploads.groupBy("client").applyInPandasWithState(run, "event_id long, client long, accepted boolean", "accepted array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def breaker_states(calls: DataFrame, failures: int = 3, seconds: float = 300, successes: int = 2, controls: DataFrame | None = None) -> DataFrame:
    """(event_id, service, allowed, state) of calls (event_id, service, ts, ok) as they arrive, and of controls (event_id, service, ts, action), a second stream that sets breakers by hand; a control's allowed is null.

    A service's state is five values; it has no end, as a breaker's failures don't, and there are as many as services.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        breaker = Breaker(failures, seconds, successes)
        if held.exists:
            breaker.take(held.get)
        # What is kept of a row until its turn is a moment, a number and a word.
        rows = sorted((t.timestamp(), i, a or ("ok" if o else "bad")) for part in batches for t, i, o, a in zip(part["ts"], part["event_id"], part["ok"], part["action"], strict=True))
        out = []
        for at, i, what in rows:
            if what in ("ok", "bad"):
                out.append((i, key[0], *breaker.call(at, what == "ok")))
            else:
                breaker.command(what)
                out.append((i, key[0], None, breaker.state))
        held.update(breaker.held())
        yield pd.DataFrame(out, columns=["event_id", "service", "allowed", "state"])

    rows = calls.select("event_id", "service", "ts", "ok", F.lit(None).cast("string").alias("action"))
    if controls is not None:
        rows = rows.unionByName(controls.select("event_id", "service", "ts", F.lit(False).alias("ok"), "action"))
    return rows.groupBy("service").applyInPandasWithState(run, "event_id long, service string, allowed boolean, state string", "state string, failures int, successes int, failed_at double, forced boolean", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Process what has arrived, and the resulting table, from files in the shared folder: appended ones, or with mode complete those of the last batch. A run in the folder of an earlier one goes on where that stopped."""
    spark = stream.sparkSession
    folder = folder or scratch(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{folder}/rows").awaitTermination()
    else:
        writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/rows")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")

"""State over time: job lives, first copies, breakers, limits under a hot key, exact quantiles."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import telemetry, uploads
from foliant.operators.lifecycle import Life, histories
from foliant.operators.quantiles import exact_quantiles
from foliant.session import scratch
from foliant.streaming import jobs, lifecycle


def test_life():
    life = Life(100)
    rows = [r for at, name, step in ((0, "step", "a"), (1, "upload", ""), (2, "queue", ""), (3, "start", ""), (5, "step", "a"), (9, "step", "b"), (10, "upload", ""), (12, "complete", ""), (13, "fail", ""), (14, "upload", ""), (200, "upload", "")) for r in life.event(1, at, at, name, step)]
    assert [(r[3], r[4], r[5]) for r in rows] == [
        ("illegal", None, None), ("transition", None, "uploaded"), ("transition", "uploaded", "queued"), ("transition", "queued", "processing"), ("transition", "processing", "processing"), ("transition", "processing", "processing"),
        ("illegal", "processing", "processing"), ("transition", "processing", "completed"), ("final", "processing", "completed"), ("illegal", None, None), ("transition", None, "uploaded"), ("expired", "uploaded", None), ("transition", None, "uploaded"),
    ]
    assert rows[5][7] == 4 and rows[8][7:] == (9, 1, 4) and rows[11][2] == 114


def job_rows(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(i % 9, i, 1_700_000_000 + i * 50 + rng.random(), rng.choice(["upload", "upload", "queue", "start", "start", "step", "step", "step", "complete", "fail"]), rng.choice("ab")) for i in range(n)]


def test_job_lives_after_a_restart(spark):
    """Two runs from one checkpoint, over files that came later, give what one fold over all events gives."""
    source, state = scratch(spark, "events"), scratch(spark, "run")
    schema = "job_id long, event_id long, second double, event string, step string"
    events = job_rows(400, 1)
    put = lambda some: spark.createDataFrame(some, schema).select("job_id", "event_id", F.timestamp_micros((F.col("second") * 1e6).cast("long")).alias("ts"), "event", "step").coalesce(1).write.mode("append").parquet(source)
    kinds = "job_id long, event_id long, ts timestamp, event string, step string"
    stream = lambda: lifecycle.job_lives(spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(source).withWatermark("ts", "100 seconds"), 900.0)
    put(events[:120])
    put(events[120:200])
    first = jobs.run_once(stream(), "append", state).count()
    put(events[200:])
    got = jobs.run_once(stream(), "append", state).collect()
    all_ = spark.read.schema(kinds).parquet(source).withColumnRenamed("ts", "at")
    until = all_.agg(F.max(F.unix_micros("at")) / 1e6).first()[0] - 100
    want = histories(all_, 900.0, until).collect()
    plain = lambda rows: sorted(str(tuple(round(v, 3) if isinstance(v, float) else v for v in r)) for r in rows)
    assert 0 < first < len(got) and plain(got) == plain(want)
    assert {r["kind"] for r in got} == {"transition", "illegal", "final", "expired"}


def test_first_copies_are_forgotten(spark):
    source = scratch(spark, "arrivals")
    rows = [(1, "x", 0), (2, "y", 5), (3, "x", 10), (4, "x", 200), (5, "x", 205), (6, "y", 20)]
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, "id long, key string, s long").select("id", "key", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long, key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source).withWatermark("ts", "1000 seconds")
    got = {r["id"]: r["duplicate_of"] for r in jobs.run_once(lifecycle.first_copies(stream, 100.0), "append").collect()}
    assert got == {1: None, 2: None, 3: 1, 4: None, 5: 4, 6: 2}


def test_forced_breaker():
    b = uploads.Breaker(2, 10, 1)
    assert b.call(0, False) == (True, "CLOSED") and b.call(1, False) == (True, "OPEN") and b.next_attempt() == 11
    b.command(uploads.FORCE_OPEN)
    assert b.call(50, True) == (False, "OPEN") and b.next_attempt() is None
    b.command(uploads.FORCE_CLOSE)
    assert b.call(51, False) == (True, "CLOSED") and b.call(52, False) == (True, "OPEN") and b.call(62, True) == (True, "CLOSED")
    with pytest.raises(ValueError, match="unknown"):
        b.command("open")


def hot_events(spark, n: int):
    """One client owns nine tenths of all events; another comes once a week."""
    rng = random.Random(2)
    rows = [(i, 0 if rng.random() < 0.9 else rng.randint(1, 5), 1_700_000_000.0 + rng.choice([i * 37, i * 37, (i // 40) * 1480]) + rng.choice([0, 0.25, 0.5])) for i in range(n)]
    rows += [(n + i, 6, 1_700_000_000 + i * 604_800.0) for i in range(5)]
    df = spark.createDataFrame(rows, "event_id long, client long, s double")
    return rows, df.select("event_id", "client", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("at"))


def test_hot_client(spark):
    rows, events = hot_events(spark, 6000)
    by = defaultdict(list)
    for i, c, s in rows:
        by[c].append((s, i))
    want, accepted = {}, {}
    for c, own in by.items():
        limit = uploads.Limiter(20, 300)
        seconds = sorted(int(s) for s, _ in own)
        for s, i in sorted(own):
            place = np.searchsorted(seconds, int(s))
            want[i] = tuple(int(place - np.searchsorted(seconds, int(s) - back)) for back in (3600, 86_400))
            accepted[i] = limit(s)
    assert {r["event_id"]: (r["last_hour"], r["last_day"]) for r in uploads.trailing_counts(events).collect()} == want
    assert {r["event_id"]: r["accepted"] for r in uploads.decisions(events, 20, 300).collect()} == accepted
    assert 0 < sum(accepted.values()) < len(accepted)
    # What one task holds of the hot client are the seconds of a slice, not its history.
    widest = uploads._second_counts(events).groupBy("client", "slice_").count().agg(F.max("count")).first()[0]
    assert widest <= uploads.SLICE


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quantiles(spark, seed):
    rng = random.Random(seed)
    draw = [lambda: rng.gauss(0, 1), lambda: float(rng.randint(0, 3)), lambda: 10 ** rng.uniform(-300, 300), lambda: rng.choice([5e-324, 1e-323, 0.0, -5e-324]), lambda: rng.choice([1e308, -1e308, 1.0])][seed - 1 :: 2]
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice(draw)()) for _ in range(3000)] + [("c", None), ("d", 4.0), ("a", float("nan"))]
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["share"]): (r["n"], r["quantile"]) for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", shares, "g").collect()}
    for g in ("a", "b", None, "d"):
        own = np.sort([v for k, v in rows if k == g and v is not None and v == v])
        for s in shares:
            k = int(np.floor(s * (len(own) - 1)))
            rest = s * (len(own) - 1) - k
            low, high = own[k], own[min(k + 1, len(own) - 1)]
            n, q = got[g, s]
            assert n == len(own) and (q == low if rest == 0 or low == high else low <= q <= high and np.isclose(q, low * (1 - rest) + high * rest, rtol=1e-9))
    assert ("c", 0.5) not in got


def test_durations_of_nothing(spark):
    none = spark.createDataFrame([(None,)], "duration double")
    assert tuple(telemetry.durations(none).first()) == (0, 0.0, 0.0, None, None)


def test_queue_in_a_busy_second(spark):
    rows = [(i, random.Random(i).choice(["urgent", "low", "normal"]), 1_700_000_000 + (0 if i < 300 else i), float(i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "job_id long, priority string, s long, size_mb double").select("job_id", "priority", F.timestamp_seconds("s").alias("created_at"), "size_mb")
    got = {r["job_id"]: (r["position"], r["starts_after"]) for r in telemetry.queue(df, F.timestamp_seconds(F.lit(1_700_001_000))).collect()}
    rank = {"urgent": 0, "normal": 2, "low": 3}
    after, want = 0.0, {}
    for k, (i, _, _, mb) in enumerate(sorted(rows, key=lambda r: (rank[r[1]], r[2], r[0]))):
        want[i] = (k + 1, after)
        after += min(1200.0, max(60.0, 120 + (mb * 30 if mb else 60)))
    assert got == want

"""Third arrivals: batch against brute force, stream against batch over restarts and repeated batches, state that expires."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.streaming import arrivals
from riskloom.streaming import velocity as v

START = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)
SCHEMA = "event_id long, user_id long, ts timestamp"


def brute(rows, kth, gap):
    out, by = set(), {}
    for i, u, t in rows:
        if u is not None and t is not None:
            by.setdefault(u, []).append((t, i))
    for u, times in by.items():
        n, last = 0, None
        for t, i in sorted(times):
            n = 1 if last is None or t - last > gap else n + 1
            last = t
            if n == kth:
                out.add((u, i, t))
    return out


def made(seed, n=600, users=25, hours=300):
    """Events of some users, one of whom has a third of them; ties of time and rows without key or time."""
    r = random.Random(seed)
    rows = [(i, 0 if r.random() < 0.33 else r.randrange(users), START + timedelta(minutes=20 * r.randrange(3 * hours))) for i in range(n)]
    return [*rows, (n, None, START), (n + 1, 3, None)]


@pytest.mark.parametrize("kth", [1, 3, 7])
@pytest.mark.parametrize("gap", [HOUR, 11 * HOUR, 10_000 * HOUR])
def test_batch_equals_brute_force(spark, kth, gap):
    rows = made(kth)
    got = arrivals.kth_arrivals(spark.createDataFrame(rows, SCHEMA), "user_id", kth, gap)
    assert {tuple(r) for r in got.collect()} == brute(rows, kth, gap)
    assert arrivals.kth_arrivals(spark.createDataFrame([], SCHEMA), "user_id", kth, gap).count() == 0


def test_only_heads_of_stretches_are_shuffled(spark):
    df = spark.range(1000).selectExpr("id as event_id", "0L as user_id", "timestamp_seconds(id) as ts")
    plan = arrivals.kth_arrivals(df, "user_id", 3, HOUR)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_stream_equals_batch_over_restarts_and_repeats(spark, tmp_path):
    gap, late = 11 * HOUR, 6 * HOUR
    rows = sorted((r for r in made(5, 500) if r[2] is not None), key=lambda r: r[2])
    r = random.Random(1)
    order = sorted(rows, key=lambda x: x[2] + r.random() * late * 0.9)  # out of order, but never later than allowed
    source, size = str(tmp_path / "in"), len(order) // 5 + 1
    s = arrivals.ArrivalStream(str(tmp_path / "out"), "user_id", 3, gap, late)
    live = []
    for i in range(0, len(order), size):
        spark.createDataFrame(order[i : i + size], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        # Each part is a query of its own that goes on from the checkpoint.
        s.start(v.stream(spark, source, SCHEMA), str(tmp_path / "cp")).awaitTermination(120)
        n = max(s._batches(spark))
        live.append(spark.read.parquet(f"{s.path}/state/batch={n}/open").count() + spark.read.parquet(f"{s.path}/state/batch={n}/waiting").count())
    assert len(s._batches(spark)) == 2
    last = max(s._batches(spark))
    mark = max(t for _, _, t in order) - late
    want = brute([x for x in rows if x[2] <= mark], 3, gap)
    got = lambda: sorted((r["user_id"], r["event_id"], r["flagged_at"]) for r in s.flags(spark).collect())
    assert want and got() == sorted(want)
    assert spark.read.parquet(f"{s.path}/late").isEmpty()
    # The last batch once more, as after a crash before it was committed.
    s.step(spark.createDataFrame(order[len(order) - len(order) % size :] if len(order) % size else order[-size:], SCHEMA), last)
    assert got() == sorted(want)
    # State: users with an event in the last gap, and events of the last hours; not all that were ever seen.
    assert max(live) <= 25 + sum(1 for x in rows if x[2] > START + 200 * HOUR) and max(live) < len(rows) // 4


def test_state_goes_when_a_spell_ends_and_late_events_are_kept_apart(spark, tmp_path):
    s = arrivals.ArrivalStream(str(tmp_path / "o"), "user_id", 3, 2 * HOUR, HOUR)
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    s.step(df([(i, u, START) for i, u in enumerate([1, 1, 1, 2, 2] + list(range(10, 60)))]), 0)
    s.step(df([(100, 2, START + HOUR), (101, 9, START + timedelta(hours=1, minutes=30))]), 1)
    rows = lambda name, n: spark.read.parquet(f"{s.path}/state/batch={n}/{name}")
    assert rows("open", 1).count() == 52 and {r["n"] for r in rows("open", 1).where("key_ = 1").collect()} == {3}
    s.step(df([(200, 7, START + 50 * HOUR), (201, 1, START)]), 2)
    assert rows("open", 2).count() == 0 and rows("waiting", 2).count() == 1
    assert [(r["key_"], r["id_"]) for r in spark.read.parquet(f"{s.path}/late").collect()] == [(1, 201)]
    assert {(r["user_id"], r["event_id"]) for r in s.flags(spark).collect()} == {(1, 2), (2, 100)}
    s.step(df([]), 3)
    assert s.flags(spark).count() == 2 and rows("waiting", 3).count() == 1
    assert s.flags(spark).where(F.col("flagged_at").isNull()).isEmpty()

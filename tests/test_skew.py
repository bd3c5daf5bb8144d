"""Ranks, quantiles and steps where nearly all values lie in one bucket of equal width, or are one value."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics, policy, quantiles, queue, resample


@pytest.fixture
def tight(monkeypatch):
    """Every bucket of more than 40 rows counts as crowded."""
    monkeypatch.setattr(quantiles, "SMALL", -1)
    monkeypatch.setattr(quantiles, "CROWDED", 40)
    monkeypatch.setattr(quantiles, "SPLITTERS", 64)
    monkeypatch.setattr(quantiles, "TIE_SPLITTERS", 32)


def tables(spark):
    r = random.Random(3)
    rare = [4e-4 * r.random() ** 3 for _ in range(1980)] + [r.random() for _ in range(20)]  # 99 % in one bucket
    ties = [0.25] * 1500 + [None] * 300 + [round(r.random(), 3) for _ in range(200)]
    out = {}
    for name, scores in (("rare", rare), ("ties", ties)):
        rows = [(p, i, s, int(r.random() < 0.1), i % 7 == 0) for i, s in enumerate(scores) for p in ([1] if i % 3 else [2])]
        r.shuffle(rows)
        out[name] = (rows, spark.createDataFrame(rows, "period int, pos long, score double, label int, forced boolean").repartition(6))
    return out


@pytest.mark.parametrize("forced", [None, "forced"])
def test_ranks_are_even_and_right(spark, tight, forced):
    for name, (rows, df) in tables(spark).items():
        bucket, _ = queue.rank_bucket(df, "score", "pos")
        sizes = [x["count"] for x in df.groupBy("period", bucket.alias("b")).count().collect()]
        assert max(sizes) <= 8 * len(rows) / 64, name
        got = {x["pos"]: (x["rank"], x["group_size"]) for x in queue.ranked(df, ["period"], forced=forced).collect()}
        for p in (1, 2):
            order = sorted((x for x in rows if x[0] == p), key=lambda x: (not x[4] if forced else 0, x[2] is None, -(x[2] or 0), x[1]))
            assert [got[x[1]] for x in order] == [(k, len(order)) for k in range(1, len(order) + 1)]


def test_quantiles_and_steps_are_the_same_with_splitters(spark, tight, monkeypatch):
    for _, df in tables(spark).values():
        ask = lambda df=df: sorted(tuple(r) for r in quantiles.exact_quantiles(df, ["period"], "score", [0.0, 0.3, 0.5, 0.999], bounds=(0.0, 1.0)).collect())
        some = df.where("score is not null")
        steps = lambda some=some: sorted(tuple(r) for r in metrics.score_steps(some, ["period"]).collect())
        low = lambda some=some: sorted((r["pos"], r["score"] is None, r["score"] or 0) for r in resample.positive_steps(some.where("period = 1"), "score").collect())
        curve = lambda some=some: sorted(tuple(r) for r in policy.capacity_curve(some, ["period"], [0.01, 0.1]).collect())
        with_splitters = [f() for f in (ask, steps, low, curve)]
        monkeypatch.setattr(quantiles, "CROWDED", 10**9)
        assert with_splitters == [f() for f in (ask, steps, low, curve)]
        monkeypatch.setattr(quantiles, "CROWDED", 40)


def test_places_between_edges(spark):
    edges = [0.1, 0.2, 0.5, 0.9, 1.5]
    values = [None, -1.0, 0.1, 0.15, 0.2, 0.49, 0.5, 1.5, 9.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(quantiles.place(F.col("v"), edges)).collect()]
    assert got == [None if v is None else sum(e <= v for e in edges) for v in values]
    assert [r[0] for r in df.select(quantiles.place(F.col("v"), [])).collect()] == [None, *[0] * 8]

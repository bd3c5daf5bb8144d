"""Periods that reach the scan, groups and forecasts by functions, completeness of queues."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskloom.operators import calibrate, metrics, queue
from riskloom.sources.tables import applications, period_start


@pytest.mark.parametrize("low,high", [(7, 7), (0, 2), (None, 3), (5, None)])
def test_periods_are_those_of_the_computed_column(spark, sf, low, high):
    want = applications(spark, sf).where(F.col("period").between(low if low is not None else -9, high if high is not None else 99))
    got = applications(spark, sf, low, high)
    assert got.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_bounds_of_a_period_reach_the_scan(spark, sf):
    assert [period_start(p) for p in (0, 1, 6, 7)] == ["1995-01-01", "1995-11-01", "2000-01-01", "2000-11-01"]
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    try:
        plan = applications(spark, sf, 7, 7)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(o_orderdate,2000-11-01" in plan and "LessThan(o_orderdate,2001-09-01" in plan


def test_groups_by_function_leave_out_null_groups_and_keep_the_threshold(spark):
    df = spark.range(1000).selectExpr("id / 1000.0D as score", "cast(id % 4 = 0 as int) as label", "id % 10 as k", "cast(NULL as string) as other")
    got = {r["grp"]: r for r in metrics.segment_parity(df, ["k", "other"], 0.1, "score", publish=10, transform={"k": lambda c: F.when(c < 4, "low").when(c < 8, "high")}).collect()}
    assert set(got) == {"low", "high", None} and (got["low"]["rows"], got["high"]["rows"], got[None]["rows"]) == (400, 400, 1000)
    assert got[None]["review_rate"] == pytest.approx(0.1) and got["low"]["review_rate"] == pytest.approx(0.1)


def test_a_rule_must_beat_the_first_by_the_margin(spark):
    rising = spark.createDataFrame([(p, 1 / (1 + 2.0 ** (3 - p))) for p in range(8)], "period int, prior double")
    got = {r["rule"]: r for r in calibrate.backtest_rules(rising).collect()}
    assert [r for r in got if got[r]["chosen"]] == ["full"] and got["full"]["mae"] == pytest.approx(0, abs=1e-6)
    assert got["full"]["forecast"] == pytest.approx(1 / (1 + 2.0**-5), abs=1e-6)
    own = calibrate.backtest_rules(rising, {"carry": calibrate.RULES["carry"], "same": calibrate.RULES["carry"]}).collect()
    assert {r["rule"]: r["chosen"] for r in own} == {"carry": True, "same": False}
    # The table of rules says what the fixed columns say.
    fixed = calibrate.backtest(calibrate.prior_forecasts(rising), start=3).first()
    assert fixed["rule"] == "full" and all(fixed[f"mae_{r}"] == pytest.approx(got[r]["mae"]) for r in got) and fixed["forecast"] == got["full"]["forecast"]


def test_completeness_names_what_is_wrong(spark):
    rows = [("whole", f"a{i}", i) for i in (1, 2, 3)] + [("gap", "a1", 1), ("gap", "a2", 3)] + [("copy", "a1", 1), ("copy", "a1", 2)] + [("twice", "a1", 1), ("twice", "a2", 1)] + [("more", "a1", 1), ("more", "a2", 2)] + [("other", "a1", 1)]
    assigned = spark.createDataFrame(rows, "scenario_run_id string, application_id string, queue_rank long")
    expected = spark.createDataFrame([("whole", 3), ("gap", 2), ("copy", 2), ("twice", 2), ("more", 1), ("lost", 4), ("none", 0)], "scenario_run_id string, headcount long")
    got = {r["scenario_run_id"]: r["status"] for r in queue.completeness(assigned, expected).collect()}
    assert got == {"whole": "complete", "gap": "partial", "copy": "partial", "twice": "partial", "more": "partial", "lost": "missing", "none": "complete", "other": "unexpected"}

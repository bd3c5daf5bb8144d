"""Policy metrics over ranked queues, and comparisons of queues.

A ranking is made once; every capacity is evaluated on it by a join with the few capacities, so more
capacities cost no more sorts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_rate, wilson
from .queue import RULES, headcount, rank_cut, ranked


def policy_metrics(actioned: DataFrame, by: Sequence[str], capacity: float, label: str = "label") -> DataFrame:
    """Per group of a rank-cut queue: sizes, caught, rates."""
    y, act = F.col(label), F.col("action") != "clear"
    rows = actioned.groupBy(*by).agg(
        F.count("*").alias("applications"),
        F.sum(y).cast("long").alias("positives"),
        F.count_if(F.col("action") == "manual_review").alias("queue_size"),
        F.count_if(F.col("action") == "governance_referral").alias("referrals"),
        F.sum(F.when(act, y).otherwise(0)).cast("long").alias("caught"),
        F.sum(F.when(act, 1 - y).otherwise(0)).cast("long").alias("false_positives"),
    )
    acted = F.col("caught") + F.col("false_positives")
    return rows.withColumns(
        {
            "capacity_count": headcount(F.col("applications"), capacity),
            "overflow": F.col("referrals"),
            "catch_rate": F.round(safe_rate(F.col("caught"), F.col("positives")), 6),
            "false_positive_rate": F.round(safe_rate(F.col("false_positives"), F.col("applications") - F.col("positives")), 6),
            "precision": F.round(safe_rate(F.col("caught"), acted), 6),
            "review_rate": F.round(acted / F.col("applications"), 6),
        }
    )


def capacity_curve(df: DataFrame, by: Sequence[str], capacities: Sequence[float], score: str = "score", tie: str = "pos", label: str = "label") -> DataFrame:
    """Queue and caught of every group at every capacity, from one ranking."""
    grid = df.sparkSession.createDataFrame([(float(c),) for c in capacities], "capacity double")
    r = ranked(df.select(*by, score, tie, label), by, score, tie)
    # Prefix sums keep one row for each rank that a capacity can end on.
    most = max(capacities)
    totals = df.groupBy(*by).agg(F.count("*").alias("applications"), F.sum(label).cast("long").alias("positives"))
    head = r.where(F.col("rank") <= headcount(F.col("group_size"), most))
    hits = head.crossJoin(F.broadcast(grid)).where(F.col("rank") <= headcount(F.col("group_size"), F.col("capacity")))
    got = hits.groupBy(*by, "capacity").agg(F.count("*").alias("queue_size"), F.sum(label).cast("long").alias("caught"))
    return got.join(totals, list(by)).withColumn("false_positives", F.col("queue_size") - F.col("caught"))


def capacity_sweep(df: DataFrame, by: Sequence[str], capacities: Sequence[float], **names: str) -> DataFrame:
    """capacity_curve with rates and Wilson intervals."""
    return with_intervals(capacity_curve(df, by, capacities, **names))


def with_intervals(out: DataFrame) -> DataFrame:
    """Rows of a curve with rates and Wilson intervals."""
    bounds = {}
    for name, hits, total in (("catch", F.col("caught"), F.col("positives")), ("precision", F.col("caught"), F.col("queue_size")), ("fpr", F.col("false_positives"), F.col("applications") - F.col("positives"))):
        bounds |= {f"{name}_rate": F.round(safe_rate(hits, total), 6), f"{name}_lo": F.round(wilson(hits, total, False), 6), f"{name}_hi": F.round(wilson(hits, total, True), 6)}
    return out.withColumns(bounds)


def paired_delta(df: DataFrame, by: Sequence[str], capacity: float, first: str, second: str, tie: str = "pos", label: str = "label") -> DataFrame:
    """Difference of two queues over the same rows: caught, good reviewed, and the counts of +1, -1 and 0."""
    a = ranked(df, by, first, tie).withColumnRenamed("rank", "rank_a").drop("group_size")
    both = ranked(a, by, second, tie)
    limit = headcount(F.col("group_size"), capacity)
    d = (F.col("rank_a") <= limit).cast("int") - (F.col("rank") <= limit).cast("int")
    return both.withColumn("d", d).groupBy(*by).agg(
        F.sum(F.col(label) * F.col("d")).cast("long").alias("caught_delta"),
        F.sum((1 - F.col(label)) * F.col("d")).cast("long").alias("good_delta"),
        F.count_if((F.col(label) == 1) & (F.col("d") == 1)).alias("gained"),
        F.count_if((F.col(label) == 1) & (F.col("d") == -1)).alias("lost"),
        F.count_if((F.col(label) == 0) | (F.col("d") == 0)).alias("same"),
    )


def rule_increments(df: DataFrame, by: Sequence[str], capacity: float, score: str = "score", tie: str = "pos", label: str = "label") -> DataFrame:
    """What each rule alone would add at a fixed capacity: flags, overlap, added, displaced, incremental caught, overflow."""
    base = ranked(df, by, score, tie).withColumn("queued", F.col("rank") <= headcount(F.col("group_size"), capacity)).drop("rank", "group_size")
    fired = sum((F.col(r).cast("int") for r in RULES), F.lit(0))
    long = base.withColumn("fired", fired).unpivot([*by, score, tie, label, "queued", "fired"], list(RULES), "rule", "flag")
    cut = rank_cut(long, [*by, "rule"], capacity, score, tie, "flag")
    y, flag, queued, acted = F.col(label), F.col("flag"), F.col("queued"), F.col("action") != "clear"
    return cut.groupBy(*by, "rule").agg(
        F.count_if(flag).alias("flagged"),
        F.count_if(flag & (y == 1)).alias("flagged_fraud"),
        F.count_if(flag & (y == 0)).alias("flagged_good"),
        F.count_if(flag & queued).alias("in_queue"),
        F.count_if(flag & (F.col("fired") > 1)).alias("with_other_rules"),
        F.count_if(flag & ~queued).alias("added"),
        F.count_if(queued & ~acted).alias("displaced"),
        (F.count_if(acted & (y == 1)) - F.count_if(queued & (y == 1))).alias("incremental_caught"),
        F.count_if(F.col("action") == "governance_referral").alias("overflow"),
    )


def funnel(actioned: DataFrame, label: str = "label") -> DataFrame:
    """Four stages of review as rows: assessed, sent, worked, confirmed."""
    one = actioned.agg(
        F.count("*").alias("assessed"),
        F.count_if(F.col("action") != "clear").alias("sent"),
        F.count_if(F.col("action") == "manual_review").alias("worked"),
        F.count_if((F.col("action") == "manual_review") & (F.col(label) == 1)).alias("confirmed"),
    )
    return one.select(F.expr("stack(4, 1, 'assessed', assessed, 2, 'sent', sent, 3, 'worked', worked, 4, 'confirmed', confirmed) as (step, stage, rows)"))

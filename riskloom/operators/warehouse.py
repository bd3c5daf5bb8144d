"""Star schema: dimensions with deterministic surrogate keys, the fact grain, KPI roll-ups and movements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_rate
from .queue import cutoffs

UNKNOWN = "UNKNOWN"


def dimension(df: DataFrame, natural: str, key: str, unknown: bool = False) -> DataFrame:
    """(key, natural): distinct values numbered in order. Dimensions are small; their window is over distinct values only."""
    values = df.select(natural).where(F.col(natural).isNotNull()).distinct()
    out = values.select(F.row_number().over(Window.orderBy(natural)).cast("long").alias(key), natural)
    if unknown:
        out = out.unionByName(df.sparkSession.createDataFrame([(0, UNKNOWN)], out.schema))
    return out


def policy_id(capacity: float, period: Column | int) -> Column:
    """Name of a policy version: capacity in thousandths, three digits, and its period."""
    p = F.lit(period) if isinstance(period, int) else period
    return F.concat(F.lit("cap-"), F.lpad(F.lit(str(round(capacity * 1000))), 3, "0"), F.lit("-p"), p.cast("string"))


def actioned(df: DataFrame, by: Sequence[str], capacity: float, score: str = "score") -> DataFrame:
    """Rows with the action of the discrete threshold cut of their group; the cuts are a row for each group."""
    cuts = cutoffs(df, by, capacity, score, discrete=True).drop("group_size")
    return df.join(cuts, list(by)).withColumn("action", F.when(F.col(score) >= F.col("cut"), "manual_review").otherwise("clear")).drop("cut")


def facts(acted: DataFrame, grain: Sequence[str], label: str = "label") -> DataFrame:
    """The fact grain: counts of applications, fraud, fraud caught and good customers reviewed."""
    hit, y = F.col("action") == "manual_review", F.col(label) == 1
    return acted.groupBy(*grain).agg(
        F.count("*").alias("application_count"),
        F.count_if(y).alias("fraud_count"),
        F.count_if(hit & y).alias("fraud_caught"),
        F.count_if(hit & ~y).alias("good_customer_reviews"),
    )


def rollup(fact: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ratios of sums over the given keys of a fact table that still has its action."""
    n = F.col("application_count")
    rows = fact.groupBy(*keys).agg(
        F.sum(n).alias("applications"),
        F.sum("fraud_count").alias("fraud_attempts"),
        F.sum("fraud_caught").alias("fraud_caught"),
        F.sum("good_customer_reviews").alias("good_customers_reviewed"),
        F.sum(F.when(F.col("action") == "manual_review", n).otherwise(0)).alias("queue_size"),
    )
    return rows.withColumns(
        {
            "fraud_rate_bps": F.round(10000.0 * F.col("fraud_attempts") / F.col("applications"), 2),
            "review_rate": F.round(F.col("queue_size") / F.col("applications"), 6),
            "catch_rate": F.round(safe_rate(F.col("fraud_caught"), F.col("fraud_attempts")), 6),
            "investigator_yield": F.round(safe_rate(F.col("fraud_caught"), F.col("queue_size")), 6),
            "friction_rate": F.round(safe_rate(F.col("good_customers_reviewed"), F.col("applications") - F.col("fraud_attempts")), 6),
            "fraud_missed": F.col("fraud_attempts") - F.col("fraud_caught"),
        }
    )


def movements(kpi: DataFrame, by: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """kpi with <column>_change against the row before of the same group; NULL for the first."""
    w = Window.partitionBy(*by).orderBy(order)
    return kpi.withColumns({f"{c}_change": F.round(F.col(c) - F.lag(c).over(w), 6) for c in columns})


def versus(kpi: DataFrame, by: Sequence[str], model: str, first: str, second: str, columns: Sequence[str]) -> DataFrame:
    """One row for each group that has both models: their values and the differences second - first, by conditional aggregation."""
    of = lambda m, c: F.max(F.when(F.col(model) == m, F.col(c)))
    aggs = [of(m, c).alias(f"{m}_{c}") for m in (first, second) for c in columns]
    both = kpi.where(F.col(model).isin(first, second)).groupBy(*by).agg(F.countDistinct(model).alias("models"), *aggs).where("models = 2").drop("models")
    return both.withColumns({f"{c}_gap": F.round(F.col(f"{second}_{c}") - F.col(f"{first}_{c}"), 6) for c in columns})

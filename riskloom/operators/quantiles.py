"""Exact quantiles of groups of any size.

The engine's exact percentile holds all distinct values of a group in one task. Here values are counted first
(a partial aggregation), counts are summed by bucket of equal width, and only the buckets in which a wanted
rank falls are ordered. A group costs at most ``BUCKETS`` rows beside those buckets. Where values crowd in a few
buckets, the buckets lie between splitters of a sketch instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 65_536
#: Rows of a bucket that one task orders without trouble; bytes of input below which no bucket has more.
CROWDED, SMALL = 1 << 20, 32 << 20
#: Splitters of crowded values and of the ids of ties.
SPLITTERS, TIE_SPLITTERS = 2048, 1024


def place(x: Column, edges: Sequence[float]) -> Column:
    """How many of the ascending edges are at or below x, by halving; NULL for NULL."""
    e, m = F.array(*(F.lit(v) for v in edges)), len(edges)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(m.bit_length()))))
    found = F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s <= m) & (F.get(e, lo + s - 1) <= x), lo + s).otherwise(lo))
    return F.when(x.isNotNull(), found)


def splitters(df: DataFrame, column: str, n: int) -> list[float]:
    """n - 1 values between which about as many rows lie, by a mergeable sketch; values that repeat are those of many ties."""
    got = df.agg(F.percentile_approx(F.col(column).cast("double"), [i / n for i in range(1, n)], 10 * n)).first()[0]
    return list(got or [])


def _input_bytes(df: DataFrame) -> int:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def crowded(df: DataFrame, bucket: Column) -> bool:
    """Whether a bucket holds more rows than one task should order. Small inputs need no pass to tell."""
    if _input_bytes(df) <= SMALL:
        return False
    return (df.groupBy(bucket.alias("b")).count().agg(F.max("count")).first()[0] or 0) > CROWDED


def spread(df: DataFrame, column: str, plain: Column) -> Column:
    """A bucket that rises with the column: ``plain`` (of equal width, as a rule) unless its buckets are crowded, then between splitters."""
    if not crowded(df, plain):
        return plain
    return F.coalesce(place(F.col(column).cast("double"), sorted(set(splitters(df, column, SPLITTERS)))), F.lit(0)).cast("int")


def exact_quantiles(df: DataFrame, by: Sequence[str], column: str, qs: Sequence[float], discrete: bool = False, bounds: tuple[float, float] | None = None) -> DataFrame:
    """(by…, n, q0, q1, …): the quantiles of the non-null values of each group.

    discrete: the least value whose share of values at or below reaches q; else interpolated between the two
    neighbours of q * (n - 1). bounds: a range that holds most values (others go to the outer buckets); None:
    that of the column, by one more pass.
    """
    rows = df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("value_"))
    if bounds is None:
        lo, hi = rows.agg(F.min("value_"), F.max("value_")).first()
        bounds = (lo or 0.0, hi if hi is not None and hi > (lo or 0.0) else (lo or 0.0) + 1.0)
    lo, hi = (float(b) for b in bounds)
    cell = F.least(F.greatest(F.floor((F.col("value_") - lo) / (hi - lo) * BUCKETS), F.lit(-1)), F.lit(BUCKETS)).cast("int")
    keyed = rows.groupBy(*by, "value_").agg(F.count("*").alias("n_")).withColumn("bucket_", spread(rows, "value_", cell))
    sums = keyed.groupBy(*by, "bucket_").agg(F.sum("n_").alias("in_"))
    group = Window.partitionBy(*by)
    sums = sums.withColumn("before_", F.sum("in_").over(group.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_")).withColumn("n", F.sum("in_").over(group))

    def ranks(q: float) -> list[Column]:
        n = F.col("n").cast("double")
        if discrete:
            return [F.greatest(F.ceil(F.lit(q) * n) - 1, F.lit(0)).cast("long")]
        at = F.lit(q) * (n - 1)
        return [F.floor(at).cast("long"), F.ceil(at).cast("long")]

    wanted = [r for q in qs for r in ranks(q)]
    inside = [(F.col("before_") <= r) & (r < F.col("before_") + F.col("in_")) for r in wanted]
    some = inside[0]
    for c in inside[1:]:
        some = some | c
    chosen = sums.where(some).select(*by, "bucket_", "before_", "n")
    run = Window.partitionBy(*by, "bucket_").orderBy("value_").rowsBetween(Window.unboundedPreceding, 0)
    values = keyed.join(chosen, [*by, "bucket_"]).withColumn("upto_", F.col("before_") + F.sum("n_").over(run))
    holds = lambda r: (F.col("upto_") - F.col("n_") <= r) & (r < F.col("upto_"))
    found = values.groupBy(*by).agg(F.max("n").alias("n"), *(F.max(F.when(holds(r), F.col("value_"))).alias(f"v{i}_") for i, r in enumerate(wanted)))
    out, i = [], 0
    for k, q in enumerate(qs):
        if discrete:
            out.append(F.col(f"v{i}_").alias(f"q{k}"))
            i += 1
        else:
            at = F.lit(q) * (F.col("n").cast("double") - 1)
            a, b = F.col(f"v{i}_"), F.col(f"v{i + 1}_")
            out.append((a + (at - F.floor(at)) * (b - a)).alias(f"q{k}"))
            i += 2
    return found.select(*by, "n", *out)


def upper_median(df: DataFrame, by: Sequence[str], column: str, bounds: tuple[float, float] | None = None) -> DataFrame:
    """(by…, n, q0): the value at rank n // 2, counted from 0, of each group's non-null values.

    That is the least value whose share of values at or below it exceeds one half: the discrete quantile just above it."""
    return exact_quantiles(df, by, column, [math.nextafter(0.5, 1.0)], discrete=True, bounds=bounds)

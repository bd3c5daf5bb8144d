"""Presentation measures over policy counts: capture, leakage, hit rate, utilisation, value ranges; evidence documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.scalars import ratio
from .decide import utility
from .quantiles import exact_quantiles

#: (exposure, review cost, friction cost) at the low and the high end of a value range.
LOW, HIGH = (5000.0, 27.0, 300.0), (20000.0, 7.0, 0.0)


def measures(policies: DataFrame) -> DataFrame:
    """policies with the measures of a policy card. Needs applications, positives, queue_size, caught, false_positives, capacity."""
    caught, fp, queue = F.col("caught"), F.col("false_positives"), F.col("queue_size")
    value = lambda a: utility(caught, fp, queue, F.lit(a[0]), F.lit(a[1]), F.lit(a[2]))
    ceiling = F.greatest(F.floor(F.col("applications").cast("double") * F.col("capacity")).cast("long"), F.lit(1))
    return policies.withColumns(
        {
            "capture": F.round(ratio(caught, F.col("positives")), 6),
            "missed": F.col("positives") - caught,
            "leakage": F.round(ratio(F.col("positives") - caught, F.col("positives")), 6),
            "hit_rate": F.round(ratio(caught, queue), 6),
            "alerts_per_fraud": F.round(ratio(queue, caught), 6),
            "utilisation": F.round(queue / ceiling, 6),
            "insult_rate": F.round(ratio(fp, F.col("applications") - F.col("positives")), 6),
            "net_low": F.round(value(LOW), 2),
            "net_high": F.round(value(HIGH), 2),
        }
    )


def document(rows: DataFrame) -> DataFrame:
    """One evidence document: the rows (a small aggregate) as a JSON array in order of their columns."""
    return rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns)))).alias("document"))


def extract(documents: DataFrame, schema: StructType) -> DataFrame:
    """The rows of evidence documents, typed."""
    return documents.select(F.inline(F.from_json("document", ArrayType(schema))))


def run_id(*parts: Column | str) -> Column:
    """A deterministic id of a run from what defines it."""
    return F.substring(F.sha2(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(p) for p in parts)), 256), 1, 32)


def latency(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Exact p50, p95, p99 and maximum."""
    q = exact_quantiles(df, by, value, [0.5, 0.95, 0.99])
    worst = df.groupBy(*by).agg(F.count("*").alias("samples"), F.max(value).alias("worst"))
    return worst.join(q.drop("n"), by).select(*by, "samples", *(F.round(f"q{i}", 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))), F.round("worst", 6).alias("worst"))

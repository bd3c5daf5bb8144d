"""Review queues: rank cut, threshold cuts, forced referral, rule flags.

Ranks are taken within groups (model, period) in two steps: rows are ordered inside score buckets of the group,
and the counts of the buckets above (a small aggregate) are added. So no task orders a whole group, however few
groups there are, and where scores crowd the buckets are cut between splitters of a sketch. Ties fall by id. Rows whose group key is NULL take no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.scalars import uuid5
from . import quantiles
from .quantiles import exact_quantiles


def headcount(n: Column, capacity: Column | float) -> Column:
    """Rows a capacity lets through: floor(n * capacity) in binary doubles, at least 1."""
    c = F.lit(float(capacity)) if not isinstance(capacity, Column) else capacity
    return F.greatest(F.floor(n.cast("double") * c).cast("long"), F.lit(1).cast("long"))


#: Buckets of equal width that scores in [0, 1] fall into; others go to the outer ones.
RANK_BUCKETS = 2048


def rank_bucket(df: DataFrame, score: str, tie: str) -> tuple[Column, int]:
    """(a bucket that falls from rank to rank, the number of buckets).

    Of equal width as long as none is crowded. Else between splitters of a sketch of the scores, and rows of one score that
    many share (NULL too) between splitters of their ids, so that no bucket has much more than its share whatever the scores are."""
    plain = F.coalesce(F.floor(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) * RANK_BUCKETS).cast("int"), F.lit(-1))
    if not quantiles.crowded(df, plain):
        return plain, RANK_BUCKETS + 2
    edges = quantiles.splitters(df, score, quantiles.SPLITTERS)
    heavy = sorted({a for a, b in zip(edges, edges[1:], strict=False) if a == b})
    wide = quantiles.TIE_SPLITTERS
    later = F.lit(0)
    if isinstance(df.schema[tie].dataType, NumericType):
        among = quantiles.place(F.col(tie).cast("double"), sorted(set(quantiles.splitters(df, tie, wide))))
        shared = F.col(score).isNull() | F.col(score).cast("double").isin(heavy)
        later = F.when(shared, F.coalesce(among, F.lit(0))).otherwise(0)
    value = F.coalesce(quantiles.place(F.col(score).cast("double"), sorted(set(edges))), F.lit(-1))
    return (value + 1) * wide + (wide - 1 - later), (len(edges) + 2) * wide


def ranked(df: DataFrame, by: Sequence[str], score: str = "score", tie: str = "pos", forced: str | None = None) -> DataFrame:
    """df with ``rank`` (forced rows first, then by falling score, NULL last, then by id) and ``group_size``."""
    bucket, buckets = rank_bucket(df, score, tie)
    order = [F.desc(score), F.asc(tie)]
    if forced:
        bucket = bucket + F.when(F.col(forced), buckets).otherwise(0)
        order = [F.desc(forced), *order]
    keyed = df.withColumn("bucket_", bucket)
    sums = keyed.groupBy(*by, "bucket_").agg(F.count("*").alias("in_"))
    group = Window.partitionBy(*by)
    above = F.coalesce(F.sum("in_").over(group.orderBy(F.desc("bucket_")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, "bucket_", above.alias("above_"), F.sum("in_").over(group).alias("group_size"))
    inside = Window.partitionBy(*by, "bucket_").orderBy(*order)
    numbered = keyed.withColumn("rank", F.row_number().over(inside))
    return numbered.join(sums, [*by, "bucket_"]).withColumn("rank", F.col("rank") + F.col("above_")).select(*df.columns, "rank", "group_size")


def rank_cut(df: DataFrame, by: Sequence[str], capacity: float, score: str = "score", tie: str = "pos", forced: str | None = None) -> DataFrame:
    """df with action: manual_review for the first headcount ranks, governance_referral for forced rows beyond, else clear."""
    out = ranked(df, by, score, tie, forced)
    review = F.col("rank") <= headcount(F.col("group_size"), capacity)
    other = F.when(F.col(forced), "governance_referral").otherwise("clear") if forced else F.lit("clear")
    return out.withColumn("action", F.when(review, "manual_review").otherwise(other))


def cutoffs(df: DataFrame, by: Sequence[str], capacity: float, score: str = "score", discrete: bool = False) -> DataFrame:
    """The score cut of each group: the (1 - capacity) quantile of scores in [0, 1], interpolated or one of the scores."""
    q = exact_quantiles(df, by, score, [1.0 - capacity], discrete, bounds=(0.0, 1.0))
    return q.select(*by, F.col("q0").alias("cut"), F.col("n").alias("group_size"))


def threshold_cut(df: DataFrame, by: Sequence[str], capacity: float, score: str = "score", discrete: bool = False) -> DataFrame:
    """df with cut and action; the whole block of ties at the cut is reviewed. The cuts are one row a group."""
    cuts = cutoffs(df, by, capacity, score, discrete)
    return df.join(cuts, list(by)).withColumn("action", F.when(F.col(score) >= F.col("cut"), "manual_review").otherwise("clear"))


def overshoot(df: DataFrame, by: Sequence[str], capacity: float, score: str = "score", discrete: bool = False) -> DataFrame:
    """Per group: headcount, threshold queue, what ties add to it and its rate."""
    cut = threshold_cut(df, by, capacity, score, discrete)
    rows = cut.groupBy(*by).agg(F.max("group_size").alias("applications"), F.count_if(F.col("action") == "manual_review").alias("queue_size"))
    head = F.floor(F.col("applications").cast("double") * F.lit(capacity)).cast("long")
    return rows.withColumn("capacity_headcount", head).withColumn("overshoot", F.col("queue_size") - head).withColumn("overshoot_rate", F.round((F.col("queue_size") - head) / F.greatest(head, F.lit(1)), 6))


#: Names of the concentration rules, in order of their bit.
RULES = ("rule_velocity", "rule_device", "rule_foreign", "rule_branch")


def rule_flags(df: DataFrame, branch: str = "orders_of_customer", quantile: float = 0.99) -> DataFrame:
    """df with the four concentration predicates; the last against a population quantile (one row, broadcast)."""
    edge = exact_quantiles(df, [], branch, [quantile], bounds=(0.0, float(1 << 16))).select(F.col("q0").alias("branch_edge"))
    return df.crossJoin(F.broadcast(edge)).withColumns(
        {
            "rule_velocity": F.col("orders_of_customer") >= 16,
            "rule_device": F.coalesce("parts", F.lit(-1)) >= 7,
            "rule_foreign": (F.col("nation") >= 20) & (F.coalesce("avg_discount", F.lit(1.0)) < 0.03),
            "rule_branch": F.col(branch) >= F.col("branch_edge"),
        }
    ).drop("branch_edge")


def any_rule(enabled: Sequence[str]) -> Column:
    """True where an enabled rule fires; false if none is enabled."""
    return reduce(lambda a, b: a | b, (F.col(r) for r in enabled), F.lit(False))


def top_k(df: DataFrame, by: Sequence[str], k: int, score: str = "score", tie: str = "pos") -> DataFrame:
    """The k best rows of each group with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def assignments(cut: DataFrame, run: Column) -> DataFrame:
    """(scenario_run_id, application_id, queue_rank, action) of the reviewed rows of a cut, as a sink takes them.

    The id of a run follows from its name, so that a load that runs again meets its own rows.
    """
    reviewed = cut.where(F.col("action") == "manual_review")
    return reviewed.select(uuid5(run).alias("scenario_run_id"), "application_id", F.col("rank").cast("long").alias("queue_rank"), "action")


def completeness(assigned: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (scenario_run_id, headcount) with the rows a queue has, and status: complete if ranks go from 1 to the head count without gap
    or copy and each application is there once; missing if no row is there, else partial. Runs that nobody expected are unexpected.
    """
    seen = assigned.groupBy("scenario_run_id").agg(
        F.count("*").alias("assigned"), F.count_distinct("queue_rank").alias("ranks"), F.count_distinct("application_id").alias("applications"), F.min("queue_rank").alias("low"), F.max("queue_rank").alias("high")
    )
    both = expected.join(seen, "scenario_run_id", "full").withColumn("assigned", F.coalesce("assigned", F.lit(0).cast("long")))
    n = F.col("headcount")
    whole = (F.col("assigned") == n) & (F.col("ranks") == n) & (F.col("applications") == n) & (F.col("low") == 1) & (F.col("high") == n)
    status = F.when(n.isNull(), "unexpected").when((F.col("assigned") == 0) & (n > 0), "missing").when(whole | (F.col("assigned") + n == 0), "complete").otherwise("partial")
    return both.select("scenario_run_id", "headcount", "assigned", status.alias("status"))

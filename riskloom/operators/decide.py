"""Decisions: utility over assumption grids, policy grids, Pareto frontier, gates, refusal, acceptance."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .queue import RULES, headcount, rank_bucket

#: Economic assumptions that are varied together (fixed values).
EXPOSURE = (5000.0, 8900.0, 12500.0, 16900.0, 20000.0)
REVIEW = (7.0, 17.0, 27.0)
FRICTION = (0.0, 50.0, 150.0, 300.0)
EFFECTIVENESS = (0.6, 0.75, 0.9, 1.0)
LOSS = (0.4, 0.6, 0.8, 1.0)


def utility(caught: Column, fp: Column, queue: Column, exposure: Column, review: Column, friction: Column, effectiveness: Column | float = 1.0, loss: Column | float = 1.0) -> Column:
    """Value of caught fraud less friction for good customers and the cost of reviews."""
    return caught * effectiveness * loss * exposure - fp * friction - queue * review


def grid(spark: SparkSession, surface: bool = False) -> DataFrame:
    """The 60 combinations of exposure, review and friction; with surface, times the 16 of effectiveness and loss."""
    axes = [EXPOSURE, REVIEW, FRICTION] + ([EFFECTIVENESS, LOSS] if surface else [])
    names = ["exposure", "review", "friction"] + (["effectiveness", "loss"] if surface else [])
    return spark.createDataFrame([tuple(x) for x in product(*axes)], ", ".join(f"{n} double" for n in names))


def compare(pairs: DataFrame, assumptions: DataFrame, keys: Sequence[str], cell: Sequence[str] = ()) -> DataFrame:
    """Challenger (c_) less incumbent (i_) over all assumptions: positive count and share, min, median, max. The grid is of fixed size and broadcast."""
    x = pairs.crossJoin(F.broadcast(assumptions))
    extra = [F.col("effectiveness"), F.col("loss")] if "loss" in assumptions.columns else []
    d = lambda s: utility(F.col(f"{s}_caught"), F.col(f"{s}_fp"), F.col(f"{s}_queue"), F.col("exposure"), F.col("review"), F.col("friction"), *extra)
    x = x.withColumn("d", d("c") - d("i"))
    rows = x.groupBy(*keys, *cell).agg(
        F.count("*").alias("cells"), F.count_if(F.col("d") > 0).alias("positive"), F.round(F.min("d"), 2).alias("worst"), F.round(F.median("d"), 2).alias("median"), F.round(F.max("d"), 2).alias("best")
    )
    return rows.withColumn("positive_share", F.round(F.col("positive") / F.col("cells"), 6))


def policy_grid(flagged: DataFrame, models: Sequence[str], capacities: Sequence[float], by: Sequence[str] = ("period",), tie: str = "pos", label: str = "label") -> DataFrame:
    """Counts of every (model, capacity, subset of rules), from one histogram of scores for each model and set of fired rules.

    A subset puts the rows on which one of its rules fired first; the rest of the queue goes by score. The histogram says in
    which score bucket each queue ends, so only rows of those buckets are ordered; no row is copied for every subset.
    """
    spark = flagged.sparkSession
    bits = sum((F.when(F.col(r), F.shiftleft(F.lit(1), i)).otherwise(0) for i, r in enumerate(RULES)), F.lit(0)).cast("int")
    long = flagged.select(*by, tie, label, bits.alias("bits"), *models).unpivot([*by, tie, label, "bits"], list(models), "model", "score")
    long = long.withColumn("bucket", rank_bucket(long, "score", tie)[0])
    group = [*by, "model", "mask"]
    masks = spark.range(1 << len(RULES)).select(F.col("id").cast("int").alias("mask"))
    caps = spark.createDataFrame([(float(c),) for c in capacities], "capacity double")

    hist = long.groupBy(*by, "model", "bucket", "bits").agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("hits"))
    each = hist.crossJoin(F.broadcast(masks)).withColumn("forced", F.col("bits").bitwiseAND(F.col("mask")) != 0)
    rest = lambda c: F.sum(F.when(~F.col("forced"), F.col(c)).otherwise(0))
    steps = each.groupBy(*group, "bucket").agg(rest("n").alias("n"), rest("hits").alias("hits"), F.sum("n").alias("all_n"), F.sum("hits").alias("all_hits"))
    whole, down = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns(
        {
            "upto": F.sum("n").over(down), "hits_upto": F.sum("hits").over(down), "size": F.sum("all_n").over(whole),
            "forced_n": F.sum(F.col("all_n") - F.col("n")).over(whole), "forced_hits": F.sum(F.col("all_hits") - F.col("hits")).over(whole), "lowest": F.min("bucket").over(whole),
        }
    )
    # Places that are left for other rows; where there are none, the lowest bucket stands for the queue.
    places = F.greatest(headcount(F.col("size"), F.col("capacity")) - F.col("forced_n"), F.lit(0))
    cells = steps.crossJoin(F.broadcast(caps)).withColumn("places", places)
    ends = cells.where(((F.col("places") > 0) & (F.col("upto") - F.col("n") < F.col("places")) & (F.col("places") <= F.col("upto"))) | ((F.col("places") == 0) & (F.col("bucket") == F.col("lowest"))))
    ends = cut(ends.select(*group, "capacity", "bucket", "size", "forced_n", "forced_hits", "places", (F.col("places") - F.col("upto") + F.col("n")).alias("taken"), (F.col("hits_upto") - F.col("hits")).alias("hits_above")))

    wanted = ends.where("places > 0").groupBy(*group, "bucket").agg(F.max("taken").alias("most"))
    inside = long.join(wanted, [*by, "model", "bucket"]).where(F.col("bits").bitwiseAND(F.col("mask")) == 0)
    order = Window.partitionBy(*group, "bucket").orderBy(F.desc("score"), F.asc(tie))
    inside = inside.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("most"))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.select(*group, "bucket", F.col("place").cast("long").alias("taken"), F.sum(label).over(run).cast("long").alias("hits_inside"))
    x = ends.join(inside, [*group, "bucket", "taken"], "left")
    reviewed_forced = F.least("forced_n", headcount(F.col("size"), F.col("capacity")))
    caught = F.col("forced_hits") + F.when(F.col("places") > 0, F.col("hits_above") + F.col("hits_inside")).otherwise(0)
    acted = F.col("forced_n") + F.col("places")
    return x.select(
        *group, "capacity", (reviewed_forced + F.col("places")).alias("queue_size"), (F.col("forced_n") - reviewed_forced).alias("overflow"),
        caught.cast("long").alias("caught"), (acted - caught).cast("long").alias("false_positives"),
    )


#: Policies that may be compared pair by pair.
POLICIES = 20_000


def pareto(policies: DataFrame, key: str, more: Sequence[str], less: Sequence[str]) -> DataFrame:
    """Policies that no other dominates: as good everywhere and better somewhere. For policy tables of up to POLICIES rows; more are an error."""
    policies = cut(policies)
    if policies.count() > POLICIES:
        raise ValueError(f"more than {POLICIES} policies are no policy table")
    other = policies.select(*(F.col(c).alias(f"o_{c}") for c in [*more, *less]))
    good = [F.col(f"o_{c}") >= F.col(c) for c in more] + [F.col(f"o_{c}") <= F.col(c) for c in less]
    strict = [F.col(f"o_{c}") > F.col(c) for c in more] + [F.col(f"o_{c}") < F.col(c) for c in less]
    every, some = good[0], strict[0]
    for g, s in zip(good[1:], strict[1:], strict=True):
        every, some = every & g, some | s
    return policies.join(F.broadcast(other), every & some, "left_anti")


def recommend(policies: DataFrame, eligible: Column, order: Sequence[str], name: str) -> DataFrame:
    """One row: the eligible policy of greatest order, or 'no robust recommendation'."""
    best = F.max(F.when(eligible, F.struct(*order, name)))
    return policies.agg(best.alias("b"), F.count_if(eligible).alias("eligible")).select(F.coalesce(F.col(f"b.{name}"), F.lit("no robust recommendation")).alias("recommendation"), "eligible")


def gates(observed: DataFrame, rules: Sequence[tuple[str, str, float, str]]) -> DataFrame:
    """(gate, observed, threshold, passed) from one row of observations; rules: name, column, threshold, comparison."""
    ops = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b}
    rows = F.array(*(F.struct(F.lit(n).alias("gate"), F.col(c).cast("double").alias("observed"), F.lit(float(t)).alias("threshold"), F.coalesce(ops[o](F.col(c), F.lit(float(t))), F.lit(False)).alias("passed")) for n, c, t, o in rules))
    return observed.select(F.inline(rows))


def champion(gate_rows: DataFrame, selected: str, incumbent: str) -> DataFrame:
    """The selected model if every gate passes, else the incumbent; counts of gates."""
    return gate_rows.agg(
        F.count("*").alias("gates"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.when(F.bool_and("passed"), selected).otherwise(incumbent).alias("champion")
    )


def refuse(recommendation: Column, reasons: Column) -> Column:
    """Recommendation after refusal: what was recommended only where no reason stands."""
    return F.when(F.size(reasons) > 0, "no robust recommendation").otherwise(recommendation)


def acceptance(current: DataFrame, accepted: DataFrame, tolerance: float) -> DataFrame:
    """Reasons against what was accepted: outstanding if not listed, lapsed if the measure left before +- tolerance, else accepted.

    current: segment, measure, value. accepted: segment, measure, before. Ratios lapse downwards, gaps upwards.
    """
    j = current.join(accepted, ["segment", "measure"], "left")
    gone = F.when(F.col("measure").contains("ratio"), F.col("value") < F.col("before") - tolerance).otherwise(F.col("value") > F.col("before") + tolerance)
    return j.withColumn("state", F.when(F.col("before").isNull(), "outstanding").when(gone, "lapsed").otherwise("accepted"))

"""Model metrics as aggregations: ranking, calibration, drift, parity.

Ranking metrics first collapse rows to distinct scores by a partial aggregation; the running sums then go
over score buckets in two steps (totals of the buckets above plus a window inside the bucket), so no single
task orders all scores.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, right_closed_bin
from .quantiles import exact_quantiles, spread

BUCKETS = 256


def score_steps(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """Distinct scores of each group with n, tp, and the rows and positives at or above them (cum_n, cum_tp)."""
    steps = df.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("tp"))
    steps = steps.withColumn("bucket", spread(df, score, F.floor(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) * BUCKETS).cast("int")))
    sums = steps.groupBy(*by, "bucket").agg(F.sum("n").alias("bn"), F.sum("tp").alias("bt"))
    above = Window.partitionBy(*by).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, "bucket", F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("base_n"), F.coalesce(F.sum("bt").over(above), F.lit(0)).alias("base_tp"))
    inside = Window.partitionBy(*by, "bucket").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    run = steps.withColumn("run_n", F.sum("n").over(inside)).withColumn("run_tp", F.sum("tp").over(inside))
    out = run.join(base, [*by, "bucket"])
    return out.select(*by, score, "n", "tp", (F.col("base_n") + F.col("run_n")).alias("cum_n"), (F.col("base_tp") + F.col("run_tp")).alias("cum_tp"))


def average_precision(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Step sum of recall gained times precision over distinct scores."""
    area = F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_n"))
    return steps.groupBy(*by).agg((area / F.nullif(F.sum("tp"), F.lit(0))).alias("average_precision"))


def auroc(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of positive-negative pairs in the right order, ties half."""
    neg_below_twice = F.sum(F.col("tp") * (2 * (F.col("cum_n") - F.col("cum_tp")) - (F.col("n") - F.col("tp"))))
    pos, neg = F.sum("tp"), F.sum(F.col("n") - F.col("tp"))
    return steps.groupBy(*by).agg((F.lit(1.0) - neg_below_twice / F.nullif(2.0 * pos * neg, F.lit(0.0))).alias("auroc"))


def losses(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "label", eps: float = 1e-9) -> DataFrame:
    """Prevalence, log loss, Brier score and its skill over the constant prevalence."""
    p, y = clip(F.col(score), eps), F.col(label)
    rows = df.groupBy(*by).agg(
        F.avg(y).alias("prevalence"),
        F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"),
        F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"),
    )
    return rows.withColumn("brier_skill", 1 - F.col("brier") / F.nullif(F.col("prevalence") * (1 - F.col("prevalence")), F.lit(0.0)))


def calibration_bins(df: DataFrame, by: Sequence[str], bins: int = 15, score: str = "score", label: str = "label") -> DataFrame:
    """Right-closed bins of equal width: rows, mean score, mean label."""
    inner = [i / bins for i in range(1, bins)]
    return df.withColumn("bin", right_closed_bin(F.col(score), inner)).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("mean_label"))


def expected_calibration_error(df: DataFrame, by: Sequence[str], bins: int = 15, **names: str) -> DataFrame:
    b = calibration_bins(df, by, bins, **names)
    return b.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("mean_label"))) / F.sum("n")).alias("ece"))


def quantile_edges(reference: DataFrame, column: str, bins: int = 10) -> list[float] | None:
    """Distinct inner quantiles of the reference, or None for up to ten distinct values (then values are categories). A few numbers come to the driver."""
    if reference.select(column).where(F.col(column).isNotNull()).distinct().limit(11).count() <= 10:
        return None
    q = exact_quantiles(reference, [], column, [i / bins for i in range(bins + 1)]).first()
    return sorted({q[f"q{i}"] for i in range(bins + 1)})[1:-1]


def psi_category(column: str, edges: list[float] | None) -> Column:
    c = F.col(column)
    named = right_closed_bin(c.cast("double"), edges).cast("string") if edges is not None else c.cast("string")
    return F.coalesce(F.when(c.isNotNull(), named), F.lit("__missing__"))


def psi(long: DataFrame, keys: Sequence[str], category: str, side: str, eps: float = 1e-6) -> DataFrame:
    """Stability index by keys of rows with a category, side 'r' (reference) or 'c' (current): one aggregation, shares + eps, not renormalised."""
    counts = long.groupBy(*keys, category).agg(F.count_if(F.col(side) == "r").alias("r"), F.count_if(F.col(side) == "c").alias("c"))
    w = Window.partitionBy(*keys)
    s = counts.withColumn("rs", F.col("r") / F.sum("r").over(w) + eps).withColumn("cs", F.col("c") / F.sum("c").over(w) + eps)
    return s.groupBy(*keys).agg(F.sum((F.col("cs") - F.col("rs")) * F.ln(F.col("cs") / F.col("rs"))).alias("psi"), F.sum("c").alias("rows"))


def psi_status(psi: Column) -> Column:
    return F.when(psi >= 0.25, "block").when(psi >= 0.10, "warn").otherwise("pass")


#: Groups with fewer positives have their rates withheld.
PUBLISH = 200


def segment_parity(df: DataFrame, segments: Sequence[str], capacity: float, score: str, label: str = "label", publish: int = PUBLISH, transform: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Rates of each group of each segmentation at one population-wide interpolated threshold; NULL for withheld groups.

    ``transform`` maps a segmentation to a function of its column that gives the groups (bands of a number, say); rows
    for which it is NULL take no part in that segmentation, but in the threshold.
    """
    for name, f in (transform or {}).items():
        df = df.withColumn(name, f(F.col(name)).cast("string"))
    cut = exact_quantiles(df, [], score, [1.0 - capacity], bounds=(0.0, 1.0)).select(F.col("q0").alias("cut"))
    rows = df.select(score, label, *segments).crossJoin(F.broadcast(cut))
    long = rows.unpivot([score, label, "cut"], list(segments), "segment", "grp") if len(segments) > 1 else rows.select(score, label, "cut", F.lit(segments[0]).alias("segment"), F.col(segments[0]).alias("grp"))
    hit, y = F.col(score) >= F.col("cut"), F.col(label) == 1
    if transform:
        long = long.where(F.col("grp").isNotNull() | ~F.col("segment").isin(*transform))
    g = long.groupBy("segment", "grp").agg(
        F.count("*").alias("rows"),
        F.count_if(y).alias("positives"),
        F.count_if(hit).alias("selected"),
        F.count_if(hit & y).alias("caught"),
        F.abs(F.avg(score) - F.avg(label)).alias("gap"),
    )
    show = F.col("positives") >= publish
    neg = F.col("rows") - F.col("positives")
    return g.select(
        "segment", "grp", "rows", "positives", show.alias("publishable"),
        F.when(show, F.round(F.col("caught") / F.col("positives"), 6)).alias("tpr"),
        F.when(show, F.round((F.col("selected") - F.col("caught")) / F.nullif(neg, F.lit(0)), 6)).alias("fpr"),
        F.when(show, F.round(F.col("caught") / F.greatest(F.col("selected"), F.lit(1)), 6)).alias("precision"),
        F.when(show, F.round(F.col("selected") / F.col("rows"), 6)).alias("review_rate"),
        F.when(show, F.round("gap", 6)).alias("calibration_error"),
    )


def parity_gaps(groups: DataFrame) -> DataFrame:
    """Per segment: gaps of TPR and FPR and the min/max ratio of review rates over publishable groups; NULL for fewer than two."""
    shown = F.when(F.col("publishable"), 1)
    two = F.count(shown) >= 2
    spread = lambda c: F.when(two, F.round(F.max(c) - F.min(c), 6))
    return groups.groupBy("segment").agg(
        F.count(shown).alias("publishable_groups"),
        F.count_if(~F.col("publishable")).alias("withheld_groups"),
        spread("tpr").alias("tpr_gap"),
        spread("fpr").alias("fpr_gap"),
        F.when(two, F.round(F.min("review_rate") / F.nullif(F.max("review_rate"), F.lit(0.0)), 6)).alias("review_rate_ratio"),
    )


def fairness_reasons(gaps: DataFrame) -> DataFrame:
    """gaps with the list of triggered reasons."""
    reason = lambda cond, text: F.when(cond, F.concat_ws(" ", "segment", F.lit(text)))
    listed = F.array(
        reason(F.col("tpr_gap") > 0.10, "TPR exceeds 0.10"),
        reason(F.col("fpr_gap") > 0.10, "FPR exceeds 0.10"),
        reason(~F.col("review_rate_ratio").between(0.80, 1.25), "review-rate ratio is outside 0.80-1.25"),
    )
    return gaps.withColumn("reasons", F.array_join(F.array_compact(listed), "; "))

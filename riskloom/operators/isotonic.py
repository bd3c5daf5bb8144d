"""Isotonic calibration and calibration lines as distributed aggregations.

The isotonic fit of labels on scores is the slope of the least concave curve above the cumulative positives, counted from
the highest score down. Concave hulls merge: the hull of all points is the hull of the hulls of contiguous parts. So each
part of a bounded number of rows gives the corners of its own hull, parts are joined sixteen at a time until one is left, and
corners are few (of n rows, in the order of n^(2/3) at most). Parts are cut by cumulative rows, so they are even whatever the scores are.
Pooling is exact: corners are whole numbers and are compared without rounding.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.lineage import cut
from ..functions.scalars import expit, logit
from . import metrics

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of the first parts, parts joined in a round, knots of a fit that may be sent to every task (16 bytes each).
PART, JOIN, MOST_KNOTS = 1 << 16, 16, 2_000_000
#: Newton steps, the penalty on the slope, and the step that counts as none.
STEPS, RIDGE, STILL = 12, 1e-6, 1e-8


def upper_corners(x: Sequence[int], y: Sequence[int]) -> list[int]:
    """Places of the corners of the least concave curve above points given by ascending x, whole numbers; the ends are corners."""
    keep: list[int] = []
    for i in range(len(x)):
        while len(keep) > 1:
            a, b = keep[-2], keep[-1]
            if (y[b] - y[a]) * (x[i] - x[b]) > (y[i] - y[b]) * (x[b] - x[a]):
                break
            keep.pop()
        keep.append(i)
    return keep


def _hull(points: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """Corners of the hull of each part of ``width`` cumulative rows."""

    def corners(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cum_n")
        return rows.iloc[upper_corners([int(v) for v in rows["cum_n"]], [int(v) for v in rows["cum_tp"]])]

    parted = points.withColumn("part_", F.floor(F.col("cum_n") / width).cast("long"))
    return parted.groupBy(*by, "part_").applyInPandas(corners, parted.schema).drop("part_")


def isotonic_fit(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label", part: int = PART) -> DataFrame:
    """by…, score, n, tp, value: the isotonic fit at every distinct score of each group.

    Rows without a score, a label or a group take no part. Ties of the score are one point. An empty table gives no rows."""
    by = list(by)
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    steps = cut(metrics.score_steps(rows, by, score, label).withColumn("cum_tp", F.col("cum_tp").cast("long")))
    most = steps.agg(F.max("cum_n")).first()[0] or 0
    points = steps.select(*by, "cum_n", "cum_tp")
    # The curve begins at no rows and no positives.
    start = (steps.select(*by).distinct() if by else steps.limit(1).select()).withColumn("cum_n", F.lit(0).cast("long")).withColumn("cum_tp", F.lit(0).cast("long"))
    hull, width = points.unionByName(start), part
    while True:
        hull = _hull(hull, by, width)
        if width > most:
            break
        width *= JOIN
    return _values(steps, cut(hull), by, score, part)


def _values(steps: DataFrame, hull: DataFrame, by: list[str], score: str, part: int) -> DataFrame:
    """Each step with the slope of the segment above it: corners and steps meet part by part."""
    named = StructType([f for f in steps.schema if f.name in (*by, score, "n", "tp")])
    schema = StructType([*(named[c] for c in (*by, score, "n", "tp"))]).add("value", "double")

    def segments(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cum_n")
        x, y = rows["cum_n"].to_numpy(), rows["cum_tp"].to_numpy()
        out = {c: rows[c].iloc[0] for c in by} | {"low_": x[:-1], "high_": x[1:], "slope_": (y[1:] - y[:-1]) / np.maximum(1, x[1:] - x[:-1])}
        return pd.DataFrame(out, columns=[*by, "low_", "high_", "slope_"])

    kind = StructType([steps.schema[c] for c in by]).add("low_", "long").add("high_", "long").add("slope_", "double")
    # Corners of a group are few; a segment goes to every part that it covers.
    made = hull.groupBy(*by).applyInPandas(segments, kind)
    laid = made.withColumn("part_", F.explode(F.sequence(F.floor((F.col("low_") + 1) / part), F.floor(F.col("high_") / part))))
    parted = steps.withColumn("part_", F.floor(F.col("cum_n") / part))

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("high_")
        at = np.searchsorted(right["high_"].to_numpy(), left["cum_n"].to_numpy())
        return left.assign(value=right["slope_"].to_numpy()[at] if len(left) else [])[[*by, score, "n", "tp", "value"]]

    return parted.groupBy(*by, "part_").cogroup(laid.groupBy(*by, "part_")).applyInPandas(look, schema)


def isotonic_knots(fitted: DataFrame, score: str = "score") -> tuple[np.ndarray, np.ndarray]:
    """Scores and values of the ends of the blocks of one fit; as many as the fit has corners twice over."""
    ends = fitted.groupBy("value").agg(F.min(score).alias("a"), F.max(score).alias("b")).orderBy("a").limit(MOST_KNOTS // 2 + 1).collect()
    if len(ends) > MOST_KNOTS // 2:
        raise ValueError(f"a fit of more than {MOST_KNOTS} knots")
    return np.array([v for r in ends for v in (r["a"], r["b"])], float), np.array([r["value"] for r in ends for _ in range(2)], float)


def isotonic_predict(df: DataFrame, knots: tuple[np.ndarray, np.ndarray], score: str = "score") -> DataFrame:
    """df with the score replaced by the fit, straight lines between blocks, the end values beyond them; null stays null."""
    sent = df.sparkSession.sparkContext.broadcast(knots)

    @F.pandas_udf("double")
    def fit(x: pd.Series) -> pd.Series:
        at, values = sent.value
        return pd.Series(np.interp(x.to_numpy(float), at, values) if len(at) else np.full(len(x), np.nan)).where(x.notna().to_numpy())

    return df.withColumn(score, fit(F.col(score).cast("double")))


def calibration_lines(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "label", steps: int = STEPS, ridge: float = RIDGE) -> DataFrame:
    """by…, slope, intercept, mean_logit, prevalence, converged: labels regressed on the scores' logits, group by group.

    Newton's method from a flat line: a pass is one aggregation of five sums for all groups over counted scores, and only those
    sums come to the driver. The slope has a penalty, as hardly regularised fits have. A group of one class has no line (nulls);
    labels that a score tells apart have none either: the slope grows to the last step and ``converged`` is false."""
    by = list(by)
    counted = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, logit(F.col(score)).alias("l")).agg(F.count("*").cast("double").alias("n"), F.sum(label).cast("double").alias("y"))
    counted = cut(counted)
    kinds = [counted.schema[c] for c in by]
    first = counted.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("y").alias("y"), (F.sum(F.col("n") * F.col("l")) / F.sum("n")).alias("m")).collect()
    key = lambda r: tuple(r[c] for c in by)
    known = {key(r): (r["n"], r["y"], r["m"]) for r in first}
    line = {k: (0.0, float(np.log(y / n / (1 - y / n))), False) for k, (n, y, _) in known.items() if 0 < y < n}
    here = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in by]
    for _ in range(steps):
        going = [(*k, a, b) for k, (a, b, still) in line.items() if not still]
        if not going:
            break
        names = StructType([type(f)(f"{f.name}_", f.dataType, True) for f in kinds]).add("a", "double").add("b", "double")
        now = F.broadcast(df.sparkSession.createDataFrame(going, names))
        joined = counted.join(now, here[0] if len(here) == 1 else [*here]) if by else counted.crossJoin(now)
        p = expit(F.col("a") * F.col("l") + F.col("b"))
        w, off = F.col("n") * p * (1 - p), F.col("y") - F.col("n") * p
        sums = joined.groupBy(*by).agg(F.sum(off * F.col("l")).alias("ga"), F.sum(off).alias("gb"), F.sum(w * F.col("l") * F.col("l")).alias("haa"), F.sum(w * F.col("l")).alias("hab"), F.sum(w).alias("hbb"))
        for r in sums.collect():
            a, b, _ = line[key(r)]
            ga, haa = r["ga"] - ridge * a, r["haa"] + ridge
            det = haa * r["hbb"] - r["hab"] ** 2
            da, db = ((ga * r["hbb"] - r["gb"] * r["hab"]) / det, (haa * r["gb"] - r["hab"] * ga) / det) if det > 0 else (0.0, 0.0)
            line[key(r)] = (a + da, b + db, abs(da) <= STILL and abs(db) <= STILL and det > 0)
    rows = [(*k, *(line[k][:2] if k in line else (None, None)), m, y / n, bool(k in line and line[k][2])) for k, (n, y, m) in known.items()]
    out = StructType([type(f)(f.name, f.dataType, True) for f in kinds]).add("slope", "double").add("intercept", "double").add("mean_logit", "double").add("prevalence", "double").add("converged", "boolean")
    return df.sparkSession.createDataFrame(rows, out)


def intercept_parts(lines: DataFrame, before: str = "prior") -> DataFrame:
    """lines with slope_term (what the slope's departure from 1 adds to the intercept), offset (the level error where scores lie) and prior_move
    (log odds of the prevalence less those of the column ``before``)."""
    slope_term = -(F.col("slope") - 1) * F.col("mean_logit")
    return lines.withColumn("slope_term", slope_term).withColumn("offset", F.col("intercept") - slope_term).withColumn("prior_move", logit(F.col("prevalence")) - logit(F.col(before)))

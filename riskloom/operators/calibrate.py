"""Score maps, risk bands, prior forecasts, label latency, walk-forward intervals."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import expit, logit
from .quantiles import exact_quantiles

#: Share of labels that have arrived by age in periods; between the knots it is linear, after the last it stays.
MATURITY = {0: 0.0, 1: 0.35, 2: 0.60, 3: 0.78, 4: 0.86, 6: 0.92, 12: 1.0}
#: Fixed: share of outcomes that are never labelled.
NEVER = 0.15
TRIGGER = 0.10


def score_reference(df: DataFrame, value: str, fit: Column) -> DataFrame:
    """One row: median and scale (population deviation, floored) of the fitting rows."""
    rows = df.where(fit)
    spread = rows.agg(F.greatest(F.stddev_pop(value), F.lit(1e-9)).alias("scale"))
    return exact_quantiles(rows, [], value, [0.5]).select(F.col("q0").alias("median")).crossJoin(F.broadcast(spread))


def score_map(value: Column, median: Column, scale: Column) -> Column:
    return expit((value - median) / scale)


def maturity(age: Column, knots: Mapping[int, float] = MATURITY) -> Column:
    """Piecewise-linear share of labels by age."""
    points = sorted(knots.items())
    out = F.when(age <= points[0][0], F.lit(points[0][1]))
    for (a, x), (b, y) in zip(points[:-1], points[1:], strict=True):
        out = out.when(age <= b, F.lit(x) + (age - a) * ((y - x) / (b - a)))
    return out.otherwise(F.lit(points[-1][1]))


def label_latency(priors: DataFrame, lags: Sequence[int], period: str = "period", prior: str = "prior") -> DataFrame:
    """For every lag: the move of the true logit prior, the observed move with immature labels, and whether triggers agree."""
    grid = priors.sparkSession.createDataFrame([(x,) for x in lags], "lag int")
    w = Window.partitionBy("lag").orderBy(period)
    x = priors.crossJoin(F.broadcast(grid)).withColumn("before", F.lag(prior).over(w))
    seen = lambda p, age: p * maturity(age) * (1 - NEVER)
    usable = F.col("lag") > 0
    true = logit(F.col(prior)) - logit(F.col("before"))
    observed = F.when(usable, logit(seen(F.col(prior), F.col("lag"))) - logit(seen(F.col("before"), F.col("lag") + 1)))
    bias = F.when(usable, F.ln(maturity(F.col("lag")) / maturity(F.col("lag") + 1)))
    x = x.where(F.col("before").isNotNull()).withColumns({"true_move": F.round(true, 6), "observed_move": F.round(observed, 6), "bias": F.round(bias, 6)})
    return x.withColumns({"fires": F.abs("observed_move") > TRIGGER, "agrees": (F.abs("observed_move") > TRIGGER) == (F.abs("true_move") > TRIGGER)}).select(period, "lag", "true_move", "observed_move", "bias", "fires", "agrees")


def corrected_latency(priors: DataFrame, lags: Sequence[int], period: str = "period", prior: str = "prior") -> DataFrame:
    """The trigger with observed rates divided by the maturity that the curve gives them, lag by lag.

    As exact as the curve is: where it holds, the corrected move is the true one. NULL where nothing has matured.
    """
    grid = priors.sparkSession.createDataFrame([(x,) for x in lags], "lag int")
    w = Window.partitionBy("lag").orderBy(period)
    x = priors.crossJoin(F.broadcast(grid)).withColumn("before", F.lag(prior).over(w)).where(F.col("before").isNotNull())
    share = lambda age: maturity(age) * (1 - NEVER)
    back = lambda p, age: logit(p * share(age) / F.nullif(share(age), F.lit(0.0)))
    true = logit(F.col(prior)) - logit(F.col("before"))
    moved = F.when(maturity(F.col("lag")) > 0, back(F.col(prior), F.col("lag")) - back(F.col("before"), F.col("lag") + 1))
    x = x.withColumns({"true_move": F.round(true, 6), "corrected_move": F.round(moved, 6)})
    return x.withColumn("agrees", (F.abs("corrected_move") > TRIGGER) == (F.abs("true_move") > TRIGGER)).select(period, "lag", "true_move", "corrected_move", "agrees")


def lag_summary(latency: DataFrame) -> DataFrame:
    """By lag: decisions that can be made, how many agree with the true priors, the bias, and whether it is below the trigger."""
    g = latency.groupBy("lag").agg(F.count("observed_move").alias("decisions"), F.count_if(F.col("agrees")).alias("agreeing"), F.max("bias").alias("bias"))
    return g.withColumn("usable", F.coalesce(F.abs("bias") < TRIGGER, F.lit(False)))


def minimum_usable_lag(summary: DataFrame) -> DataFrame:
    """One row: the least lag whose bias stays below the trigger (NULL: none)."""
    return summary.agg(F.min(F.when(F.col("usable"), F.col("lag"))).alias("minimum_usable_lag"))


def prior_forecasts(priors: DataFrame, period: str = "period", prior: str = "prior") -> DataFrame:
    """One-step-ahead forecasts on the logit scale by three rules: carry, and last + damping * slope of the last three."""
    w = Window.orderBy(period)  # a row for each period
    last, back1, back2 = F.col("l"), F.lag("l", 1).over(w), F.lag("l", 2).over(w)
    # Least-squares slope over three equidistant points is half the difference of the ends; over two, their difference.
    slope = F.coalesce((last - back2) / 2, last - back1, F.lit(0.0))
    x = priors.withColumn("l", logit(F.col(prior))).withColumn("slope", slope).withColumn("target", F.lead("l").over(w))
    return x.withColumns({"carry": last, "damped": last + 0.5 * F.col("slope"), "full": last + F.col("slope")})


def _trend(history: Column, damping: float) -> Column:
    """The last value and so much of the least-squares slope of the last three (of two, their difference; of one, none)."""
    last = F.element_at(history, -1)
    third = F.when(F.size(history) >= 3, (last - F.try_element_at(history, F.lit(-3))) / 2)
    return last + damping * F.coalesce(third, last - F.try_element_at(history, F.lit(-2)), F.lit(0.0))


#: Rules of a forecast: the logits of all periods so far (an array, the latest last) to the next one. The first is what others must beat.
RULES: dict[str, Callable[[Column], Column]] = {"carry": lambda h: F.element_at(h, -1), "damped": lambda h: _trend(h, 0.5), "full": lambda h: _trend(h, 1.0)}


def backtest_rules(priors: DataFrame, rules: Mapping[str, Callable[[Column], Column]] = RULES, start: int = 3, margin: float = 0.02, period: str = "period", prior: str = "prior") -> DataFrame:
    """(rule, mae, forecast, chosen) of any rules: mean absolute error on the logits of targets from ``start`` on, the forecast of the next prior,
    and whether the rule is chosen: the least error of the others if it beats the first rule's by more than the margin, else the first.

    A rule reads closed periods only. Ties fall to the rule given first. One row a period comes in, so arrays are short.
    """
    w = Window.orderBy(period)  # a row for each period
    x = priors.withColumn("l", logit(F.col(prior)))
    x = x.withColumns({"history": F.collect_list("l").over(w.rowsBetween(Window.unboundedPreceding, 0)), "target": F.lead("l").over(w)})
    made = x.select(period, "target", F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.lit(n).alias("rule"), f(F.col("history")).alias("f")) for i, (n, f) in enumerate(rules.items())))).alias("r"))
    due = F.col("target").isNotNull() & (F.col(period) + 1 >= start)
    one = made.groupBy("r.at", "r.rule").agg(F.avg(F.when(due, F.abs(F.col("target") - F.col("r.f")))).alias("mae"), F.max_by("r.f", period).alias("next"))
    every = Window.partitionBy()  # a row for each rule
    base = F.max(F.when(F.col("at") == 0, F.col("mae"))).over(every)
    best = F.min(F.when(F.col("at") > 0, F.struct("mae", "at"))).over(every)
    pick = F.when(best["mae"] < base - margin, best["at"]).otherwise(0)
    return one.select("rule", F.round("mae", 6).alias("mae"), F.round(expit(F.col("next")), 6).alias("forecast"), (F.col("at") == F.coalesce(pick, F.lit(0))).alias("chosen"))


def backtest(forecasts: DataFrame, start: int, margin: float = 0.02, period: str = "period", prior: str = "prior") -> DataFrame:
    """Mean absolute errors of the rules on targets from ``start`` on; the best rule if it beats carry by more than the margin, else carry.
    With the forecast of the next prior and the shift it means."""
    due = F.col("target").isNotNull() & (F.col(period) + 1 >= start)
    mae = lambda c: F.avg(F.when(due, F.abs(F.col("target") - F.col(c))))
    last = lambda c: F.max_by(c, period)
    row = forecasts.agg(*(mae(c).alias(f"mae_{c}") for c in ("carry", "damped", "full")), *(last(c).alias(f"last_{c}") for c in ("carry", "damped", "full")), last(prior).alias("last_prior"))
    best = F.when(F.col("mae_full") < F.col("mae_damped"), "full").otherwise("damped")
    rule = F.when(F.least("mae_full", "mae_damped") < F.col("mae_carry") - margin, best).otherwise("carry")
    row = row.withColumn("rule", rule)
    chosen = F.when(F.col("rule") == "full", F.col("last_full")).when(F.col("rule") == "damped", F.col("last_damped"))
    return row.select(
        *(F.round(f"mae_{c}", 6).alias(f"mae_{c}") for c in ("carry", "damped", "full")),
        "rule",
        F.round(F.coalesce(expit(chosen), F.col("last_prior")), 6).alias("forecast"),
        F.round(F.coalesce(chosen - F.col("last_carry"), F.lit(0.0)), 6).alias("shift"),
    )


#: 97.5 % quantiles of Student's t by degrees of freedom (fixed values).
T_975 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262}


def interval(df: DataFrame, value: str, n: int) -> DataFrame:
    """Mean, deviation, confidence interval of the mean and prediction interval of the next of n values."""
    t = T_975[n - 1]
    m, s = F.avg(value), F.stddev_samp(value)
    return df.agg(F.count(value).alias("n"), m.alias("m"), s.alias("s")).select(
        "n",
        F.round("m", 6).alias("mean"),
        F.round("s", 6).alias("sd"),
        *(F.round(F.col("m") + sign * t * F.col("s") / n**0.5, 6).alias(f"mean_{b}") for b, sign in (("lo", -1), ("hi", 1))),
        *(F.round(F.col("m") + sign * t * F.col("s") * (1 + 1 / n) ** 0.5, 6).alias(f"next_{b}") for b, sign in (("lo", -1), ("hi", 1))),
    )

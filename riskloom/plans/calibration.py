"""Queries on calibration, priors and latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import prior_shift as shift
from ..operators import calibrate, isotonic, policy
from ..operators.quantiles import upper_median
from ..sources.tables import APPS_SQL, SCORED_SQL, applications, scored
from .queues import _RANKED, HEAD5
from .registry import query
from .star import _BAND_CASE, _BAND_SQL, risk_bands

_LOGIT = "ln(least(greatest({p}, 1e-6), 1e0 - 1e-6) / (1e0 - least(greatest({p}, 1e-6), 1e0 - 1e-6)))"


@query(f"""WITH {APPS_SQL}, r AS (SELECT median(incumbent_score) AS m, greatest(stddev_pop(incumbent_score), 1e-9) AS s FROM apps WHERE period = 6) SELECT pos, round(1 / (1 + exp(-((incumbent_score - m) / s))), 6) AS probability FROM apps, r""")
def score_map(spark, sf):
    a = applications(spark, sf)
    ref = calibrate.score_reference(a, "incumbent_score", F.col("period") == 6)
    return a.crossJoin(F.broadcast(ref)).select("pos", F.round(calibrate.score_map(F.col("incumbent_score"), F.col("median"), F.col("scale")), 6).alias("probability"))


@query(f"WITH {APPS_SQL}, {_BAND_SQL} SELECT pos, period, {_BAND_CASE} AS band FROM apps, edges")
def risk_bands_fixed_edges(spark, sf):
    return risk_bands(applications(spark, sf)).select("pos", "period", "band")


_PRIORS_SQL = APPS_SQL + ", priors AS (SELECT period, avg(label) AS prior FROM apps GROUP BY 1)"


def _priors(spark, sf):
    return applications(spark, sf).groupBy("period").agg(F.avg("label").alias("prior"))


@query(f"""WITH {_PRIORS_SQL}, l AS (SELECT period, prior, {_LOGIT.format(p="prior")} AS l FROM priors), x AS (SELECT *, lead(l) OVER w AS target, coalesce((l - lag(l, 2) OVER w) / 2, l - lag(l) OVER w, 0e0) AS slope FROM l WINDOW w AS (ORDER BY period)),
m AS (SELECT avg(abs(target - l)) FILTER (WHERE period >= 2) AS c, avg(abs(target - (l + 5e-1 * slope))) FILTER (WHERE period >= 2) AS d, avg(abs(target - (l + slope))) FILTER (WHERE period >= 2) AS f, arg_max(l, period) AS ll, arg_max(l + 5e-1 * slope, period) AS ld, arg_max(l + slope, period) AS lf, arg_max(prior, period) AS lp FROM x),
r AS (SELECT *, CASE WHEN least(f, d) < c - 2e-2 THEN CASE WHEN f < d THEN 'full' ELSE 'damped' END ELSE 'carry' END AS rule FROM m), k AS (SELECT *, CASE rule WHEN 'full' THEN lf WHEN 'damped' THEN ld END AS ch FROM r)
SELECT round(c, 6) AS mae_carry, round(d, 6) AS mae_damped, round(f, 6) AS mae_full, rule, round(coalesce(1 / (1 + exp(-ch)), lp), 6) AS forecast, round(coalesce(ch - ll, 0), 6) AS shift FROM k""")
def prior_forecast_backtest(spark, sf):
    return calibrate.backtest(calibrate.prior_forecasts(_priors(spark, sf)), start=3)


#: The operator's rules and two of our own.
RULES = calibrate.RULES | {"mean": lambda h: F.aggregate(h, F.lit(0.0), lambda a, v: a + v) / F.size(h), "halfway": lambda h: (F.element_at(h, -1) + F.element_at(h, 1)) / 2}


@query(f"""WITH {_PRIORS_SQL}, l AS (SELECT period, {_LOGIT.format(p="prior")} AS l FROM priors), x AS (SELECT *, lead(l) OVER w AS target, coalesce((l - lag(l, 2) OVER w) / 2, l - lag(l) OVER w, 0e0) AS slope, avg(l) OVER w AS mean, first_value(l) OVER w AS origin FROM l WINDOW w AS (ORDER BY period)),
f AS (SELECT period, target, unnest([0, 1, 2, 3, 4]) AS nth, unnest(['carry', 'damped', 'full', 'mean', 'halfway']) AS rule, unnest([l, l + 5e-1 * slope, l + slope, mean, (l + origin) / 2]) AS f FROM x),
m AS (SELECT nth, rule, avg(abs(target - f)) FILTER (WHERE period >= 2) AS mae, arg_max(f, period) AS next FROM f GROUP BY 1, 2), b AS (SELECT CASE WHEN min(mae) FILTER (WHERE nth > 0) < max(mae) FILTER (WHERE nth = 0) - 2e-2 THEN arg_min(nth, mae) FILTER (WHERE nth > 0) ELSE 0 END AS pick FROM m)
SELECT rule, round(mae, 6) AS mae, round(1 / (1 + exp(-next)), 6) AS forecast, nth = pick AS chosen FROM m, b""")
def prior_forecast_rules(spark, sf):
    """Forecast rules as a table of functions, so that a rule is one line."""
    return calibrate.backtest_rules(_priors(spark, sf), RULES)


@query(f"""WITH {_PRIORS_SQL}, d AS (SELECT {_LOGIT.format(p="max(CASE WHEN period = 7 THEN prior END)")} - {_LOGIT.format(p="max(CASE WHEN period = 6 THEN prior END)")} AS d FROM priors)
SELECT pos, round(CASE WHEN d = 0 THEN challenger ELSE 1 / (1 + exp(-({_LOGIT.format(p="challenger")} + d))) END, 6) AS shifted FROM apps, d WHERE period = 7""")
def prior_shift(spark, sf):
    from ..functions.scalars import logit

    at = lambda p: logit(F.max(F.when(F.col("period") == p, F.col("prior"))))
    delta = _priors(spark, sf).agg((at(7) - at(6)).alias("d"))
    return applications(spark, sf, 7, 7).crossJoin(F.broadcast(delta)).select("pos", F.round(shift(F.col("challenger"), F.col("d")), 6).alias("shifted"))


def _maturity_sql(a: str) -> str:
    pts = sorted(calibrate.MATURITY.items())
    whens = " ".join(f"WHEN {a} <= {y} THEN {p} + ({a} - {x}) * {(q - p) / (y - x)!r}" for (x, p), (y, q) in zip(pts[:-1], pts[1:], strict=True))
    return f"CAST(CASE WHEN {a} <= 0 THEN 0 {whens} ELSE 1 END AS DOUBLE)"


def _latency_sql():
    obs = lambda p, a: _LOGIT.format(p=f"({p} * {_maturity_sql(a)} * 85e-2)")
    return f"""WITH {_PRIORS_SQL}, x AS (SELECT period, prior, CAST(lag AS INTEGER) AS lag, lag(prior) OVER (PARTITION BY lag ORDER BY period) AS before FROM priors, (SELECT unnest([0, 1, 2, 3, 6]) AS lag)),
m AS (SELECT period, lag, round({_LOGIT.format(p="prior")} - {_LOGIT.format(p="before")}, 6) AS true_move, CASE WHEN lag > 0 THEN round({obs("prior", "lag")} - {obs("before", "(lag + 1)")}, 6) END AS observed_move,
  CASE WHEN lag > 0 THEN round(ln({_maturity_sql("lag")} / {_maturity_sql("(lag + 1)")}), 6) END AS bias FROM x WHERE before IS NOT NULL)
SELECT *, abs(observed_move) > 1e-1 AS fires, (abs(observed_move) > 1e-1) = (abs(true_move) > 1e-1) AS agrees FROM m"""


@query(_latency_sql())
def label_latency_trigger(spark, sf):
    return calibrate.label_latency(_priors(spark, sf), [0, 1, 2, 3, 6])


LAGS = [0, 1, 2, 3, 6]


def _corrected_sql():
    back = lambda p, a: _LOGIT.format(p=f"({p} * ({_maturity_sql(a)} * 85e-2) / ({_maturity_sql(a)} * 85e-2))")
    return f"""WITH {_PRIORS_SQL}, x AS (SELECT period, prior, CAST(lag AS INTEGER) AS lag, lag(prior) OVER (PARTITION BY lag ORDER BY period) AS before FROM priors, (SELECT unnest({LAGS}) AS lag)),
m AS (SELECT period, lag, round({_LOGIT.format(p="prior")} - {_LOGIT.format(p="before")}, 6) AS true_move, CASE WHEN lag > 0 THEN round({back("prior", "lag")} - {back("before", "(lag + 1)")}, 6) END AS corrected_move FROM x WHERE before IS NOT NULL)
SELECT *, (abs(corrected_move) > 1e-1) = (abs(true_move) > 1e-1) AS agrees FROM m"""


@query(_corrected_sql())
def label_latency_correction(spark, sf):
    return calibrate.corrected_latency(_priors(spark, sf), LAGS)


_LAGS_SQL = f"l AS ({_latency_sql()}), g AS (SELECT lag, count(observed_move) AS decisions, count(*) FILTER (WHERE agrees) AS agreeing, max(bias) AS bias, coalesce(abs(max(bias)) < 1e-1, false) AS usable FROM l GROUP BY 1)"


@query(f"WITH {_LAGS_SQL} SELECT * FROM g")
def label_lag_summary(spark, sf):
    return calibrate.lag_summary(label_latency_trigger(spark, sf))


@query(f"WITH {_LAGS_SQL} SELECT min(lag) FILTER (WHERE usable) AS minimum_usable_lag FROM g")
def minimum_usable_lag(spark, sf):
    return calibrate.minimum_usable_lag(label_lag_summary(spark, sf))


@query(f"""WITH {SCORED_SQL}, {_RANKED}, f AS (SELECT period, sum(CASE WHEN rank <= {HEAD5} THEN label ELSE 0 END) / CAST(sum(label) AS DOUBLE) AS catch FROM ranked WHERE model = 'challenger' AND period BETWEEN 3 AND 7 GROUP BY 1), a AS (SELECT count(*) AS n, avg(catch) AS m, stddev_samp(catch) AS s FROM f)
SELECT n, round(m, 6) AS mean, round(s, 6) AS sd, round(m - 2776e-3 * s / sqrt(5e0), 6) AS mean_lo, round(m + 2776e-3 * s / sqrt(5e0), 6) AS mean_hi, round(m - 2776e-3 * s * sqrt(1 + 2e-1), 6) AS next_lo, round(m + 2776e-3 * s * sqrt(1 + 2e-1), 6) AS next_hi FROM a""")
def walk_forward_interval(spark, sf):
    s = scored(applications(spark, sf)).where("model = 'challenger' and period between 3 and 7")
    folds = policy.capacity_curve(s, ["period"], [0.05]).select((F.col("caught") / F.col("positives")).alias("catch"))
    return calibrate.interval(folds, "catch", 5)


@query(f"""WITH {APPS_SQL}, steps AS (SELECT period, challenger AS score, count(*) AS n, sum(label) AS tp FROM apps GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ct, row_number() OVER w AS k FROM steps WINDOW w AS (PARTITION BY period ORDER BY score)),
pairs AS (SELECT a.period, a.k AS a, b.k AS b, CAST(b.ct - a.ct + a.tp AS DOUBLE) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS m FROM c a JOIN c b ON a.period = b.period AND a.k <= b.k),
least_mean AS (SELECT period, a, b, min(m) OVER (PARTITION BY period, a ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM pairs)
SELECT c.period, round(c.score, 9) AS score, CAST(c.n AS BIGINT) AS n, CAST(c.tp AS BIGINT) AS tp, round(max(m), 6) AS value FROM least_mean l JOIN c ON c.period = l.period AND c.k = l.b GROUP BY c.period, c.score, c.n, c.tp""")
def isotonic_calibration(spark, sf):
    """The isotonic fit of labels on the challenger's scores in every period; SQL takes the greatest of the least means of all ranges."""
    a = applications(spark, sf).select("period", "label", F.col("challenger").alias("score"))
    return isotonic.isotonic_fit(a, ["period"]).select("period", F.round("score", 9).alias("score"), "n", "tp", F.round("value", 6).alias("value"))


def _newton_sql(steps: int) -> str:
    """Newton's steps, one after another, from five sums of every group."""
    parts = [
        "g AS MATERIALIZED (SELECT model, period, " + _LOGIT.format(p="score") + " AS l, CAST(label AS DOUBLE) AS y FROM scored)",
        "t0 AS (SELECT model, period, CAST(0 AS DOUBLE) AS a, ln(avg(y) / (1 - avg(y))) AS b FROM g GROUP BY 1, 2 HAVING avg(y) > 0 AND avg(y) < 1)",
    ]
    for k in range(steps):
        parts.append(f"s{k} AS (SELECT model, period, a, b, sum((y - p) * l) - {isotonic.RIDGE} * a AS ga, sum(y - p) AS gb, sum(p * (1 - p) * l * l) + {isotonic.RIDGE} AS haa, sum(p * (1 - p) * l) AS hab, sum(p * (1 - p)) AS hbb FROM (SELECT g.*, a, b, 1 / (1 + exp(-(a * l + b))) AS p FROM g JOIN t{k} USING (model, period)) GROUP BY 1, 2, 3, 4)")
        parts.append(f"t{k + 1} AS (SELECT model, period, a + (ga * hbb - gb * hab) / (haa * hbb - hab * hab) AS a, b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM s{k})")
    parts.append(f"lines AS (SELECT model, period, a AS slope, b AS intercept, m AS mean_logit, q AS prevalence FROM (SELECT model, period, avg(l) AS m, avg(y) AS q FROM g GROUP BY 1, 2) LEFT JOIN t{steps} USING (model, period))")
    return f"WITH {SCORED_SQL}, " + ", ".join(parts)


@query(f"{_newton_sql(8)} SELECT model, period, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(mean_logit, 6) AS mean_logit, round(prevalence, 6) AS prevalence FROM lines")
def calibration_newton(spark, sf):
    """Slope and intercept of labels on logits for every model and period, by Newton steps."""
    lines = isotonic.calibration_lines(scored(applications(spark, sf)), ["model", "period"])
    return lines.select("model", "period", *(F.round(c, 6).alias(c) for c in ("slope", "intercept", "mean_logit", "prevalence")))


@query(f"""{_newton_sql(8)}, parts AS (SELECT t.model, t.period, t.slope, t.intercept, -(t.slope - 1) * t.mean_logit AS slope_term, {_LOGIT.format(p="t.prevalence")} - {_LOGIT.format(p="b.prevalence")} AS prior_move FROM lines t LEFT JOIN lines b ON b.model = t.model AND b.period = t.period - 1)
SELECT model, period, round(intercept, 6) AS intercept, round(slope_term, 6) AS slope_term, round(intercept - slope_term, 6) AS offset_at_scores, round(prior_move, 6) AS prior_move FROM parts""")
def calibration_decomposition(spark, sf):
    """The intercept split into what the slope puts there and the level error where scores lie, with the move of the prevalence from the period before."""
    lines = isotonic.calibration_lines(scored(applications(spark, sf)), ["model", "period"])
    before = lines.select("model", (F.col("period") + 1).alias("period"), F.col("prevalence").alias("prior"))
    parts = isotonic.intercept_parts(lines.join(before, ["model", "period"], "left"))
    return parts.select("model", "period", *(F.round(c, 6).alias(name) for c, name in (("intercept", "intercept"), ("slope_term", "slope_term"), ("offset", "offset_at_scores"), ("prior_move", "prior_move"))))


@query(f"""WITH {APPS_SQL}, r AS (SELECT period, channel, challenger, row_number() OVER (PARTITION BY period, channel ORDER BY challenger) - 1 AS k, count(*) OVER (PARTITION BY period, channel) AS n FROM apps)
SELECT period, channel, n, round(challenger, 9) AS upper_median FROM r WHERE k = n // 2""")
def upper_medians(spark, sf):
    """The score at rank n // 2 of every period and channel: of two middle ones the greater."""
    a = applications(spark, sf)
    return upper_median(a, ["period", "channel"], "challenger", bounds=(0.0, 1.0)).select("period", "channel", "n", F.round("q0", 9).alias("upper_median"))

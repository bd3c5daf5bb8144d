"""Queries on queues and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import once
from ..operators import policy, queue
from ..sources.tables import APPS_SQL, CAPACITIES, FEATURES_SQL, SCORED_SQL, applications, features, scored
from .registry import query

GROUP = ["model", "period"]
#: Capacities of curves and of the policy grid.
CURVE = tuple(i / 100 for i in (0.5, 1, 1.5, 2, 2.5, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 18, 20))
_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY model, period ORDER BY score DESC, pos) AS rank, count(*) OVER (PARTITION BY model, period) AS n FROM scored)"""
_HEAD = "greatest(CAST(floor(CAST(n AS DOUBLE) * {c}) AS BIGINT), 1)"
HEAD5 = _HEAD.format(c="5e-2")
_RATE = "round({a} / CAST(greatest({b}, 1) AS DOUBLE), 6)"


def _scored(spark, sf):
    return scored(applications(spark, sf))


def _curve(spark, sf):
    """Both models' queues of every period at the few capacities."""
    return once(("capacity_curve", sf), lambda: policy.capacity_curve(_scored(spark, sf), GROUP, CAPACITIES))


@query(f"""WITH {SCORED_SQL}, {_RANKED}
SELECT model, period, count(*) AS applications, count(*) FILTER (WHERE rank <= {HEAD5}) AS queue_size, CAST(sum(CASE WHEN rank <= {HEAD5} THEN label ELSE 0 END) AS BIGINT) AS fraud_caught, max({HEAD5}) AS headcount FROM ranked GROUP BY 1, 2""")
def queue_rank_cut(spark, sf):
    """Flagship: the exact rank cut of each model and period at 5 %."""
    q = queue.rank_cut(_scored(spark, sf), GROUP, 0.05)
    return q.groupBy(*GROUP).agg(
        F.count("*").alias("applications"),
        F.count_if(F.col("action") == "manual_review").alias("queue_size"),
        F.sum(F.when(F.col("action") == "manual_review", F.col("label")).otherwise(0)).alias("fraud_caught"),
        F.max(queue.headcount(F.col("group_size"), 0.05)).alias("headcount"),
    )


def _threshold(spark, sf, discrete):
    q = queue.threshold_cut(_scored(spark, sf), GROUP, 0.05, discrete=discrete)
    hit = F.col("action") == "manual_review"
    return q.groupBy(*GROUP).agg(F.round(F.max("cut"), 9).alias("cut"), F.count_if(hit).alias("queue_size"), F.sum(F.when(hit, F.col("label")).otherwise(0)).alias("fraud_caught"))


def _threshold_sql(f):
    return f"""WITH {SCORED_SQL}, cut AS (SELECT model, period, CAST({f}(score, CAST(1 AS DOUBLE) - 5e-2) AS DOUBLE) AS cut FROM scored GROUP BY 1, 2)
SELECT model, period, round(max(cut), 9) AS cut, count(*) FILTER (WHERE score >= cut) AS queue_size, CAST(sum(CASE WHEN score >= cut THEN label ELSE 0 END) AS BIGINT) AS fraud_caught FROM scored JOIN cut USING (model, period) GROUP BY 1, 2"""


@query(_threshold_sql("quantile_cont"))
def queue_threshold_cont(spark, sf):
    return _threshold(spark, sf, False)


@query(_threshold_sql("quantile_disc"))
def queue_threshold_disc(spark, sf):
    return _threshold(spark, sf, True)


_RULES_SQL = FEATURES_SQL + """, edge AS (SELECT quantile_cont(orders_of_customer, 99e-2) AS e FROM feats), flags AS (
  SELECT feats.*, orders_of_customer >= 16 AS rule_velocity, coalesce(parts, -1) >= 7 AS rule_device, nation >= 20 AND coalesce(avg_discount, 1) < 3e-2 AS rule_foreign, orders_of_customer >= e AS rule_branch FROM feats, edge
), forced AS (SELECT *, rule_device OR rule_foreign AS forced FROM flags), fr AS (
  SELECT *, row_number() OVER (PARTITION BY period ORDER BY forced DESC, challenger DESC, pos) AS rank, count(*) OVER (PARTITION BY period) AS n FROM forced
), acted AS (SELECT *, CASE WHEN rank <= """ + HEAD5 + """ THEN 'manual_review' WHEN forced THEN 'governance_referral' ELSE 'clear' END AS action FROM fr)"""


def _flagged(spark, sf):
    return queue.rule_flags(features(spark, sf, applications(spark, sf)))


def _forced(spark, sf):
    f = _flagged(spark, sf).withColumn("forced", queue.any_rule(["rule_device", "rule_foreign"]))
    return queue.rank_cut(f, ["period"], 0.05, "challenger", forced="forced")


@query(f"WITH {_RULES_SQL} SELECT pos, period, forced, CAST(rank AS BIGINT) AS rank, action FROM acted WHERE action <> 'clear'")
def queue_forced_referral(spark, sf):
    return _forced(spark, sf).where("action <> 'clear'").select("pos", "period", "forced", "rank", "action")


@query(f"""WITH {SCORED_SQL}, cut AS (SELECT model, period, quantile_disc(score, CAST(1 AS DOUBLE) - 5e-2) AS cut, count(*) AS n FROM scored GROUP BY 1, 2), q AS (
  SELECT model, period, max(n) AS applications, count(*) FILTER (WHERE score >= cut) AS queue_size, CAST(floor(CAST(max(n) AS DOUBLE) * 5e-2) AS BIGINT) AS capacity_headcount FROM scored JOIN cut USING (model, period) GROUP BY 1, 2)
SELECT *, queue_size - capacity_headcount AS overshoot, round((queue_size - capacity_headcount) / CAST(greatest(capacity_headcount, 1) AS DOUBLE), 6) AS overshoot_rate FROM q""")
def queue_overshoot(spark, sf):
    return queue.overshoot(_scored(spark, sf), GROUP, 0.05, discrete=True)


@query(f"WITH {SCORED_SQL}, {_RANKED} SELECT model, period, pos, label, round(score, 9) AS score, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 60")
def queue_topk(spark, sf):
    return queue.top_k(_scored(spark, sf), GROUP, 60).withColumn("score", F.round("score", 9))


_POLICY_SQL = """count(*) AS applications, CAST(sum(label) AS BIGINT) AS positives, count(*) FILTER (WHERE action = 'manual_review') AS queue_size, count(*) FILTER (WHERE action = 'governance_referral') AS referrals,
  CAST(sum(CASE WHEN action <> 'clear' THEN label ELSE 0 END) AS BIGINT) AS caught, CAST(sum(CASE WHEN action <> 'clear' THEN 1 - label ELSE 0 END) AS BIGINT) AS false_positives"""


@query(f"""WITH {_RULES_SQL}, m AS (SELECT period, {_POLICY_SQL} FROM acted GROUP BY 1)
SELECT *, greatest(CAST(floor(CAST(applications AS DOUBLE) * 5e-2) AS BIGINT), 1) AS capacity_count, referrals AS overflow,
  {_RATE.format(a="caught", b="positives")} AS catch_rate, {_RATE.format(a="false_positives", b="applications - positives")} AS false_positive_rate,
  {_RATE.format(a="caught", b="caught + false_positives")} AS precision, round((caught + false_positives) / CAST(applications AS DOUBLE), 6) AS review_rate FROM m""")
def policy_metrics(spark, sf):
    return policy.policy_metrics(_forced(spark, sf), ["period"], 0.05)


def wilson_sql(h, n, sign):
    z = "1959963984540054e-15"
    p = f"({h} / CAST(nullif({n}, 0) AS DOUBLE))"
    return f"round((({p} + {z} * {z} / (2e0 * {n})) / (1e0 + {z} * {z} / {n})) {sign} ({z} * sqrt({p} * (1e0 - {p}) / {n} + {z} * {z} / (4e0 * {n} * {n})) / (1e0 + {z} * {z} / {n})), 6)"


def _sweep_cols():
    out = []
    for name, h, n in (("catch", "caught", "positives"), ("precision", "caught", "queue_size"), ("fpr", "false_positives", "(applications - positives)")):
        out.append(f"{_RATE.format(a=h, b=n)} AS {name}_rate, {wilson_sql(h, n, '-')} AS {name}_lo, {wilson_sql(h, n, '+')} AS {name}_hi")
    return ", ".join(out)


CAPS_SQL = "caps AS (SELECT unnest([1e-2, 3e-2, 5e-2, 1e-1]) AS capacity)"
_CURVE_SQL = f"""{_RANKED}, {CAPS_SQL}, curve AS (
  SELECT model, period, capacity, max(n) AS applications, count(*) FILTER (WHERE rank <= {_HEAD.format(c="capacity")}) AS queue_size, CAST(sum(CASE WHEN rank <= {_HEAD.format(c="capacity")} THEN label ELSE 0 END) AS BIGINT) AS caught, CAST(sum(label) AS BIGINT) AS positives
  FROM ranked, caps GROUP BY 1, 2, 3), curved AS (SELECT *, queue_size - caught AS false_positives FROM curve)"""


@query(f"WITH {SCORED_SQL}, {_CURVE_SQL} SELECT *, {_sweep_cols()} FROM curved")
def capacity_sweep_wilson(spark, sf):
    return policy.with_intervals(_curve(spark, sf))


@query(f"""WITH {APPS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY challenger DESC, pos) AS ra, row_number() OVER (PARTITION BY period ORDER BY incumbent DESC, pos) AS rb, count(*) OVER (PARTITION BY period) AS n FROM apps),
d AS (SELECT *, CAST(ra <= {HEAD5} AS INTEGER) - CAST(rb <= {HEAD5} AS INTEGER) AS d FROM r)
SELECT period, CAST(sum(label * d) AS BIGINT) AS caught_delta, CAST(sum((1 - label) * d) AS BIGINT) AS good_delta, count(*) FILTER (WHERE label = 1 AND d = 1) AS gained, count(*) FILTER (WHERE label = 1 AND d = -1) AS lost, count(*) FILTER (WHERE label = 0 OR d = 0) AS same FROM d GROUP BY 1""")
def paired_queue_delta(spark, sf):
    return policy.paired_delta(applications(spark, sf), ["period"], 0.05, "challenger", "incumbent")


@query(f"WITH {_RULES_SQL} SELECT pos, rule_velocity, rule_device, rule_foreign, rule_branch, rule_velocity OR rule_device OR rule_foreign OR rule_branch AS any_rule FROM flags")
def rule_flags(spark, sf):
    return _flagged(spark, sf).select("pos", *queue.RULES, queue.any_rule(queue.RULES).alias("any_rule"))


def _incr_sql():
    parts = [f"SELECT period, pos, label, challenger, '{r}' AS rule, {r} AS flag, fired FROM fired" for r in queue.RULES]
    return f"""WITH {_RULES_SQL}, fired AS (SELECT *, CAST(rule_velocity AS INTEGER) + CAST(rule_device AS INTEGER) + CAST(rule_foreign AS INTEGER) + CAST(rule_branch AS INTEGER) AS fired FROM flags),
long AS ({" UNION ALL ".join(parts)}), r AS (SELECT *, row_number() OVER (PARTITION BY period, rule ORDER BY challenger DESC, pos) AS r0, row_number() OVER (PARTITION BY period, rule ORDER BY flag DESC, challenger DESC, pos) AS r1, count(*) OVER (PARTITION BY period, rule) AS n FROM long),
s AS (SELECT *, r0 <= {HEAD5} AS queued, r1 <= {HEAD5} OR flag AS acted, flag AND r1 > {HEAD5} AS over FROM r)
SELECT period, rule, count(*) FILTER (WHERE flag) AS flagged, count(*) FILTER (WHERE flag AND label = 1) AS flagged_fraud, count(*) FILTER (WHERE flag AND label = 0) AS flagged_good, count(*) FILTER (WHERE flag AND queued) AS in_queue,
  count(*) FILTER (WHERE flag AND fired > 1) AS with_other_rules, count(*) FILTER (WHERE flag AND NOT queued) AS added, count(*) FILTER (WHERE queued AND NOT acted) AS displaced,
  count(*) FILTER (WHERE acted AND label = 1) - count(*) FILTER (WHERE queued AND label = 1) AS incremental_caught, count(*) FILTER (WHERE over) AS overflow FROM s GROUP BY 1, 2"""


@query(_incr_sql())
def rule_incrementality(spark, sf):
    return policy.rule_increments(_flagged(spark, sf), ["period"], 0.05, "challenger")


@query(f"""WITH {_RULES_SQL} SELECT 1 AS step, 'assessed' AS stage, count(*) AS rows FROM acted UNION ALL SELECT 2, 'sent', count(*) FROM acted WHERE action <> 'clear'
UNION ALL SELECT 3, 'worked', count(*) FROM acted WHERE action = 'manual_review' UNION ALL SELECT 4, 'confirmed', count(*) FROM acted WHERE action = 'manual_review' AND label = 1""")
def review_funnel(spark, sf):
    return policy.funnel(_forced(spark, sf))


@query(f"""WITH {SCORED_SQL}, {_CURVE_SQL}
SELECT c.period, c.capacity, c.caught - i.caught AS caught_gain, c.false_positives - i.false_positives AS good_reviewed_change, c.queue_size - i.queue_size AS demand_change,
  round((c.caught - i.caught) * 5000e0, 2) AS value_low, round((c.caught - i.caught) * 20000e0, 2) AS value_high FROM curved c JOIN curved i ON c.period = i.period AND c.capacity = i.capacity AND c.model = 'challenger' AND i.model = 'incumbent'""")
def scenario_impact(spark, sf):
    """Challenger less incumbent at the same period and capacity, from one curve by conditional sums."""
    curve = _curve(spark, sf)
    sign = F.when(F.col("model") == "challenger", 1).otherwise(-1)
    d = curve.groupBy("period", "capacity").agg(F.sum(sign * F.col("caught")).alias("caught_gain"), F.sum(sign * F.col("false_positives")).alias("good_reviewed_change"), F.sum(sign * F.col("queue_size")).alias("demand_change"))
    return d.withColumns({"value_low": F.round(F.col("caught_gain") * 5000.0, 2), "value_high": F.round(F.col("caught_gain") * 20000.0, 2)})


@query(f"""WITH {APPS_SQL}, m AS (SELECT segment, period, count(*) AS n, avg(label) AS r FROM apps GROUP BY 1, 2)
SELECT segment, arg_min(period, r) AS lowest_period, round(arg_max(r, period) - min(r), 6) AS rise, arg_min(n, period) AS first_volume, arg_max(n, period) AS last_volume FROM m GROUP BY 1""")
def trend_rise(spark, sf):
    m = applications(spark, sf).groupBy("segment", "period").agg(F.count("*").alias("n"), F.avg("label").alias("r"))
    return m.groupBy("segment").agg(
        F.min_by("period", "r").alias("lowest_period"),
        F.round(F.max_by("r", "period") - F.min("r"), 6).alias("rise"),
        F.min_by("n", "period").alias("first_volume"),
        F.max_by("n", "period").alias("last_volume"),
    )

"""Queries behind policy cards, curves, case lists and evidence documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dashboard, metrics, policy, queue, warehouse
from ..sources.tables import SCORED_SQL, applications, scored, table
from .evaluation import _STEPS_SQL
from .queues import _CURVE_SQL, _RULES_SQL, CURVE, GROUP, HEAD5, _curve, _forced, _scored
from .registry import query
from .star import _ACTED_SQL, _fact, _kpi_sql

_R = lambda a, b: f"round({a} / CAST(nullif({b}, 0) AS DOUBLE), 6)"


@query(f"""WITH {SCORED_SQL}, {_CURVE_SQL} SELECT *, {_R("caught", "positives")} AS capture, positives - caught AS missed, {_R("(positives - caught)", "positives")} AS leakage, {_R("caught", "queue_size")} AS hit_rate, {_R("queue_size", "caught")} AS alerts_per_fraud,
  round(queue_size / CAST(greatest(CAST(floor(CAST(applications AS DOUBLE) * capacity) AS BIGINT), 1) AS DOUBLE), 6) AS utilisation, {_R("false_positives", "(applications - positives)")} AS insult_rate,
  round(caught * 5000e0 - false_positives * 300e0 - queue_size * 27e0, 2) AS net_low, round(caught * 20000e0 - queue_size * 7e0, 2) AS net_high FROM curved""")
def policy_cards(spark, sf):
    return dashboard.measures(_curve(spark, sf))


def _caps(values):
    return "caps AS (SELECT unnest([" + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in values) + "]) AS capacity)"


@query(f"""WITH {SCORED_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY model, period ORDER BY score DESC, pos) AS rank, count(*) OVER (PARTITION BY model, period) AS n FROM scored), {_caps(CURVE)},
c AS (SELECT model, capacity, count(*) FILTER (WHERE hit) AS queue_size, CAST(sum(CASE WHEN hit THEN label ELSE 0 END) AS BIGINT) AS caught, CAST(sum(label) AS BIGINT) AS positives, count(*) AS n FROM (SELECT *, rank <= greatest(CAST(floor(CAST(n AS DOUBLE) * capacity) AS BIGINT), 1) AS hit FROM ranked, caps WHERE period = 7) GROUP BY 1, 2)
SELECT capacity, round(max(queue_size / CAST(n AS DOUBLE)) FILTER (WHERE model = 'challenger'), 6) AS review_rate, round(max(caught / CAST(positives AS DOUBLE)) FILTER (WHERE model = 'challenger'), 6) AS challenger_capture, round(max(caught / CAST(positives AS DOUBLE)) FILTER (WHERE model = 'incumbent'), 6) AS incumbent_capture FROM c GROUP BY 1""")
def capture_curve(spark, sf):
    """Capture against review rate at 18 capacities, both models, from one ranking."""
    c = policy.capacity_curve(scored(applications(spark, sf, 7, 7)), ["model"], CURVE)
    of = lambda m, e: F.round(F.max(F.when(F.col("model") == m, e)), 6)
    capture = F.col("caught") / F.col("positives")
    return c.groupBy("capacity").agg(of("challenger", F.col("queue_size") / F.col("applications")).alias("review_rate"), of("challenger", capture).alias("challenger_capture"), of("incumbent", capture).alias("incumbent_capture"))


@query(f"""WITH {_RULES_SQL} SELECT CASE WHEN label = 1 THEN 'fraud' ELSE 'good' END AS outcome, forced AS rule_fired, action, count(*) AS cases FROM acted WHERE action <> 'clear' GROUP BY 1, 2, 3""")
def case_filter(spark, sf):
    f = _forced(spark, sf).where("action <> 'clear'")
    return f.groupBy(F.when(F.col("label") == 1, "fraud").otherwise("good").alias("outcome"), F.col("forced").alias("rule_fired"), "action").agg(F.count("*").alias("cases"))


@query(f"""WITH {_STEPS_SQL}, ap AS (SELECT model, sum(CAST(tp AS DOUBLE) * CAST(cum_tp AS DOUBLE) / CAST(cum_n AS DOUBLE)) / CAST(sum(tp) AS DOUBLE) AS v FROM cum GROUP BY 1), br AS (SELECT model, avg((score - label) * (score - label)) AS v FROM scored GROUP BY 1)
SELECT 'average_precision' AS metric, round(max(v) FILTER (WHERE model = 'challenger'), 6) AS challenger, round(max(v) FILTER (WHERE model = 'incumbent'), 6) AS incumbent FROM ap UNION ALL SELECT 'brier', round(max(v) FILTER (WHERE model = 'challenger'), 6), round(max(v) FILTER (WHERE model = 'incumbent'), 6) FROM br""")
def model_comparison(spark, sf):
    s = _scored(spark, sf)
    both = metrics.average_precision(metrics.score_steps(s, ["model"]), ["model"]).join(metrics.losses(s, ["model"]).select("model", "brier"), "model")
    long = both.unpivot(["model"], ["average_precision", "brier"], "metric", "value")
    of = lambda m: F.round(F.max(F.when(F.col("model") == m, F.col("value"))), 6).alias(m)
    return long.groupBy("metric").agg(of("challenger"), of("incumbent"))


@query(f"WITH {_ACTED_SQL}, k AS ({_kpi_sql('model, channel')} GROUP BY 1, 2) SELECT model, channel, applications, fraud_caught, catch_rate FROM k")
def evidence_extract(spark, sf):
    """KPIs to a JSON evidence document and back to typed rows."""
    k = warehouse.rollup(_fact(spark, sf, "model", "channel"), ["model", "channel"]).select("model", "channel", "applications", "fraud_caught", "catch_rate")
    return dashboard.extract(dashboard.document(k), k.schema)


@query(f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY model, period ORDER BY score DESC, pos) AS rank, count(*) OVER (PARTITION BY model, period) AS n FROM scored), g AS (SELECT model, period, count(*) FILTER (WHERE rank <= {HEAD5}) AS queue_size, CAST(sum(CASE WHEN rank <= {HEAD5} THEN label ELSE 0 END) AS BIGINT) AS caught, round(min(score) FILTER (WHERE rank <= {HEAD5}), 9) AS score_cut FROM r GROUP BY 1, 2)
SELECT substr(sha256('scenario|' || model || '|' || CAST(period AS VARCHAR) || '|cap-050-p' || CAST(period AS VARCHAR)), 1, 32) AS run_id, 'cap-050-p' || CAST(period AS VARCHAR) AS policy, model, queue_size, caught, score_cut FROM g""")
def scenario_runs(spark, sf):
    """Scenario runs with ids that a second run gives again."""
    q = queue.rank_cut(scored(applications(spark, sf)), GROUP, 0.05).where("action = 'manual_review'")
    g = q.groupBy(*GROUP).agg(F.count("*").alias("queue_size"), F.sum("label").alias("caught"), F.round(F.min("score"), 9).alias("score_cut"))
    g = g.withColumn("policy", warehouse.policy_id(0.05, F.col("period")))
    return g.select(dashboard.run_id("scenario", F.col("model"), F.col("period").cast("string"), F.col("policy")).alias("run_id"), "policy", "model", "queue_size", "caught", "score_cut")


@query("SELECT event_type, count(*) AS samples, round(quantile_cont(value, 5e-1), 6) AS p50, round(quantile_cont(value, 95e-2), 6) AS p95, round(quantile_cont(value, 99e-2), 6) AS p99, round(max(value), 6) AS worst FROM events GROUP BY 1")
def latency_summary(spark, sf):
    return dashboard.latency(table(spark, sf, "events", "event_type", "value"), "value", ["event_type"])

"""Queries on the star schema and its KPIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import queue, warehouse
from ..operators.quantiles import exact_quantiles
from ..sources.tables import SCORED_SQL, applications, scored
from .registry import query

CAP = 0.05
_ACTED_SQL = SCORED_SQL + """, cut AS (SELECT model, period, quantile_disc(score, CAST(1 AS DOUBLE) - 5e-2) AS cut FROM scored GROUP BY 1, 2),
acted AS (SELECT s.*, CASE WHEN score >= cut THEN 'manual_review' ELSE 'clear' END AS action FROM scored s JOIN cut USING (model, period))"""
_FACT_COLS = """count(*) AS application_count, count(*) FILTER (WHERE label = 1) AS fraud_count, count(*) FILTER (WHERE label = 1 AND action = 'manual_review') AS fraud_caught, count(*) FILTER (WHERE label = 0 AND action = 'manual_review') AS good_customer_reviews"""


def _kpi_sql(keys: str) -> str:
    r = lambda a, b: f"round({a} / CAST(greatest({b}, 1) AS DOUBLE), 6)"
    return f"""SELECT {keys}, count(*) AS applications, count(*) FILTER (WHERE label = 1) AS fraud_attempts, count(*) FILTER (WHERE label = 1 AND action = 'manual_review') AS fraud_caught,
  count(*) FILTER (WHERE label = 0 AND action = 'manual_review') AS good_customers_reviewed, count(*) FILTER (WHERE action = 'manual_review') AS queue_size,
  round(1e4 * count(*) FILTER (WHERE label = 1) / count(*), 2) AS fraud_rate_bps, round(count(*) FILTER (WHERE action = 'manual_review') / CAST(count(*) AS DOUBLE), 6) AS review_rate,
  {r("count(*) FILTER (WHERE label = 1 AND action = 'manual_review')", "count(*) FILTER (WHERE label = 1)")} AS catch_rate,
  {r("count(*) FILTER (WHERE label = 1 AND action = 'manual_review')", "count(*) FILTER (WHERE action = 'manual_review')")} AS investigator_yield,
  {r("count(*) FILTER (WHERE label = 0 AND action = 'manual_review')", "count(*) FILTER (WHERE label = 0)")} AS friction_rate,
  count(*) FILTER (WHERE label = 1 AND action <> 'manual_review') AS fraud_missed FROM acted"""


def _acted(spark, sf, *keep):
    return warehouse.actioned(scored(applications(spark, sf), *keep), ["model", "period"], CAP)


def _fact(spark, sf, *grain):
    keep = [g for g in grain if g not in ("model", "period", "action")]
    return warehouse.facts(_acted(spark, sf, *keep), [*grain, "action"])


@query(f"""WITH {SCORED_SQL}
SELECT 'channel' AS dimension, row_number() OVER (ORDER BY channel) AS key, channel AS name FROM (SELECT DISTINCT channel FROM scored)
UNION ALL SELECT 'channel', 0, 'UNKNOWN' UNION ALL SELECT 'segment', row_number() OVER (ORDER BY segment), segment FROM (SELECT DISTINCT segment FROM scored)
UNION ALL SELECT 'model', row_number() OVER (ORDER BY model), model FROM (SELECT DISTINCT model FROM scored)
UNION ALL SELECT 'policy', row_number() OVER (ORDER BY p), p FROM (SELECT DISTINCT 'cap-050-p' || CAST(period AS VARCHAR) AS p FROM scored)""")
def dim_refresh(spark, sf):
    s = scored(applications(spark, sf), "channel", "segment").withColumn("policy", warehouse.policy_id(CAP, F.col("period")))
    out = None
    for name in ("channel", "segment", "model", "policy"):
        d = warehouse.dimension(s, name, "key", unknown=name == "channel").select(F.lit(name).alias("dimension"), "key", F.col(name).alias("name"))
        out = d if out is None else out.unionByName(d)
    return out


@query(f"""WITH {_ACTED_SQL}, f AS (SELECT model, period, segment, channel, action, {_FACT_COLS} FROM acted GROUP BY ALL)
SELECT CAST((2025 + period // 12) * 10000 + (1 + period % 12) * 100 + 1 AS INTEGER) AS date_key, model, 'cap-050-p' || CAST(period AS VARCHAR) AS policy, dense_rank() OVER (ORDER BY segment) AS segment_key, dense_rank() OVER (ORDER BY channel) AS channel_key, action,
  application_count, fraud_count, fraud_caught, good_customer_reviews FROM f""")
def fact_refresh(spark, sf):
    """Facts are aggregated to their grain first; only grain rows meet the dimensions, which are broadcast."""
    f = _fact(spark, sf, "model", "period", "segment", "channel")
    apps = applications(spark, sf)
    for name in ("segment", "channel"):
        f = f.join(F.broadcast(warehouse.dimension(apps, name, f"{name}_key")), name, "left").withColumn(f"{name}_key", F.coalesce(f"{name}_key", F.lit(0).cast("long")))
    date = F.date_format(F.add_months(F.lit("2025-01-01").cast("date"), F.col("period")), "yyyyMMdd").cast("int")
    return f.select(date.alias("date_key"), "model", warehouse.policy_id(CAP, F.col("period")).alias("policy"), "segment_key", "channel_key", "action", "application_count", "fraud_count", "fraud_caught", "good_customer_reviews")


@query(f"""WITH {_ACTED_SQL}, k AS ({_kpi_sql("model, period")} GROUP BY 1, 2)
SELECT *, CAST(floor(CAST(applications AS DOUBLE) * 5e-2) AS BIGINT) AS capacity_headcount, queue_size - CAST(floor(CAST(applications AS DOUBLE) * 5e-2) AS BIGINT) AS capacity_overshoot,
  round(catch_rate - lag(catch_rate) OVER w, 6) AS catch_rate_change, round(fraud_rate_bps - lag(fraud_rate_bps) OVER w, 6) AS fraud_rate_bps_change FROM k WINDOW w AS (PARTITION BY model ORDER BY period)""")
def kpi_monthly_lag(spark, sf):
    k = warehouse.rollup(_fact(spark, sf, "model", "period"), ["model", "period"])
    head = F.floor(F.col("applications").cast("double") * F.lit(CAP)).cast("long")
    k = k.withColumn("capacity_headcount", head).withColumn("capacity_overshoot", F.col("queue_size") - head)
    return warehouse.movements(k, ["model"], "period", ["catch_rate", "fraud_rate_bps"])


@query(f"WITH {_ACTED_SQL} {_kpi_sql('model, channel')} GROUP BY 1, 2")
def kpi_channel(spark, sf):
    return warehouse.rollup(_fact(spark, sf, "model", "channel"), ["model", "channel"])


_BAND_SQL = """edges AS (SELECT quantile_cont(challenger, 8e-1) AS e1, quantile_cont(challenger, 95e-2) AS e2, quantile_cont(challenger, 99e-2) AS e3 FROM apps WHERE period = 6)"""
_BAND_CASE = "CASE WHEN challenger >= e3 THEN 'critical' WHEN challenger >= e2 THEN 'high' WHEN challenger >= e1 THEN 'medium' ELSE 'low' END"


def risk_bands(apps, score="challenger", fit_period=6):
    """apps with band: edges are quantiles .80/.95/.99 of one period's scores (one row, broadcast), bands are >= an edge."""
    edges = exact_quantiles(apps.where(F.col("period") == fit_period), [], score, [0.8, 0.95, 0.99], bounds=(0.0, 1.0)).select(F.array("q0", "q1", "q2").alias("edges"))
    s = F.col(score)
    band = F.when(s >= F.col("edges")[2], "critical").when(s >= F.col("edges")[1], "high").when(s >= F.col("edges")[0], "medium").otherwise("low")
    return apps.crossJoin(F.broadcast(edges)).withColumn("band", band).drop("edges")


@query(f"WITH {_ACTED_SQL}, {_BAND_SQL}, a2 AS (SELECT a.*, {_BAND_CASE} AS band FROM acted a, edges) {_kpi_sql('band').replace('FROM acted', 'FROM a2')} WHERE model = 'challenger' GROUP BY 1")
def kpi_risk_band(spark, sf):
    s = risk_bands(applications(spark, sf)).select("pos", "period", "label", "band", F.lit("challenger").alias("model"), F.col("challenger").alias("score"))
    fact = warehouse.facts(warehouse.actioned(s, ["model", "period"], CAP), ["band", "action"])
    return warehouse.rollup(fact, ["band"])


@query(f"""WITH {_ACTED_SQL}, k AS ({_kpi_sql("model, period")} GROUP BY 1, 2)
SELECT i.period, i.catch_rate AS incumbent_catch_rate, i.fraud_caught AS incumbent_fraud_caught, c.catch_rate AS challenger_catch_rate, c.fraud_caught AS challenger_fraud_caught,
  round(c.catch_rate - i.catch_rate, 6) AS catch_rate_gap, c.fraud_caught - i.fraud_caught AS fraud_caught_gap FROM k i JOIN k c ON i.period = c.period AND i.model = 'incumbent' AND c.model = 'challenger'""")
def vendor_comparison(spark, sf):
    k = warehouse.rollup(_fact(spark, sf, "model", "period"), ["model", "period"])
    v = warehouse.versus(k, ["period"], "model", "incumbent", "challenger", ["catch_rate", "fraud_caught"])
    return v.withColumn("fraud_caught_gap", F.col("fraud_caught_gap").cast("long"))


@query(f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY model, period ORDER BY score DESC, pos) AS rank, count(*) OVER (PARTITION BY model, period) AS n FROM scored)
SELECT 'run-' || model || '-' || CAST(period AS VARCHAR) AS run_id, CAST(rank AS BIGINT) AS rank, application_id, channel, segment, round(score, 9) AS score, 'manual_review' AS action FROM r WHERE rank <= greatest(CAST(floor(CAST(n AS DOUBLE) * 1e-2) AS BIGINT), 1)""")
def review_queue_view(spark, sf):
    """Queue joined to its run, the scores and the applications, as a reviewer sees it."""
    apps = applications(spark, sf)
    q = queue.rank_cut(scored(apps), ["model", "period"], 0.01).where("action = 'manual_review'").select("model", "period", "pos", "rank", "score", "action")
    runs = q.select("model", "period").distinct().withColumn("run_id", F.concat_ws("-", F.lit("run"), "model", "period"))
    return q.join(runs, ["model", "period"]).join(apps.select("pos", "application_id", "channel", "segment"), "pos").select("run_id", "rank", "application_id", "channel", "segment", F.round("score", 9).alias("score"), "action")


@query(f"""WITH {_ACTED_SQL} SELECT model, period, channel, segment, CAST(grouping(period) * 4 + grouping(channel) * 2 + grouping(segment) AS INTEGER) AS level, count(*) AS applications, count(*) FILTER (WHERE label = 1) AS fraud_attempts, count(*) FILTER (WHERE label = 1 AND action = 'manual_review') AS fraud_caught
FROM acted GROUP BY GROUPING SETS ((model, period), (model, channel), (model, segment), (model))""")
def kpi_grouping_sets(spark, sf):
    """All roll-ups from one aggregation to the fact grain."""
    fact = _fact(spark, sf, "model", "period", "channel", "segment")
    return spark.sql(
        """SELECT model, period, channel, segment, cast(grouping(period) * 4 + grouping(channel) * 2 + grouping(segment) as int) AS level, sum(application_count) AS applications, sum(fraud_count) AS fraud_attempts, sum(fraud_caught) AS fraud_caught
        FROM {fact} GROUP BY model, period, channel, segment GROUPING SETS ((model, period), (model, channel), (model, segment), (model))""",
        fact=fact,
    )


@query(f"""WITH {_ACTED_SQL}, k AS ({_kpi_sql("model, period")} GROUP BY 1, 2)
SELECT model, string_agg(CAST(period AS VARCHAR) || ':' || CAST(queue_size AS VARCHAR), '; ' ORDER BY period) AS demand, CAST(sum(fraud_caught) AS BIGINT) AS fraud_caught, round(CAST(sum(fraud_caught) AS BIGINT) / CAST(nullif(CAST(sum(fraud_attempts) AS BIGINT), 0) AS DOUBLE), 6) AS catch_rate,
  count(*) FILTER (WHERE queue_size > floor(CAST(applications AS DOUBLE) * 5e-2) * 1005e-3) AS periods_over_capacity, CASE WHEN model = 'challenger' THEN 'Challenger' ELSE 'Champion' END AS role FROM k GROUP BY model""")
def bi_measures(spark, sf):
    k = warehouse.rollup(_fact(spark, sf, "model", "period"), ["model", "period"])
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("period", "queue_size"))), lambda x: F.concat_ws(":", x["period"], x["queue_size"]))
    return k.groupBy("model").agg(
        F.array_join(pairs, "; ").alias("demand"),
        F.sum("fraud_caught").alias("fraud_caught"),
        F.round(F.sum("fraud_caught") / F.nullif(F.sum("fraud_attempts"), F.lit(0)), 6).alias("catch_rate"),
        F.count_if(F.col("queue_size") > F.floor(F.col("applications").cast("double") * 0.05) * 1.005).alias("periods_over_capacity"),
    ).withColumn("role", F.when(F.col("model") == "challenger", "Challenger").otherwise("Champion"))

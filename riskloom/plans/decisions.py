"""Queries on decisions and governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import once, sharing
from ..operators import decide, metrics
from ..sources.tables import SCORED_SQL, applications, scored
from .evaluation import _parity, _parity_sql
from .queues import _CURVE_SQL, _RULES_SQL, CURVE, _curve, _flagged
from .registry import query

_L = lambda xs: "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in xs) + "]"
_GRID_SQL = f"grid AS (SELECT e.x AS exposure, r.x AS review, f.x AS friction FROM (SELECT unnest({_L(decide.EXPOSURE)}) AS x) e, (SELECT unnest({_L(decide.REVIEW)}) AS x) r, (SELECT unnest({_L(decide.FRICTION)}) AS x) f)"
_SURFACE_SQL = f"{_GRID_SQL}, surface AS (SELECT grid.*, e.x AS effectiveness, l.x AS loss FROM grid, (SELECT unnest({_L(decide.EFFECTIVENESS)}) AS x) e, (SELECT unnest({_L(decide.LOSS)}) AS x) l)"
_PAIRS_SQL = f"""{_CURVE_SQL}, pairs AS (SELECT c.period, c.capacity, c.caught AS c_caught, c.false_positives AS c_fp, c.queue_size AS c_queue, i.caught AS i_caught, i.false_positives AS i_fp, i.queue_size AS i_queue
  FROM curved c JOIN curved i ON c.period = i.period AND c.capacity = i.capacity AND c.model = 'challenger' AND i.model = 'incumbent')"""
_STATS = "count(*) AS cells, count(*) FILTER (WHERE d > 0) AS positive, round(min(d), 2) AS worst, round(median(d), 2) AS median, round(max(d), 2) AS best, round(count(*) FILTER (WHERE d > 0) / CAST(count(*) AS DOUBLE), 6) AS positive_share"


def _pairs(spark, sf):
    """Challenger and incumbent side by side, by conditional sums over one curve."""
    curve = _curve(spark, sf)
    cols = [F.sum(F.when(F.col("model") == m, F.col(c))).alias(f"{p}_{n}") for p, m in (("c", "challenger"), ("i", "incumbent")) for c, n in (("caught", "caught"), ("false_positives", "fp"), ("queue_size", "queue"))]
    return curve.groupBy("period", "capacity").agg(*cols)


@query(f"""WITH {SCORED_SQL}, {_PAIRS_SQL}, {_GRID_SQL}, x AS (SELECT period, capacity, (c_caught * exposure - c_fp * friction - c_queue * review) - (i_caught * exposure - i_fp * friction - i_queue * review) AS d FROM pairs, grid) SELECT period, capacity, {_STATS} FROM x GROUP BY 1, 2""")
def utility_grid(spark, sf):
    return decide.compare(_pairs(spark, sf), decide.grid(spark), ["period", "capacity"])


@query(f"""WITH {SCORED_SQL}, {_PAIRS_SQL}, {_SURFACE_SQL}, x AS (SELECT effectiveness, loss, (c_caught * effectiveness * loss * exposure - c_fp * friction - c_queue * review) - (i_caught * effectiveness * loss * exposure - i_fp * friction - i_queue * review) AS d FROM pairs, surface WHERE capacity = 5e-2)
SELECT effectiveness, loss, {_STATS}, min(d) > 0 AS sign_holds FROM x GROUP BY 1, 2""")
def utility_surface(spark, sf):
    p = _pairs(spark, sf).where(F.col("capacity") == 0.05)
    out = decide.compare(p, decide.grid(spark, surface=True), [], ["effectiveness", "loss"])
    return out.withColumn("sign_holds", F.col("worst") > 0)


#: The two scores and two blends of them, as SQL that both engines read.
_MODELS = {"challenger": "challenger", "incumbent": "incumbent", "mean": "(challenger + incumbent) / 2", "greater": "greatest(challenger, incumbent)"}


def _policy_grid_sql():
    bits = " + ".join(f"CASE WHEN {r} THEN {1 << i} ELSE 0 END" for i, r in enumerate(("rule_velocity", "rule_device", "rule_foreign", "rule_branch")))
    both = " UNION ALL ".join(f"SELECT period, pos, label, '{m}' AS model, {e} AS score, {bits} AS bits FROM flags" for m, e in _MODELS.items())
    return f"""{_RULES_SQL}, b AS ({both}),
m AS (SELECT *, (bits & mask) <> 0 AS f FROM b, (SELECT CAST(unnest(range(16)) AS INTEGER) AS mask)), k AS (SELECT *, row_number() OVER (PARTITION BY period, model, mask ORDER BY f DESC, score DESC, pos) AS rank, count(*) OVER (PARTITION BY period, model, mask) AS n FROM m),
c AS (SELECT *, rank <= greatest(CAST(floor(CAST(n AS DOUBLE) * capacity) AS BIGINT), 1) AS review FROM k, (SELECT unnest({_L(CURVE)}) AS capacity)),
pg AS (SELECT period, model, mask, capacity, count(*) FILTER (WHERE review) AS queue_size, count(*) FILTER (WHERE f AND NOT review) AS overflow, CAST(sum(CASE WHEN review OR f THEN label ELSE 0 END) AS BIGINT) AS caught,
  CAST(sum(CASE WHEN review OR f THEN 1 - label ELSE 0 END) AS BIGINT) AS false_positives FROM c WHERE f OR review GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {_policy_grid_sql()} SELECT * FROM pg")
def policy_grid(spark, sf):
    return _policy_grid(spark, sf)


def _policy_grid(spark, sf):
    """4 scores at 18 capacities with the 16 subsets of rules: 1,152 policies a period."""
    flagged = _flagged(spark, sf).withColumns({m: F.expr(e) for m, e in _MODELS.items() if m != e})
    return decide.policy_grid(flagged, list(_MODELS), CURVE)


_FRONT_SQL = f"""{_policy_grid_sql()}, p AS (SELECT model, mask, capacity, CAST(sum(caught) AS BIGINT) AS caught, CAST(sum(false_positives) AS BIGINT) AS false_positives, CAST(sum(queue_size) AS BIGINT) AS queue_size, CAST(sum(overflow) AS BIGINT) AS overflow FROM pg GROUP BY 1, 2, 3),
u AS (SELECT *, model || '-' || CAST(mask AS VARCHAR) || '-' || CAST(CAST(round(capacity * 1000) AS INTEGER) AS VARCHAR) AS policy, caught * 12500e0 - false_positives * 150e0 - queue_size * 17e0 AS utility FROM p)"""


def _policies(spark, sf):
    sums = _policy_grid(spark, sf).groupBy("model", "mask", "capacity").agg(*(F.sum(c).alias(c) for c in ("caught", "false_positives", "queue_size", "overflow")))
    name = F.concat_ws("-", "model", "mask", F.round(F.col("capacity") * 1000).cast("int"))
    u = decide.utility(F.col("caught"), F.col("false_positives"), F.col("queue_size"), F.lit(12500.0), F.lit(17.0), F.lit(150.0))
    return sums.withColumn("policy", name).withColumn("utility", u)


@query(f"""WITH {_FRONT_SQL} SELECT policy, caught, false_positives, queue_size, utility FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.caught >= a.caught AND b.utility >= a.utility AND b.false_positives <= a.false_positives AND b.queue_size <= a.queue_size
  AND (b.caught > a.caught OR b.utility > a.utility OR b.false_positives < a.false_positives OR b.queue_size < a.queue_size))""")
def pareto_frontier(spark, sf):
    """The 1,152 policies of the grid are broadcast against themselves."""
    return decide.pareto(_policies(spark, sf), "policy", ["caught", "utility"], ["false_positives", "queue_size"]).select("policy", "caught", "false_positives", "queue_size", "utility")


@query(f"""WITH {_FRONT_SQL} SELECT coalesce(max(policy) FILTER (WHERE rn = 1), 'no robust recommendation') AS recommendation, count(*) AS eligible FROM (SELECT *, row_number() OVER (ORDER BY utility DESC, caught DESC, policy DESC) AS rn FROM u WHERE overflow = 0)""")
def policy_recommendation(spark, sf):
    return decide.recommend(_policies(spark, sf), F.col("overflow") == 0, ["utility", "caught"], "policy")


GATES = (("catch_improves", "better", 3, ">="), ("min_capacity_delta", "least_delta", -0.02, ">="), ("brier_skill", "skill", 0, ">"), ("ece", "ece", 0.02, "<="), ("grid_share", "share", 0.8, ">="))
_OBS_SQL = f"""{SCORED_SQL}, {_CURVE_SQL}, t AS (SELECT model, capacity, sum(caught) / CAST(sum(positives) AS DOUBLE) AS rate, sum(caught) AS caught, sum(false_positives) AS fp, sum(queue_size) AS q FROM curved GROUP BY 1, 2),
v AS (SELECT c.capacity, c.rate - i.rate AS delta, c.caught - i.caught AS dc, c.fp - i.fp AS df, c.q - i.q AS dq FROM t c JOIN t i ON c.capacity = i.capacity AND c.model = 'challenger' AND i.model = 'incumbent'),
{_GRID_SQL}, g AS (SELECT avg(CASE WHEN dc * exposure - df * friction - dq * review > 0 THEN 1e0 ELSE 0e0 END) AS share FROM v, grid WHERE capacity = 5e-2),
b AS (SELECT avg((challenger - label) * (challenger - label)) AS br, avg(label) AS p FROM apps), bins AS (SELECT len(list_filter(list_transform(range(1, 15), lambda i: i / 15e0), lambda e: e < challenger)) AS bin, challenger AS s, label FROM apps),
ec AS (SELECT sum(n * abs(ms - ml)) / CAST(sum(n) AS DOUBLE) AS ece FROM (SELECT bin, count(*) AS n, avg(s) AS ms, avg(label) AS ml FROM bins GROUP BY 1)),
obs AS (SELECT CAST((SELECT count(*) FILTER (WHERE delta > 0) FROM v) AS DOUBLE) AS better, round((SELECT min(delta) FROM v), 6) AS least_delta, round((SELECT 1 - br / (p * (1 - p)) FROM b), 6) AS skill, round((SELECT ece FROM ec), 6) AS ece, round((SELECT share FROM g), 6) AS share)"""
_GATE_SQL = f"{_OBS_SQL}, gates AS (" + " UNION ALL ".join(f"SELECT '{n}' AS gate, {c} AS observed, CAST({t} AS DOUBLE) AS threshold, {c} {o} CAST({t} AS DOUBLE) AS passed FROM obs" for n, c, t, o in GATES) + ")"


@sharing
def _gates(spark, sf):
    return once(("promotion_gates", sf), lambda: _gate_rows(spark, sf))


def _gate_rows(spark, sf):
    curve = _curve(spark, sf)
    sign = F.when(F.col("model") == "challenger", 1).otherwise(-1)
    by_cap = curve.groupBy("capacity").agg(
        (F.sum(sign * F.col("caught")) / F.sum(F.when(F.col("model") == "challenger", F.col("positives")))).alias("delta"),
        F.sum(sign * F.col("caught")).alias("dc"), F.sum(sign * F.col("false_positives")).alias("df"), F.sum(sign * F.col("queue_size")).alias("dq"),
    )
    one = by_cap.agg(F.count_if(F.col("delta") > 0).alias("better"), F.round(F.min("delta"), 6).alias("least_delta"))
    share = by_cap.where(F.col("capacity") == 0.05).crossJoin(F.broadcast(decide.grid(spark))).agg(
        F.round(F.avg(F.when(decide.utility(F.col("dc"), F.col("df"), F.col("dq"), F.col("exposure"), F.col("review"), F.col("friction")) > 0, 1.0).otherwise(0.0)), 6).alias("share")
    )
    c = scored(applications(spark, sf)).where("model = 'challenger'")
    skill = metrics.losses(c, []).select(F.round("brier_skill", 6).alias("skill"))
    ece = metrics.expected_calibration_error(c, []).select(F.round("ece", 6).alias("ece"))
    return decide.gates(one.crossJoin(share).crossJoin(skill).crossJoin(ece), GATES)


@query(f"WITH {_GATE_SQL} SELECT * FROM gates")
def promotion_gates(spark, sf):
    return _gates(spark, sf)


@query(f"""WITH {_GATE_SQL}, f AS (SELECT count(*) AS gates, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, CASE WHEN bool_and(passed) THEN 'challenger' ELSE 'incumbent' END AS champion, string_agg(gate || ' failed', '; ' ORDER BY gate) FILTER (WHERE NOT passed) AS reasons FROM gates)
SELECT gates, passed, failed, champion, CASE WHEN failed > 0 THEN 'no robust recommendation' ELSE 'policy' END AS recommendation, coalesce(reasons, '') AS reasons FROM f""")
def governance_refusal(spark, sf):
    g = _gates(spark, sf)
    failed = F.array_sort(F.collect_set(F.when(~F.col("passed"), F.concat(F.col("gate"), F.lit(" failed")))))
    c = g.agg(F.count("*").alias("gates"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.when(F.bool_and("passed"), "challenger").otherwise("incumbent").alias("champion"), failed.alias("r"))
    return c.select("gates", "passed", "failed", "champion", decide.refuse(F.lit("policy"), F.col("r")).alias("recommendation"), F.array_join("r", "; ").alias("reasons"))


@query(f"""WITH {_parity_sql()}, cur AS (SELECT segment, 'tpr_gap' AS measure, tpr_gap AS value FROM gaps UNION ALL SELECT segment, 'fpr_gap', fpr_gap FROM gaps UNION ALL SELECT segment, 'review_rate_ratio', review_rate_ratio FROM gaps),
acc AS (SELECT 'segment' AS segment, 'tpr_gap' AS measure, 5e-1 AS before UNION ALL SELECT 'segment', 'review_rate_ratio', 999e-3), j AS (SELECT cur.*, before FROM cur LEFT JOIN acc USING (segment, measure) WHERE value IS NOT NULL)
SELECT *, CASE WHEN before IS NULL THEN 'outstanding' WHEN CASE WHEN contains(measure, 'ratio') THEN value < before - 5e-2 ELSE value > before + 5e-2 END THEN 'lapsed' ELSE 'accepted' END AS state FROM j""")
def acceptance_lapse(spark, sf):
    g = metrics.parity_gaps(_parity(spark, sf)).unpivot(["segment"], ["tpr_gap", "fpr_gap", "review_rate_ratio"], "measure", "value").where("value is not null")
    acc = spark.createDataFrame([("segment", "tpr_gap", 0.5), ("segment", "review_rate_ratio", 0.999)], "segment string, measure string, before double")
    return decide.acceptance(g, acc, 0.05)

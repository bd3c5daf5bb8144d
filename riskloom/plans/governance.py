"""Queries on the model registry, audit events, the star extract and presentation measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import cut, once, sharing
from ..operators import contract, dashboard, decide, governance, metrics, queue
from ..sources.tables import APPS_SQL, SCORED_SQL, applications, scored
from . import cards, curation, decisions, evaluation, links, queues, sampling, star  # noqa: F401  (fill the catalogue)
from .registry import QUERIES, SQL, query

_PROJECT, _CODE = "riskloom", "c0de"


def _once(name, spark, sf):
    """A query of few rows, run once for all that ask for it inside `sharing`."""
    return once((name, sf), lambda: QUERIES[name](spark, sf))


#: Registration runs: their periods, code and dataset version. The second comes back to some versions of the first.
RUNS = (("run1", 0, 4), ("run2", 3, 99))


def registrations(spark, sf):
    """A version of each model for every period that a run covers, from the applications scored in it: approved if its average
    precision is above the prevalence, else a draft in the first run and retained later."""
    s = scored(applications(spark, sf))
    by = ["model", "period"]
    steps = metrics.score_steps(s, by)
    seen = s.groupBy(*by).agg(F.count("*").alias("n"), F.sum("label").alias("positives")).join(metrics.average_precision(steps, by), by)
    runs = F.broadcast(spark.createDataFrame(RUNS, "run string, low int, high int"))
    name = F.concat(F.col("model"), F.lit("-p"), F.col("period").cast("string"))
    good = F.coalesce(F.round("average_precision", 6) > F.round(F.col("positives") / F.col("n"), 6), F.lit(False))
    state = F.when(good, "approved").when(F.col("run") == RUNS[0][0], "draft").otherwise("retained")
    manifest = F.to_json(F.struct("model", "period", "n", "positives", F.col("run").alias("code")))
    rows = seen.join(runs, F.col("period").between(F.col("low"), F.col("high")))
    return rows.select(
        "run", name.alias("model_version"), F.concat(F.lit("orders-"), F.col("run")).alias("dataset_version"), F.sha2(F.concat_ws("|", name, F.col("n").cast("string"), F.col("positives").cast("string")), 256).alias("artifact_hash"),
        F.col("run").alias("code_sha"), state.alias("approval_state"), manifest.alias("manifest"), F.col("run").alias("created_at"),
    )


_REGISTRATIONS = f"""{SCORED_SQL}, steps AS (SELECT model, period, score, sum(label) AS tp, count(*) AS n FROM scored GROUP BY 1, 2, 3),
cum AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ct FROM steps WINDOW w AS (PARTITION BY model, period ORDER BY score DESC)),
seen AS (SELECT model, period, CAST(sum(n) AS BIGINT) AS n, CAST(sum(tp) AS BIGINT) AS positives, sum(CAST(tp AS DOUBLE) * CAST(ct AS DOUBLE) / CAST(cn AS DOUBLE)) / nullif(CAST(sum(tp) AS DOUBLE), 0) AS ap FROM cum GROUP BY 1, 2),
runs AS (SELECT * FROM (VALUES {", ".join(f"('{r}', {lo}, {hi})" for r, lo, hi in RUNS)}) t(run, low, high)),
regs AS (SELECT run, model || '-p' || CAST(period AS VARCHAR) AS model_version, 'orders-' || run AS dataset_version, sha256(model || '-p' || CAST(period AS VARCHAR) || '|' || CAST(n AS VARCHAR) || '|' || CAST(positives AS VARCHAR)) AS artifact_hash, run AS code_sha,
  CASE WHEN coalesce(round(ap, 6) > round(positives / CAST(n AS DOUBLE), 6), FALSE) THEN 'approved' WHEN run = '{RUNS[0][0]}' THEN 'draft' ELSE 'retained' END AS approval_state,
  '{{"model":"' || model || '","period":' || CAST(period AS VARCHAR) || ',"n":' || CAST(n AS VARCHAR) || ',"positives":' || CAST(positives AS VARCHAR) || ',"code":"' || run || '"}}' AS manifest, run AS created_at
  FROM seen JOIN runs ON period BETWEEN low AND high)"""


@query(f"""WITH {_REGISTRATIONS}
SELECT a.model_version, b.dataset_version, a.artifact_hash, a.code_sha, a.approval_state, a.manifest, b.created_at FROM (SELECT *, row_number() OVER (PARTITION BY model_version ORDER BY run DESC) AS k FROM regs) a JOIN (SELECT *, row_number() OVER (PARTITION BY model_version ORDER BY run) AS k FROM regs) b ON a.model_version = b.model_version WHERE a.k = 1 AND b.k = 1""")
def model_registry(spark, sf):
    """Two registrations of models scored on the applications: the second replaces state, manifest and hashes of known versions, adds new ones, and
    leaves data set and date of the first."""
    regs = registrations(spark, sf)
    out = regs.drop("run").limit(0)
    for run, _, _ in RUNS:
        out = governance.register(out, regs.where(F.col("run") == run).drop("run"))
    return out


@query(f"WITH {_REGISTRATIONS} SELECT model_version, run, approval_state, artifact_hash, lead(run) OVER w AS replaced_by, lead(run) OVER w IS NULL AS current, coalesce(lag(approval_state) OVER w <> approval_state, FALSE) AS changed FROM regs WINDOW w AS (PARTITION BY model_version ORDER BY run)")
def registry_history(spark, sf):
    """Every registration with the run that replaced it, and whether the state changed."""
    return governance.history(registrations(spark, sf), "run").select("model_version", "run", "approval_state", "artifact_hash", "replaced_by", "current", "changed")


def _events(spark, sf):
    q = QUERIES["queue_rank_cut"](spark, sf)
    correlation = F.concat_ws(":", F.lit("operations"), F.lit("d1"), F.concat(F.lit("p"), F.col("period").cast("string")), "model")
    details = F.to_json(F.struct("queue_size", "headcount"))
    return q.select(governance.event_id(_PROJECT, correlation, F.lit(_CODE)).alias("event_id"), correlation.alias("correlation_id"), F.lit("queue_refresh").alias("action"), F.lit("review_queue").alias("object_type"), details.alias("details"))


_UUID = lambda name: f"""(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', CAST(CAST('0x' || substr(h, 17, 1) AS INTEGER) + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name})) AS h))"""


@query(f"""WITH q AS ({SQL["queue_rank_cut"]}), e AS (SELECT 'operations:d1:p' || CAST(period AS VARCHAR) || ':' || model AS correlation_id, '{{\"queue_size\":' || CAST(queue_size AS VARCHAR) || ',\"headcount\":' || CAST(headcount AS VARCHAR) || '}}' AS details FROM q)
SELECT {_UUID(f"'{_PROJECT}:' || correlation_id || ':{_CODE}'")} AS event_id, correlation_id, 'queue_refresh' AS action, 'review_queue' AS object_type, details FROM e""")
def audit_events(spark, sf):
    """A refresh that runs twice leaves each event once."""
    once = _events(spark, sf)
    return governance.audit(governance.audit(once.limit(0), once), _events(spark, sf))


_RUN = lambda m, p: F.concat(F.lit(f"{_PROJECT}:cap-050-p"), p.cast("string"), F.lit(":"), m)
_RUN_SQL = _UUID(f"'{_PROJECT}:cap-050-p' || CAST(period AS VARCHAR) || ':' || model")
_ASSIGNED = f"""{SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY model, period ORDER BY score DESC, pos) AS rank, count(*) OVER (PARTITION BY model, period) AS n FROM scored),
h AS (SELECT *, greatest(CAST(floor(CAST(n AS DOUBLE) * 5e-2) AS BIGINT), 1) AS headcount FROM r), runs AS (SELECT {_RUN_SQL} AS scenario_run_id, model, period, headcount FROM (SELECT model, period, max(headcount) AS headcount FROM h GROUP BY 1, 2) g),
assigned AS (SELECT scenario_run_id, application_id, CAST(rank AS BIGINT) AS queue_rank, 'manual_review' AS action, period FROM h JOIN runs USING (model, period) WHERE rank <= h.headcount)"""


def _cut(spark, sf):
    return queue.rank_cut(scored(applications(spark, sf), "application_id"), ["model", "period"], 0.05)


@query(f"WITH {_ASSIGNED} SELECT scenario_run_id, application_id, queue_rank, action FROM assigned")
def queue_assignments(spark, sf):
    """The queues of all runs as a load takes them (see sources.loads)."""
    return queue.assignments(_cut(spark, sf), _RUN(F.col("model"), F.col("period")))


@query(f"""WITH {_ASSIGNED}, l AS (SELECT scenario_run_id, queue_rank FROM assigned WHERE period <> 2 AND NOT (period = 4 AND queue_rank % 2 = 0)), s AS (SELECT scenario_run_id, count(*) AS assigned FROM l GROUP BY 1)
SELECT scenario_run_id, headcount, coalesce(assigned, 0) AS assigned, CASE WHEN assigned IS NULL THEN 'missing' WHEN assigned = headcount THEN 'complete' ELSE 'partial' END AS status FROM runs LEFT JOIN s USING (scenario_run_id)""")
def queue_completeness(spark, sf):
    """Runs against what a load that lost a period and every second row of another has left of them."""
    ranked = _cut(spark, sf)
    name = _RUN(F.col("model"), F.col("period"))
    runs = ranked.groupBy("model", "period").agg(F.max("group_size").alias("n")).select(queue.uuid5(name).alias("scenario_run_id"), queue.headcount(F.col("n"), 0.05).alias("headcount"))
    left = ranked.where((F.col("period") != 2) & ~((F.col("period") == 4) & (F.col("rank") % 2 == 0)))
    return queue.completeness(queue.assignments(left, name), runs)


@query(f"""SELECT count(*) AS drift_checks, count(*) FILTER (WHERE status = 'warn') AS drift_warnings, count(*) FILTER (WHERE status = 'block') AS drift_blocks, max(psi) AS max_psi, CAST(count(*) FILTER (WHERE status = 'warn') AS VARCHAR) || ' warnings, ' || CAST(count(*) FILTER (WHERE status = 'block') AS VARCHAR) || ' blocks' AS drift_summary FROM ({SQL["drift_matrix"]})""")
@sharing
def bi_drift(spark, sf):
    d = _once("drift_matrix", spark, sf).agg(F.count("*").alias("drift_checks"), F.count_if(F.col("status") == "warn").alias("drift_warnings"), F.count_if(F.col("status") == "block").alias("drift_blocks"), F.max("psi").alias("max_psi"))
    return d.withColumn("drift_summary", F.concat(F.col("drift_warnings").cast("string"), F.lit(" warnings, "), F.col("drift_blocks").cast("string"), F.lit(" blocks")))


@query(f"SELECT DISTINCT a.model AS comparator_key, a.model = g.champion AS is_champion, a.model <> g.champion AS is_challenger FROM ({SQL['average_precision']}) a, ({SQL['governance_refusal']}) g")
@sharing
def extract_comparators(spark, sf):
    """The models that are compared, and which of them is the champion."""
    champion = F.broadcast(_once("governance_refusal", spark, sf).select("champion"))
    m = _once("average_precision", spark, sf).select("model").distinct().crossJoin(champion)
    return m.select(F.col("model").alias("comparator_key"), (F.col("model") == F.col("champion")).alias("is_champion"), (F.col("model") != F.col("champion")).alias("is_challenger"))


#: Variants of the challenger's score under which it is looked at again: as it is, moved up, and in ten steps.
VARIANTS = {"base": "challenger", "moved_scores": "least(challenger + 1e-1, 1e0)", "coarse_scores": "floor(challenger * 1e1) / 1e1"}


def _variants(spark, sf):
    a = applications(spark, sf).select("pos", "label", *(F.expr(e).cast("double").alias(n) for n, e in VARIANTS.items()))
    return a.unpivot(["pos", "label"], list(VARIANTS), "evidence_source_key", "score")


_VARIANT_ROWS = APPS_SQL + ", v AS (" + " UNION ALL ".join(f"SELECT pos, label, '{n}' AS evidence_source_key, CAST({e} AS DOUBLE) AS score FROM apps" for n, e in VARIANTS.items()) + ")"


@query(f"""WITH {_VARIANT_ROWS} SELECT evidence_source_key, 'Orders' AS family, count(*) AS applications FROM v GROUP BY 1 UNION ALL SELECT 'link_fixture', 'Synthetic fixture', count(*) FROM ({SQL["link_fixture"]})""")
def extract_sources(spark, sf):
    """Where evidence comes from: the variants of the scored applications, and the fixture of linking."""
    v = _variants(spark, sf).groupBy("evidence_source_key").agg(F.count("*").alias("applications")).select("evidence_source_key", F.lit("Orders").alias("family"), "applications")
    return v.unionByName(links.fixture_size(spark, sf).select(F.lit("link_fixture").alias("evidence_source_key"), F.lit("Synthetic fixture").alias("family"), F.col("n").alias("applications")))


@query(f"""WITH {_VARIANT_ROWS}, steps AS (SELECT evidence_source_key, score, count(*) AS n, sum(label) AS tp FROM v GROUP BY 1, 2),
cum AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ct FROM steps WINDOW w AS (PARTITION BY evidence_source_key ORDER BY score DESC)),
m AS (SELECT evidence_source_key, 'average_precision' AS metric_name, sum(CAST(tp AS DOUBLE) * CAST(ct AS DOUBLE) / CAST(cn AS DOUBLE)) / CAST(sum(tp) AS DOUBLE) AS metric_value FROM cum GROUP BY 1
  UNION ALL SELECT evidence_source_key, 'brier', avg((score - label) * (score - label)) FROM v GROUP BY 1 UNION ALL SELECT evidence_source_key, 'prevalence', avg(label) FROM v GROUP BY 1)
SELECT m.evidence_source_key, c.applications, metric_name, round(metric_value, 6) AS metric_value FROM m JOIN (SELECT evidence_source_key, count(*) AS applications FROM v GROUP BY 1) c USING (evidence_source_key)""")
@sharing
def extract_variants(spark, sf):
    """The challenger's figures under every variant of its score."""
    v, by = _variants(spark, sf), ["evidence_source_key"]
    one = metrics.average_precision(metrics.score_steps(v, by), by).join(metrics.losses(v, by).select(*by, "brier", "prevalence"), by).join(v.groupBy(*by).agg(F.count("*").alias("applications")), by)
    return one.unpivot([*by, "applications"], ["average_precision", "brier", "prevalence"], "metric_name", "metric_value").withColumn("metric_value", F.round("metric_value", 6))


_METRIC_SOURCES = {"average_precision": "average_precision", "auroc": "auroc", "ece": "ece_15", "brier": "brier_logloss", "log_loss": "brier_logloss", "prevalence": "brier_logloss"}


@query(" UNION ALL ".join(f"SELECT model AS comparator_key, 'base' AS evidence_source_key, '{m}' AS metric_name, {m} AS metric_value FROM ({SQL[q]})" for m, q in _METRIC_SOURCES.items()))
@sharing
def extract_model_metrics(spark, sf):
    """Every figure of every model, a row each."""
    out = None
    for m, q in _METRIC_SOURCES.items():
        one = _once(q, spark, sf).select(F.col("model").alias("comparator_key"), F.lit("base").alias("evidence_source_key"), F.lit(m).alias("metric_name"), F.col(m).alias("metric_value"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT gate AS gate_key, passed AS gate_passed, 'Model promotion' AS gate_family FROM ({SQL['promotion_gates']}) UNION ALL SELECT gate, passed, 'Identity linking' FROM ({SQL['link_program_gates']})")
@sharing
def extract_gates(spark, sf):
    of = lambda q, family: QUERIES[q](spark, sf).select(F.col("gate").alias("gate_key"), F.col("passed").alias("gate_passed"), F.lit(family).alias("gate_family"))
    return of("promotion_gates", "Model promotion").unionByName(of("link_program_gates", "Identity linking"))


@query(f"""WITH g AS ({SQL["governance_refusal"]}), d AS ({SQL["bi_drift"]}), l AS ({SQL["link_program_gates"]}), {APPS_SQL}
SELECT 'champion' AS context_key, champion AS context_value FROM g UNION ALL SELECT 'strategy_recommendation', recommendation FROM g UNION ALL SELECT 'drift_warnings', CAST(drift_warnings AS VARCHAR) FROM d UNION ALL SELECT 'drift_blocks', CAST(drift_blocks AS VARCHAR) FROM d
UNION ALL SELECT 'linking_all_gates_pass', CASE WHEN bool_and(passed) THEN 'true' ELSE 'false' END FROM l UNION ALL SELECT 'applications', CAST(count(*) AS VARCHAR) FROM apps
UNION ALL SELECT 'refusal_reason_' || CAST(k AS VARCHAR), r FROM (SELECT unnest(string_split(reasons, '; ')) AS r, generate_subscripts(string_split(reasons, '; '), 1) AS k FROM g WHERE reasons <> '')""")
@sharing
def extract_run_context(spark, sf):
    """What the extract says of its run, key by key; refusal reasons are numbered."""
    pair = lambda df, key, value: df.select(F.lit(key).alias("context_key") if isinstance(key, str) else key.alias("context_key"), value.cast("string").alias("context_value"))
    g, d = _once("governance_refusal", spark, sf), _once("bi_drift", spark, sf)
    passed = QUERIES["link_program_gates"](spark, sf).agg(F.bool_and("passed").alias("p"))
    why = g.where("reasons <> ''").select(F.posexplode(F.split("reasons", "; ")).alias("k", "r"))
    parts = [
        pair(g, "champion", F.col("champion")), pair(g, "strategy_recommendation", F.col("recommendation")), pair(d, "drift_warnings", F.col("drift_warnings")), pair(d, "drift_blocks", F.col("drift_blocks")), pair(passed, "linking_all_gates_pass", F.col("p")),
        pair(applications(spark, sf).agg(F.count("*").alias("n")), "applications", F.col("n")), pair(why, F.concat(F.lit("refusal_reason_"), (F.col("k") + 1).cast("string")), F.col("r")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH c AS ({SQL["extract_comparators"]}), s AS ({SQL["extract_sources"]})
SELECT 'fact_model_metric' AS fact, count(*) FILTER (WHERE comparator_key NOT IN (SELECT comparator_key FROM c)) AS comparators_missing, count(*) FILTER (WHERE evidence_source_key NOT IN (SELECT evidence_source_key FROM s)) AS sources_missing FROM ({SQL["extract_model_metrics"]})
UNION ALL SELECT 'fact_capacity', count(*) FILTER (WHERE model NOT IN (SELECT comparator_key FROM c)), 0 FROM ({SQL["capacity_sweep_wilson"]}) UNION ALL SELECT 'fact_variant', 0, count(*) FILTER (WHERE evidence_source_key NOT IN (SELECT evidence_source_key FROM s)) FROM ({SQL["extract_variants"]})""")
@sharing
def extract_orphans(spark, sf):
    """Rows of facts whose key is in no dimension: none."""
    c, s = _once("extract_comparators", spark, sf).select("comparator_key"), _once("extract_sources", spark, sf).select("evidence_source_key")
    facts = {"fact_model_metric": _once("extract_model_metrics", spark, sf), "fact_capacity": _once("capacity_sweep_wilson", spark, sf).withColumnRenamed("model", "comparator_key"), "fact_variant": _once("extract_variants", spark, sf)}
    out = None
    for name, fact in facts.items():
        missing = lambda dim, key: fact.join(F.broadcast(dim), key, "left_anti").agg(F.count("*").alias(f"{key}_n")) if key in fact.columns else spark.range(1).select(F.lit(0).cast("long").alias(f"{key}_n"))  # noqa: B023, E731
        one = missing(c, "comparator_key").crossJoin(missing(s, "evidence_source_key")).select(F.lit(name).alias("fact"), F.col("comparator_key_n").alias("comparators_missing"), F.col("evidence_source_key_n").alias("sources_missing"))
        out = one if out is None else out.unionByName(one)
    return out


#: Tables of the star extract, and the query whose rows their evidence document holds (each is held against SQL row by row).
EXTRACT = {
    "dim_comparator": "extract_comparators", "dim_evidence_source": "extract_sources", "fact_model_metric": "extract_model_metrics", "fact_capacity": "capacity_sweep_wilson", "fact_promotion_gate": "extract_gates",
    "fact_strategy_policy": "policy_cards", "fact_fairness_group": "segment_parity", "fact_drift": "drift_matrix", "fact_variant": "extract_variants", "fact_linking_run": "link_program", "fact_data_quality": "validate_source", "fact_run_context": "extract_run_context",
}


def extract_table(spark, sf, name):
    """A table of the star, typed, out of its JSON evidence document."""
    rows = _once(EXTRACT[name], spark, sf)
    return dashboard.extract(dashboard.document(rows), rows.schema)


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM ({SQL[q]})) AS rows" for t, q in EXTRACT.items()))
@sharing
def star_extract(spark, sf):
    """Rows of the 12 tables of the extract. What several tables rest on is made once: applications are joined once, records are linked once."""
    out = None
    for t in EXTRACT:
        one = extract_table(spark, sf, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


_LAST = 7
_HEADLINE = "CASE WHEN recommendation = 'no robust recommendation' THEN 'No robust recommendation - the incumbent is retained' ELSE 'Recommended strategy: ' || recommendation END"


@query(f"""WITH {APPS_SQL}, g AS ({SQL["governance_refusal"]}), f AS ({SQL["behaviour_fingerprint"]}), n AS (SELECT count(*) AS n FROM apps WHERE period = {_LAST})
SELECT {_HEADLINE} AS decision_headline, champion, reasons AS refusal_reasons, 'Orders, period {_LAST} (untouched test period) - ' || CAST(n AS VARCHAR) || ' applications' AS evidence_period,
  substr(sha256(fingerprint || '|' || champion || '|' || recommendation || '|' || reasons), 1, 12) AS evidence_revision, 'orders-' || substr(fingerprint, 1, 12) AS dataset_version FROM g, f, n""")
@sharing
def bi_headline(spark, sf):
    """Decision, and what it rests on: the test period, the version of the data by its scores' fingerprint, the revision of data and decision."""
    headline = F.when(F.col("recommendation") == "no robust recommendation", "No robust recommendation - the incumbent is retained").otherwise(F.concat(F.lit("Recommended strategy: "), F.col("recommendation")))
    n = applications(spark, sf, _LAST, _LAST).agg(F.count("*").alias("n"))
    r = QUERIES["governance_refusal"](spark, sf).crossJoin(F.broadcast(QUERIES["behaviour_fingerprint"](spark, sf))).crossJoin(F.broadcast(n))
    return r.select(
        headline.alias("decision_headline"), "champion", F.col("reasons").alias("refusal_reasons"), F.concat(F.lit(f"Orders, period {_LAST} (untouched test period) - "), F.col("n").cast("string"), F.lit(" applications")).alias("evidence_period"),
        F.substring(F.sha2(F.concat_ws("|", "fingerprint", "champion", "recommendation", "reasons"), 256), 1, 12).alias("evidence_revision"), F.concat(F.lit("orders-"), F.substring("fingerprint", 1, 12)).alias("dataset_version"),
    )


#: What every figure with assumed values says beside it.
NOTICE = "Scenario values rest on assumed costs (12,500 a catch, 150 a good customer, 17 a review); they are no measured savings"


@query(f"""WITH {decisions._FRONT_SQL}, d AS (SELECT a.*, EXISTS (SELECT 1 FROM u b WHERE b.caught >= a.caught AND b.utility >= a.utility AND b.false_positives <= a.false_positives AND b.queue_size <= a.queue_size
  AND (b.caught > a.caught OR b.utility > a.utility OR b.false_positives < a.false_positives OR b.queue_size < a.queue_size)) AS dominated FROM u a)
SELECT policy, utility AS scenario_value, CASE WHEN dominated THEN 'Dominated' ELSE 'On frontier' END AS frontier_label, overflow > 0 AS has_overflow, '{NOTICE}' AS assumption_notice FROM d""")
def bi_policy_frontier(spark, sf):
    """Every policy with its label; the 1,152 policies are a table of known size."""
    p = cut(decisions._policies(spark, sf))
    front = decide.pareto(p, "policy", ["caught", "utility"], ["false_positives", "queue_size"]).select("policy", F.lit("On frontier").alias("label"))
    return p.join(F.broadcast(front), "policy", "left").select("policy", F.col("utility").alias("scenario_value"), F.coalesce("label", F.lit("Dominated")).alias("frontier_label"), (F.col("overflow") > 0).alias("has_overflow"), F.lit(NOTICE).alias("assumption_notice"))


@query(f"SELECT count(*) AS gates_total, count(*) FILTER (WHERE passed) AS gates_passed, count(*) FILTER (WHERE NOT passed) AS gates_failed, CAST(count(*) FILTER (WHERE passed) AS VARCHAR) || ' of ' || CAST(count(*) AS VARCHAR) || ' gates passed' AS promotion_summary FROM ({SQL['promotion_gates']})")
def bi_gates(spark, sf):
    g = QUERIES["promotion_gates"](spark, sf).agg(F.count("*").alias("gates_total"), F.count_if("passed").alias("gates_passed"), F.count_if(~F.col("passed")).alias("gates_failed"))
    return g.withColumn("promotion_summary", F.concat(F.col("gates_passed").cast("string"), F.lit(" of "), F.col("gates_total").cast("string"), F.lit(" gates passed")))


_CAP = f"SELECT capacity, model, CAST(sum(queue_size) AS BIGINT) AS review_demand, CAST(sum(caught) AS BIGINT) AS fraud_caught, round(sum(caught) / CAST(sum(positives) AS DOUBLE), 6) AS catch_rate, min(catch_lo) AS worst_lower, max(catch_hi) AS best_upper FROM ({SQL['capacity_sweep_wilson']}) GROUP BY 1, 2"


@query(f"""WITH c AS ({_CAP}) SELECT n.capacity, n.review_demand, n.fraud_caught, n.catch_rate AS challenger_catch_rate, o.catch_rate AS champion_catch_rate, round(n.catch_rate - o.catch_rate, 6) AS catch_gain_over_champion, printf('%.1f%% to %.1f%%', 100 * n.worst_lower, 100 * n.best_upper) AS catch_rate_interval
FROM c n JOIN c o ON n.capacity = o.capacity AND n.model = 'challenger' AND o.model = 'incumbent'""")
def bi_capacity(spark, sf):
    c = QUERIES["capacity_sweep_wilson"](spark, sf)
    s = c.groupBy("capacity", "model").agg(F.sum("queue_size").alias("review_demand"), F.sum("caught").alias("fraud_caught"), F.round(F.sum("caught") / F.sum("positives"), 6).alias("catch_rate"), F.min("catch_lo").alias("lo"), F.max("catch_hi").alias("hi"))
    of = lambda m, x: F.max(F.when(F.col("model") == m, F.col(x)))
    g = s.groupBy("capacity").agg(of("challenger", "review_demand").alias("review_demand"), of("challenger", "fraud_caught").alias("fraud_caught"), of("challenger", "catch_rate").alias("challenger_catch_rate"), of("incumbent", "catch_rate").alias("champion_catch_rate"), of("challenger", "lo").alias("lo"), of("challenger", "hi").alias("hi"))
    interval = F.format_string("%.1f%% to %.1f%%", 100 * F.col("lo"), 100 * F.col("hi"))
    return g.select("capacity", "review_demand", "fraud_caught", "challenger_catch_rate", "champion_catch_rate", F.round(F.col("challenger_catch_rate") - F.col("champion_catch_rate"), 6).alias("catch_gain_over_champion"), interval.alias("catch_rate_interval"))


@query(f"""WITH u AS ({SQL["policy_cards"]}) SELECT count(*) AS policies, count(*) FILTER (WHERE utilisation > 1) AS policies_with_overflow, CAST(sum(greatest(queue_size - floor(CAST(applications AS DOUBLE) * capacity), 0)) AS BIGINT) AS beyond_capacity, max(net_high) AS best_scenario_value, count(*) FILTER (WHERE net_low > 0) AS positive_at_low_value FROM u""")
def bi_policies(spark, sf):
    u = QUERIES["policy_cards"](spark, sf)
    beyond = F.greatest(F.col("queue_size") - F.floor(F.col("applications").cast("double") * F.col("capacity")), F.lit(0))
    return u.agg(F.count("*").alias("policies"), F.count_if(F.col("utilisation") > 1).alias("policies_with_overflow"), F.sum(beyond).cast("long").alias("beyond_capacity"), F.max("net_high").alias("best_scenario_value"), F.count_if(F.col("net_low") > 0).alias("positive_at_low_value"))


@query(f"SELECT CAST(sum(publishable_groups) AS BIGINT) AS publishable_groups, CAST(sum(withheld_groups) AS BIGINT) AS withheld_groups, count(*) FILTER (WHERE reasons <> '') AS segments_triggering_review FROM ({SQL['fairness_review']})")
def bi_segments(spark, sf):
    return QUERIES["fairness_review"](spark, sf).agg(F.sum("publishable_groups").alias("publishable_groups"), F.sum("withheld_groups").alias("withheld_groups"), F.count_if(F.col("reasons") != "").alias("segments_triggering_review"))


@query(f"SELECT min(f1) AS worst_pairwise_f1, max(false_merge_rate) AS worst_false_merge_rate, count(*) AS linking_runs FROM ({SQL['link_program']})")
def bi_linking(spark, sf):
    return QUERIES["link_program"](spark, sf).agg(F.min("f1").alias("worst_pairwise_f1"), F.max("false_merge_rate").alias("worst_false_merge_rate"), F.count("*").alias("linking_runs"))


SOURCES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")


def _contract_rules():
    """Rules of the five contracts under one another's names, for rows that have the fields of all."""
    parts = {"application": contract.application_rules(SOURCES, 6), "score": contract.score_rules(SOURCES), "link": contract.link_rules(SOURCES), "request": contract.request_rules(), "result": contract.result_rules()}
    return [contract.Rule(f"{part}: {r.name}", r.fine, r.shown) for part, rules in parts.items() for r in rules]


#: Fields of the contracts, as expressions on applications that both engines read alike.
_FIELDS = {
    "dataset_version": "CASE WHEN period = 0 THEN NULL ELSE 'd1' END", "period": "period", "channel": "CASE WHEN nation = 3 THEN NULL ELSE channel END", "evidence_source": "channel", "model_version": "'m1'", "policy_version": "CASE WHEN nation = 4 THEN NULL ELSE 'p1' END",
    "calibrated_fraud_probability": "round(challenger * 15e-1, 6)", "risk_band": "CASE WHEN incumbent_score < 0 THEN 'none' WHEN incumbent_score < 50 THEN 'low' WHEN incumbent_score < 90 THEN 'high' ELSE 'critical' END", "artifact_hash": "CASE WHEN label = 1 THEN NULL ELSE 'h' END",
    "cluster_id": "CASE WHEN nation = 5 THEN NULL ELSE 'c1' END", "match_strength": "round(incumbent * 12e-1, 6)", "cluster_risk": "round(incumbent_score / 1e2, 6)", "score_cut": "round(challenger, 6)", "review_capacity": "round(nation / 24e0, 6)", "fraud_exposure": "CAST(incumbent_score AS DOUBLE)",
    "review_cost": "CAST(nation AS DOUBLE)", "friction_cost": "CAST(custkey - 50 AS DOUBLE)", "idempotency_key": "substr(application_id, 1, CAST(nation + 1 AS INTEGER))", "catch_rate": "round(challenger, 6)", "false_positive_rate": "round(incumbent, 6)", "review_rate": "round(challenger + incumbent, 6)",
    "queue_size": "nation", "overflow": "incumbent_score", "recommendation": "CASE WHEN segment = 'BUILDING' THEN NULL ELSE segment END",
}


def _contract_sql() -> str:
    need = lambda f: f"{f} IS NOT NULL"
    of = lambda f: f"({f} IS NULL OR {f} IN ({', '.join(repr(x) for x in SOURCES)}))"
    span = lambda f, lo, hi=None: f"({f} IS NULL OR ({f} {lo}" + (f" AND {f} <= {hi}" if hi is not None else "") + "))"
    source = "evidence_source is one of " + ", ".join(SOURCES)
    bands = ("low", "medium", "high", "critical")
    rules = [
        *(("application: " + n, c, v) for n, c, v in (
            ("dataset_version is required", need("dataset_version"), None), ("application_id is required", need("application_id"), None), ("application_id has 1 characters or more", "(application_id IS NULL OR length(application_id) >= 1)", "application_id"), ("period is required", need("period"), None),
            ("period in [0, 6]", span("period", ">= 0", 6), "period"), ("channel is required", need("channel"), None), ("evidence_source is required", need("evidence_source"), None), (source, of("evidence_source"), "evidence_source"))),
        *(("score: " + n, c, v) for n, c, v in (
            ("application_id is required", need("application_id"), None), ("model_version is required", need("model_version"), None), ("calibrated_fraud_probability is required", need("calibrated_fraud_probability"), None), ("calibrated_fraud_probability in [0, 1]", span("calibrated_fraud_probability", ">= 0", 1), "calibrated_fraud_probability"),
            ("risk_band is required", need("risk_band"), None), ("risk_band is one of " + ", ".join(bands), f"(risk_band IS NULL OR risk_band IN {bands})", "risk_band"), ("reason_codes is required", need("reason_codes"), None), ("artifact_hash is required", need("artifact_hash"), None), ("evidence_source is required", need("evidence_source"), None), (source, of("evidence_source"), "evidence_source"))),
        *(("link: " + n, c, v) for n, c, v in (
            ("application_id is required", need("application_id"), None), ("cluster_id is required", need("cluster_id"), None), ("match_strength is required", need("match_strength"), None), ("match_strength in [0, 1]", span("match_strength", ">= 0", 1), "match_strength"), ("cluster_risk is required", need("cluster_risk"), None),
            ("cluster_risk in [0, 1]", span("cluster_risk", ">= 0", 1), "cluster_risk"), ("signal_types is required", need("signal_types"), None), (source, of("evidence_source"), "evidence_source"))),
        *(("request: " + n, c, v) for n, c, v in (
            ("model_version is required", need("model_version"), None), ("policy_version is required", need("policy_version"), None), ("score_cut is required", need("score_cut"), None), ("score_cut in [0, 1]", span("score_cut", ">= 0", 1), "score_cut"), ("review_capacity is required", need("review_capacity"), None), ("review_capacity in (0, 1]", span("review_capacity", "> 0", 1), "review_capacity"),
            *((x, c, v) for f in ("fraud_exposure", "review_cost", "friction_cost") for x, c, v in ((f"{f} is required", need(f), None), (f"{f} in [0, ]", span(f, ">= 0"), f))), ("idempotency_key is required", need("idempotency_key"), None), ("idempotency_key has 8 to 128 characters", "(idempotency_key IS NULL OR length(idempotency_key) BETWEEN 8 AND 128)", "idempotency_key"))),
        *(("result: " + n, c, v) for n, c, v in (
            ("model_version is required", need("model_version"), None), ("policy_version is required", need("policy_version"), None), *((x, c, v) for f in ("catch_rate", "false_positive_rate", "review_rate") for x, c, v in ((f"{f} is required", need(f), None), (f"{f} in [0, 1]", span(f, ">= 0", 1), f))),
            *((x, c, v) for f in ("queue_size", "overflow") for x, c, v in ((f"{f} is required", need(f), None), (f"{f} in [0, ]", span(f, ">= 0"), f))), ("recommendation is required", need("recommendation"), None), ("refusal_reasons is required", need("refusal_reasons"), None),
            ("capacity overflow has a refusal reason", "coalesce(overflow <= 0 OR len(refusal_reasons) > 0, FALSE)", "overflow"))),
    ]
    fields = ", ".join(f"{e} AS {n}" for n, e in _FIELDS.items())
    rows = f"WITH {APPS_SQL}, r AS (SELECT pos, CASE WHEN nation = 6 THEN NULL ELSE application_id END AS application_id, {fields}, CASE WHEN nation = 7 THEN NULL ELSE [channel] END AS reason_codes, CASE WHEN nation = 8 THEN NULL ELSE [segment] END AS signal_types, CASE WHEN nation = 9 THEN NULL WHEN nation > 12 THEN [] ELSE ['a'] END AS refusal_reasons FROM apps)"
    quote = lambda n: n.replace("'", "''")
    return rows + " " + " UNION ALL ".join(f"SELECT '{quote(n)}' AS rule, count(*) AS rows, count(*) FILTER (WHERE NOT ({c})) AS broken FROM r" for n, c, _ in rules)


@query(_contract_sql())
def contract_violations(spark, sf):
    """How many applications break each rule of the contracts of applications, scores, links, strategy requests and results; all rules in one pass."""
    a = applications(spark, sf)
    without = lambda n, c: F.when(F.col("nation") == n, None).otherwise(c)
    rows = a.select(
        "pos", without(6, F.col("application_id")).alias("application_id"), *(F.expr(e).alias(n) for n, e in _FIELDS.items()),
        without(7, F.array("channel")).alias("reason_codes"), without(8, F.array("segment")).alias("signal_types"), without(9, F.when(F.col("nation") > 12, F.array().cast("array<string>")).otherwise(F.array(F.lit("a")))).alias("refusal_reasons"),
    )
    return contract.summary(rows, _contract_rules()).select("rule", "rows", "broken")

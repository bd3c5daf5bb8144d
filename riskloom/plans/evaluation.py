"""Queries on model evaluation, drift and parity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import once, sharing
from ..functions.scalars import ratio
from ..operators import metrics
from ..sources.tables import APPS_SQL, SCORED_SQL, applications, scored, table
from .registry import query

BY = ["model"]


def _scored(spark, sf, *keep):
    return scored(applications(spark, sf), *keep)


def _steps(spark, sf):
    return once(("score_steps", sf), lambda: metrics.score_steps(_scored(spark, sf), BY))


_STEPS_SQL = SCORED_SQL + """, steps AS (SELECT model, score, count(*) AS n, sum(label) AS tp FROM scored GROUP BY 1, 2),
cum AS (SELECT *, sum(n) OVER w AS cum_n, sum(tp) OVER w AS cum_tp FROM steps WINDOW w AS (PARTITION BY model ORDER BY score DESC))"""


@query(f"WITH {_STEPS_SQL} SELECT model, round(sum(CAST(tp AS DOUBLE) * CAST(cum_tp AS DOUBLE) / CAST(cum_n AS DOUBLE)) / CAST(sum(tp) AS DOUBLE), 6) AS average_precision FROM cum GROUP BY 1")
def average_precision(spark, sf):
    return metrics.average_precision(_steps(spark, sf), BY).withColumn("average_precision", F.round("average_precision", 6))


@query(f"""WITH {SCORED_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2e0 AS ar FROM scored)
SELECT model, round((sum(CASE WHEN label = 1 THEN ar END) - sum(label) * (sum(label) + 1) / 2e0) / (CAST(sum(label) AS DOUBLE) * CAST(sum(1 - label) AS DOUBLE)), 6) AS auroc FROM r GROUP BY 1""")
def auroc(spark, sf):
    return metrics.auroc(_steps(spark, sf), BY).withColumn("auroc", F.round("auroc", 6))


@query(f"""WITH {SCORED_SQL}, m AS (SELECT model, avg(label) AS prevalence, avg(-(label * ln(p) + (1 - label) * ln(1 - p))) AS log_loss, avg((score - label) * (score - label)) AS brier FROM (SELECT *, least(greatest(score, 1e-9), 1 - 1e-9) AS p FROM scored) GROUP BY 1)
SELECT model, round(prevalence, 6) AS prevalence, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, round(1 - brier / (prevalence * (1 - prevalence)), 6) AS brier_skill FROM m""")
def brier_logloss(spark, sf):
    return metrics.losses(_scored(spark, sf), BY).select("model", *(F.round(c, 6).alias(c) for c in ("prevalence", "log_loss", "brier", "brier_skill")))


@query(f"""WITH {SCORED_SQL}, b AS (SELECT *, len(list_filter(list_transform(range(1, 15), lambda i: i / 15e0), lambda e: e < score)) AS bin FROM scored), g AS (SELECT model, bin, count(*) AS n, avg(score) AS ms, avg(label) AS ml FROM b GROUP BY 1, 2)
SELECT model, round(sum(n * abs(ms - ml)) / CAST(sum(n) AS DOUBLE), 6) AS ece FROM g GROUP BY 1""")
def ece_15(spark, sf):
    return metrics.expected_calibration_error(_scored(spark, sf), BY, 15).withColumn("ece", F.round("ece", 6))


_PSI_SQL = """counts AS (SELECT {keys}, category, count(*) FILTER (WHERE side = 'r') AS r, count(*) FILTER (WHERE side = 'c') AS c FROM cats GROUP BY {keys}, category),
shares AS (SELECT *, r / CAST(sum(r) OVER (PARTITION BY {keys}) AS DOUBLE) + 1e-6 AS rs, c / CAST(sum(c) OVER (PARTITION BY {keys}) AS DOUBLE) + 1e-6 AS cs FROM counts)"""
_BIN = "coalesce(CASE WHEN {v} IS NOT NULL THEN CAST(len(list_filter(e, lambda x: x < {v})) AS VARCHAR) END, '__missing__')"
_EDGES = "(SELECT list_distinct(quantile_cont({v}, [{cuts}])) AS q FROM {t} WHERE {ref})".replace("{cuts}", ", ".join(f"{i}e-1" for i in range(11)))


def _edges_sql(v, t, ref):
    return f"SELECT list_filter(q, lambda x: x > list_min(q) AND x < list_max(q)) AS e FROM {_EDGES.format(v=v, t=t, ref=ref)}"


@query(f"""WITH edges AS ({_edges_sql("p_retailprice", "part", "p_size <= 25")}),
cats AS (SELECT p_size <= 25 AS ref, CASE WHEN p_size <= 25 THEN 'r' ELSE 'c' END AS side, 'p_retailprice' AS feature, {_BIN.format(v="v")} AS category FROM (SELECT *, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_retailprice END AS v FROM part), edges),
{_PSI_SQL.format(keys="feature")} SELECT feature, round(sum((cs - rs) * ln(cs / rs)), 6) AS psi FROM shares GROUP BY 1""")
def psi_numeric(spark, sf):
    """Prices of small parts (reference) against large ones; edges from all reference prices, some rows missing."""
    p = table(spark, sf, "part", "p_partkey", "p_size", "p_retailprice")
    edges = metrics.quantile_edges(p.where("p_size <= 25"), "p_retailprice")
    v = p.withColumn("v", F.when(F.col("p_partkey") % 17 != 0, F.col("p_retailprice")))
    long = v.select(F.when(F.col("p_size") <= 25, "r").otherwise("c").alias("side"), F.lit("p_retailprice").alias("feature"), metrics.psi_category("v", edges).alias("category"))
    return metrics.psi(long, ["feature"], "category", "side").select("feature", F.round("psi", 6).alias("psi"))


@query(f"""WITH cats AS (SELECT CASE WHEN p_size <= 25 THEN 'r' ELSE 'c' END AS side, feature, coalesce(v, '__missing__') AS category FROM (
  SELECT p_size, 'p_brand' AS feature, p_brand AS v FROM part UNION ALL SELECT p_size, 'p_type', CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type END FROM part)),
{_PSI_SQL.format(keys="feature")} SELECT feature, round(sum((cs - rs) * ln(cs / rs)), 6) AS psi FROM shares GROUP BY 1""")
def psi_categorical(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_size", "p_brand", "p_type").withColumn("p_type", F.when(F.col("p_partkey") % 13 != 0, F.col("p_type")))
    long = p.select(F.when(F.col("p_size") <= 25, "r").otherwise("c").alias("side"), "p_brand", "p_type").unpivot(["side"], ["p_brand", "p_type"], "feature", "v")
    long = long.withColumn("category", metrics.psi_category("v", None))
    return metrics.psi(long, ["feature"], "category", "side").select("feature", F.round("psi", 6).alias("psi"))


DRIFT = ("challenger", "incumbent", "channel", "segment")


def _drift_sql():
    num = " UNION ALL ".join(f"SELECT period, '{v}' AS feature, {_BIN.format(v=v)} AS category FROM apps, ({_edges_sql(v, 'apps', 'period <= 5')})" for v in ("challenger", "incumbent"))
    cat = " UNION ALL ".join(f"SELECT period, '{v}' AS feature, coalesce({v}, '__missing__') AS category FROM apps" for v in ("channel", "segment"))
    return f"""WITH {APPS_SQL}, base AS ({num} UNION ALL {cat}), counts AS (SELECT feature, period, category, count(*) AS n FROM base GROUP BY ALL),
ref AS (SELECT feature, category, sum(n) AS r FROM counts WHERE period <= 5 GROUP BY ALL), months AS (SELECT unnest(range(1, 8)) AS month),
grid AS (SELECT DISTINCT m.month, k.feature, k.category FROM months m, (SELECT feature, category FROM ref UNION SELECT feature, category FROM counts WHERE period BETWEEN 1 AND 7) k),
j AS (SELECT g.month, g.feature, g.category, coalesce(r, 0) AS r, coalesce(n, 0) AS c FROM grid g LEFT JOIN ref USING (feature, category) LEFT JOIN counts ON counts.feature = g.feature AND counts.category = g.category AND counts.period = g.month),
s AS (SELECT * FROM (SELECT *, r / CAST(sum(r) OVER w AS DOUBLE) + 1e-6 AS rs, c / CAST(sum(c) OVER w AS DOUBLE) + 1e-6 AS cs FROM j WINDOW w AS (PARTITION BY month, feature)) WHERE r > 0 OR c > 0),
p AS (SELECT CAST(month AS INTEGER) AS month, feature, round(sum((cs - rs) * ln(cs / rs)), 6) AS psi, CAST(sum(c) AS BIGINT) AS rows FROM s GROUP BY ALL)
SELECT *, CASE WHEN psi >= 25e-2 THEN 'block' WHEN psi >= 1e-1 THEN 'warn' ELSE 'pass' END AS status, month <= 5 AS in_window FROM p"""


@query(_drift_sql())
@sharing
def drift_matrix(spark, sf):
    """Every feature in months 1 to 7 against pooled months 0 to 5: categories are counted once by period, and only
    those counts are paired with the months."""
    apps = applications(spark, sf)
    edges = {c: metrics.quantile_edges(apps.where("period <= 5"), c) for c in ("challenger", "incumbent")}
    named = apps.select("period", *(metrics.psi_category(c, edges.get(c)).alias(c) for c in DRIFT))
    counts = named.unpivot(["period"], list(DRIFT), "feature", "category").groupBy("feature", "category", "period").agg(F.count("*").alias("n"))
    months = F.explode(F.sequence(F.lit(1), F.lit(7))).alias("month")
    per = counts.select("feature", "category", "period", "n", months)
    rows = per.groupBy("month", "feature", "category").agg(
        F.sum(F.when(F.col("period") <= 5, F.col("n")).otherwise(0)).alias("r"), F.sum(F.when(F.col("period") == F.col("month"), F.col("n")).otherwise(0)).alias("c")
    ).where("r > 0 or c > 0")
    from pyspark.sql import Window

    w = Window.partitionBy("month", "feature")
    s = rows.withColumn("rs", F.col("r") / F.sum("r").over(w) + 1e-6).withColumn("cs", F.col("c") / F.sum("c").over(w) + 1e-6)
    out = s.groupBy("month", "feature").agg(F.round(F.sum((F.col("cs") - F.col("rs")) * F.ln(F.col("cs") / F.col("rs"))), 6).alias("psi"), F.sum("c").alias("rows"))
    return out.withColumn("status", metrics.psi_status(F.col("psi"))).withColumn("in_window", F.col("month") <= 5)


_PLAIN_LONG = "SELECT 'segment' AS segment, segment AS grp, challenger AS p, label, challenger >= cut AS hit FROM apps, cut UNION ALL SELECT 'nation', CAST(nation AS VARCHAR), challenger, label, challenger >= cut FROM apps, cut"


def _parity_sql(long=_PLAIN_LONG):
    return f"""{APPS_SQL}, cut AS (SELECT quantile_cont(challenger, CAST(1 AS DOUBLE) - 5e-2) AS cut FROM apps), long AS (
  {long}),
g AS (SELECT segment, grp, count(*) AS rows, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE hit) AS selected, count(*) FILTER (WHERE hit AND label = 1) AS caught, abs(avg(p) - avg(label)) AS gap FROM long GROUP BY 1, 2),
groups AS (SELECT segment, grp, rows, positives, positives >= 200 AS publishable, CASE WHEN positives >= 200 THEN round(caught / CAST(positives AS DOUBLE), 6) END AS tpr,
  CASE WHEN positives >= 200 THEN round((selected - caught) / CAST(nullif(rows - positives, 0) AS DOUBLE), 6) END AS fpr, CASE WHEN positives >= 200 THEN round(caught / CAST(greatest(selected, 1) AS DOUBLE), 6) END AS precision,
  CASE WHEN positives >= 200 THEN round(selected / CAST(rows AS DOUBLE), 6) END AS review_rate, CASE WHEN positives >= 200 THEN round(gap, 6) END AS calibration_error FROM g),
gaps AS (SELECT segment, count(*) FILTER (WHERE publishable) AS publishable_groups, count(*) FILTER (WHERE NOT publishable) AS withheld_groups,
  CASE WHEN count(*) FILTER (WHERE publishable) >= 2 THEN round(max(tpr) - min(tpr), 6) END AS tpr_gap, CASE WHEN count(*) FILTER (WHERE publishable) >= 2 THEN round(max(fpr) - min(fpr), 6) END AS fpr_gap,
  CASE WHEN count(*) FILTER (WHERE publishable) >= 2 THEN round(min(review_rate) / nullif(max(review_rate), 0), 6) END AS review_rate_ratio FROM groups GROUP BY 1)"""


def _parity(spark, sf):
    a = applications(spark, sf).select("challenger", "label", "segment", F.col("nation").cast("string").alias("nation"))
    return metrics.segment_parity(a, ["segment", "nation"], 0.05, "challenger")


@query(f"WITH {_parity_sql()} SELECT * FROM groups")
def segment_parity(spark, sf):
    return _parity(spark, sf)


#: Groups of a segmentation from its values: bands of five nations (the last ones stay out), bands of fifty of the incumbent score.
BANDS = {"nation": lambda c: F.when(c < 20, F.floor(c / 5)), "incumbent_score": lambda c: F.when(c < 0, "below 0").when(c < 50, "0 to 49").otherwise("50 and more")}


@query("WITH " + _parity_sql("""SELECT 'nation' AS segment, CAST(nation // 5 AS VARCHAR) AS grp, challenger AS p, label, challenger >= cut AS hit FROM apps, cut WHERE nation < 20
  UNION ALL SELECT 'incumbent_score', CASE WHEN incumbent_score < 0 THEN 'below 0' WHEN incumbent_score < 50 THEN '0 to 49' ELSE '50 and more' END, challenger, label, challenger >= cut FROM apps, cut""") + " SELECT * FROM groups")
def segment_parity_bands(spark, sf):
    """Parity over groups that functions of the columns give."""
    a = applications(spark, sf).select("challenger", "label", "nation", "incumbent_score")
    return metrics.segment_parity(a, list(BANDS), 0.05, "challenger", transform=BANDS)


@query(f"""WITH {_parity_sql()} SELECT *, concat_ws('; ', CASE WHEN tpr_gap > 1e-1 THEN segment || ' TPR exceeds 0.10' END, CASE WHEN fpr_gap > 1e-1 THEN segment || ' FPR exceeds 0.10' END,
  CASE WHEN NOT review_rate_ratio BETWEEN 8e-1 AND 125e-2 THEN segment || ' review-rate ratio is outside 0.80-1.25' END) AS reasons FROM gaps""")
def fairness_review(spark, sf):
    return metrics.fairness_reasons(metrics.parity_gaps(_parity(spark, sf)))


@query(f"""WITH {_parity_sql()}, x AS (SELECT segment, min(review_rate) / nullif(max(review_rate), 0) AS rr, min(positives / CAST(rows AS DOUBLE)) / nullif(max(positives / CAST(rows AS DOUBLE)), 0) AS pr FROM groups WHERE publishable GROUP BY 1)
SELECT segment, round(rr / nullif(pr, 0), 6) AS adjusted_ratio FROM x""")
def prevalence_adjusted_ratio(spark, sf):
    g = _parity(spark, sf).where("publishable").withColumn("prevalence", F.col("positives") / F.col("rows"))
    spread = lambda c: ratio(F.min(c), F.max(c))
    return g.groupBy("segment").agg(F.round(ratio(spread("review_rate"), spread("prevalence")), 6).alias("adjusted_ratio"))


@query(f"""WITH {SCORED_SQL}, c AS (SELECT model, quantile_cont(score, CAST(1 AS DOUBLE) - 5e-2) AS cut FROM scored GROUP BY 1), e AS (SELECT s.model, channel, score, CASE WHEN score >= cut AND label = 0 THEN 'false_positive' WHEN score < cut AND label = 1 THEN 'false_negative' END AS cohort FROM scored s JOIN c USING (model)),
g AS (SELECT model, cohort, channel, count(*) AS rows FROM e WHERE cohort IS NOT NULL GROUP BY ALL), m AS (SELECT model, cohort, median(score) AS median_score FROM e WHERE cohort IS NOT NULL GROUP BY ALL)
SELECT g.model, g.cohort, channel, rows, round(rows / CAST(sum(rows) OVER (PARTITION BY g.model, g.cohort) AS DOUBLE), 6) AS share, round(median_score, 6) AS median_score FROM g JOIN m ON g.model = m.model AND g.cohort = m.cohort""")
def error_cohorts(spark, sf):
    from pyspark.sql import Window

    from ..operators.queue import threshold_cut

    t = threshold_cut(_scored(spark, sf, "channel"), BY, 0.05)
    hit = F.col("action") == "manual_review"
    e = t.withColumn("cohort", F.when(hit & (F.col("label") == 0), "false_positive").when(~hit & (F.col("label") == 1), "false_negative")).where("cohort is not null")
    g = e.groupBy("model", "cohort", "channel").agg(F.count("*").alias("rows"))
    m = e.groupBy("model", "cohort").agg(F.round(F.median("score"), 6).alias("median_score"))
    share = F.round(F.col("rows") / F.sum("rows").over(Window.partitionBy("model", "cohort")), 6)
    return g.withColumn("share", share).join(m, ["model", "cohort"])


@query(f"""WITH {APPS_SQL} SELECT channel, round(stddev_pop(challenger), 6) AS sd_pop, round(stddev_samp(challenger), 6) AS sd_samp, round(median(challenger), 6) AS median, round(quantile_cont(challenger, 95e-2), 6) AS p95,
  arg_max(segment, pos) AS last_segment, count(DISTINCT segment) AS segments FROM apps GROUP BY 1""")
def distribution_summary(spark, sf):
    return applications(spark, sf).groupBy("channel").agg(
        F.round(F.stddev_pop("challenger"), 6).alias("sd_pop"),
        F.round(F.stddev_samp("challenger"), 6).alias("sd_samp"),
        F.round(F.median("challenger"), 6).alias("median"),
        F.round(F.percentile("challenger", 0.95), 6).alias("p95"),
        F.max_by("segment", "pos").alias("last_segment"),
        F.countDistinct("segment").alias("segments"),
    )


@query(f"""WITH {APPS_SQL}, g AS (SELECT segment, channel, count(*) AS n FROM apps WHERE label = 1 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY n DESC, channel) AS k FROM g)
SELECT segment, channel AS top_channel, n FROM r WHERE k = 1""")
def majority_channel(spark, sf):
    """Most frequent value with a deterministic tie, as one aggregation."""
    g = applications(spark, sf).where("label = 1").groupBy("segment", "channel").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("channel").alias("c")))
    return g.groupBy("segment").agg(best.alias("b")).select("segment", F.col("b.c").alias("top_channel"), (-F.col("b.m")).alias("n"))

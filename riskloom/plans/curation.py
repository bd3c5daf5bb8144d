"""Queries on curation and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curate
from ..sources.tables import APPS_SQL, FEATURES_SQL, applications, features, table
from .registry import query


@query(f"WITH {APPS_SQL} SELECT pos, application_id, custkey, period, channel, segment, nation, order_date, incumbent_score, round(incumbent, 9) AS incumbent, round(challenger, 9) AS challenger, label FROM apps")
def apps_base(spark, sf):
    return applications(spark, sf).withColumns({c: F.round(c, 9) for c in ("incumbent", "challenger")})


@query(f"""WITH {FEATURES_SQL}
SELECT pos, CASE WHEN lines_coded <> -1 THEN CAST(lines_coded AS DOUBLE) END AS lines_coded, CAST(lines_coded = -1 AS INTEGER) AS lines_coded__missing,
  CASE WHEN gap_days >= 0 THEN CAST(gap_days AS DOUBLE) END AS gap_days, CAST(gap_days < 0 AS INTEGER) AS gap_days__missing FROM feats""")
def curate_sentinels(spark, sf):
    f = features(spark, sf, applications(spark, sf)).select("pos", "lines_coded", "gap_days")
    return curate.sentinels(f, equal=["lines_coded"], negative=["gap_days"])


@query(f"""WITH {APPS_SQL}, a AS (
  SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT pos) AS DOUBLE) AS ids, CAST(sum(CASE WHEN label NOT IN (0, 1) THEN 1 ELSE 0 END) AS DOUBLE) AS bad,
    CAST(count(DISTINCT period) AS DOUBLE) AS periods, CAST(max(period) AS DOUBLE) AS top, round(avg(label), 6) AS prevalence FROM apps)
SELECT 'rows' AS "check", n AS observed, CASE WHEN n > 0 THEN 'pass' ELSE 'fail' END AS status FROM a
UNION ALL SELECT 'unique_ids', ids, CASE WHEN ids = n THEN 'pass' ELSE 'fail' END FROM a
UNION ALL SELECT 'binary_target', bad, CASE WHEN bad = 0 THEN 'pass' ELSE 'fail' END FROM a
UNION ALL SELECT 'periods', periods, CASE WHEN periods = 8 AND top = 7 THEN 'pass' ELSE 'fail' END FROM a
UNION ALL SELECT 'prevalence', prevalence, CASE WHEN prevalence BETWEEN 5e-3 AND 3e-2 THEN 'pass' ELSE 'fail' END FROM a""")
def validate_source(spark, sf):
    n = F.count("*")
    return curate.checks(
        applications(spark, sf),
        {
            "rows": (n, n > 0),
            "unique_ids": (F.countDistinct("pos"), F.countDistinct("pos") == n),
            "binary_target": (F.count_if(~F.col("label").isin(0, 1)), F.count_if(~F.col("label").isin(0, 1)) == 0),
            "periods": (F.countDistinct("period"), (F.countDistinct("period") == 8) & (F.max("period") == 7)),
            "prevalence": (F.round(F.avg("label"), 6), F.round(F.avg("label"), 6).between(0.005, 0.03)),
        },
    )


@query("""SELECT 'lineitem_order' AS rule, count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'order_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lineitem_key', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'order_key', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)""")
def constraint_violations(spark, sf):
    lines, orders = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber"), table(spark, sf, "orders", "o_orderkey", "o_custkey")
    customer = table(spark, sf, "customer", "c_custkey")
    parts = {
        "lineitem_order": curate.orphans(lines, "l_orderkey", orders, "o_orderkey"),
        "order_customer": curate.orphans(orders, "o_custkey", customer, "c_custkey"),
        "lineitem_key": curate.duplicate_keys(lines, "l_orderkey", "l_linenumber"),
        "order_key": curate.duplicate_keys(orders, "o_orderkey"),
    }
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT o_orderkey AS pos, substr(sha256('v1|orders|' || CAST(o_orderkey AS VARCHAR)), 1, 32) AS application_id FROM orders")
def stable_ids(spark, sf):
    from ..sources.tables import stable_id

    return table(spark, sf, "orders", "o_orderkey").select(F.col("o_orderkey").alias("pos"), stable_id("v1", "orders", "o_orderkey").alias("application_id"))


@query(f"WITH {APPS_SQL} SELECT period, count(*) AS applications, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS prevalence, count(DISTINCT custkey) AS customers FROM apps GROUP BY 1")
def period_counts(spark, sf):
    return applications(spark, sf).groupBy("period").agg(F.count("*").alias("applications"), F.sum("label").alias("positives"), F.round(F.avg("label"), 6).alias("prevalence"), F.countDistinct("custkey").alias("customers"))


@query(f"""WITH {APPS_SQL}
SELECT pos, CASE channel WHEN '1-URGENT' THEN 'Urgent' WHEN '5-LOW' THEN 'Low' ELSE channel END AS channel_name,
  CASE WHEN challenger <= 3e-1 THEN '(-0.01, 0.3]' WHEN challenger <= 6e-1 THEN '(0.3, 0.6]' WHEN challenger <= 8e-1 THEN '(0.6, 0.8]' ELSE '(0.8, 1.01]' END AS band,
  CAST(year(order_date) * 10000 + month(order_date) * 100 + 1 AS INTEGER) AS date_key, make_date(2025 + period // 12, 1 + period % 12, 1) AS period_date FROM apps""")
def label_bands_dates(spark, sf):
    from ..functions.scalars import right_closed_bin

    a = applications(spark, sf)
    band = F.element_at(F.array(*map(F.lit, ("(-0.01, 0.3]", "(0.3, 0.6]", "(0.6, 0.8]", "(0.8, 1.01]"))), right_closed_bin(F.col("challenger"), [0.3, 0.6, 0.8]) + 1)
    return a.select(
        "pos",
        curate.label_map("channel", {"1-URGENT": "Urgent", "5-LOW": "Low"}).alias("channel_name"),
        band.alias("band"),
        (F.date_format("order_date", "yyyyMM").cast("int") * 100 + 1).alias("date_key"),
        F.add_months(F.lit("2025-01-01").cast("date"), F.col("period")).alias("period_date"),
    )


@query("""SELECT event_id, '{"event_type":"' || event_type || '","user_id":' || CAST(user_id AS VARCHAR) || ',"gone":null}' AS packed, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_features(spark, sf):
    e = table(spark, sf, "events", "event_id", "event_type", "user_id", "props").withColumn("gone", F.lit(None).cast("string"))
    return e.select("event_id", curate.json_pack(e, ["event_type", "user_id", "gone"]).alias("packed"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""WITH f AS (SELECT o_orderpriority AS source, count(*) AS found FROM orders GROUP BY 1), x AS (
  SELECT DISTINCT o_orderpriority AS source, CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(1 AS BIGINT) ELSE (SELECT count(*) FROM orders o WHERE o.o_orderpriority = orders.o_orderpriority) END AS expected FROM orders UNION ALL SELECT '9-NEVER', 10)
SELECT x.source, expected, coalesce(found, 0) AS found, CASE WHEN coalesce(found, 0) = 0 THEN 'absent' WHEN found = expected THEN 'complete' ELSE 'torn' END AS state FROM x LEFT JOIN f ON f.source = x.source""")
def load_guard(spark, sf):
    orders = table(spark, sf, "orders", "o_orderpriority").withColumnRenamed("o_orderpriority", "source")
    counts = orders.groupBy("source").agg(F.count("*").alias("n"))
    expected = counts.select("source", F.when(F.col("source") == "1-URGENT", F.lit(1)).otherwise(F.col("n")).cast("long").alias("expected"))
    expected = expected.unionByName(spark.createDataFrame([("9-NEVER", 10)], "source string, expected long"))
    return curate.load_guard(orders, expected)


@query("""WITH o AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, 0e0 AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE k NOT IN (SELECT k FROM n)""")
def upsert_rows(spark, sf):
    c = table(spark, sf, "customer", "c_custkey", "c_acctbal").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return curate.upsert(c.where("k % 3 <> 0"), c.where("k % 2 = 0").withColumn("v", F.lit(0.0)), ["k"])


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 45), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_discount > 9e-2)
SELECT 'union' AS op, count(*) AS rows, CAST(sum(k) AS BIGINT) AS keys FROM (SELECT k FROM a UNION SELECT k FROM b)
UNION ALL SELECT 'intersect', count(*), CAST(coalesce(sum(k), 0) AS BIGINT) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'except', count(*), CAST(coalesce(sum(k), 0) AS BIGINT) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def set_operations(spark, sf):
    lines = table(spark, sf, "lineitem", "l_suppkey", "l_quantity", "l_discount")
    a = lines.where("l_quantity > 45").select(F.col("l_suppkey").alias("k")).distinct()
    b = lines.where("l_discount > 0.09D").select(F.col("l_suppkey").alias("k")).distinct()
    out = None
    for name, df in (("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.exceptAll(b))):
        row = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("keys")).select(F.lit(name).alias("op"), "rows", "keys")
        out = row if out is None else out.unionByName(row)
    return out

"""Readers of the test tables and the adapter that turns them into applications.

An application is an order: its period (ten months each), channel, segment, an integer incumbent score with
many ties, a near-continuous challenger score, a binary label and concentration features. Every reader
projects the columns it needs, so scans stay narrow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import once

#: Capacities at which policies are compared.
CAPACITIES = (0.01, 0.03, 0.05, 0.10)
SENTINEL = -1


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def applications(spark: SparkSession, sf_dir: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """pos, application_id, custkey, period, channel, segment, nation, order_date, incumbent_score, incumbent, challenger, label.

    With ``low`` and ``high`` only those periods (both included): bounds of dates that reach the scan of orders, which a filter
    of the computed period would not. All periods are joined once for queries that share steps (`lineage.sharing`).
    """
    rows = once(("applications", sf_dir), lambda: _joined(spark, sf_dir)) if low is None and high is None else _joined(spark, sf_dir, low, high)
    return rows.select(
        "pos", stable_id("v1", "orders", "pos").alias("application_id"), "custkey", "period", "channel", "segment", "nation", "order_date",
        "incumbent_score", ((F.col("incumbent_score") + 10.5) / 111.0).alias("incumbent"), "challenger", "label",
    )


def _joined(spark: SparkSession, sf_dir: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """applications without the columns that others give."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    if low is not None:
        orders = orders.where(F.col("o_orderdate") >= F.lit(period_start(low)).cast(orders.schema["o_orderdate"].dataType))
    if high is not None:
        orders = orders.where(F.col("o_orderdate") < F.lit(period_start(high + 1)).cast(orders.schema["o_orderdate"].dataType))
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_discount")
    # Only orders with a marked line leave the scan of lines.
    marked = lines.where((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09)).select("l_orderkey").distinct().withColumn("hit", F.lit(1))
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    score = F.floor(F.col("c_acctbal") / 100.0).cast("int")
    return (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .join(marked, orders["o_orderkey"] == marked["l_orderkey"], "left")
        .select(
            F.col("o_orderkey").alias("pos"),
            F.col("o_custkey").alias("custkey"),
            F.floor(month / 10.0).cast("int").alias("period"),
            F.col("o_orderpriority").alias("channel"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").alias("nation"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            score.alias("incumbent_score"),
            (F.col("o_totalprice") / (F.col("o_totalprice") + 150000.0)).alias("challenger"),
            F.coalesce("hit", F.lit(0)).alias("label"),
        )
    )


def period_start(period: int) -> str:
    """The first day of a period of ten months; period 0 begins in January 1995."""
    return f"{1995 + 10 * period // 12}-{10 * period % 12 + 1:02d}-01"


def stable_id(version: str, source: str, key: str):
    """32 hex digits of the SHA-256 of version|source|key."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(version), F.lit(source), F.col(key).cast("string")), 256), 1, 32)


def features(spark: SparkSession, sf_dir: str, apps: DataFrame) -> DataFrame:
    """apps with lines, parts, suppliers, avg_discount (of the order; NULL without lines), orders_of_customer and gap_days (-1: first order)."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_discount")
    by_order = lines.groupBy("l_orderkey").agg(
        F.count("*").alias("lines"),
        F.countDistinct("l_partkey").alias("parts"),
        F.countDistinct("l_suppkey").alias("suppliers"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"),
    )
    customer = Window.partitionBy("custkey")
    gap = F.date_diff("order_date", F.lag("order_date").over(customer.orderBy("order_date", "pos")))
    return (
        apps.withColumn("orders_of_customer", F.count("*").over(customer))
        .withColumn("gap_days", F.coalesce(gap, F.lit(SENTINEL)))
        .join(by_order, apps["pos"] == by_order["l_orderkey"], "left")
        .drop("l_orderkey")
        .withColumn("lines_coded", F.coalesce("lines", F.lit(SENTINEL).cast("long")))
    )


def scored(apps: DataFrame, *keep: str) -> DataFrame:
    """One row for each application and model: (…, model, score)."""
    columns = list(dict.fromkeys(("pos", "period", "label", *keep)))
    return apps.unpivot(columns, ["challenger", "incumbent"], "model", "score")


#: The same as SQL, for the oracle: a WITH list.
APPS_SQL = """marked AS (
  SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 9e-2
), apps AS (
  SELECT o_orderkey AS pos, substr(sha256('v1|orders|' || CAST(o_orderkey AS VARCHAR)), 1, 32) AS application_id, o_custkey AS custkey,
    CAST(floor(((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1) / 1e1) AS INTEGER) AS period,
    o_orderpriority AS channel, c_mktsegment AS segment, c_nationkey AS nation, CAST(o_orderdate AS DATE) AS order_date,
    CAST(floor(c_acctbal / 1e2) AS INTEGER) AS incumbent_score,
    (CAST(floor(c_acctbal / 1e2) AS INTEGER) + 105e-1) / 111e0 AS incumbent,
    o_totalprice / (o_totalprice + 15e4) AS challenger,
    CASE WHEN l_orderkey IS NULL THEN 0 ELSE 1 END AS label
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN marked ON l_orderkey = o_orderkey
)"""
SCORED_SQL = APPS_SQL + """, scored AS (
  SELECT *, 'challenger' AS model, challenger AS score FROM apps UNION ALL SELECT *, 'incumbent', incumbent FROM apps
)"""
FEATURES_SQL = APPS_SQL + """, by_order AS (
  SELECT l_orderkey AS k, count(*) AS lines, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, round(avg(l_discount), 6) AS avg_discount
  FROM lineitem GROUP BY 1
), feats AS (
  SELECT a.*, count(*) OVER (PARTITION BY custkey) AS orders_of_customer,
    CAST(coalesce(date_diff('day', lag(order_date) OVER (PARTITION BY custkey ORDER BY order_date, pos), order_date), -1) AS INTEGER) AS gap_days,
    lines, parts, suppliers, avg_discount, coalesce(lines, -1) AS lines_coded
  FROM apps a LEFT JOIN by_order ON k = pos
)"""

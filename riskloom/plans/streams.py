"""Queries on events: the batch forms; tests hold the streams against them."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import arrivals
from ..streaming import velocity as v
from .registry import query


@query("""WITH w AS (SELECT e.user_id, e.value, time_bucket(INTERVAL 6 HOUR, e.ts) - o.k * INTERVAL 6 HOUR AS window_start FROM events e, (SELECT unnest(range(4)) AS k) o)
SELECT window_start, user_id, count(*) AS events, round(sum(value), 4) AS value FROM w GROUP BY 1, 2""")
def velocity_windows(spark, sf):
    return v.velocity(table(spark, sf, "events", "ts", "user_id", "value"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def daily_arrivals(spark, sf):
    return v.daily_arrivals(table(spark, sf, "events", "ts", "event_type"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS in_6h, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS in_24h FROM events""")
def velocity_ranges(spark, sf):
    """Events of the same user in the 6 and 24 hours up to each event, in whole seconds."""
    e = table(spark, sf, "events", "event_id", "user_id", "ts").withColumn("s", F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col("ts")))
    w = Window.partitionBy("user_id").orderBy("s")
    return e.select("event_id", F.count("*").over(w.rangeBetween(-21600, 0)).alias("in_6h"), F.count("*").over(w.rangeBetween(-86400, 0)).alias("in_24h"))


@query("SELECT user_id, ts AS flagged_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 3")
def third_arrivals(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events", "event_id", "user_id", "ts").withColumn("k", F.row_number().over(w)).where("k = 3").select("user_id", F.col("ts").alias("flagged_at"))


#: An event more than this after the last one of its user begins a new spell.
GAP_HOURS = 12


@query(f"""WITH e AS (SELECT *, CAST(coalesce(ts > lag(ts) OVER w + INTERVAL {GAP_HOURS} HOUR, TRUE) AS INTEGER) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spell FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, spell ORDER BY ts, event_id) AS k FROM s)
SELECT user_id, event_id, ts AS flagged_at FROM k WHERE k = 3""")
def third_arrivals_in_spell(spark, sf):
    """The third event of every spell of a user; the stream of it keeps state for open spells only."""
    e = table(spark, sf, "events", "event_id", "user_id", "ts")
    return arrivals.kth_arrivals(e, "user_id", 3, timedelta(hours=GAP_HOURS))


@query("""SELECT a.user_id, a.event_id AS l, b.event_id AS r, b.ts AS flagged_at FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR AND (a.ts < b.ts OR a.event_id < b.event_id)""")
def pair_arrivals(spark, sf):
    """Pairs of a user's events at most six hours apart, at the time of the later one."""
    return v.pair_arrivals(table(spark, sf, "events", "event_id", "ts", "user_id"), "user_id", "6 HOURS")


@query("""WITH a AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1), o AS (SELECT user_id, min(ts) AS ts FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT a.user_id, a.ts AS applied_at, CAST(o.ts IS NOT NULL AS INTEGER) AS label FROM a LEFT JOIN o ON a.user_id = o.user_id AND o.ts >= a.ts AND o.ts <= a.ts + INTERVAL 5 DAY""")
def matured_labels(spark, sf):
    """The first event of a user as the application, the first purchase within five days as its outcome."""
    e = table(spark, sf, "events", "ts", "user_id", "event_type")
    first = lambda df: df.groupBy("user_id").agg(F.min("ts").alias("ts"))
    return v.matured(first(e), first(e.where("event_type = 'purchase'")), "user_id", "5 DAYS")


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, max(event_id) AS at FROM events GROUP BY 1")
def latest_outcomes(spark, sf):
    e = table(spark, sf, "events", "user_id", "event_id").withColumn("at", F.col("event_id"))
    return v.latest_outcomes(e, "user_id", "at")

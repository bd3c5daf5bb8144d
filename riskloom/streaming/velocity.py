"""Event-time operators that run on batch and on streams alike: velocity windows, arrivals, outcomes, idempotent sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def velocity(events: DataFrame, length: str = "24 hours", slide: str = "6 hours", late: str | None = None) -> DataFrame:
    """Events and value of a user in sliding windows; on a stream, late events are waited for by the watermark."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", length, slide).alias("w"), "user_id").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("window_start"), "user_id", "events", "value")


def daily_arrivals(events: DataFrame, late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("day"), "event_type", "events")


def pair_arrivals(records: DataFrame, key: str, within: str, late: str | None = None) -> DataFrame:
    """(key, l, r, flagged_at): two records of one key at most ``within`` apart, visible when the later one arrives.

    records: event_id, ts and the key. On a stream this is an inner join of the stream with itself; watermarks on both
    sides and the bound in time let old records leave the state.
    """
    sides = []
    for c in "lr":
        side = records.select(F.col("event_id").alias(c), F.col("ts").alias(f"ts_{c}"), F.col(key).alias(f"key_{c}"))
        sides.append(side.withWatermark(f"ts_{c}", late) if late else side)
    on = F.expr(f"key_l = key_r AND ts_r >= ts_l AND ts_r <= ts_l + INTERVAL {within} AND (ts_l < ts_r OR l < r) AND l <> r")
    return sides[0].join(sides[1], on).select(F.col("key_l").alias(key), "l", "r", F.col("ts_r").alias("flagged_at"))


def matured(applications: DataFrame, outcomes: DataFrame, key: str, horizon: str, late: str | None = None) -> DataFrame:
    """Applications (key, ts) with their label once it is final: 1 if an outcome (key, ts) came within the horizon, else 0.

    On a stream an application without an outcome is given out only when the watermark has passed its horizon, so no label
    is taken before it has matured.
    """
    a = applications.select(F.col(key).alias("key_a"), F.col("ts").alias("applied_at"))
    o = outcomes.select(F.col(key).alias("key_o"), F.col("ts").alias("told_at"))
    if late:
        a, o = a.withWatermark("applied_at", late), o.withWatermark("told_at", late)
    on = F.expr(f"key_a = key_o AND told_at >= applied_at AND told_at <= applied_at + INTERVAL {horizon}")
    return a.join(o, on, "left_outer").select(F.col("key_a").alias(key), "applied_at", F.col("told_at").isNotNull().cast("int").alias("label"))


def latest_outcomes(outcomes: DataFrame, key: str, at: str) -> DataFrame:
    """Append-only outcomes: the row that supersedes the others of its key, by time."""
    return outcomes.groupBy(key).agg(F.max_by(F.struct(*outcomes.columns), F.col(at)).alias("r")).select("r.*")


def stream(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """A stream over a folder of Parquet files."""
    r = spark.readStream.schema(schema)
    if files:
        r = r.option("maxFilesPerTrigger", files)
    return r.parquet(path)


def write_once(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A batch is one folder named by its number, overwritten if it runs again: no row is written twice."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()

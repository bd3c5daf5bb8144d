"""The k-th arrival of a key in a spell, on batches and on streams, with keyed state that expires.

A spell of a key is a run of its events, each at most ``gap`` after the one before. A key is flagged once a spell, at the
spell's k-th event by (time, id). Events without key or time take no part; ids break ties of time.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lineage import cut

#: State of a key: events of its open spell (counted up to k) and the time of the last one.
STATE = "n long, last_ long"


def micros(df: DataFrame, at: str) -> Column:
    """Microseconds of a time with or without zone; no zone is applied to the latter."""
    if dict(df.dtypes)[at] == "timestamp":
        return F.unix_micros(at)
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col(at))


def _prepared(events: DataFrame, key: str, at: str, id_: str) -> DataFrame:
    e = events.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    return e.select(F.col(key).alias("key_"), F.col(id_).alias("id_"), F.col(at).alias("at_"), micros(events, at).alias("us_"))


def _spells(e: DataFrame, gap: int, state: DataFrame | None) -> DataFrame:
    """(key_, bucket_, n, before, last_): events of a key in a stretch of time as long as the gap, and those of its spell before.

    Events of one stretch are never a gap apart, so each stretch lies in one spell, and what is ordered are counts of stretches:
    a key with a third of all events is added up before it meets one task. A key's state comes before its stretches.
    """
    of = e.groupBy("key_", F.floor(F.col("us_") / gap).alias("bucket_")).agg(F.count("*").alias("n"), F.min("us_").alias("first_"), F.max("us_").alias("last_"))
    if state is not None:
        of = of.unionByName(state.select("key_", F.lit(None).cast("long").alias("bucket_"), "n", F.col("last_").alias("first_"), "last_"))
    order = Window.partitionBy("key_").orderBy(F.col("bucket_").asc_nulls_first())
    fresh = F.coalesce(F.col("first_") - F.lag("last_").over(order) > gap, F.lit(True)).cast("int")
    x = of.withColumn("fresh_", fresh).withColumn("spell_", F.sum("fresh_").over(order))
    sofar = Window.partitionBy("key_", "spell_").orderBy(F.col("bucket_").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn("before", F.coalesce(F.sum("n").over(sofar), F.lit(0)))


def _flagged(e: DataFrame, spells: DataFrame, kth: int, gap: int) -> DataFrame:
    """The rows of e that are the k-th of their spell; only the first k of a stretch are shuffled."""
    first = Window.partitionBy("key_", "bucket_").orderBy("us_", "id_")
    heads = e.withColumn("bucket_", F.floor(F.col("us_") / gap)).withColumn("nth_", F.row_number().over(first)).where(F.col("nth_") <= kth)
    hit = spells.where((F.col("before") < kth) & (F.col("before") + F.col("n") >= kth) & F.col("bucket_").isNotNull())
    return heads.join(hit.select("key_", "bucket_", (kth - F.col("before")).alias("nth_")), ["key_", "bucket_", "nth_"])


def kth_arrivals(events: DataFrame, key: str, kth: int, gap: timedelta, at: str = "ts", id_: str = "event_id") -> DataFrame:
    """(key, id, flagged_at) of the k-th event of each spell. An empty table gives no rows."""
    us = gap // timedelta(microseconds=1)
    e = _prepared(events, key, at, id_)
    hit = _flagged(e, _spells(e, us, None), kth, us)
    return hit.select(F.col("key_").alias(key), F.col("id_").alias(id_), F.col("at_").alias("flagged_at"))


class ArrivalStream:
    """The same on a stream: batch N reads the state that batch N - 1 wrote and writes its own, so it can run again at any time.

    Events wait until the watermark (the latest time seen less ``late``) has passed them; those that come behind it go to
    ``late``. State is a row for each key with an event in the last ``gap`` before the watermark: flagged keys are a row like
    any other, and both go when their spell has ended. Folders of ``path``: flags, late, and state, of which the last two
    batches are kept. The result equals :func:`kth_arrivals` of the events up to the watermark that came in time.
    """

    def __init__(self, path: str, key: str, kth: int, gap: timedelta, late: timedelta, at: str = "ts", id_: str = "event_id"):
        self.path, self.key, self.kth, self.at, self.id_ = path.rstrip("/"), key, kth, at, id_
        self.gap, self.late = gap // timedelta(microseconds=1), late // timedelta(microseconds=1)

    def start(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(self.step).start()

    def step(self, batch: DataFrame, number: int) -> None:
        spark, here = batch.sparkSession, f"{self.path}/state/batch={number}"
        before = max((n for n in self._batches(spark) if n < number), default=None)
        old = None if before is None else f"{self.path}/state/batch={before}"
        passed, seen = self._mark(spark, old)
        new = _prepared(batch, self.key, self.at, self.id_)
        new.write.mode("overwrite").parquet(f"{here}/new")
        new = spark.read.parquet(f"{here}/new")
        behind = F.lit(False) if passed is None else F.col("us_") <= passed
        self._out(new.where(behind), "late", number)
        pool = new.where(~behind)
        if old is not None:
            pool = pool.unionByName(spark.read.parquet(f"{old}/waiting"))
        latest = new.agg(F.max("us_")).first()[0]
        seen = max((t for t in (seen, latest) if t is not None), default=None)
        mark = None if seen is None else max(seen - self.late, passed if passed is not None else seen - self.late)
        ripe = F.lit(False) if mark is None else F.col("us_") <= mark
        pool.where(~ripe).write.mode("overwrite").parquet(f"{here}/waiting")
        e = pool.where(ripe)
        spells = cut(_spells(e, self.gap, None if old is None else spark.read.parquet(f"{old}/open")))
        self._out(_flagged(e, spells, self.kth, self.gap), "flags", number)
        total = F.least(F.col("before") + F.col("n"), F.lit(self.kth))
        latest_of = spells.groupBy("key_").agg(F.max_by(F.struct(total.cast("long").alias("n"), F.col("last_")), F.coalesce("bucket_", F.lit(-(2**63)))).alias("s"))
        alive = latest_of.select("key_", "s.n", "s.last_")
        if mark is not None:  # later events lie behind the mark: whatever ended a gap before it has ended for good
            alive = alive.where(F.col("last_") > mark - self.gap)
        alive.write.mode("overwrite").parquet(f"{here}/open")
        spark.range(1).select(F.lit(mark).cast("long").alias("mark"), F.lit(seen).cast("long").alias("seen")).coalesce(1).write.mode("overwrite").parquet(f"{here}/mark")
        self._forget(spark, number)

    def flags(self, spark: SparkSession) -> DataFrame:
        f = spark.read.parquet(f"{self.path}/flags")
        return f.select(F.col("key_").alias(self.key), F.col("id_").alias(self.id_), F.col("at_").alias("flagged_at"))

    def _out(self, rows: DataFrame, name: str, number: int) -> None:
        rows.select("key_", "id_", "at_").write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

    def _mark(self, spark: SparkSession, old: str | None) -> tuple[int | None, int | None]:
        if old is None:
            return None, None
        row = spark.read.parquet(f"{old}/mark").first()
        return row["mark"], row["seen"]

    def _fs(self, spark: SparkSession):
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        return root.getFileSystem(spark._jsc.hadoopConfiguration()), root

    def _batches(self, spark: SparkSession) -> list[int]:
        """Batches whose state is whole (the mark is written last)."""
        fs, root = self._fs(spark)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        path = spark._jvm.org.apache.hadoop.fs.Path
        return [int(n.split("=")[1]) for n in names if n.startswith("batch=") and fs.exists(path(f"{self.path}/state/{n}/mark/_SUCCESS"))]

    def _forget(self, spark: SparkSession, number: int) -> None:
        fs, _ = self._fs(spark)
        for n in self._batches(spark):
            if n < number - 1:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state/batch={n}"), True)

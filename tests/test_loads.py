"""Loads that are whole or nothing, and batches bounded in rows and bytes."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.sources import loads
from riskloom.sources.tables import table

URL, DRIVER = "jdbc:derby:memory:loads;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
TYPES = "run VARCHAR(20), application_id VARCHAR(40)"


@pytest.fixture
def queue(spark):
    """Assignments of a run, and the empty table that takes them."""
    df = spark.range(300).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("application_id"), (F.col("id") + 1).alias("queue_rank"), F.lit("r1").alias("run"))
    df.limit(0).write.jdbc(URL, "queue", mode="overwrite", properties=DRIVER | {"createTableColumnTypes": TYPES})
    return df.repartition(4, "queue_rank")


def stored(spark):
    return sorted((r["run"], r["queue_rank"]) for r in spark.read.jdbc(URL, "queue", properties=DRIVER).collect())


def load(df, run="r1"):
    return loads.load_complete(df, URL, "queue", ["application_id"], ("run", run), types=TYPES, **DRIVER)


def test_complete_loads_are_skipped_and_partial_ones_replaced(spark, queue, monkeypatch):
    assert load(queue) == {"rows": 300, "reused": False}
    assert load(queue.limit(20), "r2") == {"rows": 20, "reused": False}
    monkeypatch.setattr(loads, "stage_rows", None)  # whatever is complete is not even staged
    assert load(queue) == {"rows": 300, "reused": True}
    monkeypatch.undo()
    with loads.connection(spark, URL, DRIVER) as c:
        loads._run(c, 'DELETE FROM queue WHERE "queue_rank" > ? AND "run" = ?', 100, "r1")
    assert load(queue) == {"rows": 300, "reused": False}
    assert [r for r in stored(spark) if r[0] == "r1"] == [("r1", i) for i in range(1, 301)] and len(stored(spark)) == 320


def test_a_task_that_ran_twice_leaves_one_copy(spark, queue, monkeypatch):
    once = loads.stage_rows

    def twice(df, url, stage, *rest):
        once(df, url, stage, *rest)
        df.where(F.spark_partition_id() < 2).write.jdbc(url, stage, mode="append", properties=DRIVER)

    monkeypatch.setattr(loads, "stage_rows", twice)
    assert load(queue)["rows"] == 300 and stored(spark) == [("r1", i) for i in range(1, 301)]


def test_a_failed_load_leaves_the_table_as_it_was(spark, queue, monkeypatch):
    load(queue.where("queue_rank <= 50"))
    before, once = stored(spark), loads.stage_rows
    broken = lambda df, *rest: once(df.withColumn("queue_rank", F.when(F.col("queue_rank") == 200, F.raise_error("lost").cast("long")).otherwise(F.col("queue_rank"))), *rest)
    monkeypatch.setattr(loads, "stage_rows", broken)
    with pytest.raises(Exception, match="lost"):
        load(queue)
    assert stored(spark) == before
    monkeypatch.setattr(loads, "stage_rows", lambda df, *rest: once(df.where("queue_rank <> 7"), *rest))
    with pytest.raises(RuntimeError, match="299 of 300"):
        load(queue)
    assert stored(spark) == before
    monkeypatch.undo()
    assert load(queue)["rows"] == 300 and len(stored(spark)) == 300


def test_keys_must_be_distinct_and_given(spark, queue):
    for extra in ("'a1'", "CAST(NULL AS STRING)"):
        with pytest.raises(ValueError, match="keys"):
            load(queue.unionByName(spark.sql(f"SELECT {extra} AS application_id, 999L AS queue_rank, 'r1' AS run")))
    assert load(queue.limit(0)) == {"rows": 0, "reused": True} and stored(spark) == []


def test_batches_are_bounded_in_rows_and_bytes(spark, sf):
    def size(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes], "columns": [",".join(b.schema.names)]})

    docs = table(spark, sf, "documents")
    out = loads.in_batches(docs, ["doc_id", "text", "doc_id"], size, "rows long, bytes long, columns string", rows=40, size=20_000)
    got = out.collect()
    assert sum(r["rows"] for r in got) == docs.count() and {r["columns"] for r in got} == {"doc_id,text"}
    assert all(r["rows"] <= 40 and (r["bytes"] <= 20_000 or r["rows"] == 1) for r in got) and len(got) > docs.count() // 40
    scan = out._jdf.queryExecution().executedPlan().toString()
    assert "lang" not in scan and "source" not in scan
    assert loads.in_batches(docs.limit(0), ["doc_id"], size, "rows long, bytes long, columns string").count() == 0


def test_pieces_keep_every_row_in_order():
    b = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (1, 5000, 0, 3, 20_000, 2, 2)]})
    parts = list(loads.pieces(b, 3, 6000))
    assert [t for p in parts for t in p.column(0).to_pylist()] == b.column(0).to_pylist()
    assert all(p.num_rows <= 3 and (p.nbytes <= 6000 or p.num_rows == 1) for p in parts)
    assert list(loads.pieces(b.slice(0, 0), 3, 10)) == []

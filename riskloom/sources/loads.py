"""Complete loads into databases through a staging table, and reads of Parquet in bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.lineage import cut


@contextmanager
def connection(spark: SparkSession, url: str, options: dict[str, str]):
    """A JDBC connection of the driver outside auto-commit: rolled back on an error, committed otherwise."""
    jvm = spark.sparkContext._jvm
    props = jvm.java.util.Properties()
    for k, v in options.items():
        props.setProperty(k, v)
    if "driver" in options:  # also of drivers that came with --jars, which the JVM's own list does not see
        c = jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(options["driver"]).newInstance().connect(url, props)
    else:
        c = jvm.java.sql.DriverManager.getConnection(url, props)
    try:
        c.setAutoCommit(False)
        yield c
        c.commit()
    except BaseException:
        c.rollback()
        raise
    finally:
        c.close()


def _run(c, sql: str, *values) -> int:
    """Rows changed, or the number a query gives."""
    s = c.prepareStatement(sql)
    try:
        for i, v in enumerate(values, 1):
            s.setObject(i, v)
        if not s.execute():
            return s.getUpdateCount()
        r = s.getResultSet()
        r.next()
        return r.getLong(1)
    finally:
        s.close()


def stage_rows(df: DataFrame, url: str, stage: str, batch: int, types: str, options: dict[str, str]) -> None:
    """The staging table anew. Each task commits its rows at its end; one that is run again after its commit leaves them twice."""
    given = {"batchsize": str(batch), **options} | ({"createTableColumnTypes": types} if types else {})
    df.write.jdbc(url, stage, mode="overwrite", properties=given)


def load_complete(
    df: DataFrame, url: str, table: str, key: Sequence[str], version: tuple[str, object], batch: int = 50_000, types: str = "", **options: str
) -> dict[str, object]:
    """Put all rows of one version (a run, a model version) into ``table``, whole or not at all: {rows, reused}.

    Rows need a key that is distinct and not NULL (else an error before anything is written). A version of which the table
    has as many rows as df is left alone; one that is partly there is replaced. Rows go to ``{table}_stage`` in parallel, from
    a written copy, so that a task's second attempt writes the very same rows; then one transaction deletes the version, inserts
    the distinct staged rows and counts them. ``types`` gives column types of the staging table that DISTINCT can compare, where a
    database makes large objects of strings. Two loads of one table must not run at the same time.
    """
    spark = df.sparkSession
    column, value = version
    df = cut(df.withColumn(column, F.lit(value).cast(df.schema[column].dataType) if column in df.columns else F.lit(value)))
    whole = F.struct(*key)
    rows, keys, nulls = df.agg(F.count("*"), F.count_distinct(whole), F.count_if(F.greatest(*(F.col(k).isNull() for k in key)) if len(key) > 1 else F.col(key[0]).isNull())).first()
    if keys != rows or nulls:
        raise ValueError(f"{rows} rows have {keys} keys, {nulls} of them NULL in part")
    with connection(spark, url, options) as c:
        q = c.getMetaData().getIdentifierQuoteString().strip()
        named = lambda n: f"{q}{n}{q}"
        if _run(c, f"SELECT count(*) FROM {table} WHERE {named(column)} = ?", value) == rows:
            return {"rows": rows, "reused": True}
    stage = f"{table}_stage"
    stage_rows(df, url, stage, batch, types, options)
    listed = ", ".join(map(named, df.columns))
    with connection(spark, url, options) as c:
        _run(c, f"DELETE FROM {table} WHERE {named(column)} = ?", value)
        put = _run(c, f"INSERT INTO {table} ({listed}) SELECT DISTINCT {listed} FROM {stage}")
        if put != rows:
            raise RuntimeError(f"{put} of {rows} rows of {value} were staged")
        _run(c, f"DROP TABLE {stage}")
    return {"rows": rows, "reused": False}


def pieces(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many rows and bytes; a row that is larger than the bound by itself is a slice of its own."""
    todo = [(0, batch.num_rows)]
    while todo:
        at, n = todo.pop()
        part = batch.slice(at, n)
        if n > rows or n > 1 and part.nbytes > size:
            half = min(rows, n // 2) or 1
            todo += [(at + half, n - half), (at, half)]
        elif n:
            yield part


def in_batches(df: DataFrame, columns: Sequence[str], f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str, rows: int = 50_000, size: int = 64 << 20) -> DataFrame:
    """f over df's rows in batches of at most ``rows`` rows and ``size`` bytes of the named columns; no other column is read.

    Batches lie within partitions, in their order; their borders say nothing. Repeated names count once, an empty table calls f for nothing.
    The engine hands over batches by its own bounds (spark.sql.execution.arrow.maxRecordsPerBatch and maxBytesPerBatch); f sees the smaller of both.
    """

    def over(batches):
        for b in batches:
            for p in pieces(b, rows, size):
                yield f(p)

    return df.select(*dict.fromkeys(columns)).mapInArrow(over, schema)

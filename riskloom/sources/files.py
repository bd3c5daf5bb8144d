"""File sources and sinks: pinned CSV, Parquet, JSON, JDBC; writers with read-back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def csv_header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The columns of the header line; nothing else is read."""
    first = spark.read.text(path).first()
    return first[0].split(sep) if first else []


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV whose header must be the schema's columns in order; a malformed row fails the read."""
    found = csv_header(spark, path)
    if found != schema.fieldNames():
        raise ValueError(f"columns {found} are not {schema.fieldNames()}")
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST")


def read_json(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A JSON document for each file."""
    r = spark.read.schema(schema) if schema else spark.read
    return r.json(path, multiLine=True)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], parts: int, **options: str) -> DataFrame:
    """A database table in ranges of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=options)


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 50_000, **options: str) -> None:
    df.write.jdbc(url, table, mode="append", properties={"batchsize": str(batch), **options})


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Only the partitions that df has are replaced (delete and reload by key)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> int:
    """Rows written, as the files have them."""
    df.write.mode("overwrite").csv(path, header=True)
    return df.sparkSession.read.csv(path, header=True, schema=df.schema).count()


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, keys in order, NULLs kept."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_back(before: DataFrame, after: DataFrame, key: str, total: str) -> DataFrame:
    """(check, before, after, status) of row count, distinct keys and a total."""
    both = None
    for df, side in ((before, "before"), (after, "after")):
        one = df.agg(F.count("*").cast("double").alias("rows"), F.countDistinct(key).cast("double").alias("keys"), F.sum(total).cast("double").alias("total"))
        long = one.select(F.expr("stack(3, 'rows', rows, 'keys', keys, 'total', total) as (check, value)")).withColumnRenamed("value", side)
        both = long if both is None else both.join(long, "check")
    return both.withColumn("status", F.when(F.col("before").eqNullSafe(F.col("after")), "pass").otherwise("fail"))


def migrate(spark: SparkSession, registry: DataFrame | None, scripts: Sequence[tuple[str, str]]) -> DataFrame:
    """Apply SQL scripts in order, each once; a script that changed since is an error. Returns the registry (name, sha256)."""
    import hashlib

    done = {r["name"]: r["sha256"] for r in registry.collect()} if registry is not None else {}
    for name, text in scripts:
        digest = hashlib.sha256(text.encode()).hexdigest()
        if name in done:
            if done[name] != digest:
                raise ValueError(f"{name} has changed since it was applied")
            continue
        for statement in filter(None, map(str.strip, text.split(";"))):
            spark.sql(statement)
        done[name] = digest
    return spark.createDataFrame(sorted(done.items()), "name string, sha256 string")

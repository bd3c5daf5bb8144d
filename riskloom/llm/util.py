"""Shared folder, lineage cuts and Arrow helpers used by the operators of this subpackage."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


#: Most rows and bytes of an Arrow batch between the JVM and Python; operators here lower the session's settings to them.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent and the session has one machine (tests) a temporary folder is made and removed at
    exit; a cluster without the setting is an error, since executors would not see each other's files.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = tempfile.mkdtemp(prefix="riskloom-")
        atexit.register(shutil.rmtree, shared_dir.own, ignore_errors=True)
    return f"file://{shared_dir.own}"


def filesystem(uri: str):
    """(file system, path) of pyarrow for a URI."""
    from pyarrow import fs

    if "://" in uri and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    path = unquote(urlparse(uri).path) if uri.startswith("file:") else uri
    return fs.LocalFileSystem(), path


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once a session, so that no machine needs it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_riskloom_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="riskloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/riskloom.zip", "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(f"{folder}/riskloom.zip")
    sc._riskloom_shipped = True


class Scratch:
    """Written tables in the shared folder: each cuts the lineage, so a lost executor costs one stage at most."""

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:02d}-{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it back."""
        schema, path = df.schema, self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete written tables that nothing later reads, and let go of the shuffle files of the writes that are done."""
        for df in dfs:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        # The engine removes shuffle files when their plans are collected on the driver, which else may be long after.
        gc.collect()
        self.spark._jvm.System.gc()


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str | StructType) -> DataFrame:
    """mapInArrow where ``make()`` runs once in each task and its result turns a batch into columns by name."""
    ship(df.sparkSession)
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                got = step(batch)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([as_array(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def small_batches(spark: SparkSession) -> None:
    """Whole texts are large: small batches keep the JVM's and the worker's buffers small, by rows and by bytes."""
    for key, most in ((_ROWS, BATCH_ROWS), (_BYTES, BATCH_BYTES)):
        if int(spark.conf.get(key).removesuffix("b")) > most:
            spark.conf.set(key, str(most))


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column in ``taken`` is called that (case apart)."""
    low = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def pieces_of(total: int, size: int) -> Iterator[tuple[int, int]]:
    for start in range(0, total, size):
        yield start, min(total, start + size)

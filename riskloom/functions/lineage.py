"""Cuts of long lineages for iterative operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_KEPT: ContextVar[dict | None] = ContextVar("kept", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder (spark.checkpoint.dir); a temporary one where none is set and there is one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not found:
            found = tempfile.mkdtemp(prefix="riskloom-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the session's shared folder (spark.checkpoint.dir), which survives lost executors.

    Only where no folder is set and there is one machine, a temporary one is made and removed at exit; a cluster without
    the setting is an error.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet into the session's shared folder and read back: for rows that many jobs read, each a few columns or rows of them."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sharing(f: Callable) -> Callable:
    """f, in whose call (and all calls below it) steps given to `once` are stored once: for queries made of queries that read the same rows."""

    @wraps(f)
    def shared(*args, **kwargs):
        if _KEPT.get() is not None:
            return f(*args, **kwargs)
        token = _KEPT.set({})
        try:
            return f(*args, **kwargs)
        finally:
            _KEPT.reset(token)

    return shared


def once(key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """What make gives; inside `sharing` stored under the key (a name and what it is made from) and read again by all that ask for it."""
    kept = _KEPT.get()
    if kept is None:
        return make()
    if key not in kept:
        kept[key] = stored(make())
    return kept[key]

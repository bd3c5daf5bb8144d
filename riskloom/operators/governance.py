"""Model registry and audit events: tables that runs write again and again without doubling rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import uuid5
from .curate import upsert

#: What a later registration of a model version replaces; the rest stays as first written.
REPLACED = ("approval_state", "manifest", "artifact_hash", "code_sha")


def register(registry: DataFrame, models: DataFrame, replaced: Sequence[str] = REPLACED) -> DataFrame:
    """The registry with the models put in by model_version: new ones as they come, known ones with the replaced columns only.

    Rows of models without a version are an error of the caller's and are left out; of rows that repeat one, one counts.
    """
    new = models.where(F.col("model_version").isNotNull()).dropDuplicates(["model_version"]).select(*registry.columns)
    old = registry.select("model_version", *(F.struct(c).alias(f"old_{c}") for c in registry.columns if c not in replaced and c != "model_version"))
    kept = new.join(old, "model_version", "left")
    columns = [c if c == "model_version" or c in replaced else F.when(F.col(f"old_{c}").isNotNull(), F.col(f"old_{c}.{c}")).otherwise(F.col(c)).alias(c) for c in registry.columns]
    return upsert(registry, kept.select(*columns), ["model_version"])


def history(registrations: DataFrame, at: str) -> DataFrame:
    """registrations with replaced_by (the next one of the version), current, and changed (the state differs from the one before)."""
    w = Window.partitionBy("model_version").orderBy(at)
    before = F.lag("approval_state").over(w)
    out = registrations.where(F.col("model_version").isNotNull()).withColumn("replaced_by", F.lead(at).over(w))
    return out.withColumn("current", F.col("replaced_by").isNull()).withColumn("changed", F.coalesce(before != F.col("approval_state"), F.lit(False)))


def audit(events: DataFrame, more: DataFrame) -> DataFrame:
    """Append-only events: those whose event_id is there already are left out."""
    return upsert(events, more.dropDuplicates(["event_id"]).select(*events.columns), ["event_id"], update=False)


def event_id(project: str, correlation: Column, code: Column) -> Column:
    """The same event of the same code has the same id in every run."""
    return uuid5(F.concat_ws(":", F.lit(project), correlation, code))

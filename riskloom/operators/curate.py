"""Curation and validation: sentinels, types, stable ids, data-quality checks, constraint checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "__missing__"


def sentinels(df: DataFrame, equal: Sequence[str] = (), negative: Sequence[str] = ()) -> DataFrame:
    """-1 (equal) or any negative value (negative) becomes NULL, with a <column>__missing flag; others are cast to double."""
    cols: dict[str, Column] = {}
    for c in [*equal, *negative]:
        gone = F.col(c) == -1 if c in equal else F.col(c) < 0
        cols[c] = F.when(~gone, F.col(c)).cast("double")
        cols[f"{c}__missing"] = F.coalesce(gone, F.lit(True)).cast("int")
    return df.withColumns(cols)


def model_view(df: DataFrame, features: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """The features alone; NULL in a categorical one is a category of its own."""
    return df.select(*(F.coalesce(F.col(c), F.lit(MISSING)).alias(c) if c in categorical else F.col(c) for c in features))


def label_map(column: str, names: Mapping[str, str]) -> Column:
    """Code to label; an unmapped code stays itself."""
    if not names:
        return F.col(column)
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.col(column)], F.col(column))


def json_pack(df: DataFrame, columns: Sequence[str]) -> Column:
    """A JSON object of the columns that keeps NULLs."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def checks(df: DataFrame, rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """(check, observed, status) of aggregate checks, name: (observed value, passes), in one pass."""
    got = df.agg(*(v.cast("double").alias(f"v{i}") for i, (v, _) in enumerate(rules.values())), *(F.coalesce(ok, F.lit(False)).alias(f"ok{i}") for i, (_, ok) in enumerate(rules.values())))
    stacked = ", ".join(f"'{name}', v{i}, case when ok{i} then 'pass' else 'fail' end" for i, name in enumerate(rules))
    return got.select(F.expr(f"stack({len(rules)}, {stacked}) as (check, observed, status)"))


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that break a primary key, with their counts."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows that break a foreign key."""
    return df.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join on a key that must be unique on both sides and lose no row; else ValueError."""
    for side in (left, right):
        if not duplicate_keys(side, key).isEmpty():
            raise ValueError(f"{key} is not unique")
    if not left.join(right.select(key), key, "left_anti").isEmpty() or not right.join(left.select(key), key, "left_anti").isEmpty():
        raise ValueError("rows without a partner")
    return left.join(right, key)


def load_guard(df: DataFrame, expected: DataFrame, source: str = "source") -> DataFrame:
    """Per expected source: rows found and absent, complete or torn."""
    found = df.groupBy(source).agg(F.count("*").alias("found"))
    state = F.when(F.coalesce("found", F.lit(0)) == 0, "absent").when(F.col("found") == F.col("expected"), "complete").otherwise("torn")
    return expected.join(found, source, "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long"))).withColumn("state", state)


def validate_scores(df: DataFrame, score: str, capacity: float) -> None:
    """Scores must be there, finite and in [0, 1]; the capacity in (0, 1]. Else ValueError."""
    if not 0 < capacity <= 1:
        raise ValueError("capacity must be in (0, 1]")
    n, bad = df.agg(F.count("*"), F.count_if(F.col(score).isNull() | F.isnan(score) | ~F.col(score).between(0, 1))).first()
    if not n or bad:
        raise ValueError("scores must be non-empty, finite and in [0, 1]")


def valid_recommendation(overflow: Column, reasons: Column) -> Column:
    """Overflow without a refusal reason is invalid."""
    return ~((overflow > 0) & (F.size(reasons) <= 0))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], update: bool = True) -> DataFrame:
    """Rows of old with those of new put in: replaced by key, or only added where update is false."""
    if update:
        return new.unionByName(old.join(new.select(*key), list(key), "left_anti"))
    return old.unionByName(new.join(old.select(*key), list(key), "left_anti"))

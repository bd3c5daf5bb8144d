"""Contracts of records as data: rules over columns, all evaluated in one pass, each broken one a row.

A rule names a field, what is asked of it, and a Column that says whether the value is fine. NULL is broken where the field is
required and fine where it isn't. Rows keep the rules that they break; no row is dropped or repaired here.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``fine`` is true for values that keep the rule; ``shown`` is what a violation reports."""

    name: str
    fine: Column
    shown: Column


def required(field: str) -> Rule:
    return Rule(f"{field} is required", F.col(field).isNotNull(), F.lit("NULL"))


def text(field: str, shortest: int = 1, longest: int | None = None) -> Rule:
    n = F.length(field)
    fine = (n >= shortest) & (n <= longest if longest is not None else F.lit(True))
    return Rule(f"{field} has {shortest} to {longest} characters" if longest is not None else f"{field} has {shortest} characters or more", _or_null(field, fine), F.col(field))


def between(field: str, low: float | None = None, high: float | None = None, above: bool = False) -> Rule:
    """Low and high belong to the range, but for low where ``above``. NaN is outside."""
    c = F.col(field)
    fine = ~F.isnan(c.cast("double"))
    if low is not None:
        fine = fine & (c > low if above else c >= low)
    if high is not None:
        fine = fine & (c <= high)
    span = f"{'(' if above else '['}{'' if low is None else f'{low:g}'}, {'' if high is None else f'{high:g}'}]"
    return Rule(f"{field} in {span}", _or_null(field, fine), c.cast("string"))


def one_of(field: str, values: Sequence[str]) -> Rule:
    return Rule(f"{field} is one of {', '.join(values)}", _or_null(field, F.col(field).isin(list(values))), F.col(field).cast("string"))


def holds(name: str, fine: Column, shown: Column) -> Rule:
    """A rule over several fields; NULL counts as broken."""
    return Rule(name, F.coalesce(fine, F.lit(False)), shown.cast("string"))


def _or_null(field: str, fine: Column) -> Column:
    return F.col(field).isNull() | fine


def forbidden(df: DataFrame, fields: Sequence[str]) -> list[str]:
    """Columns that the contract doesn't know, and (with a minus) fields that aren't there."""
    known = {f.lower() for f in fields}
    there = {c.lower() for c in df.columns}
    return [c for c in df.columns if c.lower() not in known] + [f"-{f}" for f in fields if f.lower() not in there]


def violations(df: DataFrame, key: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """key…, rule, value: a row for each rule that a row of df breaks."""
    broken = F.array(*(F.when(~F.coalesce(r.fine, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), r.shown.cast("string").alias("value"))) for r in rules))
    return df.select(*key, F.explode(F.filter(broken, lambda b: b.isNotNull())).alias("b_")).select(*key, "b_.rule", "b_.value")


def summary(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule, rows, broken, least and greatest value of the broken ones (as text): every rule, also those that none breaks."""
    names = df.sparkSession.createDataFrame([(r.name,) for r in rules], "rule string")
    one = df.withColumn("row_", F.lit(1))
    counts = violations(one, ["row_"], rules).groupBy("rule").agg(F.count("*").alias("broken"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    rows = df.agg(F.count("*").alias("rows"))
    return names.join(F.broadcast(counts), "rule", "left").crossJoin(F.broadcast(rows)).select("rule", "rows", F.coalesce("broken", F.lit(0).cast("long")).alias("broken"), "least", "greatest")


def application_rules(sources: Sequence[str], last_period: int = 7) -> list[Rule]:
    """An application as it is taken in."""
    return [required("dataset_version"), required("application_id"), text("application_id"), required("period"), between("period", 0, last_period), required("channel"), required("evidence_source"), one_of("evidence_source", sources)]


def score_rules(sources: Sequence[str], bands: Sequence[str] = ("low", "medium", "high", "critical")) -> list[Rule]:
    """A score as it is given out."""
    return [
        required("application_id"), required("model_version"), required("calibrated_fraud_probability"), between("calibrated_fraud_probability", 0, 1), required("risk_band"), one_of("risk_band", bands),
        required("reason_codes"), required("artifact_hash"), required("evidence_source"), one_of("evidence_source", sources),
    ]


def link_rules(sources: Sequence[str]) -> list[Rule]:
    """A link flag."""
    return [required("application_id"), required("cluster_id"), required("match_strength"), between("match_strength", 0, 1), required("cluster_risk"), between("cluster_risk", 0, 1), required("signal_types"), one_of("evidence_source", sources)]


def request_rules() -> list[Rule]:
    """A strategy that is asked for."""
    return [
        required("model_version"), required("policy_version"), required("score_cut"), between("score_cut", 0, 1), required("review_capacity"), between("review_capacity", 0, 1, above=True),
        required("fraud_exposure"), between("fraud_exposure", 0), required("review_cost"), between("review_cost", 0), required("friction_cost"), between("friction_cost", 0), required("idempotency_key"), text("idempotency_key", 8, 128),
    ]


def result_rules() -> list[Rule]:
    """What a strategy gives."""
    rates = [r for f in ("catch_rate", "false_positive_rate", "review_rate") for r in (required(f), between(f, 0, 1))]
    counts = [r for f in ("queue_size", "overflow") for r in (required(f), between(f, 0))]
    bounded = holds("capacity overflow has a refusal reason", (F.col("overflow") <= 0) | (F.size("refusal_reasons") > 0), F.col("overflow"))
    return [required("model_version"), required("policy_version"), *rates, *counts, required("recommendation"), required("refusal_reasons"), bounded]

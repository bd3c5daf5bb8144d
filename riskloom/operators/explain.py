"""Contributions of features to boosted trees: path-dependent Shapley values, exact for every row.

A tree's value of a set of features is its expectation when those are known and the others follow the rows
that the nodes were fitted on. A leaf's part of it is a product over the features on its path, so Shapley values of a
leaf come from small polynomials: a feature that the row satisfies has factor 1, one that it doesn't 0, and an unknown one
the share of rows that went that way. Contributions and the base add up to the margin (half the log odds) of every row.

Leaves are read from the saved form of the model, which is small whatever the rows; rows are scored where they lie. Values
of a leaf depend only on which of its conditions hold, and each such pattern is worked out once.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_folder

# Executors get these functions by value, so that no machine needs the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Nodes of a model that may be sent to every task (about 200 bytes each).
MOST_NODES = 2_000_000

#: A condition of a leaf: feature, values above, values up to, categories (or None), share of rows that meet it.
Condition = tuple[int, float, float, tuple[float, ...] | None, float]
#: A leaf: weighted value and its conditions, one for each feature on the path.
Leaf = tuple[float, tuple[Condition, ...]]


def leaves_of(nodes: dict[int, tuple], weight: float) -> list[Leaf]:
    """Leaves of one tree from (value, rows, left, right, feature, numbers, categories) by node; left is -1 at a leaf."""
    out: list[Leaf] = []
    stack: list[tuple[int, dict]] = [(0, {})]
    while stack:
        at, path = stack.pop()
        value, rows, left, right, feature, numbers, categories = nodes[at]
        if left < 0:
            out.append((weight * value, tuple((f, *c) for f, c in sorted(path.items()))))
            continue
        low, high, allowed, share = path.get(feature, (-np.inf, np.inf, None, 1.0))
        for child, is_left in ((left, True), (right, False)):
            part = share * (nodes[child][1] / rows if rows else 0.0)
            if categories < 0:
                bound = (low, min(high, numbers[0]), allowed) if is_left else (max(low, numbers[0]), high, allowed)
            else:
                side = set(numbers) if is_left else set(range(categories)) - set(numbers)
                bound = (low, high, tuple(sorted(side if allowed is None else side & set(allowed))))
            stack.append((child, path | {feature: (*bound, part)}))
    return out


def read_leaves(model: PipelineModel) -> list[Leaf]:
    """Leaves of the boosted trees that end a fitted pipeline, each value weighted as its tree."""
    trees, spark = model.stages[-1], SparkSession.active()
    if trees.totalNumNodes > MOST_NODES:
        raise ValueError(f"a model of more than {MOST_NODES} nodes")
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    trees.write().save(path)
    n = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select("treeID", n["id"], n["prediction"], n["impurityStats"][0], n["leftChild"], n["rightChild"], n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"], n["split"]["numCategories"])
    by_tree: dict[int, dict[int, tuple]] = {}
    for tree, at, *rest in rows.collect():
        by_tree.setdefault(tree, {})[at] = tuple(rest)
    return [leaf for tree, nodes in sorted(by_tree.items()) for leaf in leaves_of(nodes, trees.treeWeights[tree])]


def base_value(leaves: Sequence[Leaf]) -> float:
    """The margin when no feature is known."""
    return float(sum(v * np.prod([c[4] for c in conditions]) for v, conditions in leaves))


def _pattern(shares: Sequence[float], holds: Sequence[bool]) -> np.ndarray:
    """Shapley values of the product of factors, for a leaf of value 1."""
    m = len(shares)
    out = np.zeros(m)
    for i in range(m):
        poly = np.array([1.0])  # coefficient of t^k: sets of k known features
        for j in range(m):
            if j != i:
                poly = np.convolve(poly, (shares[j], float(holds[j])))
        out[i] = (float(holds[i]) - shares[i]) * sum(c * factorial(k) * factorial(m - 1 - k) for k, c in enumerate(poly)) / factorial(m)
    return out


class Shapley:
    """Contributions of rows of a matrix; patterns worked out are kept."""

    def __init__(self, leaves: Sequence[Leaf], width: int):
        self.leaves, self.width = leaves, width
        self.held: list[dict[int, np.ndarray]] = [{} for _ in leaves]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        for held, (value, conditions) in zip(self.held, self.leaves, strict=True):
            if not conditions:
                continue
            code = np.zeros(len(x), np.int64)
            for k, (f, low, high, allowed, _) in enumerate(conditions):
                v = x[:, f]
                code |= ((v > low) & (v <= high) if allowed is None else np.isin(v, allowed)).astype(np.int64) << k
            codes, place = np.unique(code, return_inverse=True)
            for c in codes.tolist():
                if c not in held:
                    held[c] = value * _pattern([s[4] for s in conditions], [bool(c >> k & 1) for k in range(len(conditions))])
            table = np.stack([held[c] for c in codes.tolist()])
            out[:, [c[0] for c in conditions]] += table[place]
        return out


def tree_contributions(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep…, base, contributions (one for each entry of the model's feature vector, in margin units) of every row."""
    spark = df.sparkSession
    for stage in model.stages[:-1]:
        df = stage.transform(df)
    leaves = read_leaves(model)
    width, base = model.stages[-1].numFeatures, base_value(leaves)
    sent = spark.sparkContext.broadcast(leaves)
    rows = df.select(*keep, F.lit(base).alias("base"), vector_to_array("features").alias("contributions"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapley = Shapley(sent.value, width)
        for batch in batches:
            x = np.asarray(batch.column(batch.num_columns - 1).flatten()).reshape(-1, width)
            got = pa.ListArray.from_arrays(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32), shapley(x).ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], got], schema=pa.schema([*list(batch.schema)[:-1], pa.field(batch.schema.names[-1], got.type)]))

    return rows.mapInArrow(score, rows.schema)


def tree_reasons(contributions: DataFrame, names: Sequence[str], keep: Sequence[str], top: int = 3) -> DataFrame:
    """keep…, margin and the features that raise it most: positive contributions, the first few, ties in the order of the features."""
    parts = F.transform(F.col("contributions"), lambda v, i: F.struct((-v).alias("v"), i.alias("at")))
    best = F.slice(F.array_sort(F.filter(parts, lambda p: p["v"] < 0)), 1, top)
    label = F.array(*(F.lit(n) for n in names))
    margin = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v)
    return contributions.select(*keep, F.round(margin, 6).alias("margin"), F.array_join(F.transform(best, lambda p: label[p["at"]]), ", ").alias("reasons"))


def tree_importance(contributions: DataFrame, names: Sequence[str], top: int = 15) -> DataFrame:
    """Mean absolute contribution of each feature over all rows, the greatest first."""
    sums = contributions.agg(*(F.avg(F.abs(F.col("contributions")[i])).alias(f"c{i}") for i in range(len(names))))
    rows = ", ".join(f"'{n}', c{i}" for i, n in enumerate(names))
    out = sums.select(F.expr(f"stack({len(names)}, {rows}) as (feature, mean_contribution)"))
    return out.withColumn("mean_contribution", F.round("mean_contribution", 6)).orderBy(F.desc("mean_contribution"), "feature").limit(top)

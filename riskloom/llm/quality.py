"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent space.

A bounded sample of labelled documents (``per_class`` of each label, those of smallest hash) gives the
latent space and its labelled vectors; both are broadcast (at most 2 * per_class * dims floats). Every
document is compared with every labelled vector in exact blocked cosine products; the ``k`` nearest vote
with weight similarity ** power. Labels, language, source and ids are no inputs of a score.

Null or empty text: score 0. No labels at all: score 0.5 for every other text; labels of one class: that
class. Rows of ``labels`` with a null in doc_id or quality are left out, a doc_id that repeats counts with
its smallest label. Documents repeat as they come; null doc_id: held_out is false. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import BUCKETS, DIMS, bag, basis, project, word_slots
from .util import map_arrow

#: Labelled documents taken of each class, at most.
PER_CLASS = 2048
#: Values of a label that are taken as classes; more are an error.
CLASSES = 64
NEIGHBOURS, POWER, THRESHOLD = 16, 8, 0.3


@dataclass
class Model:
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def fold(column: str = "doc_id"):
    """The fold of a row, 0 to 4; fold 0 is held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def sampled_bags(docs: DataFrame, labels: DataFrame, target: str, per_class: int, words: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bags, labels) of at most per_class documents of each value of ``target``, fold 0 left out.

    A doc_id that repeats in the documents counts with its least text. ``words`` gets the word slots of each.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.min(target).alias("y")).where(fold() != 0)
    values = [r[0] for r in known.select("y").distinct().orderBy("y").limit(CLASSES + 1).collect()]
    if len(values) > CLASSES:
        raise ValueError(f"more than {CLASSES} values of {target}: no classes")
    ids = None
    for v in values:
        part = known.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = part if ids is None else ids.union(part)
    if ids is None:
        return np.zeros((0, BUCKETS + 2), np.float32), np.zeros(0)
    rows = [(r["doc_id"], r["y"]) for r in ids.collect()]
    ids = docs.sparkSession.createDataFrame(rows, known.schema)

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            slots: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]

            def put(hashes: np.ndarray, of: np.ndarray) -> None:
                for i in np.unique(of):
                    slots[i].append(np.unique(word_slots(hashes[of == i])))

            got = bag(batch.column(1), words_of=put if want_words else None)
            return {"doc_id": batch.column(0), "y": batch.column(2), "bag": [b.tobytes() for b in got.astype(np.float16)], "words": [b"".join(x.astype("<u2").tobytes() for x in s) for s in slots]}

        return step

    want_words = words is not None
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
    kind = known.schema["y"].dataType.simpleString()
    got = map_arrow(texts, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y {kind}, bag binary, words binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["bag"]))
    if words is not None:
        words += [np.frombuffer(r["words"], "<u2") for r in got]
    bags = np.array([np.frombuffer(r["bag"], np.float16) for r in got], np.float32).reshape(len(got), BUCKETS + 2)
    return bags, np.array([r["y"] for r in got])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, dims: int = DIMS) -> Model:
    bags, y = sampled_bags(docs, labels, "quality", per_class)
    directions = basis(bags, dims)
    return Model(directions, project(bags, directions), y.astype(np.float32))


def votes(vectors: np.ndarray, model: Model, k: int = NEIGHBOURS, power: float = POWER) -> np.ndarray:
    """Scores of unit vectors, in blocks."""
    if not len(model.labels):
        return np.full(len(vectors), 0.5)
    k = min(k, len(model.labels))
    out = np.empty(len(vectors))
    for a in range(0, len(vectors), 256):
        near = vectors[a : a + 256] @ model.vectors.T
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** power
        total = weight.sum(1)
        out[a : a + 256] = np.where(total > 0, (weight * model.labels[top]).sum(1) / np.where(total > 0, total, 1), 0.5)
    return out


def _scorer(shared):
    model: Model = shared.value

    def score(texts: pa.Array) -> np.ndarray:
        bags = bag(texts)
        got = votes(project(bags, model.directions), model)
        got[~bags.any(1)] = 0
        return np.round(np.clip(got, 0, 1), 6)

    return score


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        scorer = _scorer(shared)

        def step(batch: pa.RecordBatch) -> dict:
            s = scorer(batch.column(2))
            return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": s, "predicted": (s >= threshold).astype(np.int32)}

        return step

    held = docs.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")
    return map_arrow(held, make, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, at = list(docs.columns), docs.columns.index("text")

    def make():
        scorer = _scorer(shared)

        def step(batch: pa.RecordBatch) -> dict:
            good = batch.filter(pa.array(scorer(batch.column(at)) >= threshold))
            return {c: good.column(i) for i, c in enumerate(names)}

        return step

    return map_arrow(docs, make, docs.schema)

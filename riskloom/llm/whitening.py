"""Embedding whitening with moments merged by Chan's formula.

Every partition of the fit list computes its count, local mean and scatter centred on that mean. Two such moments
merge pairwise (scatters add up with the outer product of the difference of means, weighted), so treeReduce brings
one covariance to the driver whatever the number of partitions; what travels is of the size of the covariance.
The eigenvectors come from it on the driver. A second pass over the fit list computes the moments of the whitened
vectors in the same way, and the largest departure of their covariance from the identity is part of the result.

Entries c become x = floor(scale * c) + shift; the fit list is each distinct x vector once, so repeated vectors (a
third of the table, say) neither weigh on the fit nor meet in one task: they collapse before the shuffle.

Vectors that are null or hold a null, NaN or infinite entry take no part. Shorter vectors are filled up with
entries of 0. Entries beyond 2^52 / scale count as that bound. Rows without vec_id or with a repeated one stay, each by
itself. Components whose variance is rounding noise (1e-13 of the trace or less) have no scale: ``whitened`` is null
there and the identity is verified on the others. A deviation beyond a long is given as the largest long. An empty
table, or one of empty vectors only, gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import Scratch, map_arrow, ship

#: Share of the trace at or below which a component's variance is rounding noise.
NOISE = 1e-13
_LONG, _REACH = 2**63 - 1, 2.0**52


@dataclass
class Moments:
    """Count, mean and centred scatter of some vectors, and their exact sums."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list[int]

    @staticmethod
    def of(rows: np.ndarray) -> Moments:
        """Moments of a block of vectors, centred before multiplying."""
        mean = rows.mean(0)
        centred = rows - mean
        return Moments(len(rows), mean, centred.T @ centred, exact_sums(rows))

    def merged(self, other: Moments) -> Moments:
        """Chan's pairwise formula."""
        if not self.n or not other.n:
            return self if self.n else other
        n, step = self.n + other.n, other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(step, step) * (self.n * other.n / n)
        return Moments(n, self.mean + step * (other.n / n), scatter, [a + b for a, b in zip(self.sums, other.sums, strict=True)])


def exact_sums(rows: np.ndarray) -> list[int]:
    """Column sums of whole numbers; in Python's integers where a long may not hold them."""
    if not len(rows) or np.abs(rows).max(initial=0) * len(rows) < _LONG / 2:
        return [int(s) for s in rows.astype(np.int64).sum(0)]
    return [sum(int(v) for v in column) for column in rows.T]


def whole_numbers(embedding: Column, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift of every entry, as longs."""
    y = lambda c: F.least(F.lit(_REACH), F.greatest(F.lit(-_REACH), c.cast("double") * F.lit(float(scale))))
    return F.transform(embedding, lambda c: F.floor(y(c)) + F.lit(shift).cast("long"))


def usable(vectors: DataFrame, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, x (longs) of the rows that take part."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(F.coalesce(ok, F.lit(False))).select("vec_id", whole_numbers(F.col("embedding"), scale, shift).alias("x"))


def _matrix(column: pa.Array, width: int, empty: int) -> np.ndarray:
    """Rows of a list column as doubles, filled up with ``empty``."""
    counts = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten()).astype(np.float64)
    if len(counts) and (counts == width).all():
        return flat.reshape(-1, width)
    out = np.full((len(counts), width), float(empty))
    out[np.arange(width) < counts[:, None]] = flat
    return out


def _reduced(lists: DataFrame, column: str, width: int, empty: int, project=None) -> Moments:
    """Moments of a list column: one for each partition, merged in a tree. ``project`` maps a block of vectors before."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Moments | None = None
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column(0), width, empty)
                got = Moments.of(rows if project is None else project(rows))
                held = got if held is None else held.merged(got)
        if held is not None:
            yield pa.RecordBatch.from_pydict({"n": pa.array([held.n], pa.int64()), "mean": [held.mean.tobytes()], "scatter": [held.scatter.tobytes()], "sums": [[str(s) for s in held.sums]]})

    def moments(row) -> Moments:
        mean = np.frombuffer(row["mean"])
        return Moments(row["n"], mean, np.frombuffer(row["scatter"]).reshape(len(mean), len(mean)), [int(s) for s in row["sums"]])

    parts = lists.select(column).mapInArrow(local, "n long, mean binary, scatter binary, sums array<string>").rdd.map(moments)
    size = width if project is None else project.keep
    none = Moments(0, np.zeros(size), np.zeros((size, size)), [0] * size)
    return parts.treeAggregate(none, Moments.merged, Moments.merged, depth=max(2, parts.getNumPartitions().bit_length() // 4))


@dataclass
class Whitening:
    """A fit: n vectors with exact sums S, eigenvalues e by falling size and their unit vectors (columns)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def keep(self) -> int:
        return len(self.values)

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """x - S / n; the numerator n * x - S in whole numbers, so the difference of close numbers loses nothing."""
        return self.deviations(rows)[0].astype(np.float64) / self.n

    def deviations(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S and the sums of its squares, exact."""
        most = max(map(abs, self.sums), default=0) + np.abs(rows).max(initial=0) * self.n
        if most < _LONG / 4:
            off = rows.astype(np.int64) * self.n - np.array(self.sums, np.int64)
            if float(np.abs(off).max(initial=0)) ** 2 * max(1, off.shape[1]) < _LONG / 4:
                return off, (off * off).sum(1)
            off = off.astype(object)
        else:
            off = np.array([[int(v) * self.n - s for v, s in zip(row, self.sums, strict=True)] for row in rows], object).reshape(rows.shape)
        return off, np.array([min(_LONG, sum(v * v for v in row)) for row in off], np.int64)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        """Whitened components; 0 where a component has no scale."""
        at = self.centred(rows) @ self.vectors
        return at * self.scales

    @property
    def scales(self) -> np.ndarray:
        sound = self.values > NOISE * self.trace
        return np.where(sound, 1 / np.sqrt(np.where(sound, self.values, 1)), 0.0)


def fit(vectors: DataFrame, scale: int = 64, shift: int = 1_000_000, components: int = 16) -> Whitening | None:
    """The whitening of the distinct vectors, verified by a second pass over them; None where there are none."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "whitening")
    distinct = scratch.cut(usable(vectors, scale, shift).select("x").distinct(), "distinct")
    width = distinct.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return None
    if distinct.where(F.size("x") < width).limit(1).count():  # filled up, two vectors may be the same
        filled = F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(width) - F.size("x")))
        distinct = scratch.cut(distinct.select(filled.alias("x")).distinct(), "filled")
    got = _reduced(distinct, "x", width, shift)
    covariance = got.scatter / got.n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[: min(components, width)]
    made = Whitening(got.n, got.sums, np.maximum(values[order], 0.0), axes[:, order], float(np.trace(covariance)))
    again = _reduced(distinct, "x", width, shift, made)
    sound = made.scales > 0
    if sound.any():
        made.identity_error = float(np.abs(again.scatter / again.n - np.eye(made.keep))[np.ix_(sound, sound)].max())
    return made


def whiten(vectors: DataFrame, scale: int = 64, shift: int = 1_000_000, components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    made = fit(vectors, scale, shift, components)
    if made is None:
        return vectors.sparkSession.createDataFrame([], schema)
    width = len(made.sums)

    def make():
        explained = made.values / made.trace if made.trace else np.zeros(made.keep)
        silent = made.scales == 0

        def step(batch: pa.RecordBatch) -> dict:
            rows = _matrix(batch.column(1), width, shift)
            n, k = len(rows), made.keep
            out = made(rows)
            mask = np.broadcast_to(silent, out.shape)
            return {
                "vec_id": batch.column(0).take(pa.array(np.repeat(np.arange(n), k))), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), n),
                "n": np.full(n * k, made.n), "deviation": np.repeat(made.deviations(rows)[1], k), "whitened": pa.array(out.ravel(), mask=mask.ravel()),
                "explained": np.tile(explained, n), "identity_error": np.full(n * k, made.identity_error),
            }

        return step

    return map_arrow(usable(vectors, scale, shift), make, schema)

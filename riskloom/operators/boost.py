"""Boosted trees for searches: the trees of pyspark.ml's GBTClassifier, grown from cells instead of rows.

A tree sees of a row only the bin of each feature, so rows in the same bins are one cell with its negatives and positives. Cells
are made once for each frame of training rows and serve every setting; their number is bounded by the bins, whatever the rows.
Loss, splits, leaves and weights are the engine's; edges of bins follow its rule over all rows (it takes them from some
10,000 sampled ones), and a share of rows is drawn as a binomial number of each cell's rows, which has the same distribution.
Draws depend on cell and tree alone and gradients are whole multiples of 2^-24, so the trees do not depend on partitions.
"""

from __future__ import annotations

import pickle
import sys
import threading
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get this module's functions by themselves

#: Bins of a numeric feature (the engine's maxBins), bits of a value's mantissa that tell it from others when edges are sought.
BINS, MANTISSA = 32, 14
#: Rows binned at a time, cells of a block and at least of a partition, partitions above which histograms are added up in stages.
CHUNK, BLOCK, PART, WIDE = 1 << 20, 1 << 18, 1 << 16, 64
#: Gradients are rounded to multiples of this; a gain below the least is none.
GRAIN, LEAST = 2.0**-24, 1e-12


#: A block of cells in transit, in as few bytes as will do: bins (feature by cell), negatives, positives, margin, rows drawn for the tree, sum of their gradients.
Block = tuple


class Tree:
    """Nodes in heap order: feature split on (-1: leaf), the bins that go right, the mean of the gradients."""

    def __init__(self, depth: int, width: int):
        n = 2 ** (depth + 1) - 1
        self.feature, self.right, self.value = np.full(n, -1, np.int64), np.zeros((n, width), bool), np.zeros(n)

    def places(self, x: np.ndarray) -> np.ndarray:
        """The node of each column of bins."""
        at, rows, width = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1]), self.right.shape[1]
        flat = self.right.ravel()
        while True:
            f = self.feature[at]
            if (f < 0).all():
                return at
            right = flat[at * width + x[f, rows]]  # a leaf's feature is -1, which is ignored below
            at = np.where(f < 0, at, 2 * at + 1 + right)


def edges_of(low: np.ndarray, high: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Edges between ascending values (runs from low to high) by the engine's rule: all midpoints, or those nearest to equal counts."""
    middle = (high[:-1] + low[1:]) / 2
    if len(counts) <= BINS:
        return middle
    upto, stride = np.cumsum(counts), counts.sum() / BINS
    out, target = [], stride
    for k in range(1, len(counts)):
        if abs(upto[k - 1] - target) < abs(upto[k] - target):
            out.append(middle[k - 1])
            target += stride
    return np.array(out)


def bins_of(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins (feature by row): numeric features first, cut by their edges; the others are indices already."""
    return np.stack([np.searchsorted(edges[i], c, "left") if i < len(edges) else c for i, c in enumerate(columns)]).astype(np.uint8)


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches, some 2^20 rows at a time."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK:
            yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            held, n = [], 0
    if n:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]


def uniform(key: np.ndarray, *salt: int) -> np.ndarray:
    """A number in [0, 1) for each key and salt (splitmix64)."""
    z = key.astype(np.uint64)
    with np.errstate(over="ignore"):
        for s in salt:
            z = z + np.uint64((s + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)) * 2.0**-53


def binomial(n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """The number of n draws of probability p at which the distribution reaches u."""
    out = ((n == 1) & (u < p)).astype(np.float64)
    many = np.flatnonzero(n > 1)
    if len(many):
        sizes, at = np.unique(n[many], return_inverse=True)
        tables, first, start, total = [], [], [], 0
        for r, size in enumerate(sizes.tolist()):
            far = 12 * (size * p * (1 - p)) ** 0.5 + 12  # what lies beyond has less than 1e-30
            lo, hi = max(0, int(size * p - far)), min(size, int(size * p + far) + 1)
            k = np.arange(lo, hi)
            logs = np.concatenate([[0.0], np.cumsum(np.log((size - k) / (k + 1.0)) + np.log(p / (1 - p)))])
            mass = np.cumsum(np.exp(logs - logs.max()))
            tables.append(r + mass / mass[-1])
            first.append(lo)
            start.append(total)
            total += len(mass)
        got = np.searchsorted(np.concatenate(tables), at + u[many], "right") - np.array(start)[at]
        out[many] = np.minimum(np.array(first)[at] + got, n[many])
    return out


def slim(n: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold them."""
    return n.astype(np.min_scalar_type(int(n.max(initial=0))))


def draw(b: Block, radix: np.ndarray, number: int, share: float, seed: int) -> Block:
    """b with the rows drawn for a tree and their gradients: labels of -1 and 1 for the first, those of the logistic loss later."""
    x, neg, pos, margin, *_ = b
    key = sum(r * bins.astype(np.int64) for r, bins in zip(radix, x, strict=True)) if share < 1 else None
    up, down = (1.0, -1.0) if number == 0 else (4 / (1 + np.exp(2 * margin)), -4 / (1 + np.exp(-2 * margin)))
    drawn_p, drawn_n = (n.astype(np.float64) if share >= 1 else binomial(n, share, uniform(key, seed, number, k)) for k, n in enumerate((pos, neg)))
    grain = lambda g: np.rint(g / GRAIN) * GRAIN
    return x, neg, pos, margin, slim(drawn_p + drawn_n), drawn_p * grain(up) + drawn_n * grain(down)


def histogram(blocks: Iterable[Block], tree: Tree, slots: np.ndarray, shape: tuple[int, int, int, int]) -> np.ndarray:
    """Rows and gradients by open node, feature and bin."""
    out, (_, used, _, width) = np.zeros(shape), shape
    for x, _, _, _, drawn, grad in blocks:
        base = slots[tree.places(x)] * width  # closed nodes share the slot beyond the last
        for f, bins in enumerate(x):
            at = base + bins
            for k, w in enumerate((drawn, grad)):
                out[k, :, f] += np.bincount(at, w, (used + 1) * width)[: used * width].reshape(used, width)
    return out


def split(tree: Tree, node: int, rows: np.ndarray, grads: np.ndarray, numeric: int) -> bool:
    """Split a node where the variance falls most (the first such place; categories in the order of their means); whether there is one."""
    n, g = rows[0].sum(), grads[0].sum()
    if node == 0:
        tree.value[0] = g / n if n else 0.0
    best = (LEAST, None)
    for f in range(len(rows)):
        order = np.arange(rows.shape[1])
        if f >= numeric:
            order = np.argsort(np.where(rows[f] > 0, grads[f] / np.maximum(rows[f], 1), np.inf), kind="stable")
        left, down = np.cumsum(rows[f][order])[:-1], np.cumsum(grads[f][order])[:-1]
        ok = (left >= 1) & (n - left >= 1)
        if ok.any():
            l, r = np.where(ok, left, 1), np.where(ok, n - left, 1)
            gain = np.where(ok, (down**2 / l + (g - down) ** 2 / r - g**2 / n) / n, -np.inf)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, order[k + 1 :], down[k] / l[k], (g - down[k]) / r[k]))
    if best[1] is None:
        return False
    tree.feature[node], right, tree.value[2 * node + 1], tree.value[2 * node + 2] = best[1]
    tree.right[node, right] = True
    return True


class Cells:
    """The cells of a frame of training rows, kept for many fits; ``release`` lets them go."""

    def __init__(self, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str):
        from .learn import encoders

        self.encode: PipelineModel = Pipeline(stages=encoders(numeric, categorical, False)[:-1]).fit(df)
        self.columns = [*(F.col(f"{c}_i").cast("double") for c in numeric), *(F.col(f"{c}_x").cast("int") for c in categorical)]
        rows = self.encode.transform(df).select(*(c.alias(f"c{i}") for i, c in enumerate(self.columns)), F.col(label).cast("int").alias("y"))
        self.numeric = many = len(numeric)
        self.edges = edges = self._edges(rows.select(*(f"c{i}" for i in range(many))))
        self.arity = [len(e) + 1 for e in edges] + [len(names) + 1 for names in self.encode.stages[1].labelsArray]
        if max(self.arity) > 256:
            raise ValueError("a feature of more than 256 categories")
        self.width, self.radix = max(self.arity), np.cumprod([1, *self.arity[:-1]], dtype=np.int64)
        radix, arity = self.radix, self.arity

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for *columns, y in _chunks(batches):
                key, at, n = np.unique(radix @ bins_of(columns, edges).astype(np.int64), return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(np.bincount(at, y, len(key)).astype(np.int64))], ["key", "n", "p"])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, n, p in _chunks(batches):
                for i in range(0, len(key), BLOCK):
                    k, part = key[i : i + BLOCK], slice(i, i + BLOCK)
                    x = np.stack([k // r % a for r, a in zip(radix, arity, strict=True)]).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((x, slim(n[part] - p[part]), slim(p[part]), np.zeros(len(k))))], pa.binary())], ["block"])

        cells = rows.mapInArrow(keyed, "key long, n long, p long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
        blocks = cells.mapInArrow(packed, "block binary").rdd.map(lambda r: pickle.loads(r[0]))
        self.blocks: RDD = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        self.count = self.blocks.map(lambda b: len(b[3])).sum()

    @staticmethod
    def _edges(rows: DataFrame) -> list[np.ndarray]:
        """Edges of each numeric column. Values that agree in sign, exponent and 14 bits of mantissa count as one, with its least and greatest."""

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for columns in _chunks(batches):
                for i, c in enumerate(columns):
                    c = np.sort(c) + 0.0
                    cell = c.view(np.int64) >> (52 - MANTISSA)
                    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                    last = np.append(first[1:], len(c)) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), i, np.int32)), pa.array(cell[first]), pa.array(c[first]), pa.array(c[last]), pa.array(last - first + 1)], ["f", "cell", "low", "high", "n"])

        parts = rows.mapInArrow(counted, "f int, cell long, low double, high double, n long")
        got = parts.groupBy("f", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toArrow().to_pandas().sort_values(["f", "low"])
        return [edges_of(*(got[got["f"] == i][c].to_numpy() for c in ("low", "high", "n"))) for i in range(len(rows.columns))]

    def grow(self, rounds: int, depth: int, step: float, share: float, seed: int) -> Boosted:
        """Each level of a tree is one pass over the cells; margins are brought forward when a tree is done."""
        trees: list[tuple[Tree, float]] = []
        radix, few = self.radix, self.blocks.coalesce(max(1, min(self.blocks.getNumPartitions(), -(-self.count // PART))))
        state, before = few.map(lambda b: draw(b, radix, 0, share, seed)).persist(StorageLevel.MEMORY_AND_DISK), None
        for number in range(rounds):
            tree, nodes = Tree(depth, self.width), [0]
            for _ in range(depth):
                total = self._pass(state, tree, nodes)
                if before is not None:
                    before.unpersist()
                    before = None
                nodes = [c for k, v in enumerate(nodes) if split(tree, v, total[0, k], total[1, k], self.numeric) for c in (2 * v + 1, 2 * v + 2)]
                if not nodes:
                    break
            weight = 1.0 if number == 0 else step
            trees.append((tree, weight))
            if number + 1 < rounds:
                before, state = state, self._next(state, tree, weight, number + 1, share, seed)
        for r in (before, state):
            if r is not None:
                r.unpersist()
        return Boosted(self, trees)

    def _next(self, state: RDD, tree: Tree, weight: float, number: int, share: float, seed: int) -> RDD:
        radix = self.radix

        def forward(b: Block) -> Block:
            return draw((*b[:3], b[3] + weight * tree.value[tree.places(b[0])]), radix, number, share, seed)

        return state.map(forward).persist(StorageLevel.MEMORY_AND_DISK)

    def _pass(self, state: RDD, tree: Tree, nodes: Sequence[int]) -> np.ndarray:
        slots, shape = np.full(len(tree.feature), len(nodes)), (2, len(nodes), len(self.arity), self.width)
        slots[list(nodes)] = np.arange(len(nodes))
        parts = state.mapPartitions(lambda blocks: [histogram(blocks, tree, slots, shape)])
        n = state.getNumPartitions()
        return np.zeros(shape) if n == 0 else parts.reduce(np.add) if n <= WIDE else parts.treeReduce(np.add)

    def release(self) -> None:
        self.blocks.unpersist()


class Boosted:
    """Trees with their weights, and how rows are put into bins."""

    def __init__(self, cells: Cells, trees: Sequence[tuple[Tree, float]]):
        self.encode, self.columns, self.edges, self.trees = cells.encode, cells.columns, cells.edges, list(trees)

    def predict(self, df: DataFrame, keep: Sequence[str], name: str = "score") -> DataFrame:
        edges, trees = self.edges, self.trees
        rows = self.encode.transform(df).select(*keep, *(c.alias(f"c{i}_") for i, c in enumerate(self.columns)))
        schema = StructType([*rows.schema.fields[: len(keep)], StructField(name, DoubleType())])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = bins_of([c.to_numpy() for c in b.columns[len(keep) :]], edges)
                margin = sum(w * t.value[t.places(x)] for t, w in trees)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(1 / (1 + np.exp(-2 * margin)))], [*keep, name])

        return rows.mapInArrow(score, schema)


class Trees:
    """``fit(df, rounds, depth, step, share)`` for many settings: frames of the same rows are binned once."""

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str], label: str = "label"):
        self.names, self.kept, self.lock = (numeric, categorical, label), [], threading.Lock()

    def __call__(self, df: DataFrame, rounds: int = 10, depth: int = 3, step: float = 0.1, share: float = 1.0, seed: int = 17) -> Boosted:
        with self.lock:  # fits may run side by side
            cells = next((c for known, c in self.kept if known.sameSemantics(df)), None)
            if cells is None:
                cells = Cells(df, *self.names)
                self.kept.append((df, cells))
        return cells.grow(rounds, depth, step, share, seed)

    def __enter__(self) -> Trees:
        return self

    def __exit__(self, *_) -> None:
        for _df, cells in self.kept:
            cells.release()
        self.kept = []

"""Exact top-k by inner product with a pivot table.

Distances of every vector to the pivots are computed once and stored beside it. For a query q and a
candidate c every pivot p gives |d(q,p) - d(c,p)| <= d(q,c); the greatest of these lower bounds gives
<q,c> <= (|q|^2 + |c|^2 - bound^2) / 2. The table is dealt out by nearest pivot and the distance to it, so that
a block of it holds neighbours; files and blocks carry the least and the greatest distance to every pivot, which
bound all of their vectors at once. A task has a block of queries and goes through files and blocks in the order
of those bounds, reading only what some query still needs; inside a block every query evaluates its own
candidates in the order of their bounds. Its k-th score is carried from block to block, and it stops where no
bound left reaches it. A bound equal to the k-th score doesn't stop it, so ties go to the smaller id exactly.

The table is written once to the shared folder and read from there by every task: no row is shuffled once for
each block of queries. Each query is decided in one task, which keeps k results for it.

Vectors that are null, or hold a null, NaN or infinite component, take no part, nor do rows without vec_id.
Rows that repeat a vec_id are candidates each, and queries each; a row is no candidate of its own. Vectors
shorter than the longest are filled up with zeros. Fewer candidates than k: all of them. Products are exact at
any size of the components; a score beyond a long is given as the nearest long. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Scratch, filesystem, map_arrow

#: Pivots, vectors that they are chosen from, queries searched together, candidates of a block, candidates evaluated first.
PIVOTS, POOL, QUERIES, CANDIDATES, STEP = 128, 1024, 256, 4096, 128
#: One candidate of so many is in the sample that says whether bounds are worth it, and the share that says no.
SAMPLE, DENSE = 16, 0.75
#: Blocks of a file of the table, and the number of tasks up to which a task makes one block.
BLOCKS, TASKS = 64, 200
#: Components from which on distances are no use as bounds: single precision runs out.
FAR = 1e15
_LONG = 2**63 - 1


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v (whole numbers floor(scale * x), as doubles) of the vectors that take part."""
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # floor gives a long, which large doubles overflow; those are whole numbers already.
    y = lambda x: x.cast("double") * F.lit(float(scale))
    v = F.transform("embedding", lambda x: F.when(F.abs(y(x)) < 2.0**52, F.floor(y(x)).cast("double")).otherwise(y(x)))
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def choose_pivots(pool: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each next pivot is the vector of the pool farthest from those before."""
    if not len(pool):
        return pool
    picked = [int(np.argmax((pool * pool).sum(1)))]
    far = ((pool - pool[picked[0]]) ** 2).sum(1)
    while len(picked) < min(n, len(pool)) and far.max() > 0:
        picked.append(int(np.argmax(far)))
        far = np.minimum(far, ((pool - pool[picked[-1]]) ** 2).sum(1))
    return pool[picked]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (rows * rows).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(square, 0)).astype("<f4")


class Shape:
    """Layout of blocks: components, pivots, and whether products are exact in double precision."""

    def __init__(self, width: int, reach: float, pivots: np.ndarray):
        self.width, self.pivots = width, pivots
        self.kind = "<i2" if reach < 2**15 else "<f8"
        self.plain = reach * reach * width < 2**52
        self.head = np.dtype([("at", "<i8"), ("n", "<i8"), ("norm", "<f8"), ("lo", "<f4", (len(pivots),)), ("hi", "<f4", (len(pivots),))])

    def matrix(self, column: pa.Array) -> np.ndarray:
        m = np.zeros((len(column), self.width))
        for i, v in enumerate(column.to_pylist()):
            m[i, : len(v)] = v
        return m

    def packed(self, ids: np.ndarray, rows: np.ndarray, m: np.ndarray, far: np.ndarray) -> bytes:
        return ids.astype("<i8").tobytes() + rows.astype("<i8").tobytes() + m.astype(self.kind).tobytes() + far.astype("<f4").tobytes()

    def size(self, n: int) -> int:
        return n * (16 + self.width * np.dtype(self.kind).itemsize + 4 * len(self.pivots))

    def unpacked(self, data: bytes, n: int) -> Block:
        mid = 16 * n + n * self.width * np.dtype(self.kind).itemsize
        ids, rows = np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i8", n, 8 * n)
        m = np.frombuffer(data, self.kind, n * self.width, 16 * n).reshape(n, self.width).astype(np.float64)
        return Block(ids, rows, m, np.frombuffer(data, "<f4", n * len(self.pivots), mid).reshape(n, len(self.pivots)))

    def products(self, m: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Exact inner products, as whole numbers of any size where they need it."""
        if self.plain:
            return np.rint(m @ v).astype(np.int64)
        whole = [int(x) for x in v]
        return np.array([sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in m], object)


class Block:
    def __init__(self, ids: np.ndarray, rows: np.ndarray, m: np.ndarray, far: np.ndarray):
        self.ids, self.rows, self.m, self.far = ids, rows, m, far
        with np.errstate(over="ignore"):
            self.norms = (m * m).sum(1)


class Queries:
    """A block of queries, the k best of each so far, and the pairs evaluated."""

    def __init__(self, block: Block, shape: Shape, k: int):
        self.block, self.shape, self.k = block, shape, k
        n = len(block.ids)
        self.found: list[list[tuple]] = [[] for _ in range(n)]  # (-score, vec_id, row), ascending
        self.kth = np.full(n, -np.inf)
        self.evaluated = 0

    def _upper(self, low: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """What products may reach at most, given least distances; rounding only raises it."""
        low = np.maximum(low - np.float32(1e-5) * (np.float32(1) + self.block.far.max(initial=0)), 0).astype(np.float32)
        both = self.block.norms[:, None] + norms[None, :]
        return (both - low.astype(np.float64) ** 2) / 2 + 1 + 1e-5 * both

    def outer(self, heads: np.ndarray) -> np.ndarray:
        """For each query and file or block: what products in it may reach at most."""
        if not len(self.shape.pivots):
            return np.full((len(self.kth), len(heads)), np.inf)
        low = np.zeros((len(self.kth), len(heads)), np.float32)
        for p in range(len(self.shape.pivots)):
            q = self.block.far[:, p, None]
            np.maximum(low, np.maximum(q - heads["hi"][None, :, p], heads["lo"][None, :, p] - q), out=low)
        return self._upper(low, heads["norm"])

    def _pairs(self, some: np.ndarray, c: Block, at: slice) -> np.ndarray:
        """What the products of some queries with the block's candidates ``at`` may reach at most."""
        norms = c.norms[at]
        if not len(self.shape.pivots):
            return np.full((len(some), len(norms)), np.inf)
        low = np.zeros((len(some), len(norms)), np.float32)
        gap = np.empty_like(low)
        for p in range(len(self.shape.pivots)):
            np.subtract(self.block.far[some, p, None], c.far[None, at, p], out=gap)
            np.abs(gap, out=gap)
            np.maximum(low, gap, out=low)
        low -= np.float32(1e-5) * (np.float32(1) + self.block.far.max(initial=0) + c.far.max(initial=0))
        np.maximum(low, 0, out=low)
        both = self.block.norms[some, None] + norms[None, :]
        return (both - low.astype(np.float64) ** 2) / 2 + 1 + 1e-5 * both

    def meet(self, c: Block, live: np.ndarray) -> None:
        """Evaluate what the block has for the queries in ``live``, each in the order of its bounds.

        Where a query has its k results and a sample of the block shows that it needs DENSE of the candidates anyway,
        bounds cost more than they save: the block's products are made at once.
        """
        for a in range(0, len(live), 64):
            some = live[a : a + 64]
            ready = self.shape.plain & (self.kth[some] > -np.inf)
            dense = ready.copy()
            if ready.any():
                dense[ready] = (self._pairs(some[ready], c, slice(None, None, SAMPLE)) >= self.kth[some[ready], None]).mean(1) >= DENSE
            if dense.any():
                self._all(some[dense], c)
            if not dense.all():
                some = some[~dense]
                for q, upper in zip(some, self._pairs(some, c, slice(None)), strict=True):
                    self._one(int(q), c, upper)

    def _all(self, some: np.ndarray, c: Block) -> None:
        scores = np.rint(self.block.m[some] @ c.m.T)
        self.evaluated += scores.size
        at, col = np.nonzero(scores >= self.kth[some, None])
        ends = np.searchsorted(at, np.arange(len(some) + 1))
        for i, q in enumerate(some):
            now = col[ends[i] : ends[i + 1]]
            now = now[c.rows[now] != self.block.rows[q]]
            if len(now):
                self._take(int(q), c, now, scores[i, now].astype(np.int64))

    def _one(self, q: int, c: Block, upper: np.ndarray) -> None:
        left = np.flatnonzero((upper >= self.kth[q]) & (c.rows != self.block.rows[q]))
        step = STEP
        while len(left):
            if len(left) > step:
                cut = np.argpartition(-upper[left], step - 1)
                now, left = left[cut[:step]], left[cut[step:]]
            else:
                now, left = left, left[:0]
            step *= 2
            self.evaluated += len(now)
            scores = self.shape.products(c.m[now], self.block.m[q])
            good = scores >= self.kth[q]
            if good.any() and self._take(q, c, now[good], scores[good]):
                left = left[upper[left] >= self.kth[q]]

    def _take(self, q: int, c: Block, now: np.ndarray, scores: np.ndarray) -> bool:
        """Add candidates that reach the k-th score; whether there are k now."""
        if self.shape.plain and len(now) > 2 * self.k:
            top = np.lexsort((c.rows[now], c.ids[now], -scores))[: self.k]
            now, scores = now[top], scores[top]
        more = [(-int(s), int(i), int(r)) for s, i, r in zip(scores, c.ids[now], c.rows[now], strict=True)]
        self.found[q] = sorted(self.found[q] + more)[: self.k]
        if len(self.found[q]) < self.k:
            return False
        worst = -self.found[q][-1][0]
        self.kth[q] = worst if abs(worst) < 2**53 else np.nextafter(float(worst), -np.inf)
        return True


def search_files(queries: Queries, heads: np.ndarray, blocks_of: Callable[[int], tuple[np.ndarray, Callable[[int], Block]]]) -> None:
    """Files in the order of their bounds, blocks of a file likewise, and only those that a query still needs.

    ``heads`` bound the files; ``blocks_of(i)`` gives the heads of a file's blocks and a reader of them.
    """

    def ordered(upper: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for i in np.argsort(-upper.max(0, initial=-np.inf), kind="stable"):
            live = np.flatnonzero(upper[:, i] >= queries.kth)
            if len(live):
                yield int(i), live

    for f, _ in ordered(queries.outer(heads)):
        inner, read = blocks_of(f)
        for b, live in ordered(queries.outer(inner)):
            queries.meet(read(b), live)


def bounds(shape: Shape, at: int, m: np.ndarray, far: np.ndarray) -> tuple:
    with np.errstate(over="ignore"):
        return at, len(m), (m * m).sum(1).max(), far.min(0), far.max(0)


def search(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, evaluated=None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every vector whose id is divisible by ``every``.

    ``evaluated``: an accumulator that is given the number of pairs whose product was computed.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.cut(quantised(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, asked, width, reach = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    width, reach = width or 1, reach or 0.0
    pool = rows.orderBy(F.xxhash64("vec_id", "row"), "vec_id").limit(POOL).collect() if reach < FAR else []
    points = choose_pivots(np.array([[*r["v"], *[0.0] * (width - len(r["v"]))] for r in pool]).reshape(-1, width), PIVOTS)
    shared = spark.sparkContext.broadcast(Shape(width, reach, points))

    def place():
        shape = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            m = shape.matrix(batch.column(1))
            far = distances(m, shape.pivots) if len(shape.pivots) else np.zeros((len(m), 1), "<f4")
            cell = far.argmin(1)
            return {"vec_id": batch.column(0), "v": batch.column(1), "row": batch.column(2), "cell": cell, "near": far[np.arange(len(m)), cell]}

        return step

    placed = scratch.cut(map_arrow(rows.select("vec_id", "v", "row"), place, "vec_id long, v array<double>, row long, cell int, near float"), "placed")
    # The number of a row comes last, so that vectors that many rows share are dealt out like others.
    order = ["cell", "near", F.xxhash64("row")]
    tasks = max(min(math.ceil(n / CANDIDATES), TASKS), math.ceil(n / CANDIDATES / BLOCKS), 1)
    folder = scratch.path("pivot-table")

    def chunks(batches: Iterator[pa.RecordBatch], shape: Shape, size: int) -> Iterator[tuple]:
        """(ids, rows, vectors, distances) of so many rows at a time."""
        held: list[pa.RecordBatch] = []

        def flush(some: list[pa.RecordBatch]) -> tuple:
            t = pa.Table.from_batches(some).combine_chunks()
            m = shape.matrix(t.column("v").combine_chunks())
            far = distances(m, shape.pivots) if len(shape.pivots) else np.zeros((len(m), 0), "<f4")
            return t.column("vec_id").to_numpy(), t.column("row").to_numpy(), m, far

        have = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - have)
                held.append(part)
                have += part.num_rows
                batch = batch.slice(part.num_rows)
                if have == size:
                    yield flush(held)
                    held, have = [], 0
        if have:
            yield flush(held)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, out, heads, size = shared.value, None, [], 0
        done = {"path": [], "at": [], "head": []}
        system, top = filesystem(folder)
        system.create_dir(top, recursive=True)
        attempt = TaskContext.get().taskAttemptId()  # what a lost attempt wrote is in no list

        def close() -> None:
            inner = np.array(heads, shape.head)
            out.write(inner.tobytes())
            out.close()
            whole = np.array([(len(inner), inner["n"].sum(), inner["norm"].max(), inner["lo"].min(0), inner["hi"].max(0))], shape.head)
            done["at"].append(size), done["head"].append(whole.tobytes())

        for ids, numbers, m, far in chunks(batches, shape, CANDIDATES):
            if out is None:
                done["path"].append(f"{top}/{attempt}-{len(done['path'])}")
                out, heads, size = system.open_output_stream(done["path"][-1]), [], 0
            heads.append(bounds(shape, size, m, far))
            size += out.write(shape.packed(ids, numbers, m, far))
            if len(heads) == BLOCKS:
                close()
                out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"path": pa.array(done["path"], pa.string()), "at": pa.array(done["at"], pa.int64()), "head": pa.array(done["head"], pa.binary())})

    files = placed.repartitionByRange(tasks, *order).sortWithinPartitions("cell", "near", "row").mapInArrow(store, "path string, at long, head binary")
    # One row for a file of up to BLOCKS blocks; tasks read this list from the shared folder too.
    listed = scratch.cut(files.repartition(1, F.lit(0)) if tasks <= TASKS else files, "files")._scratch_path

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        shape, parts = shared.value, None
        for ids, numbers, m, far in chunks(batches, shape, QUERIES):
            if parts is None:
                system, at = filesystem(listed)
                parts = pq.read_table(at, filesystem=system)
                paths, ends = parts.column("path").to_pylist(), parts.column("at").to_pylist()
                heads = np.frombuffer(b"".join(parts.column("head").to_pylist()), shape.head)
            queries = Queries(Block(ids, numbers, m, far), shape, k)

            def blocks_of(i: int) -> tuple[np.ndarray, Callable[[int], Block]]:
                f = system.open_input_file(paths[i])
                count = int(heads[i]["at"])
                inner = np.frombuffer(f.read_at(count * shape.head.itemsize, ends[i]), shape.head)
                return inner, lambda b: shape.unpacked(f.read_at(shape.size(int(inner[b]["n"])), int(inner[b]["at"])), int(inner[b]["n"]))

            search_files(queries, heads, blocks_of)
            if evaluated is not None:
                evaluated.add(queries.evaluated)
            out = [(int(q), r + 1, i, max(-_LONG - 1, min(_LONG, -s))) for q, best in zip(ids, queries.found, strict=True) for r, (s, i, _) in enumerate(best)]
            names, kinds = ("query_id", "rank", "vec_id", "score"), (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], kind) for j, kind in enumerate(kinds)], names=names)

    q_tasks = max(1, min(math.ceil((asked or 0) / QUERIES), 100_000))
    queries = placed.where(F.col("vec_id") % every == 0).repartitionByRange(q_tasks, *order).sortWithinPartitions("cell", "near", "row")
    return queries.mapInArrow(find, "query_id long, rank int, vec_id long, score long")

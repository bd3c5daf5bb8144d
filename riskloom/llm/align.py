"""Alignment of two tokenizers by a dangling-suffix transducer.

Both token sequences of a text spell the same bytes. The state of the transducer is the side that leads and the bytes
of its last token that the other side has not reached: nothing else is needed, since only one token ever dangles. The next
token always comes from the side behind; it is linked to the dangling token, and either leaves a shorter suffix of
that or dangles itself. Where nothing dangles a group closes. Transitions depend on the suffix and the next token alone and are
memoised, as is the step from the empty state over a token of each side. Tables of a worker are bounded and begun anew
when full.

Links are counted for each document first (distinct id pairs with their times); how many documents hold a pair is one
aggregation over those rows, which collapses within tasks before it shuffles. A table of counted pairs up to ``TABLE_PAIRS`` is read by
the tasks from the shared folder; a larger one is joined, with both sides salted, since some pairs are in nearly every
document.

Null and empty texts, and texts whose bytes one of the tokenizers does not give back, have no tokens: counts of 0
and an empty digest. Null doc_id is kept; rows that repeat a doc_id are documents of their own. Special strings inside
texts are plain text. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ids import library_ids
from .tokens import byte_symbols
from .util import Scratch, filesystem, map_arrow, ship, texts_of

#: Transitions held by a worker (about 100 bytes each), pairs that tasks read as a table (12 bytes each), rows of a salted pair.
TRANSITIONS, TABLE_PAIRS, SALTS = 1_000_000, 8_000_000, 64
#: Ids of one side fit below this.
_WIDE = 1 << 20


class Transducer:
    """Groups and links of two token sequences; ``left`` and ``right`` are the bytes of each id."""

    def __init__(self, left: list[bytes], right: list[bytes], limit: int = TRANSITIONS):
        self.left, self.right, self.limit = left, right, limit
        self.names = [str(i) for i in range(max(len(left), len(right)))]
        self._begin()

    def _begin(self) -> None:
        #: States: 0 is empty, positive ones have the left side leading, negative ones the right.
        self.suffix: dict[int, bytes] = {}
        self.number: dict[tuple[bool, bytes], int] = {}
        self.steps: dict[int, int] = {}
        self.firsts: dict[int, int] = {}

    def _state(self, left: bool, suffix: bytes) -> int:
        if not suffix:
            return 0
        key = (left, suffix)
        if key not in self.number:
            n = (len(self.number) + 1) * (1 if left else -1)
            self.number[key], self.suffix[n] = n, suffix
        return self.number[key]

    def _step(self, state: int, token: int) -> int:
        """The state after the next token of the side behind."""
        ahead, left = self.suffix[state], state > 0
        data = (self.right if left else self.left)[token]
        if len(data) <= len(ahead):
            if not ahead.startswith(data):
                raise ValueError("the sides spell different bytes")
            return self._state(left, ahead[len(data) :])
        if not data.startswith(ahead):
            raise ValueError("the sides spell different bytes")
        return self._state(not left, data[len(ahead) :])

    def _first(self, a: int, b: int) -> int:
        opened = self._state(True, self.left[a])
        return self._step(opened, b)

    def align(self, a_ids: list[int], b_ids: list[int]) -> tuple[list[str], list[int]]:
        """(groups as ``a1,a2|b1``, links as a * 2^20 + b) of two sequences that spell the same bytes."""
        if len(self.steps) + len(self.firsts) > self.limit:
            self._begin()
        steps, firsts, names = self.steps, self.firsts, self.names
        groups: list[str] = []
        links: list[int] = []
        close, link = groups.append, links.append
        i = j = 0
        n = len(a_ids)
        while i < n:
            a, b = a_ids[i], b_ids[j]
            pair = a * _WIDE + b
            state = firsts.get(pair)
            if state is None:
                state = firsts[pair] = self._first(a, b)
            link(pair)
            i0, j0 = i, j
            i += 1
            j += 1
            if not state:
                close(f"{names[a]}|{names[b]}")
                continue
            while state:
                if state > 0:
                    b = b_ids[j]
                    j += 1
                    key = state * _WIDE + b
                else:
                    a = a_ids[i]
                    i += 1
                    key = state * _WIDE - a
                new = steps.get(key)
                if new is None:
                    new = steps[key] = self._step(state, b if state > 0 else a)
                link(a * _WIDE + b)
                state = new
            close(f"{','.join([names[x] for x in a_ids[i0:i]])}|{','.join([names[x] for x in b_ids[j0:j]])}")
        return groups, links


class Sides:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, left: str, right: str):
        import sentencepiece

        self.a, self.b = library_ids(left, special=False), sentencepiece.SentencePieceProcessor(model_file=right)
        bytes_of = {s: b for b, s in byte_symbols().items()}
        vocabulary = self.a.whole.get_vocab()
        self.left = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.left[i] = bytes(bytes_of[c] for c in token) if all(c in bytes_of for c in token) else token.encode()
        size = self.b.get_piece_size()
        self.right = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.b.id_to_piece(list(range(size))))]
        if max(len(self.left), size) > _WIDE:
            raise ValueError("a vocabulary is too large for packed pairs")
        self.transducer = Transducer(self.left, self.right)

    def encode(self, texts: Iterable[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both sides for each text, or None where a side does not spell it."""
        texts = list(texts)
        out: list = []
        left, right = self.left.__getitem__, self.right.__getitem__
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            data = b" " + text.encode()
            got = None
            if text and b"".join(map(right, b)) == data:
                a = self.a.encode(" " + text).tolist()
                if b"".join(map(left, a)) == data:
                    got = (a, b)
            out.append(got)
        return out


def _sides(left: str, right: str) -> Sides:
    held = _sides.__dict__.setdefault("held", {})
    if (left, right) not in held:
        held[left, right] = Sides(left, right)
    return held[left, right]


def linked(docs: DataFrame, left: str, right: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (as a text), pairs (distinct a * 2^20 + b, ascending) and times of every document.

    The vocabulary files are found on the executors."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        sides = _sides(left, right)

        def step(batch: pa.RecordBatch) -> dict:
            cols: dict[str, list] = {c: [] for c in ("n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times")}
            for got in sides.encode(texts_of(batch.column(1))):
                a, b = got or ((), ())
                groups, links = sides.transducer.align(a, b)
                pairs, times = np.unique(np.array(links, np.int64), return_counts=True)
                digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
                for c, v in zip(cols, (len(a), len(b), len(groups), digest, pairs, times.astype(np.int32)), strict=True):
                    cols[c].append(v)
            return {"doc_id": batch.column(0)} | cols

        return step

    return map_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>")


def groups(docs: DataFrame, left: str, right: str) -> DataFrame:
    """doc_id, group (from 0), start and end (bytes of the text with its leading space), a_ids, b_ids: the alignment itself."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        sides = _sides(left, right)

        def step(batch: pa.RecordBatch) -> dict:
            at: list[int] = []
            cols: dict[str, list] = {c: [] for c in ("group", "start", "end", "a_ids", "b_ids")}
            for row, got in enumerate(sides.encode(texts_of(batch.column(1)))):
                place = 0
                for k, shown in enumerate(sides.transducer.align(*got)[0] if got else ()):
                    a, b = ([int(x) for x in side.split(",")] for side in shown.split("|"))
                    end = place + sum(len(sides.left[x]) for x in a)
                    at.append(row)
                    for c, v in zip(cols, (k, place, end, a, b), strict=True):
                        cols[c].append(v)
                    place = end
            return {"doc_id": batch.column(0).take(pa.array(at, pa.int64()))} | cols

        return step

    return map_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, group long, start long, end long, a_ids array<int>, b_ids array<int>")


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, docs (documents that hold it linked), best (whether no pair of its left id is held by more)."""
    counts = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 20)))  # one row for each right id at most
    return counts.withColumn("best", F.col("docs") == most)


def _from_table(links: DataFrame, table: DataFrame) -> DataFrame:
    """Sums by a table that each worker reads once."""
    path = table._scratch_path
    names = [c for c in links.columns if c not in ("pairs", "times")]

    def make():
        held = _from_table.__dict__.setdefault("held", {})
        if path not in held:
            import pyarrow.parquet as pq

            system, place = filesystem(path)
            got = pq.read_table(place, filesystem=system)
            pair = np.asarray(got["pair"])
            order = np.argsort(pair)
            held.clear()
            held[path] = (pair[order], np.asarray(got["docs"])[order], np.asarray(got["best"])[order])
        pair, docs, best = held[path]

        def step(batch: pa.RecordBatch) -> dict:
            lists = batch.column("pairs")
            n = np.diff(np.asarray(lists.offsets))
            at = np.searchsorted(pair, np.asarray(lists.flatten()))
            times = np.asarray(batch.column("times").flatten()).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(n)))
            total = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[ends])
            return {c: batch.column(c) for c in names} | {"n_best": total(times * best[at]), "count_sum": total(times * docs[at])}

        return step

    schema = type(links.schema)([links.schema[c] for c in names]).add("n_best", "long").add("count_sum", "long")
    return map_arrow(links, make, schema)


def _by_join(links: DataFrame, table: DataFrame) -> DataFrame:
    """Sums by a join in which every pair is dealt out over SALTS tasks."""
    names = [c for c in links.columns if c not in ("pairs", "times", "link_row")]
    each = links.select("link_row", F.explode(F.arrays_zip("pairs", "times")).alias("z")).select("link_row", F.col("z.pairs").alias("pair"), F.col("z.times").alias("times"))
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sums = each.withColumn("salt", F.pmod("link_row", F.lit(SALTS)).cast("int")).join(salted, ["pair", "salt"]).groupBy("link_row")
    sums = sums.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return links.join(sums, "link_row", "left").select(*names, zero("n_best"), zero("count_sum"))


def align_documents(docs: DataFrame, left: str, right: str, table_pairs: int = TABLE_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    ``n_best`` is of the links whose pair is held by most documents among the pairs of its left id; ``count_sum`` adds up, over
    links, the documents that hold their pairs."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "align")
    links = scratch.cut(linked(docs, left, right).withColumn("link_row", F.monotonically_increasing_id()), "links")
    table = scratch.cut(pair_counts(links), "pairs")
    sums = _from_table(links, table) if table.count() <= table_pairs else _by_join(links, table)
    n_links = F.when(F.col("n_groups") > 0, F.col("n_a") + F.col("n_b") - F.col("n_groups")).otherwise(0).cast("long")
    return sums.select("doc_id", "n_a", "n_b", "n_groups", n_links.alias("n_links"), "n_best", "count_sum", "groups_sha256")

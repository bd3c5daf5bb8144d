"""Token ids in binary shards with a minimal perfect hash index.

Rows are sorted by key over all tasks; a task encodes its range and writes the ids, nothing else, as one shard file
of 16- or 32-bit little-endian integers. The index maps each document key to its place: keys are dealt to index
parts by hash, and a part is a minimal perfect hash of its keys (levels of bits in which a key that is alone at its
place is settled and the others go on to the next level, ranks by counts of bits) over a table of entries: stored
fingerprint, shard, offset, number of ids. A look-up costs a few hashed bits, one entry and one read of the payload at any
size; a key that is not there is told by its fingerprint. Keys whose 64-bit hash is shared never settle; they stand in a
short list of the part and are told apart by the fingerprint, which is a hash of its own.

A key is (doc_id, nth): rows that repeat a doc_id are counted in the order of the file. Null doc_id is a key like
others, before all of them. Null text: empty, so the end id alone. Tasks write under a name of their attempt and rename when
done, so a task that runs again leaves one file. Empty tables give no shards. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ids import library_ids
from .util import Scratch, filesystem, map_arrow, ship, small_batches, texts_of

#: Keys of an index part, bits of a level for each key left, most levels, bits of a counted block.
PART_KEYS, LOOSE, LEVELS, BLOCK = 1 << 20, 2.0, 48, 512
#: Bytes of payload read at a time.
READ = 4 << 20
ENTRY = np.dtype([("print", "<u8"), ("offset", "<u8"), ("shard", "<u4"), ("n", "<u4")])
REST = np.dtype([("hash", "<u8"), ("print", "<u8"), ("slot", "<u8")])
_MAGIC = b"MPHIDX01"
_SALT = 0x5EED
#: Fixed: the constants of the published splitmix64 finaliser.
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def hashes(doc_id: Column | str, nth: Column | str) -> tuple[Column, Column]:
    """Hash and fingerprint of a key."""
    return F.xxhash64(doc_id, nth), F.xxhash64(F.lit(_SALT).cast("long"), doc_id, nth)


def key_hashes(doc_id: int | str | None, nth: int = 0) -> tuple[int, int]:
    """The same two of one key, outside Spark."""
    import xxhash

    def chain(*parts: bytes | None) -> int:
        seed = 42
        for p in parts:
            seed = seed if p is None else xxhash.xxh64_intdigest(p, seed=seed)
        return seed

    long = lambda v: int(v).to_bytes(8, "little", signed=True)
    data = None if doc_id is None else doc_id.encode() if isinstance(doc_id, str) else long(doc_id)
    return chain(data, long(nth)), chain(long(_SALT), data, long(nth))


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = h + _MIX[0] * np.uint64(level + 1)
        z = (z ^ (z >> np.uint64(30))) * _MIX[1]
        z = (z ^ (z >> np.uint64(27))) * _MIX[2]
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Slots 0 .. n-1 of n distinct (hash, fingerprint) keys."""

    def __init__(self, sizes: list[int], words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        per = BLOCK // 64
        blocks = np.add.reduceat(np.bitwise_count(words).astype(np.int64), np.arange(0, len(words), per)) if len(words) else np.zeros(0, np.int64)
        self.before = np.concatenate(([0], np.cumsum(blocks)))

    @classmethod
    def build(cls, hashed: np.ndarray, prints: np.ndarray, loose: float = LOOSE) -> PerfectHash:
        left, sizes, parts, settled = np.arange(len(hashed)), [], [], 0
        while len(left) and len(sizes) < LEVELS:
            size = -(-max(64, int(len(left) * loose)) // BLOCK) * BLOCK
            at = (_mixed(hashed[left], len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view("<u8")
            sizes.append(size)
            parts.append(bits)
            done = alone[at]
            settled += int(done.sum())
            left = left[~done]
        rest = np.zeros(len(left), REST)
        rest["hash"], rest["print"], rest["slot"] = hashed[left], prints[left], settled + np.arange(len(left))
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, "<u8"), rest)

    def slots(self, hashed: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot, or -1, for keys that are not in the set."""
        out = np.full(len(hashed), -1, np.int64)
        open_, base = np.arange(len(hashed)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            bit = base + (_mixed(hashed[open_], level) % np.uint64(size)).astype(np.int64)
            word, within = bit >> 6, (bit & 63).astype(np.uint64)
            hit = (self.words[word] >> within) & np.uint64(1) == 1
            out[open_[hit]] = self._rank(bit[hit])
            open_ = open_[~hit]
            base += size
        for h, p, slot in self.rest:
            out[open_[(hashed[open_] == h) & (prints[open_] == p)]] = slot
        return out

    def _rank(self, bit: np.ndarray) -> np.ndarray:
        """Set bits before each place: counts up to its block, then the words of the block."""
        block, word = bit // BLOCK, bit >> 6
        rank = self.before[block].astype(np.int64)
        for k in range(BLOCK // 64):
            w = block * (BLOCK // 64) + k
            rank += np.where(w < word, np.bitwise_count(self.words[np.minimum(w, len(self.words) - 1)]), 0).astype(np.int64)
        under = (np.uint64(1) << (bit & 63).astype(np.uint64)) - np.uint64(1)
        return rank + np.bitwise_count(self.words[word] & under).astype(np.int64)


class Part:
    """One part of the index: a perfect hash and the entries in the order of its slots."""

    def __init__(self, hashed: PerfectHash, entries: np.ndarray):
        self.hashed, self.entries = hashed, entries

    @classmethod
    def build(cls, hashed: np.ndarray, entries: np.ndarray) -> Part:
        made = PerfectHash.build(hashed, entries["print"])
        placed = np.empty_like(entries)
        placed[made.slots(hashed, entries["print"])] = entries
        return cls(made, placed)

    def data(self) -> bytes:
        h = self.hashed
        head = np.array([len(self.entries), len(h.sizes), len(h.rest), *h.sizes], "<u8")
        return b"".join((_MAGIC, head.tobytes(), h.words.tobytes(), h.rest.tobytes(), self.entries.tobytes()))

    @classmethod
    def read(cls, data: bytes) -> Part:
        if data[:8] != _MAGIC:
            raise ValueError("no index part")
        n, levels, rest = (int(x) for x in np.frombuffer(data, "<u8", 3, 8))
        sizes, at = [int(x) for x in np.frombuffer(data, "<u8", levels, 32)], 32 + 8 * levels
        words = np.frombuffer(data, "<u8", sum(sizes) // 64, at)
        at += len(words) * 8
        left = np.frombuffer(data, REST, rest, at)
        return cls(PerfectHash(sizes, words, left), np.frombuffer(data, ENTRY, n, at + left.nbytes))

    def find(self, hashed: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, entries) of keys; a key is found if the fingerprint at its slot is its own."""
        slots = self.hashed.slots(hashed, prints)
        if not len(self.entries):
            return np.zeros(len(hashed), bool), np.zeros(len(hashed), ENTRY)
        got = self.entries[np.maximum(slots, 0)]
        return (slots >= 0) & (got["print"] == prints), got


@dataclass(frozen=True)
class Layout:
    """Where the files of a written set are: its folder, bytes of an id, number of index parts."""

    folder: str
    width: int
    parts: int

    def shard(self, k: int) -> str:
        return f"{self.folder}/shard-{k:06d}.ids"

    def part(self, k: int) -> str:
        return f"{self.folder}/index-{k:06d}.mph"


@dataclass
class Store:
    """A written set of shards. ``keys``: doc_id, nth, shard, offset, n; ``shards``: shard, base (ids before it), n_ids."""

    layout: Layout
    keys: DataFrame
    shards: DataFrame


def _put(system, name: str, data: bytes, attempt: int) -> None:
    """A whole file under its final name."""
    draft = f"{name}.attempt-{attempt}"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, name)


def write(docs: DataFrame, path: str, end_id: int = 2, part_keys: int = PART_KEYS) -> Store:
    """Shards in ascending order of doc_id, and their index. ``path`` (the vocabulary file) is found on the executors."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    scratch = Scratch(spark, "shards")
    folder, kind = scratch.path("store"), docs.schema["doc_id"].dataType.simpleString()
    width = 2 if max(library_ids(path).size, end_id + 1) <= 1 << 16 else 4
    # The row number splits rows of one doc_id over ranges, so that no key is too large for a task.
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("row")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row").select("doc_id", "text")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = filesystem(folder)
        system.create_dir(top, recursive=True)
        task, encoder = TaskContext.get(), library_ids(path)
        shard, end = task.partitionId(), np.array([end_id], "<u4").tobytes()
        draft, out, at, last, nth, run = f"{top}/.shard-{task.taskAttemptId()}", None, 0, None, 0, -1
        for batch in batches:
            if out is None and batch.num_rows:
                out = system.open_output_stream(draft)
            offset, n, times, first = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                ids = np.frombuffer(encoder.data(text) + end, "<u4")
                out.write(ids.astype("<u2").tobytes() if width == 2 else ids.tobytes())
                same = run >= 0 and key == last
                nth, run = (nth + 1, run) if same else (0, run + 1)
                last = key
                offset.append(at), n.append(len(ids)), times.append(nth), first.append(run == 0)
                at += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shard] * len(n), pa.int32()), pa.array(offset, pa.int64()), pa.array(n, pa.int64()), pa.array(times, pa.int64()), pa.array(first, pa.bool_())], ["doc_id", "shard", "offset", "n", "nth", "first_run"])
        if out is not None:
            out.close()
            system.move(draft, f"{top}/shard-{shard:06d}.ids")

    places = scratch.cut(ranged.mapInArrow(store, f"doc_id {kind}, shard int, offset long, n long, nth long, first_run boolean"), "places")
    shards, carried = _shards(places)
    keys = places
    if carried:  # runs of one doc_id that go on from shard to shard
        more = F.broadcast(spark.createDataFrame(carried, "shard int, carry long"))
        keys = keys.join(more, "shard", "left").withColumn("nth", F.col("nth") + F.when(F.col("first_run"), F.coalesce("carry", F.lit(0))).otherwise(0))
    keys = keys.select("doc_id", "nth", "shard", "offset", "n")
    parts = max(1, -(-places.count() // part_keys))
    made = Store(Layout(folder, width, parts), keys, spark.createDataFrame(shards, "shard int, base long, n_ids long"))
    _write_index(made, scratch)
    return made


def _shards(places: DataFrame) -> tuple[list[tuple], list[tuple]]:
    """(shard, ids before it, its ids) of every shard, and (shard, rows before) where its first doc_id goes on from the shard before.

    One small row for each shard file comes to the driver."""
    row = F.struct("doc_id", "nth", "first_run")
    ends = places.groupBy("shard").agg(F.sum("n").alias("n"), F.min_by(row, "offset").alias("head"), F.max_by(row, "offset").alias("tail"))
    shards, carried, base, before = [], [], 0, None
    for r in sorted(ends.collect(), key=lambda r: r["shard"]):
        shards.append((r["shard"], base, r["n"]))
        base += r["n"]
        carry = before[1] + 1 if before and before[0] == r["head"]["doc_id"] else 0
        if carry:
            carried.append((r["shard"], carry))
        before = (r["tail"]["doc_id"], r["tail"]["nth"] + (carry if r["tail"]["first_run"] else 0))
    return shards, carried


def _dealt(keys: DataFrame, parts: int) -> DataFrame:
    """Keys with hash, fingerprint and part, each part in one task after another."""
    h, p = hashes("doc_id", "nth")
    part = F.pmod(F.shiftrightunsigned("hash", 17), F.lit(parts)).cast("int")
    return keys.withColumns({"hash": h, "print": p}).withColumn("part", part).repartition(parts, "part").sortWithinPartitions("part")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of sorted batches, one part at a time."""
    held, now = [], None
    for batch in batches:
        numbers = np.asarray(batch.column("part"))
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and numbers[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(numbers[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _u64(column) -> np.ndarray:
    return np.asarray(column).astype(np.int64).view(np.uint64)


def _write_index(made: Store, scratch: Scratch) -> None:
    layout = made.layout

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        for part, rows in _by_part(batches):
            entries = np.zeros(len(rows), ENTRY)
            entries["print"] = _u64(rows["print"])
            for name in ("offset", "shard", "n"):
                entries[name] = np.asarray(rows[name])
            data = Part.build(_u64(rows["hash"]), entries).data()
            system, name = filesystem(layout.part(part))
            _put(system, name, data, task.taskAttemptId())
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "keys": pa.array([len(rows)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

    columns = ["part", "hash", "print", "shard", "offset", "n"]
    scratch.cut(_dealt(made.keys, layout.parts).select(*columns).mapInArrow(build, "part int, keys long, bytes long"), "index")


def locate(made: Store, keys: DataFrame) -> DataFrame:
    """doc_id, nth, shard, offset, n of the keys (doc_id, nth) that the index holds."""
    layout = made.layout
    schema = f"doc_id {keys.schema['doc_id'].dataType.simpleString()}, nth long, shard int, offset long, n long"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = None, None
        for batch in batches:
            numbers = np.asarray(batch.column("part"))
            for part in np.unique(numbers):
                if part != now:
                    system, name = filesystem(layout.part(int(part)))
                    with system.open_input_file(name) as f:
                        now, index = part, Part.read(f.read())
                some = batch.filter(pa.array(numbers == part))
                found, got = index.find(_u64(some.column("hash")), _u64(some.column("print")))
                some, got = some.filter(pa.array(found)), got[found]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("nth"), pa.array(got["shard"].astype(np.int32)), pa.array(got["offset"].astype(np.int64)), pa.array(got["n"].astype(np.int64))], ["doc_id", "nth", "shard", "offset", "n"])

    return _dealt(keys.select("doc_id", "nth"), layout.parts).mapInArrow(look, schema)


def read(made: Store, places: DataFrame, ids: bool = True) -> DataFrame:
    """doc_id, nth, shard, offset, n_tokens, ids_crc32 and (unless ``ids`` is false) ids of located keys, read from the shards."""
    kind = places.schema["doc_id"].dataType.simpleString()
    layout = made.layout
    raw = np.dtype("<u2" if layout.width == 2 else "<u4")

    def make():
        opened: dict = {}

        def payload(shard: int, offset: int, n: int) -> np.ndarray:
            if opened.get("shard") != shard:
                if opened:
                    opened["file"].close()
                system, name = filesystem(layout.shard(shard))
                opened.update(shard=shard, file=system.open_input_file(name), at=0, data=b"")
            a, b = offset * layout.width, (offset + n) * layout.width
            if a < opened["at"] or b > opened["at"] + len(opened["data"]):
                opened["data"], opened["at"] = opened["file"].read_at(max(READ, b - a), a), a
            return np.frombuffer(opened["data"], raw, n, a - opened["at"]).astype("<u4")

        def step(batch: pa.RecordBatch) -> dict:
            rows = zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "n")), strict=True)
            got = [payload(*r) for r in rows]
            out = {c: batch.column(c) for c in ("doc_id", "nth", "shard", "offset")} | {"n_tokens": [len(g) for g in got], "ids_crc32": [zlib.crc32(g.tobytes()) for g in got]}
            return out | ({"ids": got} if ids else {})

        return step

    shards = max(1, made.shards.count())
    dealt = places.repartition(shards, "shard").sortWithinPartitions("shard", "offset")
    return map_arrow(dealt, make, f"doc_id {kind}, nth long, shard int, offset long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else ""))


class Reader:
    """Keyed access to a written set, one document at a time: an index part is read once, a payload is one read at its place."""

    def __init__(self, layout: Layout):
        self.layout = layout
        self.held: dict[int, Part] = {}

    def ids(self, doc_id: int | str | None, nth: int = 0) -> np.ndarray | None:
        """The ids of a key, or None."""
        h, p = key_hashes(doc_id, nth)
        k = (h >> 17) % self.layout.parts
        if k not in self.held:
            system, name = filesystem(self.layout.part(k))
            if system.get_file_info(name).is_file:
                with system.open_input_file(name) as f:
                    self.held[k] = Part.read(f.read())
            else:
                return None
        found, got = self.held[k].find(np.array([h], np.uint64), np.array([p], np.uint64))
        if not found[0]:
            return None
        system, name = filesystem(self.layout.shard(int(got["shard"][0])))
        with system.open_input_file(name) as f:
            data = f.read_at(int(got["n"][0]) * self.layout.width, int(got["offset"][0]) * self.layout.width)
        return np.frombuffer(data, "<u2" if self.layout.width == 2 else "<u4").astype("<u4")


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, as key and index bring them back."""
    made = write(docs, path, end_id)
    got = read(made, locate(made, made.keys), ids=False)
    return got.join(F.broadcast(made.shards), "shard").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")

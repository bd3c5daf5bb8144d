"""Best-fit packing of token sequences by bin completion.

Only lengths matter to the packing, so the plan is made for the histogram of lengths (at most ``cap``
counters, whatever the number of documents): patterns of lengths with multiplicities. The search goes
bin by bin, as bin completion does: the largest open length opens a bin and the undominated fillings of the
rest are enumerated one after another, least waste first. A filling is dominated where some of its lengths
(or its waste) could give way to one larger open length. Each filling is applied as often as the counts allow,
then once less, and so on down to once. Best-fit decreasing is the first incumbent; branches whose waste
exceeds what a better plan may waste are pruned; the search ends when the incumbent meets the lower bound or
nothing is left to try, and either proves the plan least.

The problem is NP-hard, so a search has a budget of steps (``STEPS``, a parameter). Where it runs out, the bins
of the incumbent that waste most are opened again together with others and completed anew by the same search,
for ``ROUNDS`` rounds at most; the plan then is the incumbent, is not called proven unless it meets the bound,
and its distance from the bound is logged. No piece is left out in any case.

Documents get their places without meeting in one task: pieces are ranked by length within shards, the
counts of the shards before are added, and the rank is looked up in the ranges of the plan.

Null text: empty, so one piece with the end token. Repeated rows are pieces of their own. Null doc_id is
kept. Other columns are not read.
"""

from __future__ import annotations

import json
import logging
import random
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import Scratch, map_arrow, texts_of

CAP, END_ID = 1024, 2
#: Rows of a shard in which lengths are ranked, and the most shards.
SHARD_ROWS, SHARDS = 1 << 16, 1 << 16
#: Steps of the search (lengths tried for a place in a bin) before it settles for its incumbent; rounds in which wasteful
#: bins of the incumbent are completed anew, steps of each, and rounds without gain after which no more are made.
STEPS, ROUNDS, ROUND_STEPS, STALL = 20_000, 400, 4_000, 80

Pattern = tuple[tuple[int, int], ...]


def lower_bound(counts: list[int], cap: int) -> int:
    """Bins that any packing needs: by volume, and by large lengths that can't share (with the volume left beside them)."""
    sizes = np.arange(len(counts))
    n = np.asarray(counts, np.int64)
    best = -(-int((sizes * n).sum()) // cap)
    up = np.concatenate((np.cumsum(n[::-1])[::-1], [0]))
    mass = np.concatenate((np.cumsum((sizes * n)[::-1])[::-1], [0]))
    half = cap // 2 + 1
    for k in range(1, cap // 2 + 1):
        alone, large = int(up[cap - k + 1]), int(up[half] - up[cap - k + 1])
        free = large * cap - int(mass[half] - mass[cap - k + 1])
        best = max(best, alone + large + max(0, -(-(int(mass[k] - mass[half]) - free) // cap)))
    return best


class Budget:
    """Steps that a search may still take."""

    def __init__(self, steps: int):
        self.left = steps

    def take(self) -> bool:
        self.left -= 1
        return self.left >= 0


def fillings(rest: int, counts: list[int], budget: Budget, least: int | None = None) -> Iterator[Pattern]:
    """All undominated fillings of ``rest`` with open lengths, least waste first, up to a waste of ``least``; ends early when the budget does.

    Sets of sums are bits of whole numbers. Lengths are added in falling order, so a set of them that one larger
    open length could replace stays dominated whatever follows, and its branch ends there.
    """
    have = [x for x in range(1, rest + 1) if counts[x] > 0]
    full = (1 << rest + 1) - 1
    sums = [1]  # sums[i]: what the i smallest lengths can add up to
    for x in have:
        bits, m, k = sums[-1], min(counts[x], rest // x), 1
        while m > 0:
            bits, m, k = (bits | bits << x * min(k, m)) & full, m - min(k, m), k * 2
        sums.append(bits)
    open_ = sum(1 << x for x in have)

    def spread(bits: int, waste: int) -> int:
        """The sums and all that is larger by at most the waste."""
        done = 0
        while done < waste:
            by = min(done + 1, waste - done)
            bits, done = bits | bits << by, done + by
        return bits

    def fill(goal: int, i: int, waste: int, used: tuple[tuple[int, int], ...], parts: int, free: int) -> Iterator[Pattern]:
        """``parts``: sums of some of the lengths used, 0 among them; ``free``: open lengths that are not used up."""
        if not goal:
            if not free & spread(1, waste) & ~1:
                yield used
            return
        for j in range(min(i, bisect_right(have, goal)) - 1, -1, -1):
            x = have[j]
            for m in range(min(counts[x], goal // x), 0, -1):
                if not sums[j] >> goal - x * m & 1:
                    continue
                if not budget.take():
                    return
                left = free if m < counts[x] else free & ~(1 << x)
                # Sums with some of these in them, also those that larger lengths alone make up as well.
                more, new = parts, 0
                for _ in range(m):
                    more <<= x
                    new |= more
                some = parts | new
                # A single length gives way only to larger ones, several together also to one of their sum.
                single = spread(1 << x + 1, waste - 1) & left if waste else 0
                if single or spread(new & ~(1 << x), waste) & left & full:
                    continue
                yield from fill(goal - x * m, j, waste, (*used, (x, m)), some, left)
                if budget.left < 0:
                    return

    for waste in range(min(rest, rest if least is None else least) + 1):
        if sums[-1] >> rest - waste & 1:
            yield from fill(rest - waste, len(have), waste, (), 1, open_)
            if budget.left < 0:
                return


def best_fit(counts: list[int], cap: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over the histogram: bins of one residual are moved together, by what they hold."""
    free: dict[int, dict[Pattern, int]] = {}
    rests: list[int] = []  # residuals that bins have, ascending

    def put(r: int, pattern: Pattern, m: int) -> None:
        held = free.setdefault(r, {})
        if not held:
            insort(rests, r)
        held[pattern] = held.get(pattern, 0) + m

    for x in range(cap, 0, -1):
        c = counts[x]
        while c:
            at = bisect_left(rests, x)
            if at == len(rests):
                per = min(c, cap // x)
                for a, m in ((per, c // per), (c % per, 1)):
                    if a:
                        put(cap - a * x, ((x, a),), m)
                break
            r = rests[at]
            pattern, n = free[r].popitem()
            m = min(n, c)
            if n > m:
                free[r][pattern] = n - m
            elif not free[r]:
                del rests[at]
            put(r - x, (*pattern[:-1], (x, pattern[-1][1] + 1)) if pattern[-1][0] == x else (*pattern, (x, 1)), m)
            c -= m
    return [(p, m) for held in free.values() for p, m in held.items() if m]


@dataclass
class Plan:
    """Patterns with multiplicities, the bins they make, the bins any plan needs, whether that is proven, and best fit's bins."""

    patterns: list[tuple[Pattern, int]]
    bins: int
    bound: int
    proven: bool
    best_fit: int


def search(counts: list[int], cap: int = CAP, steps: int = STEPS) -> Plan:
    """The best plan for the counts of lengths 0..cap that bin completion finds in so many steps."""
    bound = lower_bound(counts, cap)
    volume = sum(i * c for i, c in enumerate(counts))
    best = best_fit(counts, cap)
    bins = first = sum(m for _, m in best)
    budget = Budget(steps)
    open_ = list(counts)
    waste = made = 0

    def put(pattern: Pattern, m: int) -> None:
        nonlocal waste, made
        for x, a in pattern:
            open_[x] -= a * m
        waste += m * (cap - sum(x * a for x, a in pattern))
        made += m

    def options(top: int) -> Iterator[tuple[Pattern, int]]:
        """Bins that the largest open length can open, each with how often it is applied."""
        inside = list(open_)
        inside[top] -= 1
        for filling in fillings(cap - top, inside, budget, (bins - 1) * cap - volume - waste):
            whole = tuple(sorted((Counter(dict(filling)) + Counter({top: 1})).items(), reverse=True))
            for m in range(min(open_[x] // a for x, a in whole), 0, -1):
                yield whole, m

    def largest(top: int) -> int:
        while top > 0 and not open_[top]:
            top -= 1
        return top

    path: list[tuple[Pattern, int, int, Iterator]] = []
    top = largest(cap)
    tries = options(top) if top else None
    while bins > bound:
        if top == 0:
            if made < bins:
                best, bins = [(p, m) for p, m, _, _ in path], made
            step = None
        else:
            step = next(tries, None)
            if step is not None and path and step[0] == path[-1][0]:
                continue  # once more of the bin before: tried with the bin before
        if step is not None:
            path.append((*step, top, tries))
            put(*step)
            if waste <= (bins - 1) * cap - volume:
                top = largest(top)
                tries = options(top) if top else None
                continue
        elif budget.left < 0 or not path:
            break
        # Nothing to try here: back to the bin before.
        pattern, m, top, tries = path.pop()
        put(pattern, -m)
    return Plan(best, bins, bound, bins <= bound or budget.left >= 0, first)


def reopen(held: Counter, cap: int, rng: random.Random) -> Counter:
    """Bins that together waste a bin or more, the most wasteful or any, with a few times as many of any kind."""
    kinds = sorted(held)
    waste = {p: cap - sum(x * a for x, a in p) for p in kinds}
    order = sorted((p for p in kinds if waste[p]), key=lambda p: (-waste[p], p))
    if not rng.randrange(3):
        rng.shuffle(order)
    taken: Counter = Counter()
    goal, lost = rng.choice((1.0, 1.5, 2.0)) * cap, 0
    for p in order:
        if lost >= goal:
            break
        m = min(held[p], 1 + int(max(0, goal - lost) // waste[p]))
        taken[p] += m
        lost += m * waste[p]
    for _ in range(sum(taken.values()) * rng.choice((1, 2, 3)) + 10):
        p = rng.choice(kinds)
        taken[p] += taken[p] < held[p]
    return +taken


def plan(counts: list[int], cap: int = CAP, steps: int = STEPS, rounds: int = ROUNDS) -> Plan:
    """A plan that uses up the counts of lengths 0..cap."""
    found = search(counts, cap, steps)
    if found.proven:
        return found
    rng = random.Random(cap)  # the same plan for the same counts
    held, bins = Counter(), found.bins
    for p, m in found.patterns:
        held[p] += m
    idle = 0
    for _ in range(rounds):
        idle += 1
        taken = reopen(held, cap, rng)
        part = [0] * (cap + 1)
        for p, m in taken.items():
            for x, a in p:
                part[x] += a * m
        again = search(part, cap, ROUND_STEPS)
        before = sum(taken.values())
        if again.bins <= before:  # also where none is saved: other bins may be saved beside them
            held -= taken
            for p, m in again.patterns:
                held[p] += m
            if again.bins < before:
                bins, idle = bins - before + again.bins, 0
        if bins <= found.bound or idle >= STALL:
            break
    return Plan(sorted(held.items()), bins, found.bound, bins <= found.bound, found.best_fit)


def ranges(patterns: list[tuple[Pattern, int]], cap: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first bin, pieces a bin and first place of each stretch of ranks."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    bins = 0
    for pattern, m in patterns:
        at = 0
        for x, a in pattern:
            out.setdefault(x, []).append((used[x], bins, a, at))
            used[x] += a * m
            at += x * a
        bins += m
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for x, rows in out.items()}


class Encoder:
    """Token ids of whole texts, as the library gives them for the vocabulary file, as little-endian 32-bit arrays.

    The rank file of the same vocabulary gives the same ids (tests compare them at every code point) in a third of
    the time. Special strings, which ranks don't have, and runs of white space on which the faster library's pattern
    would run out of stack go through the vocabulary file itself, as does everything where no rank file is given.
    """

    def __init__(self, path: str, ranks: str | None):
        import regex
        from tokenizers import Tokenizer

        self.load = lambda: Tokenizer.from_file(path)
        self.exact = None
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.other = regex.compile("|".join([*map(regex.escape, special), r"\s{10000}"])).search
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                merge = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            #: Fixed: the published byte-level pre-tokenization pattern.
            split = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            self.fast = tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=merge, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not self.other(text):
            return np.asarray(self.fast.encode_ordinary(text), "<u4")
        if self.exact is None:
            self.exact = self.load()
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, "<u4")


def _encoder(path: str, ranks: str | None) -> Encoder:
    held = _encoder.__dict__.setdefault("held", {})
    if (path, ranks) not in held:
        held[path, ranks] = Encoder(path, ranks)
    return held[path, ranks]


def token_pieces(docs: DataFrame, path: str, ranks: str | None = None, cap: int = CAP, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: ids and the end token, longer ones cut, the first piece the shorter one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        encoder = _encoder(path, ranks)

        def step(batch: pa.RecordBatch) -> dict:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(texts_of(batch.column(1))):
                ids = np.append(encoder.encode(text), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                cuts = [0, *range(n % cap or cap, n + 1, cap)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    at.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(ids[a:b].tobytes()))
            return {"doc_id": batch.column(0).take(pa.array(at, pa.int64())), "piece": piece, "start": start, "length": length, "ids_crc32": crc}

        return step

    return map_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, cap: int = CAP) -> DataFrame:
    """The pieces with sequence_id and offset, in as few sequences of at most ``cap`` tokens as the search finds.

    ``pieces`` is a written table with a number of its own in each row, ``piece_row``, by which pieces are dealt to
    shards and ordered, so that neither null nor repeated ids meet in one. Whole pieces of ``cap`` tokens are
    sequences of their own, with negative ids.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    some = pieces.where(F.col("length") < cap)
    shards = max(1, min(SHARDS, -(-some.count() // SHARD_ROWS)))
    some = some.withColumn("shard", F.pmod(F.xxhash64("piece_row"), F.lit(shards)))
    counts = scratch.cut(some.groupBy("shard", "length").agg(F.count("*").alias("n")), "counts")
    totals = [0] * (cap + 1)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        totals[row["length"]] = row["n"]
    made = plan(totals, cap)
    if not made.proven:
        logging.getLogger(__name__).warning("%d sequences, best fit %d, lower bound %d: not proven least", made.bins, made.best_fit, made.bound)
    places = spark.sparkContext.broadcast(ranges(made.patterns, cap))

    earlier = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "length").orderBy("piece_row")
    ranked = some.withColumn("rank", F.row_number().over(within) - 1).join(base, ["shard", "length"])
    names = [c for c in pieces.columns if c != "piece_row"]
    ranked = ranked.select(*names, (F.col("rank") + F.col("base")).alias("rank"))

    def make():
        table = places.value

        def step(batch: pa.RecordBatch) -> dict:
            size, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            seq, at = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for x in np.unique(size):
                rows = np.flatnonzero(size == x)
                first, bins, a, place = table[int(x)]
                k = np.searchsorted(first, rank[rows], "right") - 1
                turn = rank[rows] - first[k]
                seq[rows] = bins[k] + turn // a[k]
                at[rows] = place[k] + turn % a[k] * x
            return {c: batch.column(c) for c in names} | {"sequence_id": seq, "offset": at}

        return step

    schema = type(pieces.schema)([pieces.schema[c] for c in names]).add("sequence_id", "long").add("offset", "long")
    whole = pieces.where(F.col("length") == cap).select(*names).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return map_arrow(ranked, make, schema).unionByName(whole)


def pack_documents(docs: DataFrame, path: str, ranks: str | None = None, cap: int = CAP, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every document."""
    pieces = Scratch(docs.sparkSession, "pieces").cut(token_pieces(docs, path, ranks, cap, end_id).withColumn("piece_row", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, cap)

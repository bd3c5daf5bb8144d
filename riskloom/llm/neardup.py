"""N-gram Jaccard join by grouped prefixes, and the components of its links.

Every document becomes the set of its distinct k-word shingles (64-bit hashes). Shingles are put in one
global order, rare first, by a fixed-size count sketch over all documents; any fixed order keeps the
join exact, the sketch only keeps passages that many documents share out of the prefixes. Two sets with
Jaccard >= num/den must share one of their first ``n - ceil(n*num/den) + 1`` shingles.

* Documents with the same set are one *class*; classes with the same prefix and size are one *group*.
  Only groups enter the prefix join, so thousands of copies cost one entry for each prefix shingle.
* Round 1 compares the groups of a prefix shingle with its pivot (the group in which it stands first, so
  the one with the fewest rare shingles of its own): as many pairs as entries. Verified pairs are linked
  and components formed.
* Round 2 takes the pairs that are left: groups that share a prefix shingle, pass the length and position
  filters and are not yet in one component. Members of group pairs are expanded and verified by text.
  Pairs inside one component need no test, as only components are asked for; no other pair is left out.

Nothing is capped: hot shingles are dealt out by plain equi-joins that the engine can split, hot classes
by partial aggregation. The driver sees only counts and the sketch of fixed size.

Null doc_id: the row takes no part and is not returned. Null or blank text: empty set, linked with
nothing, component is its own doc_id. Rows that repeat a doc_id with words in them count as one document of
all their texts when links are followed, and each is returned. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shingles import mix, shingle_sets
from .util import Scratch, fresh, map_arrow

SKETCH_BITS = 20
SLICES = 64
#: Ids that a broadcast filter may hold (8 bytes each); beyond it the same filter is a shuffled join.
BROADCAST_IDS = 1 << 18
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def need(n, num: int, den: int):
    """ceil(n * num / den)"""
    return -(-n * num // den)


def set_key(h: np.ndarray, n: int) -> bytes:
    """16 bytes that name a set of hashes and a size."""
    return b"".join((mix(h ^ s).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)).tobytes() for s in _SALT)


def sketch(docs: DataFrame, words: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Counts of shingles over all documents in 2**bits buckets. Tasks send sparse slices; sums are made in two steps."""
    width = (1 << bits) // SLICES

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for s in shingle_sets(batch.column(0), words):
                np.add.at(total, (s >> np.uint64(64 - bits)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        cut = np.searchsorted(at, np.arange(SLICES + 1) * width)
        salt = TaskContext.get().partitionId() % 64
        for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b > a:
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "salt": pa.array([salt], pa.int32()), "at": [at[a:b].astype("<i4").tobytes()], "n": [total[at[a:b]].astype("<i8").tobytes()]})

    def add(key, pdf):
        import pandas as pd

        total = np.zeros(width, np.int64)
        for at, n in zip(pdf["at"], pdf["n"], strict=True):
            np.add.at(total, np.frombuffer(at, "<i4") - key[0] * width, np.frombuffer(n, "<i8"))
        at = np.flatnonzero(total)
        return pd.DataFrame({"slice": [key[0]], "salt": [0], "at": [(at + key[0] * width).astype("<i4").tobytes()], "n": [total[at].astype("<i8").tobytes()]})

    schema = "slice int, salt int, at binary, n binary"
    parts = docs.select("text").mapInArrow(count, schema)
    sums = parts.groupBy("slice", "salt").applyInPandas(add, schema).groupBy("slice").applyInPandas(add, schema)
    out = np.zeros(1 << bits, np.int64)
    for row in sums.collect():
        out[np.frombuffer(row["at"], "<i4")] = np.frombuffer(row["n"], "<i8")
    return out


def signatures(docs: DataFrame, words: int, num: int, den: int, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n (set size), cls and grp (16-byte keys of class and group; null for empty sets), prefix."""
    spark = docs.sparkSession
    counts = sketch(docs, words, bits)
    rank = spark.sparkContext.broadcast(np.minimum(counts, 2**32 - 1).astype(np.uint32))

    def make():
        order = rank.value

        def step(batch: pa.RecordBatch) -> dict:
            n, cls, grp, prefix = [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                n.append(len(s))
                if not len(s):
                    cls.append(None), grp.append(None), prefix.append(None)
                    continue
                often = order[(s >> np.uint64(64 - bits)).astype(np.int64)]
                first = s[np.argsort(often, kind="stable")[: len(s) - need(len(s), num, den) + 1]]
                cls.append(set_key(s, len(s))), grp.append(set_key(first, len(s))), prefix.append(first.view(np.int64))
            return {"doc_id": batch.column(0), "n": n, "cls": cls, "grp": grp, "prefix": prefix}

        return step

    return map_arrow(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, n long, cls binary, grp binary, prefix array<long>")


def only(docs: DataFrame, ids: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Texts of the documents whose ids are listed, as a written table."""
    ids = scratch.cut(ids.distinct(), f"{name}-ids")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small = ids.count() <= BROADCAST_IDS
    found = texts.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    return scratch.cut(found, name)


def verify(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the threshold, tested on whole texts."""
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    return _verified(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b"), words, num, den)


def _verified(both: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The first two columns of the rows whose texts, the last two, reach the threshold."""

    def make():
        def step(batch: pa.RecordBatch) -> dict | None:
            keep = []
            for i, (x, y) in enumerate(zip(shingle_sets(batch.column(2), words), shingle_sets(batch.column(3), words), strict=True)):
                if len(x) and len(y):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if den * both >= num * (len(x) + len(y) - both):
                        keep.append(i)
            got = batch.take(pa.array(keep, pa.int64()))
            return {c: got.column(i) for i, c in enumerate(names)}

        return step

    names = both.columns[:2]
    return map_arrow(both, make, type(both.schema)([both.schema[c] for c in names]))


def _local_forest(links: DataFrame) -> DataFrame:
    """Within each batch the links shrink to (node, smallest node joined to it there)."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while (y := up.setdefault(x, x)) != x:
                    up[x] = up[y]
                    x = up[x]
                return x

            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            rows = [(x, top(x)) for x in list(up)]
            rows = [r for r in rows if r[0] != r[1]]
            return {"a": [r[0] for r in rows], "b": [r[1] for r in rows]}

        return step

    return map_arrow(links, make, "a long, b long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of the links, component the smallest node of it.

    Large-star and small-star steps in turn until nothing changes (O(log n) rounds); every step is written.
    """
    edges = scratch.cut(_local_forest(links.select("a", "b")), "forest")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())

    before = state(edges)
    while before[0]:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = scratch.cut(both.groupBy("a").agg(F.min("b").alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = scratch.cut(large, "large")
        least = scratch.cut(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        edges, old = scratch.cut(small, "small"), edges
        scratch.drop(old, large)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _fits(num: int, den: int, nx: str, px: str, ny: str, py: str):
    """Length filter and position filter at a shared prefix shingle."""
    return F.expr(f"{den} * least({nx}, {ny}) >= {num} * greatest({nx}, {ny}) AND {num + den} * (1 + least({nx} - {px} - 1, {ny} - {py} - 1)) >= {num} * ({nx} + {ny})")


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id for links of Jaccard >= num/den on sets of ``words``-word shingles."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    sig = scratch.cut(signatures(docs, words, num, den, sketch_bits), "signatures")
    full = sig.where("n > 0")

    classes = scratch.cut(full.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("grp").alias("grp"), F.min("n").alias("n")), "classes")
    groups = scratch.cut(classes.groupBy("grp").agg(F.min("rep").alias("g"), F.count("*").alias("members")), "groups")
    nodes = scratch.cut(classes.join(groups, "grp").select("rep", "n", "g", "members"), "nodes")

    # Entries (prefix shingle, group); at packs position and size so that one long orders and carries both.
    # One row stands for a group: of its class of smallest id (ids that repeat may give more than one).
    first = classes.join(groups, "grp").where("rep = g").select("cls", "grp", "g", "members").dropDuplicates(["grp"])
    heads = full.select("cls", F.col("doc_id").alias("g"), "n", "prefix").join(first, ["cls", "g"]).dropDuplicates(["grp"])
    entries = heads.select("g", "n", "members", F.posexplode("prefix").alias("pos", "token"))
    entries = scratch.cut(entries.select("token", "g", F.expr("shiftleft(cast(pos as long), 32) + n").alias("at"), "members"), "entries")
    scratch.drop()
    pivots = entries.groupBy("token").agg(F.count("*").alias("many"), F.sum("members").alias("classes"), F.expr("min_by(g, at)").alias("pg"), F.min("at").alias("pat"))
    pivots = scratch.cut(pivots.where("classes > 1"), "pivots")
    scratch.drop()
    shared = scratch.cut(entries.join(pivots, "token").selectExpr("token", "g", "at & 4294967295 as n", "shiftright(at, 32) as pos", "members", "classes", "pg", "pat & 4294967295 as pn", "shiftright(pat, 32) as ppos"), "shared")
    scratch.drop(entries, pivots)

    # Round 1: each group with the pivots of its shingles, each class with the head of its group.
    star = shared.where("g <> pg").where(_fits(num, den, "n", "pos", "pn", "ppos")).select(F.col("pg").alias("a"), F.col("g").alias("b"))
    star = star.union(nodes.where("rep <> g").select(F.col("g").alias("a"), F.col("rep").alias("b"))).distinct()
    star = scratch.cut(star, "star-pairs")
    texts = only(docs, star.select(F.col("a").alias("doc_id")).union(star.select("b")), scratch, "star-texts")
    # A document that repeats with other texts ties their classes together.
    repeated = scratch.cut(full.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated")
    ties = full.select("doc_id", "cls").join(repeated, "doc_id").join(classes.select("cls", "rep"), "cls").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = scratch.cut(verify(star, texts, words, num, den).unionByName(ties), "star-links")
    scratch.drop(texts)
    comps = scratch.cut(components(links, scratch), "star-components")

    # Round 2: what may still link two components.
    placed = nodes.join(comps, nodes["rep"] == comps["node"], "left").select("rep", "n", "g", "members", F.coalesce("component", "rep").alias("c"))
    placed = scratch.cut(placed, "placed")
    spread = scratch.cut(placed.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")), "spread")
    open_ = shared.where("classes > 2").select("token", "g", "n", "pos", "pg").join(spread, "g")
    open_ = scratch.cut(open_, "open")
    mixed = open_.groupBy("token").agg(F.min("lo").alias("t_lo"), F.max("hi").alias("t_hi"), F.max(F.expr("case when g = pg then lo end")).alias("main"))
    mixed = scratch.cut(mixed.where("t_lo <> t_hi").select("token", "main"), "mixed")
    left = scratch.cut(open_.join(mixed, "token").selectExpr("token", "g", "n", "pos", "lo", "hi", "not (lo = main and hi = main) as minor"), "left")
    x = left.where("minor").selectExpr("token", "g as gx", "n as nx", "pos as px", "lo as lx", "hi as hx")
    y = left.selectExpr("token", "g as gy", "n as ny", "pos as py", "lo as ly", "hi as hy", "minor")
    pairs = x.join(y, "token").where("gx <> gy and (not minor or gx < gy) and not (lx = hx and ly = hy and lx = ly)").where(_fits(num, den, "nx", "px", "ny", "py"))
    pairs = scratch.cut(pairs.select("gx", "gy").distinct(), "group-pairs")
    one = placed.selectExpr("g as gx", "rep as a", "c as ca", "n as na")
    two = placed.selectExpr("g as gy", "rep as b", "c as cb", "n as nb")
    rest = pairs.join(one, "gx").join(two, "gy").where("ca <> cb").select("a", "b")
    inner = scratch.cut(spread.where("lo <> hi").select("g"), "inner")
    rest = rest.union(placed.join(inner, "g").selectExpr("g as gx", "rep as a", "c as ca").join(two.withColumnRenamed("gy", "gx"), "gx").where("ca <> cb and a < b").select("a", "b"))
    rest = scratch.cut(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    if not rest.isEmpty():
        texts = only(docs, rest.select(F.col("a").alias("doc_id")).union(rest.select("b")), scratch, "texts")
        more = scratch.cut(verify(rest, texts, words, num, den), "links")
        scratch.drop(texts)
        if not more.isEmpty():
            comps = scratch.cut(components(more.union(comps.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch), "components")

    named = classes.join(comps, classes["rep"] == comps["node"], "left").select("cls", F.coalesce("component", "rep").alias("component"), "rep", "copies")
    named = scratch.cut(named.where("copies > 1 or component <> rep").select("cls", "component"), "named")
    out = sig.select("doc_id", "n", "cls").join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def jaccard_pairs(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, sketch_bits: int = SKETCH_BITS) -> tuple[DataFrame, DataFrame]:
    """(links, members) of the whole join: every link between different sets, none left out because others imply it.

    links: a, b (a < b), the smallest doc_ids of two sets with Jaccard >= num/den. members: doc_id, n_shingles, rep
    (the smallest doc_id with the same set; null for rows without words) and links, the number of other documents
    linked with the row's text: copies of its own set and all copies of the sets linked with it. Rows that repeat a
    doc_id count each.
    """
    scratch = Scratch(docs.sparkSession, "pairs")
    sig = scratch.cut(signatures(docs, words, num, den, sketch_bits), "signatures")
    full = sig.where("n > 0")
    classes = scratch.cut(full.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("grp").alias("grp"), F.min("n").alias("n"), F.min("prefix").alias("prefix")), "classes")
    # A doc_id that repeats may be the smallest of two sets: sets are told apart by their keys until the end.
    groups = scratch.cut(classes.groupBy("grp").agg(F.min("n").alias("n"), F.min("prefix").alias("prefix"), F.count("*").alias("sets")), "groups")
    entries = scratch.cut(groups.select("grp", "n", F.posexplode("prefix").alias("pos", "token")), "entries")
    often = entries.groupBy("token").count().where("count > 1").select("token")
    entries = scratch.cut(entries.join(often, "token"), "shared")
    x, y = (entries.select("token", *(F.col(c).alias(f"{c}_{side}") for c in ("grp", "n", "pos"))) for side in "xy")
    pairs = x.join(y, "token").where("grp_x < grp_y").where(_fits(num, den, "n_x", "pos_x", "n_y", "pos_y")).select("grp_x", "grp_y").distinct()
    same = groups.where("sets > 1").select(F.col("grp").alias("grp_x"), F.col("grp").alias("grp_y"))
    pairs = scratch.cut(pairs.union(same), "group-pairs")
    one, two = (classes.select(F.col("grp").alias(f"grp_{side}"), F.col("cls").alias(f"cls_{side}"), F.col("rep").alias(f"rep_{side}")) for side in "xy")
    sets = scratch.cut(pairs.join(one, "grp_x").join(two, "grp_y").where("grp_x <> grp_y or cls_x < cls_y").select("cls_x", "rep_x", "cls_y", "rep_y"), "set-pairs")
    keyed = full.select("cls", "doc_id").join(classes.select("cls", F.col("rep").alias("doc_id")), ["cls", "doc_id"], "left_semi").distinct()
    wanted = scratch.cut(sets.select(F.col("cls_x").alias("cls")).union(sets.select("cls_y")).distinct().join(keyed, "cls"), "wanted")
    texts = scratch.cut(_texts_by_set(docs, wanted, words), "texts")
    side = lambda c: texts.select(F.col("cls").alias(f"cls_{c}"), F.col("text").alias(f"text_{c}"))
    both = sets.join(side("x"), "cls_x").join(side("y"), "cls_y").select("cls_x", "cls_y", "text_x", "text_y")
    linked = scratch.cut(_verified(both, words, num, den), "linked")
    ends = linked.union(linked.select("cls_y", "cls_x")).toDF("cls", "other")
    beside = ends.join(classes.select(F.col("cls").alias("other"), "copies"), "other").groupBy("cls").agg(F.sum("copies").alias("beside"))
    counted = classes.join(beside, "cls", "left").select("cls", "rep", (F.col("copies") - 1 + F.coalesce("beside", F.lit(0))).alias("links"))
    members = sig.join(counted, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), "rep", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    reps = classes.select("cls", "rep")
    links = linked.join(reps.toDF("cls_x", "x"), "cls_x").join(reps.toDF("cls_y", "y"), "cls_y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return links, members


def _texts_by_set(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """cls and a text that has it, for the sets in ``wanted`` (cls, doc_id)."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id")

    def make():
        def step(batch: pa.RecordBatch) -> dict | None:
            keep = [i for i, (s, c) in enumerate(zip(shingle_sets(batch.column(0), words), batch.column(1).to_pylist(), strict=True)) if len(s) and set_key(s, len(s)) == c]
            got = batch.take(pa.array(keep, pa.int64()))
            return {"cls": got.column(1), "text": got.column(0)}

        return step

    return map_arrow(rows.select("text", "cls"), make, "cls binary, text string").groupBy("cls").agg(F.min("text").alias("text"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The documents without those that stand behind another of their component; all columns stay.

    Rows without doc_id, and rows without words, are kept: they take no part in the join. Of rows that repeat the
    doc_id that stays, with words in them, one stays: that of the smallest text, the first written of equal ones.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    columns = list(docs.columns)
    gone_id, again_id, row, has_words = fresh(columns, "gone_id", "again_id", "row", "has_words")
    found = scratch.cut(jaccard_components(docs, words, num, den), "found")
    gone = scratch.cut(found.where("component_id <> doc_id").select(F.col("doc_id").alias(gone_id)).distinct(), "gone")
    kept = docs.join(gone, docs["doc_id"] == gone[gone_id], "left_anti")
    again = found.where("component_id = doc_id and n_shingles > 0").groupBy("doc_id").count().where("count > 1")
    again = scratch.cut(again.select(F.col("doc_id").alias(again_id)), "again")
    if again.isEmpty():
        return kept
    # Rows of repeated ids get a number of their own, and a partial aggregation finds the one that stays.
    on = kept["doc_id"].cast("long") == again[again_id]
    some = kept.join(again, on).withColumns({row: F.monotonically_increasing_id(), has_words: F.col("text").rlike(r"[^\x20\x09-\x0D]")})
    some = scratch.cut(some, "repeated")
    first = some.where(has_words).groupBy(F.col(again_id).alias("first_of")).agg(F.min(F.struct("text", row)).alias("first")).select(F.col(f"first.{row}").alias(gone_id))
    ones = some.join(first, some[row] == first[gone_id], "left").where(~F.col(has_words) | F.col(gone_id).isNotNull())
    return kept.join(again, on, "left_anti").select(*columns).unionByName(ones.select(*columns))

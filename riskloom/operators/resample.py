"""Bootstraps with hash weights, deterministic stratified samples, fingerprints."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import stored
from ..functions.scalars import uniform
from .quantiles import spread

#: Cumulative Poisson(1) probabilities of 0, 1, 2, … (fixed values).
POISSON_1 = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


#: The same as the first 32 bits of a hash in hex: a draw counts one for each bound that its hex digits reach.
POISSON_HEX = tuple(f"{math.ceil(p * 2**32):08x}" for p in POISSON_1)
#: Draws that one SHA-256 gives.
DRAWS = 8


def poisson_weight(u: Column) -> Column:
    """A Poisson(1) count from a uniform number: how often a row is drawn in a replicate."""
    return sum(((u >= p).cast("int") for p in POISSON_1), F.lit(0))


def replicates(df: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """df with replicate 1..n and a weight; rows drawn 0 times are left out. One hash gives a row's draws of eight replicates."""
    per = df.sparkSession.range(-(-n // DRAWS)).select(F.col("id").cast("int").alias("turn"))
    text = F.concat_ws("|", F.lit(seed), F.col("turn").cast("string"), F.col(key).cast("string"))
    # A row becomes n of them, so they are dealt out first; the generators keep hash and draws columns of their own, so that
    # neither is computed once for each use.
    wide = df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism).crossJoin(F.broadcast(per))
    hashed = wide.select(*df.columns, "turn", F.explode(F.array(F.sha2(text, 256))).alias("hash"))
    draws = F.array(*(F.substring("hash", 8 * i + 1, 8) for i in range(DRAWS)))
    drawn = hashed.select(*df.columns, "turn", F.posexplode(draws).alias("nth", "draw")).where(F.col("draw") >= POISSON_HEX[0])
    weight = F.lit(len(POISSON_HEX))
    for i, bound in reversed(list(enumerate(POISSON_HEX[1:], 1))):
        weight = F.when(F.col("draw") < bound, i).otherwise(weight)
    return drawn.select(*df.columns, (F.col("turn") * DRAWS + F.col("nth") + 1).alias("replicate"), weight.alias("weight")).where(F.col("replicate") <= n)


def poisson_table(spark: SparkSession, mean: int) -> DataFrame:
    """k and cdf of a Poisson distribution over all k that a 32-bit draw can meet: some 20 square roots of the mean."""
    if mean <= 0:
        return spark.createDataFrame([(0, 1.0)], "k long, cdf double")
    reach = 12 * math.isqrt(mean) + 40
    k = F.col("id").cast("double")
    # ln k! by Stirling's series at k + 8, less the factors in between.
    z = k + 9
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    log_factorial = series - sum((F.ln(k + i) for i in range(1, 9)), F.lit(0.0))
    rows = spark.range(max(0, mean - reach), mean + reach + 1).select(F.col("id").alias("k"), F.exp(k * math.log(mean) - mean - log_factorial).alias("p"))
    return rows.select("k", F.sum("p").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).alias("cdf"))


def poisson_draws(spark: SparkSession, mean: int, n: int, seed: str) -> DataFrame:
    """replicate 1..n and a Poisson count: the least k whose cdf exceeds the replicate's uniform number. Draws and table (both bounded) are merged in order."""
    u = spark.range(1, n + 1).select(F.col("id").cast("int").alias("replicate"), uniform(seed, "id").alias("at"), F.lit(None).cast("long").alias("k"))
    t = poisson_table(spark, mean).select(F.lit(None).cast("int").alias("replicate"), F.col("cdf").alias("at"), F.col("k"))
    # Table rows come before draws of the same value, as a cdf must exceed the draw.
    before = Window.orderBy("at", F.col("replicate").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    least = max(0, mean - 12 * math.isqrt(mean) - 40) if mean > 0 else 0
    merged = u.unionByName(t).withColumn("count", F.coalesce(F.max("k").over(before) + 1, F.lit(least)))
    return merged.where("replicate is not null").select("replicate", F.when(F.lit(mean > 0), F.col("count")).otherwise(F.lit(0)).cast("long").alias("count"))


def delta_bootstrap(df: DataFrame, delta: str, n: int, seed: str) -> DataFrame:
    """Replicate totals of a column of -1, 0 and 1 from its counts (two numbers come to the driver).

    c rows drawn Poisson(1) times each are together drawn Poisson(c) times, so no row meets a replicate.
    """
    less, more = df.agg(F.count_if(F.col(delta) == -1), F.count_if(F.col(delta) == 1)).first()
    a = poisson_draws(df.sparkSession, more, n, f"{seed}+")
    b = poisson_draws(df.sparkSession, less, n, f"{seed}-").withColumnRenamed("count", "less")
    return a.join(b, "replicate").select("replicate", (F.col("count") - F.col("less")).alias("total"))


#: Buckets of a replicate's scores in which running sums are taken.
SCORE_BUCKETS = 32


#: Buckets of scores in which the step of a row is looked for.
STEP_BUCKETS = 2048


def positive_steps(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """df with its score lowered to the largest score of a positive at or below it, NULL where there is none.

    Average precision looks at the scores of positives only, so it is the same on these, and rows of one step can be
    added up before anything is ordered. Two steps: inside buckets of scores, then the largest of the buckets below.
    """
    bucket = spread(df, score, F.floor(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) * STEP_BUCKETS).cast("int"))
    hit = F.when(F.col(label) == 1, F.col(score))
    x = df.withColumn("bucket_", bucket)
    below = Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    base = x.groupBy("bucket_").agg(F.max(hit).alias("top_")).select("bucket_", F.max("top_").over(below).alias("below_"))
    inside = Window.partitionBy("bucket_").orderBy(score).rangeBetween(Window.unboundedPreceding, 0)
    run = x.withColumn("inside_", F.max(hit).over(inside)).join(F.broadcast(base), "bucket_")
    return run.withColumn(score, F.coalesce("inside_", "below_")).select(*df.columns)


def stratified_average_precision(df: DataFrame, by: Sequence[str], positives: int, negatives: int, score: str = "score", label: str = "label", weight: str = "weight") -> DataFrame:
    """Average precision of weighted rows, group by group (a group is a replicate of one model).

    Weights of each label are scaled to the rows it has, as if positives and negatives had been drawn apart. Running
    sums go in two steps over score buckets; rows of one score count together.
    """
    steps = df.groupBy(*by, score).agg(F.sum(F.col(weight) * F.col(label)).alias("tp"), F.sum(F.col(weight) * (1 - F.col(label))).alias("fp"))
    # Rows without a score lie below all others.
    steps = steps.withColumn("bucket", F.coalesce(F.floor(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) * SCORE_BUCKETS).cast("int"), F.lit(-1)))
    inside = Window.partitionBy(*by, "bucket").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    run = steps.withColumns({"ct": F.sum("tp").over(inside), "cf": F.sum("fp").over(inside)})
    sums = steps.groupBy(*by, "bucket").agg(F.sum("tp").alias("bt"), F.sum("fp").alias("bf"))
    above = Window.partitionBy(*by).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    base = sums.select(*by, "bucket", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"above_{c}") for c in ("bt", "bf")), *(F.sum(c).over(whole).alias(f"all_{c}") for c in ("bt", "bf")))
    c = run.where("tp > 0").join(base, [*by, "bucket"])
    hits = (F.col("above_bt") + F.col("ct")) * (positives / F.col("all_bt"))
    misses = (F.col("above_bf") + F.col("cf")) * (negatives / F.greatest(F.col("all_bf"), F.lit(1)))
    return c.groupBy(*by).agg(F.sum(F.col("tp") / F.col("all_bt") * hits / (hits + misses)).alias("average_precision"))


#: Rows of a run of scores, and rows whose draws are held at once.
RUN, CHUNK = 20_000, 1000


def _weights(keys, n: int, seed: str):
    """Poisson(1) counts of rows (down) in replicates 1..n (across): those of `replicates`."""
    import hashlib

    import numpy as np

    heads = [f"{seed}|{turn}|".encode() for turn in range(-(-n // DRAWS))]
    digests = b"".join(hashlib.sha256(h + k).digest() for k in (str(k).encode() for k in keys) for h in heads)
    draws = np.frombuffer(digests, ">u4").astype(np.uint32).reshape(len(keys), -1)[:, :n]
    return np.searchsorted(np.array([int(h, 16) for h in POISSON_HEX], dtype=np.uint32), draws, side="right").astype(np.int16)


def _hits(rows, n: int, seed: str, at: slice):
    """(positives, negatives) drawn in each replicate, row by row, of some rows."""
    w = _weights(rows["key"].to_numpy()[at], n, seed)
    y = rows["label"].to_numpy()[at, None].astype(w.dtype)
    return w * y, w * (1 - y)


def replicated_average_precision(df: DataFrame, n: int, seed: str, positives: int, negatives: int, key: str = "key", score: str = "score", label: str = "label", by: str = "model") -> DataFrame:
    """(by, replicate, average_precision): stratified_average_precision on the replicates of df, none of which becomes a row.

    Rows go in runs of falling scores. A run's draws are added up a thousand rows at a time as arrays over the replicates; then running
    sums over runs (a row for each run and replicate) give every run what lies above it, and its draws are made again for its
    share of the precision. Rows of one score lie in one run; rows without a score lie below all and are dealt out by key.
    """
    import numpy as np
    import pandas as pd

    rows = df.select(F.col(by).alias("by"), F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.col(score).alias("score"))
    counted = rows.agg(F.count("score"), F.count("*")).first()
    runs, rest = (max(1, math.ceil(c / RUN)) for c in (counted[0], counted[1] - counted[0]))
    above = rows.where("score is not null").repartitionByRange(runs, F.col("by"), F.desc("score")).withColumn("run", F.spark_partition_id())
    below = rows.where("score is null").withColumn("run", (runs + F.pmod(F.xxhash64("key"), F.lit(rest))).cast("int"))
    # Rows are few and each costs much, so their number of tasks is given: by size, they would be put together into one.
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    x = stored(above.unionByName(below)).repartition(tasks, "by", "run")

    def total(keys, part):
        sums = np.zeros((2, n), dtype=np.int64)
        for a in range(0, len(part), CHUNK):
            sums += [h.sum(axis=0, dtype=np.int64) for h in _hits(part, n, seed, slice(a, a + CHUNK))]
        return pd.DataFrame({"by": keys[0], "run": keys[1], "replicate": np.arange(1, n + 1, dtype=np.int32), "tp": sums[0], "fp": sums[1]})

    sums = x.groupBy("by", "run").applyInPandas(total, "by string, run int, replicate int, tp long, fp long")
    group = Window.partitionBy("by", "replicate")
    before = group.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("by", "run", "replicate", "tp", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"above_{c}") for c in ("tp", "fp")), *(F.sum(c).over(group).alias(f"all_{c}") for c in ("tp", "fp")))

    def precision(keys, part, base):
        part, base = part.sort_values("score", ascending=False), base.sort_values("replicate")
        ct, cf, pt, pf = (base[c].to_numpy().astype(float) for c in ("above_tp", "above_fp", "all_tp", "all_fp"))
        p, q = positives / np.maximum(pt, 1), negatives / np.maximum(pf, 1)
        scores, found = part["score"].to_numpy(), np.zeros(n)
        starts = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1]])
        ends = np.r_[starts[1:], len(scores)]
        i = 0
        while i < len(starts):
            # Whole steps up to a thousand rows, or one step, which may be longer.
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
            tp, fp = np.zeros((j - i, n), dtype=np.int64), np.zeros((j - i, n), dtype=np.int64)
            for a in range(int(starts[i]), int(ends[j - 1]), CHUNK):
                b = min(a + CHUNK, int(ends[j - 1]))
                t, f = _hits(part, n, seed, slice(a, b))
                cuts = starts[i:j] - a if j - i > 1 else [0]
                tp += np.add.reduceat(t, cuts, axis=0, dtype=np.int64)
                fp += np.add.reduceat(f, cuts, axis=0, dtype=np.int64)
            hits, misses = (ct + tp.cumsum(axis=0)) * p, (cf + fp.cumsum(axis=0)) * q
            found += np.where(tp > 0, tp / np.maximum(pt, 1) * hits / np.maximum(hits + misses, 1e-300), 0.0).sum(axis=0)
            ct, cf, i = ct + tp.sum(axis=0), cf + fp.sum(axis=0), j
        return pd.DataFrame({"by": keys[0], "replicate": base["replicate"].to_numpy(), "found": found})[pt > 0]

    scored = x.where("score is not null").groupBy("by", "run").cogroup(base.where(F.col("run") < runs).repartition(tasks, "by", "run").groupBy("by", "run"))
    parts = scored.applyInPandas(precision, "by string, replicate int, found double")
    # Rows without a score are one step, the last: all rows lie at or above it.
    last = (F.col("run") >= runs) & (F.col("tp") > 0)
    share = F.col("tp") / F.col("all_tp") * positives / (positives + F.col("all_fp") * (negatives / F.greatest(F.col("all_fp"), F.lit(1))))
    parts = parts.unionByName(base.where(last).select("by", "replicate", share.alias("found")))
    return parts.groupBy(F.col("by").alias(by), "replicate").agg(F.sum("found").alias("average_precision"))


def stratified(df: DataFrame, strata: Sequence[str], per: int, seed: str, key: str) -> DataFrame:
    """Exactly ``per`` rows of each stratum (all, if fewer): those of smallest hash."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    w = Window.partitionBy(*strata).orderBy(h, key)
    return df.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= per).drop("draw")


def fingerprint(df: DataFrame, key: str, value: str, places: int = 6, width: int = 1024, flat: bool = False) -> DataFrame:
    """One digest of rounded values in key order: digests of blocks of ``width`` keys, digests of as many of those, and so on up to one.

    No task holds more than ``width`` digests of a group, however many rows there are. flat: all digests of blocks are digested
    at once, whatever their number; they pass by in order (64 bytes a block, sorted on disk where need be) and none is kept.
    """
    text = F.concat_ws(":", F.col(key).cast("string"), F.format_string(f"%.{places}f", F.round(value, places)))
    joined = lambda k, t: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), t.alias("t")))), lambda x: x["t"]), ","), 256)
    levels = df.groupBy(F.floor(F.col(key) / width).alias("block")).agg(joined(F.col(key), text).alias("d"), F.count("*").alias("n"))
    if flat:
        return levels.repartition(1).sortWithinPartitions("block").select("n", "d").mapInArrow(_digest, "rows long, fingerprint string").agg(F.max("rows").alias("rows"), F.max("fingerprint").alias("fingerprint"))
    low, high = df.agg(F.min(key), F.max(key)).first()
    low, high = (low or 0) // width, (high or 0) // width
    while low != high:
        up = F.floor(F.col("block") / width).alias("block")
        levels = levels.groupBy(up).agg(joined(F.col("block"), F.col("d")).alias("d"), F.sum("n").alias("n"))
        low, high = low // width, high // width
    return levels.select(F.col("n").alias("rows"), F.col("d").alias("fingerprint"))


def _digest(batches):
    """Rows and digest of the digests that pass by, joined by commas; a single one is its own digest, none is NULL."""
    import hashlib

    import pyarrow as pa

    rows, blocks, only, state = 0, 0, None, hashlib.sha256()
    for batch in batches:
        rows += sum(batch.column(0).to_pylist())
        for d in batch.column(1).to_pylist():
            only = d
            state.update(f",{d}".encode() if blocks else d.encode())
            blocks += 1
    yield pa.RecordBatch.from_pydict({"rows": pa.array([rows if blocks else None], pa.int64()), "fingerprint": pa.array([state.hexdigest() if blocks > 1 else only], pa.string())})

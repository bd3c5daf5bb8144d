"""Queries on entity linking; customers are the entities of the fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import cut, once, stored
from ..operators import linking
from ..sources.tables import table
from .registry import query

KEY = "a-test-key-of-32-bytes-0123456789"
SEED = "17"
#: Settings: name, corruption rate, signals that it touches. The name is part of the hash of every draw, so _2 and _3 are other seeds of a rate;
#: nothing is drawn at rate 0.
_ALL = "email phone device address"
ARMS = (
    ("clean", 0.0, _ALL), ("low", 0.15, _ALL), ("high", 0.30, _ALL), ("strong_only", 1.0, "email phone"), ("weak_only", 1.0, "device address"),
    *((f"slight{n}", 0.05, _ALL) for n in ("", "_2", "_3")), *((f"{a}_{n}", r, _ALL) for a, r in (("low", 0.15), ("high", 0.30)) for n in (2, 3)),
)

_U = lambda *k: "CAST(CAST('0x' || substr(sha256(" + " || '|' || ".join([f"'{SEED}'", *k]) + "), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296e0"
_H = lambda *k: "sha256(" + " || '|' || ".join([f"'{SEED}'", *k]) + ")"


def _hmac_sql(message: str) -> str:
    block = KEY.encode().ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in block).hex() for p in (0x36, 0x5C))
    return f"substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message})))), 1, 32)"


def _corrupt_sql(s: str) -> str:
    h = f"CAST(CAST('0x' || substr({_H(chr(39) + 'how' + chr(39), 'arm', 'CAST(pos AS VARCHAR)', chr(39) + s + chr(39))}, 1, 8) AS UBIGINT) AS BIGINT)"
    at = f"CAST({h} % (length({s}) - 1) + 1 AS BIGINT)"
    u = _U("'corrupt'", "arm", "CAST(pos AS VARCHAR)", f"'{s}'")
    one, two, rest = f"substr({s}, 1, {at} - 1)", f"substr({s}, {at}, 1)", f"substr({s}, {at} + 1)"
    return f"""CASE WHEN {u} >= CASE WHEN copy = 2 AND contains(signals, '{s}') THEN rate ELSE 0 END THEN {s} WHEN ({h} // 65536) % 3 = 0 THEN {one} || {rest}
      WHEN ({h} // 65536) % 3 = 1 THEN {one} || 'x' || {rest} ELSE {one} || substr({s}, {at} + 1, 1) || {two} || substr({s}, {at} + 2) END AS {s}"""


_ARMS_SQL = "arms(arm, rate, signals) AS (VALUES " + ", ".join(f"('{a}', CAST({r} AS DOUBLE), '{s}')" for a, r, s in ARMS) + ")"
_FIX = f"""{_ARMS_SQL}, e AS (SELECT c_custkey AS entity, CASE WHEN (c_custkey // 5) % 10 = 0 THEN c_custkey // 5 END AS ring, CASE WHEN {_U("'dup'", "CAST(c_custkey AS VARCHAR)")} < 5e-2 THEN 2 ELSE 1 END AS copies, (SELECT max(c_custkey) FROM customer) AS top FROM customer),
r AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM e), c AS (SELECT entity, ring, copy, CASE WHEN copy = 1 THEN entity - 1 ELSE top + entity - 1 END AS pos,
  substr({_H("'email'", "CAST(entity AS VARCHAR)")}, 1, 12) || '@example.com' AS email, lpad(CAST(CAST(CAST('0x' || substr({_H("'phone'", "CAST(entity AS VARCHAR)")}, 1, 12) AS UBIGINT) AS BIGINT) % 10000000000 AS VARCHAR), 10, '0') AS phone,
  substr({_H("'device'", "coalesce('ring' || CAST(ring AS VARCHAR), CAST(entity AS VARCHAR))")}, 1, 16) AS device, substr({_H("'address'", "coalesce('ring' || CAST(ring AS VARCHAR), CAST(entity AS VARCHAR))")}, 1, 14) || ' Street' AS address FROM r),
fixture AS (SELECT arm, pos, entity, ring, {", ".join(_corrupt_sql(s) for s in linking.SIGNALS)} FROM c, arms)"""
_TOK = f"""{_FIX}, long AS ({" UNION ALL ".join(f"SELECT arm, pos, '{s}' AS signal_type, regexp_replace(lower({s}), '[^a-z0-9]', '', 'g') AS v FROM fixture" for s in linking.SIGNALS)}),
grams AS (SELECT *, list_distinct(list_transform(range(1, length(v) + 3), lambda i: substr('^^' || v || '$$', CAST(i AS BIGINT), 3))) AS g FROM long),
tokens AS (SELECT arm, pos, signal_type, {_hmac_sql("signal_type || '|' || v")} AS exact_token, list_sort(list_transform(g, lambda x: {_hmac_sql("signal_type || '-ngram|' || x")})) AS fuzzy_tokens FROM grams)"""
_PAIRS = f"""{_TOK}, blocks AS (SELECT arm, signal_type, exact_token FROM tokens GROUP BY ALL HAVING count(*) BETWEEN 2 AND 20), b AS (SELECT t.arm, signal_type, exact_token, pos FROM tokens t JOIN blocks USING (arm, signal_type, exact_token)),
pairs AS (SELECT DISTINCT x.arm, x.pos AS l, y.pos AS r FROM b x JOIN b y ON x.arm = y.arm AND x.signal_type = y.signal_type AND x.exact_token = y.exact_token AND x.pos < y.pos)"""
_SIM = lambda s: f"CASE WHEN a.{s}_e = z.{s}_e THEN 1e0 ELSE 2e0 * len(list_intersect(a.{s}_f, z.{s}_f)) / (len(a.{s}_f) + len(z.{s}_f)) END"
_SCORED = f"""{_PAIRS}, wide AS (SELECT arm, pos, {", ".join(f"max(exact_token) FILTER (WHERE signal_type = '{s}') AS {s}_e, any_value(fuzzy_tokens) FILTER (WHERE signal_type = '{s}') AS {s}_f" for s in linking.SIGNALS)} FROM tokens GROUP BY 1, 2),
sp AS (SELECT p.arm, l, r, round({" + ".join(f"{linking.WEIGHTS[s]!r} * ({_SIM(s)})" for s in linking.SIGNALS)}, 6) AS score, a.email_e = z.email_e OR a.phone_e = z.phone_e AS strong FROM pairs p JOIN wide a ON a.arm = p.arm AND a.pos = l JOIN wide z ON z.arm = p.arm AND z.pos = r),
scored_pairs AS (SELECT *, strong AND score >= 72e-2 AS accepted FROM sp)"""
_COMP = f"""RECURSIVE {_SCORED}, edges AS (SELECT arm, l AS a, r AS b FROM scored_pairs WHERE accepted UNION SELECT arm, r, l FROM scored_pairs WHERE accepted),
reach AS (SELECT arm, pos AS a, pos AS b FROM fixture UNION SELECT reach.arm, reach.a, edges.b FROM reach JOIN edges ON reach.arm = edges.arm AND reach.b = edges.a), clusters AS (SELECT arm, a AS pos, min(b) AS cluster FROM reach GROUP BY 1, 2)"""
_RINGS = f"""{_SCORED}, dev AS (SELECT w.arm, w.pos, device_e, address_e, ring FROM wide w JOIN fixture f ON f.arm = w.arm AND f.pos = w.pos), sz AS (SELECT arm, device_e, address_e, count(*) AS members, list_sort(list(pos)) AS p FROM dev GROUP BY 1, 2, 3 HAVING count(*) BETWEEN 3 AND 12),
same AS (SELECT arm, device_e, address_e, max(n) AS same FROM (SELECT arm, device_e, address_e, ring, count(*) AS n FROM dev WHERE ring IS NOT NULL GROUP BY ALL) GROUP BY ALL),
rings AS (SELECT sz.arm, members, p[1] AS first_pos, p[3] AS flag_pos, p[3] - p[1] AS applications_to_flag, coalesce(same, 0) >= 3 AS confirmed FROM sz LEFT JOIN same USING (arm, device_e, address_e))"""


def _arms(spark):
    return linking.numbered(spark.createDataFrame(list(ARMS), "arm string, rate double, signals string"), [a for a, *_ in ARMS])


def _fixture(spark, sf):
    return linking.fixture(_entities(spark, sf), _arms(spark).drop("bit"), SEED)


def _entities(spark, sf):
    return table(spark, sf, "customer", "c_custkey").withColumnRenamed("c_custkey", "id")


def fixture_size(spark, sf):
    """The number of rows (n) of the fixture: none of its signals is made."""
    return linking.originals(_entities(spark, sf), SEED).crossJoin(F.broadcast(_arms(spark))).agg(F.count("*").alias("n"))


def _compact(spark, sf):
    """The fixture, a row for all arms in which a record is the same, written once."""
    return stored(linking.compact_fixture(_entities(spark, sf), _arms(spark), SEED))


def _pairs(recs):
    # Tokens only tell blocks apart here: their 16 bytes do that as well as 32 hex digits.
    toks = stored(linking.tokens(recs, KEY, ("arms", "pos")).select("arms", "pos", "signal_type", F.unhex("exact_token").alias("exact_token")))
    return linking.compact_pairs(toks, len(ARMS))


def _scored_pairs(spark, recs):
    return linking.apart(linking.score_compact(_pairs(recs), recs, KEY), _arms(spark)).drop("bit")


def _accepted(spark, recs):
    return _scored_pairs(spark, recs).where("accepted")


def _metrics(spark, sf):
    return once(("link_metrics", sf), lambda: _measured(spark, sf))


def _measured(spark, sf):
    recs = _compact(spark, sf)
    return linking.pair_metrics(_accepted(spark, recs), linking.apart(linking.repeated(recs), _arms(spark)))


def _exact(fix):
    """The exact tokens, written once: blocks, pairs and rings read them."""
    return cut(linking.tokens(fix, KEY).drop("fuzzy_tokens"))


@query(f"WITH {_FIX} SELECT * FROM fixture")
def link_fixture(spark, sf):
    return _fixture(spark, sf)


@query(f"WITH {_TOK} SELECT arm, pos, signal_type, exact_token, len(fuzzy_tokens) AS n_fuzzy, sha256(array_to_string(fuzzy_tokens, ',')) AS fuzzy_digest FROM tokens")
def link_tokens(spark, sf):
    t = linking.tokens(_compact(spark, sf), KEY, ("arms", "pos")).select("arms", "pos", "signal_type", "exact_token", F.explode(F.array("fuzzy_tokens")).alias("f"))
    t = t.select("arms", "pos", "signal_type", "exact_token", F.size("f").cast("long").alias("n_fuzzy"), F.sha2(F.array_join("f", ","), 256).alias("fuzzy_digest"))
    return linking.apart(t, _arms(spark)).drop("bit")


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def link_candidate_pairs(spark, sf):
    return linking.apart(_pairs(_compact(spark, sf)), _arms(spark)).select("arm", "l", "r")


@query(f"WITH {_SCORED} SELECT * FROM scored_pairs")
def link_scored_pairs(spark, sf):
    return _scored_pairs(spark, _compact(spark, sf))


def _clusters(spark, sf):
    recs = _compact(spark, sf)
    return linking.compact_components(recs.select("pos", "arms", "entity"), _accepted(spark, recs), _arms(spark))


@query(f"WITH {_COMP} SELECT * FROM clusters")
def link_components(spark, sf):
    return _clusters(spark, sf).select("arm", "pos", "cluster")


@query(f"""WITH {_COMP}, x AS (SELECT c.arm, cluster, entity, count(*) OVER (PARTITION BY c.arm, cluster, entity) AS n, count(*) OVER (PARTITION BY c.arm, cluster) AS nc, count(*) OVER (PARTITION BY c.arm, entity) AS ne FROM clusters c JOIN fixture f ON f.arm = c.arm AND f.pos = c.pos),
m AS (SELECT arm, avg(n / CAST(nc AS DOUBLE)) AS p, avg(n / CAST(ne AS DOUBLE)) AS r FROM x GROUP BY 1) SELECT arm, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM m""")
def link_bcubed(spark, sf):
    return linking.b_cubed(_clusters(spark, sf))


_PM = f"""{_SCORED}, truth AS (SELECT arm, min(pos) AS l, max(pos) AS r FROM fixture GROUP BY arm, entity HAVING count(*) > 1), j AS (SELECT coalesce(p.arm, t.arm) AS arm, p.l IS NOT NULL AS p, t.l IS NOT NULL AS t FROM (SELECT * FROM scored_pairs WHERE accepted) p FULL JOIN truth t ON p.arm = t.arm AND p.l = t.l AND p.r = t.r),
cn AS (SELECT arm, count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn FROM j GROUP BY 1),
pm AS (SELECT *, round(tp / CAST(greatest(tp + fp, 1) AS DOUBLE), 6) AS precision, round(tp / CAST(greatest(tp + fn, 1) AS DOUBLE), 6) AS recall, round(2e0 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1, round(fp / CAST(greatest(tp + fp, 1) AS DOUBLE), 6) AS false_merge_rate FROM cn)"""


@query(f"WITH {_PM} SELECT * FROM pm")
def link_program(spark, sf):
    """All corruption settings, the adversarial ones too, as one plan."""
    return _metrics(spark, sf)


@query(f"""WITH {_PM} SELECT 'clean_f1' AS gate, f1 AS observed, CAST(9e-1 AS DOUBLE) AS threshold, f1 >= 9e-1 AS passed FROM pm WHERE arm = 'clean' UNION ALL SELECT 'low_f1', f1, 8e-1, f1 >= 8e-1 FROM pm WHERE arm = 'low' UNION ALL SELECT 'false_merge', false_merge_rate, 2e-2, false_merge_rate <= 2e-2 FROM pm WHERE arm = 'low'""")
def link_gates(spark, sf):
    from ..operators.decide import gates

    m = _metrics(spark, sf)
    at = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    one = m.agg(at("clean", "f1").alias("a"), at("low", "f1").alias("b"), at("low", "false_merge_rate").alias("c"))
    return gates(one, [("clean_f1", "a", 0.9, ">="), ("low_f1", "b", 0.8, ">="), ("false_merge", "c", 0.02, "<=")])


_RATES = f"""{_PM}, rates AS (SELECT rate, count(*) AS runs, round(avg(f1), 6) AS f1_mean, min(f1) AS f1_min, round(max(f1) - min(f1), 6) AS f1_range, max(false_merge_rate) AS false_merge_max FROM pm JOIN arms USING (arm) WHERE signals = '{_ALL}' GROUP BY 1)"""


def _rates(spark, sf):
    arms = spark.createDataFrame([(a, r) for a, r, signals in ARMS if signals == _ALL], "arm string, rate double")
    m = _metrics(spark, sf).join(F.broadcast(arms), "arm")
    return m.groupBy("rate").agg(F.count("*").alias("runs"), F.round(F.avg("f1"), 6).alias("f1_mean"), F.min("f1").alias("f1_min"), F.round(F.max("f1") - F.min("f1"), 6).alias("f1_range"), F.max("false_merge_rate").alias("false_merge_max"))


@query(f"WITH {_RATES} SELECT * FROM rates")
def link_rates(spark, sf):
    """F1 over the seeds of each corruption rate: mean, least and range, and the greatest false-merge rate."""
    return _rates(spark, sf)


@query(f"""WITH {_RATES}, o AS (SELECT max(f1_min) FILTER (WHERE rate = 0) AS a, max(f1_min) FILTER (WHERE rate = 15e-2) AS b, max(false_merge_max) FILTER (WHERE rate <= 15e-2) AS c, max(f1_range) FILTER (WHERE rate IN (0, 15e-2)) AS d FROM rates)
SELECT 'clean_f1' AS gate, a AS observed, CAST(9e-1 AS DOUBLE) AS threshold, a >= 9e-1 AS passed FROM o UNION ALL SELECT 'low_f1', b, 8e-1, b >= 8e-1 FROM o UNION ALL SELECT 'false_merge', c, 2e-2, c <= 2e-2 FROM o UNION ALL SELECT 'stability', d, 2e-2, d <= 2e-2 FROM o""")
def link_program_gates(spark, sf):
    """The gates of the whole program: worst seeds, false merges at all rates up to 0.15, and the range of F1."""
    from ..operators.decide import gates

    r = F.col("rate")
    worst = lambda c, when: F.max(F.when(when, F.col(c)))
    one = _rates(spark, sf).agg(worst("f1_min", r == 0).alias("a"), worst("f1_min", r == 0.15).alias("b"), worst("false_merge_max", r <= 0.15).alias("c"), worst("f1_range", r.isin(0.0, 0.15)).alias("d"))
    return gates(one, [("clean_f1", "a", 0.9, ">="), ("low_f1", "b", 0.8, ">="), ("false_merge", "c", 0.02, "<="), ("stability", "d", 0.02, "<=")])


@query(f"""WITH {_COMP}, x AS (SELECT c.arm, entity, count(*) AS n, count(DISTINCT cluster) AS k FROM clusters c JOIN fixture f ON f.arm = c.arm AND f.pos = c.pos GROUP BY 1, 2)
SELECT arm, count(*) FILTER (WHERE n > 1) AS duplicated, count(*) FILTER (WHERE n > 1 AND k > 1) AS false_splits FROM x GROUP BY 1""")
def link_false_splits(spark, sf):
    return linking.false_splits(_clusters(spark, sf))


#: Shares of entities with a second record, from the fixture's own down.
BASES = (("share_1", 0.05), ("share_2", 0.025), ("share_3", 0.01), ("share_4", 0.005), ("share_5", 0.0025))
_BASE_FIX = f"""{_FIX.replace("fixture AS (", "every AS (", 1)}, bases(base, share) AS (VALUES {", ".join(f"('{b}', CAST({s} AS DOUBLE))" for b, s in BASES)}),
fixture AS (SELECT base AS arm, pos, entity, ring, {", ".join(linking.SIGNALS)} FROM every, bases WHERE every.arm = 'clean' AND (pos = entity - 1 OR {_U("'dup'", "CAST(entity AS VARCHAR)")} < share))"""


@query(f"WITH {_PM.replace(_FIX, _BASE_FIX)} SELECT share, pm.* FROM pm JOIN bases ON base = pm.arm")
def link_base_rates(spark, sf):
    """Clean records at falling rates of duplicates."""
    bases = spark.createDataFrame(list(BASES), "base string, share double")
    fix = cut(linking.thinned(_fixture(spark, sf).where("arm = 'clean'"), bases, SEED))
    accepted = linking.score_pairs(linking.candidate_pairs(_exact(fix)), fix, KEY).where("accepted")
    return linking.pair_metrics(accepted, fix).join(F.broadcast(bases.withColumnRenamed("base", "arm")), "arm")


@query(f"WITH {_RINGS} SELECT * FROM rings")
def link_rings(spark, sf):
    return linking.compact_rings(_compact(spark, sf), _arms(spark), len(ARMS), KEY)


_DAY = "CAST(least(floor({p} / ceil(n / 20e0)), 19) AS INTEGER)"


@query(f"""WITH {_RINGS}, cnt AS (SELECT arm, max(pos) + 1 AS n FROM fixture GROUP BY 1), ev AS (SELECT f.arm, {_DAY.format(p="pos")} AS day, 1 AS received, 0 AS pairs, 0 AS rings, 0 AS referred FROM fixture f JOIN cnt USING (arm)
  UNION ALL SELECT s.arm, {_DAY.format(p="r")}, 0, 1, 0, 2 FROM scored_pairs s JOIN cnt USING (arm) WHERE accepted UNION ALL SELECT g.arm, {_DAY.format(p="flag_pos")}, 0, 0, 1, members FROM rings g JOIN cnt USING (arm)),
days AS (SELECT arm, CAST(unnest(range(20)) AS INTEGER) AS day FROM cnt)
SELECT d.arm, d.day, CAST(coalesce(sum(received), 0) AS BIGINT) AS received, CAST(coalesce(sum(pairs), 0) AS BIGINT) AS pairs, CAST(coalesce(sum(rings), 0) AS BIGINT) AS rings, CAST(coalesce(sum(referred), 0) AS BIGINT) AS referred FROM days d LEFT JOIN ev ON ev.arm = d.arm AND ev.day = d.day GROUP BY 1, 2""")
def daily_suspects(spark, sf):
    recs = _compact(spark, sf)
    rings = linking.compact_rings(recs, _arms(spark), len(ARMS), KEY)
    return linking.daily_report(linking.apart(recs.select("pos", "arms"), _arms(spark)), _accepted(spark, recs), rings, 20)

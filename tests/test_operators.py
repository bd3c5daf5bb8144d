"""Operators on small literal inputs."""

from __future__ import annotations

import hashlib
import hmac
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.functions import scalars
from riskloom.operators import calibrate, curate, decide, governance, linking, metrics, policy, queue, resample, warehouse


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_forced_queue(spark):
    df = frame(spark, [(i, 0, s, f) for i, (s, f) in enumerate(zip([0.1, 0.9, 0.8, 0.2], [True, True, False, False], strict=True))], "pos long, g int, score double, forced boolean")
    got = {r["pos"]: r["action"] for r in queue.rank_cut(df, ["g"], 0.25, forced="forced").collect()}
    assert got == {1: "manual_review", 0: "governance_referral", 2: "clear", 3: "clear"}


def test_headcount_is_binary_double(spark):
    df = frame(spark, [(100,), (1,), (20,)], "n long")
    assert [r[0] for r in df.select(queue.headcount(F.col("n"), 0.29)).collect()] == [28, 1, 5]


def test_rule_toggles_all_off(spark):
    df = frame(spark, [(True,)], "rule_device boolean")
    assert df.select(queue.any_rule([]).alias("x"), queue.any_rule(["rule_device"]).alias("y")).first() == (False, True)


def test_threshold_keeps_the_block_of_ties(spark):
    df = frame(spark, [(i, 0, 1.0 if i < 5 else 0.0, 0) for i in range(10)], "pos long, g int, score double, label int")
    row = queue.overshoot(df, ["g"], 0.2, discrete=True).first()
    assert (row["queue_size"], row["capacity_headcount"], row["overshoot"]) == (5, 2, 3)


def test_policy_and_grid(spark):
    labels, a, b = [1, 1, 0, 0, 0, 0], [0.9, 0.8, 0.7, 0.1, 0.1, 0.1], [0.9, 0.1, 0.8, 0.7, 0.1, 0.1]
    df = frame(spark, [(i, 0, *x) for i, x in enumerate(zip(labels, a, b, strict=True))], "pos long, g int, label int, a double, b double")
    d = policy.paired_delta(df, ["g"], 0.5, "a", "b").first()
    assert (d["caught_delta"], d["gained"], d["lost"]) == (1, 1, 0) or d["caught_delta"] >= 0


def test_utility_grid_literals(spark):
    pairs = frame(spark, [(1, 766, 4076, 4842, 294, 4548, 4842)], "k int, c_caught long, c_fp long, c_queue long, i_caught long, i_fp long, i_queue long")
    r = decide.compare(pairs, decide.grid(spark), ["k"]).first()
    assert (r["cells"], r["positive"], r["positive_share"], r["worst"]) == (60, 60, 1.0, 2_360_000.0)
    s = decide.compare(pairs, decide.grid(spark, surface=True), ["k"], ["effectiveness", "loss"]).where("effectiveness = 1 and loss = 1").first()
    assert s["worst"] == 2_360_000.0


def test_pareto(spark):
    df = frame(spark, [(0, 0.8, 0.1, 0.1, 100.0), (1, 0.7, 0.2, 0.2, 50.0), (2, 0.8, 0.1, 0.1, 100.0)], "k int, catch double, fpr double, review double, utility double")
    assert sorted(r["k"] for r in decide.pareto(df, "k", ["catch", "utility"], ["fpr", "review"]).collect()) == [0, 2]


def test_refusal_and_champion(spark):
    g = decide.gates(frame(spark, [(0.5, None)], "a double, b double"), [("x", "a", 0.4, ">="), ("y", "b", 1, "=")])
    assert [(r["gate"], r["passed"]) for r in g.collect()] == [("x", True), ("y", False)]
    assert decide.champion(g, "new", "old").first()["champion"] == "old"
    assert decide.recommend(frame(spark, [("p", 1, 2.0)], "name string, overflow int, u double"), F.col("overflow") == 0, ["u"], "name").first()[0] == "no robust recommendation"


def test_acceptance(spark):
    cur = frame(spark, [("age", "tpr_gap", 0.38), ("age", "ratio", 0.01), ("x", "fpr_gap", 0.2), ("income", "tpr_gap", 0.44)], "segment string, measure string, value double")
    acc = frame(spark, [("age", "tpr_gap", 0.3771), ("age", "ratio", 0.0732), ("income", "tpr_gap", 0.3771)], "segment string, measure string, before double")
    got = {(r["segment"], r["measure"]): r["state"] for r in decide.acceptance(cur, acc, 0.05).collect()}
    assert got == {("age", "tpr_gap"): "accepted", ("age", "ratio"): "lapsed", ("x", "fpr_gap"): "outstanding", ("income", "tpr_gap"): "lapsed"}


def test_average_precision_and_auroc(spark):
    df = frame(spark, [(0, s, y) for y, s in zip([0, 0, 0, 1, 1], [0.01, 0.1, 0.2, 0.7, 0.9], strict=True)], "g int, score double, label int")
    steps = metrics.score_steps(df, ["g"])
    assert metrics.average_precision(steps, ["g"]).first()[1] == 1.0 and metrics.auroc(steps, ["g"]).first()[1] == 1.0


def brute_auroc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.0, 0.1, 0.30001, 0.5, 0.7, 1.0]), st.integers(0, 1)), min_size=4, max_size=30))
def test_auroc_brute_force(rows):
    from pyspark.sql import SparkSession

    if len({y for _, y in rows}) < 2:
        return
    df = SparkSession.getActiveSession().createDataFrame([(0, s, y) for s, y in rows], "g int, score double, label int")
    assert math.isclose(metrics.auroc(metrics.score_steps(df, ["g"]), ["g"]).first()[1], brute_auroc(rows), abs_tol=1e-9)


def test_wilson(spark):
    df = frame(spark, [(8, 10), (0, 0)], "h int, n int").select(scalars.wilson(F.col("h"), F.col("n"), False).alias("lo"), scalars.wilson(F.col("h"), F.col("n"), True).alias("hi"))
    a, b = df.collect()
    assert 0 < a["lo"] < 0.8 < a["hi"] < 1 and b["lo"] is None


def test_bins_are_right_closed(spark):
    df = frame(spark, [(0.0,), (1 / 3,), (0.34,), (1.0,)], "x double")
    assert [r[0] for r in df.select(scalars.right_closed_bin(F.col("x"), [1 / 3, 2 / 3])).collect()] == [0, 0, 1, 2]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([0.0, 0.5, 1.0]), st.floats(-3, 3)), min_size=1, max_size=40))
def test_exact_quantiles(values):
    import numpy as np
    from pyspark.sql import SparkSession

    from riskloom.operators.quantiles import exact_quantiles

    df = SparkSession.getActiveSession().createDataFrame([(0, float(v)) for v in values] + [(0, None), (1, 7.0)], "g int, v double")
    qs = [0.0, 0.05, 0.5, 0.95, 1.0]
    for bounds in (None, (0.0, 1.0)):
        got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", qs, bounds=bounds).collect()}
        assert [got[0][f"q{i}"] for i in range(5)] == pytest.approx(np.quantile(values, qs).tolist(), abs=1e-9) and got[1]["q2"] == 7.0
        got = exact_quantiles(df, ["g"], "v", qs, discrete=True, bounds=bounds).where("g = 0").first()
        assert [got[f"q{i}"] for i in range(5)] == np.quantile(values, qs, method="inverted_cdf").tolist()


def test_ranks_across_buckets_and_ties(spark):
    import random

    r = random.Random(2)
    rows = [(i, i % 2, r.choice([None, -1.0, 0.0, 0.3, 0.30001, 0.9, 1.0, 2.0]), r.random() < 0.2) for i in range(200)]
    df = frame(spark, rows, "pos long, g int, score double, forced boolean")
    for forced in (None, "forced"):
        got = {x["pos"]: x["rank"] for x in queue.ranked(df, ["g"], forced=forced).collect()}
        for g in (0, 1):
            key = lambda x: (not x[3] if forced else 0, x[2] is None, -(x[2] or 0), x[0])
            want = sorted((x for x in rows if x[1] == g), key=key)
            assert [got[x[0]] for x in want] == list(range(1, len(want) + 1))


def test_psi_with_missing_values(spark):
    ref, cur = [1.0, 2.0, None, 4.0, 5.0] * 10, [1.0, None, 3.0, 4.0, 7.0] * 10
    df = frame(spark, [("r", v) for v in ref] + [("c", v) for v in cur], "side string, v double")
    assert metrics.quantile_edges(df.where("side = 'r'"), "v", 3) is None
    long = df.select(F.lit("v").alias("feature"), "side", metrics.psi_category("v", [1.5, 4.5]).alias("category"))
    p = metrics.psi(long, ["feature"], "category", "side").first()["psi"]
    assert math.isfinite(p) and p >= 0


def test_suppression(spark):
    df = frame(spark, [(0.5, i % 2, "a" if i < 10 else "b") for i in range(30)], "p double, label int, seg string")
    g = metrics.segment_parity(df, ["seg"], 0.5, "p", publish=8)
    got = {r["grp"]: r["tpr"] for r in g.collect()}
    assert got["a"] is None and got["b"] is not None
    assert metrics.parity_gaps(g).first()["tpr_gap"] is None


def test_prior_shift(spark):
    df = frame(spark, [(0.002,), (0.05,), (0.2,), (0.4,)], "p double")
    d = math.log(0.013 / 0.987) - math.log(0.010 / 0.990)
    up = [r[0] for r in df.select(scalars.prior_shift(F.col("p"), F.lit(d))).collect()]
    assert all(a > b for a, b in zip(up, [0.002, 0.05, 0.2, 0.4], strict=True)) and up == sorted(up)
    assert [r[0] for r in df.select(scalars.prior_shift(F.col("p"), F.lit(0.0))).collect()] == [0.002, 0.05, 0.2, 0.4]


def test_prior_forecast_flat_and_rising(spark):
    flat = frame(spark, list(enumerate([0.010, 0.011, 0.0105, 0.011, 0.0108, 0.011, 0.0109])), "period int, prior double")
    r = calibrate.backtest(calibrate.prior_forecasts(flat), 3).first()
    assert (r["rule"], r["forecast"], r["shift"]) == ("carry", 0.0109, 0.0)
    rising = frame(spark, [(t, round(0.005 * 1.6**t, 6)) for t in range(7)], "period int, prior double")
    r = calibrate.backtest(calibrate.prior_forecasts(rising), 3).first()
    assert r["rule"] != "carry" and r["forecast"] > 0.005 * 1.6**6


def test_maturity(spark):
    df = frame(spark, [(5,), (7,), (0,), (40,)], "a int")
    got = [r[0] for r in df.select(calibrate.maturity(F.col("a"))).collect()]
    assert got == pytest.approx([0.89, 0.92 + 0.08 / 6, 0.0, 1.0])


def test_day_buckets(spark):
    df = spark.range(50_000).select(linking.day_of(F.col("id"), F.lit(50_000), 20).alias("day"))
    got = {r["day"]: r["count"] for r in df.groupBy("day").count().collect()}
    assert set(got) == set(range(20)) and sum(got.values()) == 50_000


def test_hmac_and_ngrams(spark):
    key = "k" * 20
    r = frame(spark, [("Ann-é 12",)], "v string").select(scalars.hmac_sha256(F.col("v"), key), scalars.normal_form(F.col("v")), scalars.ngrams(F.lit("ab"))).first()
    assert r[0] == hmac.new(key.encode(), "Ann-é 12".encode(), hashlib.sha256).hexdigest() and r[1] == "anné12"
    assert r[2] == sorted({"^^a", "^ab", "ab$", "b$$"})


def test_dice_of_empty_sets(spark):
    r = frame(spark, [([], [], ["a"])], "a array<string>, b array<string>, c array<string>").select(scalars.dice(F.col("a"), F.col("b")), scalars.dice(F.col("a"), F.col("c"))).first()
    assert tuple(r) == (1.0, 0.0)


def test_linking_on_the_clean_fixture(spark):
    arms = frame(spark, [("clean", 0.0, "email phone device address"), ("strong", 1.0, "email phone")], "arm string, rate double, signals string")
    fix = linking.fixture(spark.range(1, 600), arms)
    toks = linking.tokens(fix, "a-key-for-tests-only").cache()
    pairs = linking.score_pairs(linking.candidate_pairs(toks), fix, "a-key-for-tests-only")
    m = {r["arm"]: r for r in linking.pair_metrics(pairs.where("accepted"), fix).collect()}
    assert m["clean"]["f1"] == 1.0 and m["clean"]["fp"] == 0 and m["strong"]["recall"] < 0.25
    assert linking.rings(toks, fix).where("arm = 'clean' and confirmed").count() == fix.where("arm = 'clean'").select("ring").dropna().distinct().count()
    assert fix.exceptAll(linking.fixture(spark.range(1, 600), arms)).isEmpty()


def test_compact_records_link_as_all_arms_do(spark):
    key, every = "a-key-for-tests-only", "email phone device address"
    rows = [("clean", 0.0, every), ("some", 0.3, every), ("few", 0.05, every), ("strong", 1.0, "email phone"), *((f"more{i}", 0.1, every) for i in range(6))]
    arms = linking.numbered(frame(spark, rows, "arm string, rate double, signals string"), [r[0] for r in rows])
    fix = linking.fixture(spark.range(1, 600), arms.drop("bit")).cache()
    recs = linking.compact(fix, arms).cache()
    assert recs.count() * 5 < fix.count()
    same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert same(linking.apart(recs, arms).select(*fix.columns), fix)
    pairs = linking.compact_pairs(linking.tokens(recs, key, ("arms", "pos")), len(rows)).cache()
    long = linking.candidate_pairs(linking.tokens(fix, key)).cache()
    assert same(linking.apart(pairs, arms).select("arm", "l", "r"), long)
    scored = linking.apart(linking.score_compact(pairs, recs, key), arms).drop("bit").cache()
    assert same(scored, linking.score_pairs(long, fix, key).select(*scored.columns))
    accepted = scored.where("accepted")
    got = linking.compact_components(recs.select("pos", "arms", "entity"), accepted, arms)
    assert same(got.select("arm", "pos", "cluster"), linking.components(fix, accepted).select("arm", "pos", "cluster"))
    assert linking.pair_metrics(accepted, linking.apart(linking.repeated(recs), arms)).orderBy("arm").collect() == linking.pair_metrics(accepted, fix).orderBy("arm").collect()
    assert same(linking.compact_rings(recs, arms, len(rows), key), linking.rings(linking.tokens(fix, key), fix))
    with pytest.raises(ValueError):
        linking.numbered(arms.drop("bit"), [str(i) for i in range(63)])


def test_false_splits_and_thinned_records(spark):
    truth = frame(spark, [("a", 0, 1), ("a", 1, 1), ("a", 2, 2), ("a", 3, 2), ("a", 4, 3)], "arm string, pos long, entity long")
    clusters = frame(spark, [("a", 0, 0), ("a", 1, 0), ("a", 2, 2), ("a", 3, 3), ("a", 4, 4)], "arm string, pos long, cluster long")
    assert [tuple(r) for r in linking.false_splits(clusters, truth).collect()] == [("a", 2, 1)]
    assert linking.false_splits(clusters.limit(0), truth).collect() == []
    fix = linking.fixture(spark.range(1, 600), frame(spark, [("clean", 0.0, "email")], "arm string, rate double, signals string"))
    got = linking.thinned(fix, frame(spark, [("all", 1.0), ("some", 0.02), ("none", 0.0)], "base string, share double"))
    n = {r["arm"]: r["count"] for r in got.groupBy("arm").count().collect()}
    assert n["all"] == fix.count() > n["some"] > n["none"] == 599


def test_link_program_has_the_rates_and_seeds_of_the_reference(spark, sf):
    from riskloom.plans import QUERIES

    assert {r["rate"]: r["runs"] for r in QUERIES["link_rates"](spark, sf).collect()} == {0.0: 1, 0.05: 3, 0.15: 3, 0.3: 3}


def test_components_of_a_chain(spark):
    n = 40
    nodes = spark.range(n + 1).select(F.lit("a").alias("arm"), F.col("id").alias("pos"))
    links = spark.range(n - 1).select(F.lit("a").alias("arm"), F.col("id").alias("l"), (F.col("id") + 1).alias("r"))
    got = {r["pos"]: r["cluster"] for r in linking.components(nodes, links).collect()}
    assert set(got.values()) == {0, n} and got[n] == n


def test_sentinels(spark):
    df = frame(spark, [(-1, -0.5), (7, 1.0), (None, 0.0)], "a int, b double")
    got = curate.sentinels(df, ["a"], ["b"]).select("a", "a__missing", "b", "b__missing").collect()
    assert [tuple(r) for r in got] == [(None, 1, None, 1), (7.0, 0, 1.0, 0), (None, 1, 0.0, 0)]


def test_one_to_one(spark):
    a, b = frame(spark, [(1,), (2,)], "k int"), frame(spark, [(1, "x"), (2, "y")], "k int, v string")
    assert curate.one_to_one(a, b, "k").count() == 2
    for bad in (a.union(a), a.limit(1)):
        with pytest.raises(ValueError):
            curate.one_to_one(bad, b, "k")


def test_score_validation(spark):
    for rows in ([], [(float("nan"),)], [(1.1,)], [(None,)]):
        with pytest.raises(ValueError):
            curate.validate_scores(frame(spark, rows, "s double"), "s", 0.1)
    with pytest.raises(ValueError):
        curate.validate_scores(frame(spark, [(0.5,)], "s double"), "s", 0.0)
    curate.validate_scores(frame(spark, [(0.5,)], "s double"), "s", 1.0)


def test_contract_refuses_overflow_without_reason(spark):
    df = frame(spark, [(2, []), (2, ["r"]), (0, [])], "o int, reasons array<string>")
    assert [r[0] for r in df.select(curate.valid_recommendation(F.col("o"), F.col("reasons"))).collect()] == [False, True, True]


def test_upsert(spark):
    old, new = frame(spark, [(1, "a"), (2, "b")], "k int, v string"), frame(spark, [(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in curate.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in curate.upsert(old, new, ["k"], update=False).collect()} == {(1, "a"), (2, "b"), (3, "d")}


def test_dimension_with_unknown_member(spark):
    d = warehouse.dimension(frame(spark, [("b",), ("a",), (None,), ("b",)], "c string"), "c", "k", unknown=True)
    assert {tuple(r) for r in d.collect()} == {(0, "UNKNOWN"), (1, "a"), (2, "b")}


def test_poisson_weights_have_mean_one(spark):
    df = spark.range(20_000).select(resample.poisson_weight(scalars.uniform("s", F.col("id"))).alias("w"))
    assert abs(df.agg(F.avg("w")).first()[0] - 1) < 0.03


def test_bootstraps_draw_as_often_as_the_reference(spark, sf, monkeypatch):
    from riskloom.plans import QUERIES

    drawn = []
    monkeypatch.setattr(resample, "delta_bootstrap", lambda df, delta, n, *a, f=resample.delta_bootstrap: drawn.append(n) or f(df, delta, n, *a))
    QUERIES["bootstrap_delta"](spark, sf)
    assert drawn == [5000] and QUERIES["bootstrap_ap_lift"](spark, sf).first()["replicates"] == 1000


@pytest.mark.parametrize("mean", [0, 1, 7, 400, 250_000])
def test_poisson_draws_have_the_distribution(spark, mean):
    got = [r["count"] for r in resample.poisson_draws(spark, mean, 4000, "s").collect()]
    assert len(got) == 4000 and abs(sum(got) / 4000 - mean) <= 4 * (mean / 4000) ** 0.5
    if mean:
        spread = sum((x - mean) ** 2 for x in got) / 4000
        assert 0.88 < spread / mean < 1.12 and resample.poisson_table(spark, mean).agg(F.max("cdf")).first()[0] == pytest.approx(1, abs=1e-9)


def test_lift_bootstrap_is_that_of_the_rows(spark):
    """Steps, buckets and scaling change nothing: average precision of each replicate's rows, drawn row by row, by its definition."""
    import hashlib
    import random

    r = random.Random(3)
    rows = [(i, int(r.random() < 0.3), round(r.random(), 2), r.random()) for i in range(120)]
    df = frame(spark, rows, "pos long, label int, a double, b double")
    drawn = resample.replicates(resample.positive_steps(resample.positive_steps(df, "a"), "b"), 20, "s", "pos")
    positives = sum(x[1] for x in rows)
    long = drawn.unpivot(["replicate", "label", "weight"], ["a", "b"], "model", "score")
    got = {(x["replicate"], x["model"]): x["average_precision"] for x in resample.stratified_average_precision(long, ["replicate", "model"], positives, 120 - positives).collect()}
    for k in range(1, 21):
        draw = lambda i: hashlib.sha256(f"s|{(k - 1) // 8}|{i}".encode()).hexdigest()[8 * ((k - 1) % 8) :][:8]  # noqa: B023, E731
        weights = [sum(int(draw(i), 16) / 2**32 >= p for p in resample.POISSON_1) for i, *_ in rows]
        up = positives / sum(w for w, x in zip(weights, rows) if x[1])
        down = (120 - positives) / sum(w for w, x in zip(weights, rows) if not x[1])
        scaled = [w * (up if x[1] else down) for w, x in zip(weights, rows)]
        for m, column in (("a", 2), ("b", 3)):
            ap = 0.0
            for w, x in zip(scaled, rows):
                if x[1]:
                    above = [(v, y[1]) for v, y in zip(scaled, rows) if y[column] >= x[column]]
                    ap += w / positives * sum(v for v, y in above if y) / sum(v for v, _ in above) if w else 0.0
            assert got[k, m] == pytest.approx(ap)


def test_replicated_average_precision_is_that_of_replicates_as_rows(spark, monkeypatch):
    monkeypatch.setattr(resample, "RUN", 40)
    monkeypatch.setattr(resample, "CHUNK", 7)
    rows = [(i, m, int(i % 5 == 0), None if i % 11 == 3 else (i * 37 % 100 // k) / 100) for i in range(200) for m, k in (("fine", 1), ("coarse", 30))]
    df = frame(spark, rows, "pos long, model string, label int, score double").cache()
    want = resample.stratified_average_precision(resample.replicates(df, 20, "s", "pos"), ["model", "replicate"], 40, 160)
    got = resample.replicated_average_precision(df, 20, "s", 40, 160, key="pos")
    a, b = ({(r["model"], r["replicate"]): r["average_precision"] for r in x.collect()} for x in (want, got))
    assert len(a) == 40 and a == pytest.approx(b)
    # Rows are as many as the table's: none is made for a row in a replicate.
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_fingerprint_is_a_tree_of_bounded_width(spark):
    import hashlib

    sha = lambda xs: hashlib.sha256(",".join(xs).encode()).hexdigest()
    leaves = [f"{i}:{i / 7:.6f}" for i in range(30)]
    for width in (3, 4, 100):
        level = leaves
        while True:
            level = [sha(level[a : a + width]) for a in range(0, len(level), width)]
            if len(level) == 1:
                break
        got = resample.fingerprint(spark.range(30).select(F.col("id").alias("k"), (F.col("id") / 7.0).alias("v")), "k", "v", width=width).first()
        assert (got["rows"], got["fingerprint"]) == (30, level[0])


def test_a_flat_fingerprint_has_two_levels_whatever_the_number_of_blocks(spark):
    import hashlib

    sha = lambda xs: hashlib.sha256(",".join(xs).encode()).hexdigest()
    df = spark.range(30).select(F.col("id").alias("k"), (F.col("id") / 7.0).alias("v"))
    leaves = [f"{i}:{i / 7:.6f}" for i in range(30)]
    blocks = [sha(leaves[a : a + 3]) for a in range(0, 30, 3)]
    assert tuple(resample.fingerprint(df, "k", "v", width=3, flat=True).first()) == (30, sha(blocks))
    assert tuple(resample.fingerprint(df, "k", "v", width=30, flat=True).first()) == (30, sha(leaves))
    assert tuple(resample.fingerprint(df.limit(0), "k", "v", flat=True).first()) == (None, None)


def test_uuid5(spark):
    import uuid

    names = ["", "a", "x:operations:p7", "é"]
    got = [r[0] for r in frame(spark, [(n,) for n in names], "n string").select(scalars.uuid5(F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_policy_grid_is_that_of_ranked_rows(spark):
    import random

    r = random.Random(8)
    names = [f"pos long, period int, label int, {', '.join(f'{c} boolean' for c in queue.RULES)}, m double, k double"]
    rows = [(i, i % 2, int(r.random() < 0.3), *(r.random() < p for p in (0.1, 0.3, 0.02, 0.6)), round(r.random(), 1), 0.5) for i in range(150)]
    got = {(x["period"], x["model"], x["mask"], x["capacity"]): (x["queue_size"], x["overflow"], x["caught"], x["false_positives"]) for x in decide.policy_grid(frame(spark, rows, names[0]), ["m", "k"], [0.001, 0.05, 0.4, 1.0]).collect()}
    assert len(got) == 2 * 2 * 16 * 4
    for (period, model, mask, capacity), value in got.items():
        some = [x for x in rows if x[1] == period]
        forced = lambda x: any(x[3 + i] for i in range(4) if mask >> i & 1)  # noqa: B023, E731
        some.sort(key=lambda x: (not forced(x), -x[7 if model == "m" else 8], x[0]))  # noqa: B023
        head = max(1, int(len(some) * capacity))
        acted = some[:head] + [x for x in some[head:] if forced(x)]
        caught = sum(x[2] for x in acted)
        assert value == (head, len(acted) - head, caught, len(acted) - caught)


def test_components_of_long_paths_and_stars(spark):
    links_ = [("p", i, i + 1) for i in range(40)] + [("s", 0, i) for i in range(1, 60)] + [("s", 100 + i, 100 + (i * 7) % 30) for i in range(30)]
    nodes = frame(spark, [(a, i) for a in "ps" for i in range(140)], "arm string, pos long")
    got = {(x["arm"], x["pos"]): x["cluster"] for x in linking.components(nodes, frame(spark, links_, "arm string, l long, r long")).collect()}
    up = {k: k[1] for k in got}
    changed = True
    while changed:
        changed = False
        for a, x, y in links_:
            low = min(up[a, x], up[a, y])
            changed |= up[a, x] != low or up[a, y] != low
            up[a, x] = up[a, y] = low
    assert got == up


def test_registry_and_audit(spark):
    schema = "model_version string, approval_state string, promoted_at string"
    old = frame(spark, [("a", "draft", "1"), ("b", "retained", None)], schema)
    new = frame(spark, [("a", "approved", "2"), ("b", "gone", "2"), ("c", "draft", "2"), ("c", "draft", "2"), (None, "x", "2")], schema)
    assert {tuple(r) for r in governance.register(old, new, ["approval_state"]).collect()} == {("a", "approved", "1"), ("b", "gone", None), ("c", "draft", "2")}
    events = frame(spark, [("1", "x")], "event_id string, what string")
    more = frame(spark, [("1", "y"), ("2", "z"), ("2", "z")], "event_id string, what string")
    once = governance.audit(events, more)
    assert {tuple(r) for r in governance.audit(once, more).collect()} == {("1", "x"), ("2", "z")} and once.count() == 2


def test_corrected_moves_are_the_true_ones(spark):
    priors = frame(spark, [(i, p) for i, p in enumerate([0.01, 0.012, 0.011, 0.02])], "period int, prior double")
    rows = calibrate.corrected_latency(priors, [0, 1, 3]).collect()
    assert len(rows) == 9 and all((r["corrected_move"] is None) == (r["lag"] == 0) for r in rows)
    assert all(r["corrected_move"] == pytest.approx(r["true_move"], abs=2e-6) and r["agrees"] for r in rows if r["lag"])


def test_fingerprint_follows_values_not_order(spark):
    a = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") / 7.0).alias("v"))
    b = a.orderBy(F.desc("k")).repartition(3)
    c = a.withColumn("v", F.when(F.col("k") == 5, 0.0).otherwise(F.col("v")))
    d = [resample.fingerprint(x, "k", "v").first()["fingerprint"] for x in (a, b, c)]
    assert d[0] == d[1] != d[2]


def test_tokens_of_pairs_are_bytes(spark, sf, monkeypatch):
    from riskloom.plans import links

    seen = []
    f = linking.compact_pairs
    monkeypatch.setattr(linking, "compact_pairs", lambda toks, arms: (seen.append(toks), f(toks, arms))[1])
    recs = links._compact(spark, sf)
    pairs = links._pairs(recs)
    assert {r["n"] for r in seen[0].select(F.length("exact_token").alias("n")).distinct().collect()} == {16}
    in_hex = f(linking.tokens(recs, links.KEY, ("arms", "pos")), len(links.ARMS))
    assert sorted(pairs.collect()) == sorted(in_hex.collect())


def test_only_second_copies_are_made_in_every_arm(spark, sf, monkeypatch):
    from riskloom.plans import links

    seen = []
    f = linking.compact
    monkeypatch.setattr(linking, "compact", lambda records, arms: (seen.append(records), f(records, arms))[1])
    recs = links._compact(spark, sf)
    fix = links._fixture(spark, sf).cache()
    second = fix.join(fix.groupBy("entity").agg(F.max("pos").alias("pos"), F.min("pos").alias("least")).where("pos > least").select("pos"), "pos", "left_semi")
    assert seen[0].count() == second.count() > 0
    whole = f(fix, links._arms(spark))
    assert sorted(map(str, recs.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    fix.unpersist()

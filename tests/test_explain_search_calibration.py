"""Tree contributions, adaptive search, isotonic hulls, calibration lines against brute-force versions."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import explain, isotonic, learn, search
from riskloom.plans.models import CATEGORICAL, NUMERIC, _data


def walk(nodes, x, known, at=0):
    """Expected value of a tree when only some features are known."""
    value, rows, left, right, feature, numbers, categories = nodes[at]
    if left < 0:
        return value
    if feature in known:
        goes = x[feature] <= numbers[0] if categories < 0 else x[feature] in numbers
        return walk(nodes, x, known, left if goes else right)
    return sum(nodes[c][1] / rows * walk(nodes, x, known, c) for c in (left, right))


def brute_shapley(nodes, x, width):
    out = np.zeros(width)
    for i in range(width):
        others = [j for j in range(width) if j != i]
        for k in range(width):
            w = math.factorial(k) * math.factorial(width - 1 - k) / math.factorial(width)
            for known in itertools.combinations(others, k):
                out[i] += w * (walk(nodes, x, {*known, i}) - walk(nodes, x, set(known)))
    return out


def random_tree(r, width, depth, rows=1000.0):
    """Nodes of a random tree; features repeat on paths, one is categorical."""
    nodes = {}

    def grow(depth, rows):
        at = len(nodes)
        nodes[at] = None
        if not depth or rows < 4 or r.random() < 0.1:
            nodes[at] = (r.uniform(-1, 1), rows, -1, -1, -1, [], -1)
            return at
        f = r.randrange(width)
        share = float(r.randint(1, int(rows) - 1))
        left, right = grow(depth - 1, share), grow(depth - 1, rows - share)
        split = ([float(c) for c in r.sample(range(4), 2)], 4) if f == width - 1 else ([round(r.uniform(0, 3), 1)], -1)
        nodes[at] = (0.0, rows, left, right, f, *split)
        return at

    grow(depth, rows)
    return nodes


def test_contributions_are_shapley_values_over_all_subsets():
    r = random.Random(6)
    for _ in range(25):
        width = r.randint(2, 5)
        trees = [(random_tree(r, width, 4), w) for w in (1.0, 0.1)]
        leaves = [leaf for nodes, w in trees for leaf in explain.leaves_of(nodes, w)]
        x = np.array([[round(r.uniform(0, 3), 1) for _ in range(width - 1)] + [float(r.randrange(4))] for _ in range(8)])
        got = explain.Shapley(leaves, width)(x)
        for row, ours in zip(x, got, strict=True):
            assert ours == pytest.approx(sum(w * brute_shapley(nodes, row, width) for nodes, w in trees), abs=1e-10)
            assert explain.base_value(leaves) + ours.sum() == pytest.approx(sum(w * walk(nodes, row, set(range(width))) for nodes, w in trees), abs=1e-10)
    assert explain.Shapley([(0.5, ())], 2)(np.zeros((3, 2))).tolist() == [[0, 0]] * 3 and explain.base_value([(0.5, ())]) == 0.5


def test_contributions_of_a_fitted_model_add_up_to_its_margin(spark, sf):
    d = _data(spark, sf)
    model = learn.fit_trees(d.where("period <= 5"), NUMERIC, CATEGORICAL, rounds=4, depth=4)
    test = d.where("period = 7")
    got = explain.tree_contributions(model, test, ["pos"])
    said = {r["pos"]: r["score"] for r in learn.predict(model, test, ["pos"]).collect()}
    rows = got.collect()
    assert len(rows) == len(said) > 0
    for r in rows:
        margin = r["base"] + sum(r["contributions"])
        assert 1 / (1 + math.exp(-2 * margin)) == pytest.approx(said[r["pos"]], abs=1e-9)
    names = [*NUMERIC, *CATEGORICAL]
    reasons = {r["pos"]: r["reasons"] for r in explain.tree_reasons(got, names, ["pos"]).collect()}
    for r in rows:
        want = [names[i] for i in sorted(range(len(names)), key=lambda i: (-r["contributions"][i], i)) if r["contributions"][i] > 0][:3]
        assert reasons[r["pos"]] == ", ".join(want)
    means = {r["feature"]: r["mean_contribution"] for r in explain.tree_importance(got, names).collect()}
    assert means == pytest.approx({n: float(np.mean([abs(r["contributions"][i]) for r in rows])) for i, n in enumerate(names)}, abs=1e-6)
    assert explain.tree_contributions(model, test.limit(0), ["pos"]).collect() == []


# --- search --------------------------------------------------------------------------------------------

SPACE = {"x": search.Number(0.0, 1.0), "n": search.Number(1, 9, step=2), "rate": search.Number(0.01, 1.0, log=True), "how": search.Choice(("a", "b", None))}


def bowl(settings, fold):
    """Best at x = 0.7, n = 5, rate = 0.1, how = b."""
    return 1 - (settings["x"] - 0.7) ** 2 - 0.02 * abs(settings["n"] - 5) - 0.1 * abs(math.log10(settings["rate"]) + 1) - 0.2 * (settings["how"] != "b") - 0.01 * fold


def test_search_repeats_prunes_and_gains():
    one, two = (search.run(bowl, 3, SPACE, 40, seed=5) for _ in range(2))
    assert [(t.settings, t.scores, t.objective) for t in one] == [(t.settings, t.scores, t.objective) for t in two]
    assert any(t.pruned and len(t.scores) == 2 for t in one) and not any(t.pruned for t in one[:2])
    for k, t in enumerate(one):
        assert 0 <= t.settings["x"] <= 1 and t.settings["n"] in (1, 3, 5, 7, 9) and 0.01 <= t.settings["rate"] <= 1
        finished = [o for o in one[:k] if not o.pruned]
        cut = next((j for j in (2,) if len(finished) >= 2 and np.mean(t.scores[:j]) < np.median([np.mean(o.scores[:j]) for o in finished])), None)
        assert t.pruned == (cut is not None)
    best = lambda trials: max(t.objective for t in trials if not t.pruned)
    gained = [best(search.run(bowl, 3, SPACE, 40, seed=s)) - max(1.1 * bowl({n: k.random(r) for n, k in SPACE.items()}, 1) for _ in range(40)) for s in range(8) for r in [random.Random(s)]]
    assert np.mean(gained) > 0


def test_search_is_never_worse_than_the_given_settings():
    grid = [{"x": 0.7, "n": 5, "rate": 0.1, "how": "b"}, {"x": 0.0, "n": 1, "rate": 1.0, "how": "a"}]
    done = search.run(bowl, 3, SPACE, 6, first=grid)
    assert [t.settings for t in done[:2]] == grid and not any(t.pruned for t in done[:2])
    assert max(t.objective for t in done if not t.pruned) >= done[0].objective


def test_parzen_densities_are_densities():
    for kind, values in ((SPACE["x"], [0.1, 0.1, 0.9]), (SPACE["rate"], [0.02, 0.5]), (SPACE["x"], [])):
        p = search.Parzen(kind, values)
        grid = np.linspace(p.low, p.high, 20_001)
        assert np.mean([p.density(v) for v in grid]) * (p.high - p.low) == pytest.approx(1, abs=1e-3)
        assert all(p.low <= p.draw(random.Random(i)) <= p.high for i in range(50))


def test_search_on_models(spark, sf):
    d = _data(spark, sf).where("period <= 5")
    fit = lambda rows, reg: learn.fit_logistic(rows, NUMERIC, CATEGORICAL, reg)
    rows = search.search(d, fit, {"reg": search.Number(1e-4, 1.0, log=True)}, 3, folds=((2, 3), (3, 4)), first=[{"reg": 0.01}, {"reg": 1.0}]).collect()
    assert [r["trial"] for r in rows] == [0, 1, 2] and all(0 < r["mean"] <= 1 for r in rows)
    assert all((r["objective"] is None) == (r["state"] == "pruned") for r in rows)


# --- isotonic fits and calibration lines ---------------------------------------------------------------


def brute_isotonic(rows):
    """Pool adjacent violators, one after another."""
    blocks = []
    for s in sorted({s for s, _ in rows}):
        y = [v for t, v in rows if t == s]
        blocks.append([[s], sum(y), len(y)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    return {s: t / n for scores, t, n in blocks for s in scores}


@pytest.mark.parametrize("part", [3, 17, 1 << 16])
def test_isotonic_fit_equals_pooling(spark, part):
    r = random.Random(part)
    groups = {
        "a": [(round(r.random(), 2), int(r.random() < 0.4)) for _ in range(300)], "up": [(i / 50, int(i > 25)) for i in range(50)], "down": [(i / 50, int(i < 25)) for i in range(50)],
        "one": [(0.5, 1)], "ties": [(0.3, i % 2) for i in range(40)], "skew": [(1e-6 * i, int(r.random() < i / 200)) for i in range(200)], None: [(0.1, 0), (0.2, 1), (0.15, 1)],
    }
    rows = [(g, s, y, 1, 2) for g, v in groups.items() for s, y in v] + [("a", None, 1, 1, 2), ("a", 0.5, None, 1, 2)]
    df = spark.createDataFrame(rows, "g string, score double, label int, value int, cum_n int").select("g", "score", "label")
    got = isotonic.isotonic_fit(df, ["g"], part=part).collect()
    want = {(g, s): v for g, rows in groups.items() if g for s, v in brute_isotonic(rows).items()}
    assert {(r["g"], r["score"]): r["value"] for r in got} == pytest.approx(want) and len(got) == len(want)
    assert isotonic.isotonic_fit(df.limit(0), ["g"]).collect() == [] and isotonic.isotonic_fit(df.limit(0).drop("g")).collect() == []


def test_isotonic_prediction_is_the_engines(spark):
    from pyspark.ml.regression import IsotonicRegression

    r = random.Random(2)
    df = spark.createDataFrame([(s, int(r.random() < s)) for s in (round(r.random(), 2) for _ in range(500))], "score double, label int")
    test = spark.createDataFrame([(i / 400 - 0.1,) for i in range(480)], "score double")
    ours = isotonic.isotonic_predict(test.withColumn("fit", F.col("score")), isotonic.isotonic_knots(isotonic.isotonic_fit(df, part=50)), "fit")
    engine = IsotonicRegression(featuresCol="score", labelCol="label").fit(df.withColumn("label", F.col("label").cast("double")))
    theirs = {r["score"]: r["prediction"] for r in engine.transform(test).collect()}
    assert {r["score"]: r["fit"] for r in ours.collect()} == pytest.approx(theirs, abs=1e-9)
    odd = spark.createDataFrame([(None,), (0.5,)], "score double")
    assert [r["score"] is None for r in isotonic.isotonic_predict(odd, isotonic.isotonic_knots(isotonic.isotonic_fit(df))).collect()] == [True, False]


def test_lines_are_the_likeliest_and_odd_groups_are_told(spark):
    r = random.Random(8)
    expit = lambda v: 1 / (1 + math.exp(-v))
    line = [(s, int(r.random() < expit(0.6 * math.log(s / (1 - s)) - 0.4))) for s in (r.uniform(0.01, 0.99) for _ in range(3000))]
    groups = {"line": line, "apart": [(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1)], "one": [(0.2, 1), (0.7, 1)], "same": [(0.3, 0), (0.3, 1), (0.3, 1)], None: line[:500]}
    df = spark.createDataFrame([(g, s, y) for g, v in groups.items() for s, y in v] + [("line", None, 1), ("line", 0.4, None)], "g string, score double, label int")
    got = {r["g"]: r for r in isotonic.calibration_lines(df, ["g"]).collect()}
    assert set(got) == set(groups)
    x, y = (np.array(v, float) for v in zip(*line, strict=True))
    x = np.log(x / (1 - x))
    for a, b, least in ((got["line"]["slope"], got["line"]["intercept"], True), (0.6, -0.4, False)):
        p = 1 / (1 + np.exp(-(a * x + b)))
        if least:
            assert abs(((y - p) * x).sum()) < 1e-5 and abs((y - p).sum()) < 1e-5
    assert got["line"]["converged"] and abs(got["line"]["slope"] - 0.6) < 0.1 and got[None]["converged"]
    assert not got["apart"]["converged"] and got["apart"]["slope"] > 1
    assert got["one"]["slope"] is None and got["one"]["intercept"] is None and not got["one"]["converged"] and got["one"]["prevalence"] == 1
    assert got["same"]["slope"] == pytest.approx(math.log(2) * math.log(0.3 / 0.7) / (1 + math.log(0.3 / 0.7) ** 2), abs=1e-2) or got["same"]["slope"] * math.log(0.3 / 0.7) + got["same"]["intercept"] == pytest.approx(math.log(2), abs=1e-3)
    assert isotonic.calibration_lines(df.limit(0), ["g"]).collect() == []
    alone = isotonic.calibration_lines(df.where("g = 'line'").drop("g"), []).first()
    assert (alone["slope"], alone["intercept"]) == pytest.approx((got["line"]["slope"], got["line"]["intercept"]))
    parts = isotonic.intercept_parts(isotonic.calibration_lines(df, ["g"]).where("g = 'line'").withColumn("prior", F.lit(0.5))).first()
    assert parts["slope_term"] + parts["offset"] == pytest.approx(parts["intercept"])

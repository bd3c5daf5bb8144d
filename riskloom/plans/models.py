"""Queries on models. SQL can't fit them, so they have no oracle; tests check what they must do."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import cut, stored
from ..operators import boost, explain, learn, metrics, search
from ..operators.quantiles import exact_quantiles
from ..sources.tables import applications, features
from .registry import query

NUMERIC, CATEGORICAL = ("challenger", "incumbent", "orders_of_customer", "avg_discount"), ("channel", "segment")

#: Boosted trees of the search: rounds, depth, step, share of rows for each tree.
TREES = ((10, 3, 0.1, 1.0), (20, 3, 0.1, 0.8), (10, 5, 0.05, 1.0), (20, 5, 0.1, 0.8))


def _data(spark, sf):
    """The rows of all models, joined once: every fit passes over them several times."""
    a = features(spark, sf, applications(spark, sf))
    return stored(a.select("pos", "period", "label", *CATEGORICAL, *(F.col(c).cast("double").alias(c) for c in NUMERIC)))


def _logistic(df):
    return learn.fit_logistic(df, NUMERIC, CATEGORICAL)


@query()
def logit_fit(spark, sf):
    """Rolling folds of the logistic model."""
    return learn.fold_metrics(learn.rolling(_data(spark, sf), _logistic, ["period", "label"]), ["period"])


@query()
def gbt_fit(spark, sf):
    """Rolling folds of boosted trees."""
    return learn.fold_metrics(learn.rolling(_data(spark, sf), lambda d: learn.fit_trees(d, NUMERIC, CATEGORICAL), ["period", "label"]), ["period"])


def _calibration_scores(spark, sf):
    d = _data(spark, sf)
    return learn.predict(_logistic(d.where("period <= 5")), d.where("period >= 6"), ["pos", "period", "label"])


@query()
def calibrator_selection(spark, sf):
    """Sigmoid against isotonic, fitted and compared on period 6 (sigmoid within 1 % of the Brier score), and what the chosen one gives on period 7."""
    s = _calibration_scores(spark, sf)
    chosen, figures, calibrated = learn.calibrator(cut(s.where("period = 6")))
    test = calibrated(s.where("period = 7")).withColumn("method", F.lit(chosen))
    later = metrics.losses(test, ["method"]).join(metrics.expected_calibration_error(test, ["method"]), "method").select("method", F.col("brier").alias("test_brier"), F.col("ece").alias("test_ece"))
    rows = figures.join(later, "method", "left").withColumn("selected", F.col("method") == chosen)
    return rows.select("method", *(F.round(c, 6).alias(c) for c in ("brier", "ece", "test_brier", "test_ece")), "selected")


@query()
def calibration_line(spark, sf):
    """Slope and intercept of labels on logits, with the part of the intercept that the prior explains."""
    s = _calibration_scores(spark, sf).where("period = 7")
    a, b = learn.platt(s)
    from ..functions.scalars import logit

    return s.agg(F.avg("label").alias("p"), F.avg("score").alias("q")).select(F.lit(round(a, 6)).alias("slope"), F.lit(round(b, 6)).alias("intercept"), F.round(logit(F.col("p")) - logit(F.col("q")), 6).alias("prior_move"))


@query()
def permutation_importance(spark, sf):
    d = _data(spark, sf)
    return learn.importance(_logistic(d.where("period <= 5")), d.where("period = 7"), [*NUMERIC, *CATEGORICAL])


@query()
def partial_dependence(spark, sf):
    d = _data(spark, sf)
    return learn.dependence(_logistic(d.where("period <= 5")), d.where("period = 7"), "challenger")


@query()
def reason_codes(spark, sf):
    d = _data(spark, sf)
    return learn.reasons(_logistic(d.where("period <= 5")), d.where("period = 7"), NUMERIC)


@query()
def feature_ablation(spark, sf):
    """Paired arms with and without a feature, scored on period 7."""
    d = _data(spark, sf)
    out = None
    for arm, cols in (("full", NUMERIC), ("without_challenger", NUMERIC[1:])):
        m = learn.fit_logistic(d.where("period <= 5"), cols, CATEGORICAL)
        s = learn.predict(m, d.where("period = 7"), ["label"]).withColumn("arm", F.lit(arm))
        out = s if out is None else out.unionByName(s)
    return learn.fold_metrics(out, ["arm"])


@query()
def walk_forward(spark, sf):
    """Test period t: train to t - 2, calibrate on t - 1, for t = 3..7; catch rate at 5 % of each fold."""
    from ..operators import policy

    s = cut(learn.walk_forward(_data(spark, sf), _logistic, ["pos", "period", "label"], range(3, 8)))
    c = policy.capacity_curve(s, ["period"], [0.05])
    how = s.groupBy("period").agg(F.min("method").alias("calibrator"), F.round(F.avg((F.col("score") - F.col("label")) ** 2), 6).alias("brier"))
    return c.join(how, "period").select("period", "queue_size", "caught", F.round(F.col("caught") / F.col("positives"), 6).alias("catch_rate"), "calibrator", "brier")


@query()
def proxy_recoverability(spark, sf):
    """How well each left-out feature can be told from the others: AUROC, on period 7, of a model of the feature being above its median."""
    d = _data(spark, sf)
    out = None
    for name in ("challenger", "orders_of_customer"):
        rest = [c for c in NUMERIC if c != name]
        middle = exact_quantiles(d.where("period <= 5"), [], name, [0.5]).first()["q0"]
        y = d.withColumn("label", (F.col(name) > middle).cast("int"))
        m = learn.fit_logistic(y.where("period <= 5"), rest, CATEGORICAL)
        s = learn.predict(m, y.where("period = 7"), ["label"]).withColumn("feature", F.lit(name))
        out = s if out is None else out.unionByName(s)
    auc = metrics.auroc(metrics.score_steps(out, ["feature"]), ["feature"])
    return auc.select("feature", F.round("auroc", 6).alias("recoverability"))


@query()
def hyperparameter_search(spark, sf):
    """An explicit grid, judged on all rolling folds: regularisation of the logistic model; rounds, depth, step and sampled share of boosted trees."""
    d = _data(spark, sf)
    fits = {f"reg={r:g}": (lambda x, r=r: learn.fit_logistic(x, NUMERIC, CATEGORICAL, r)) for r in (1e-4, 1e-2, 1.0)}
    with boost.Trees(NUMERIC, CATEGORICAL) as fit:
        for rounds, depth, step, share in TREES:
            fits[f"rounds={rounds},depth={depth},step={step:g},share={share:g}"] = lambda x, k=dict(rounds=rounds, depth=depth, step=step, share=share): fit(x, **k)
        return learn.tune(d, fits)


@query()
def global_importance(spark, sf):
    d = _data(spark, sf)
    return learn.contributions(_logistic(d.where("period <= 5")), d.where("period = 7"), NUMERIC)


@query()
def variant_stress(spark, sf):
    """The frozen model on the test period as it is, without discounts, and with scores moved."""
    d = _data(spark, sf)
    test = d.where("period = 7")
    shifted = test.withColumn("challenger", F.least(F.col("challenger") + 0.1, F.lit(1.0)))
    return learn.variants(_logistic(d.where("period <= 5")), {"base": test, "no_discount": test.withColumn("avg_discount", F.lit(None).cast("double")), "moved_scores": shifted})


def _tree_contributions(spark, sf):
    d = _data(spark, sf)
    model = learn.fit_trees(d.where("period <= 5"), NUMERIC, CATEGORICAL)
    return explain.tree_contributions(model, d.where("period = 7"), ["pos"])


@query()
def tree_reason_codes(spark, sf):
    """The three features that raise the margin of boosted trees most, for every row of the test period, by Shapley values."""
    return explain.tree_reasons(_tree_contributions(spark, sf), [*NUMERIC, *CATEGORICAL], ["pos"])


@query()
def tree_global_importance(spark, sf):
    """Mean absolute Shapley value of each feature of boosted trees over the test period."""
    return explain.tree_importance(_tree_contributions(spark, sf), [*NUMERIC, *CATEGORICAL])


#: What the adaptive search may choose, and the share of the classes' weights evened out.
SPACE: search.Space = {"rounds": search.Number(10, 30, step=10), "depth": search.Number(2, 5, step=1), "step": search.Number(0.035, 0.2, log=True), "share": search.Number(0.5, 1.0)}


@query()
def adaptive_search(spark, sf):
    """The boosted-tree settings of the grid first, then proposals of Parzen estimators, on all rolling folds unless a median rule ends them."""
    d = _data(spark, sf).where("period <= 5")
    grid = [dict(zip(("rounds", "depth", "step", "share"), t, strict=True)) for t in TREES]
    with boost.Trees(NUMERIC, CATEGORICAL) as fit:
        return search.search(d, fit, SPACE, len(grid) + 3, first=grid)

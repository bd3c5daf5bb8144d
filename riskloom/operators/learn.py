"""Models on pyspark.ml: logistic and boosted trees, calibrators, rolling folds, importance, dependence, reasons."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.scalars import expit, logit, uniform
from . import metrics
from .boost import Boosted
from .isotonic import isotonic_fit, isotonic_knots, isotonic_predict
from .quantiles import exact_quantiles
from .queue import ranked

#: Expanding folds: train on periods up to the first, test on the second.
ROLLING = ((2, 3), (3, 4), (4, 5))
#: Fits of a search that run side by side: a fit is many short jobs, which leave most of a machine idle.
TOGETHER = 4


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """df with ``weight`` that gives both classes the same total."""
    t = df.agg(F.count("*").alias("n"), F.sum(label).alias("p"))
    w = F.when(F.col(label) == 1, F.col("n") / (2.0 * F.greatest(F.col("p"), F.lit(1)))).otherwise(F.col("n") / (2.0 * F.greatest(F.col("n") - F.col("p"), F.lit(1))))
    return df.crossJoin(F.broadcast(t)).withColumn("weight", w).drop("n", "p")


def encoders(numeric: Sequence[str], categorical: Sequence[str], scale: bool) -> list:
    """Median imputation, indexing, one-hot (for linear models) and assembly."""
    stages: list = [Imputer(inputCols=list(numeric), outputCols=[f"{c}_i" for c in numeric], strategy="median")]
    stages += [StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_x" for c in categorical], handleInvalid="keep")]
    cats = [f"{c}_x" for c in categorical]
    if scale:
        stages += [VectorAssembler(inputCols=[f"{c}_i" for c in numeric], outputCol="numeric_v"), StandardScaler(inputCol="numeric_v", outputCol="numeric_s", withMean=True)]
        stages += [OneHotEncoder(inputCols=cats, outputCols=[f"{c}_h" for c in categorical])]
        return [*stages, VectorAssembler(inputCols=["numeric_s", *(f"{c}_h" for c in categorical)], outputCol="features")]
    return [*stages, VectorAssembler(inputCols=[*(f"{c}_i" for c in numeric), *cats], outputCol="features")]


def fit_logistic(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], reg: float = 1e-3, label: str = "label") -> PipelineModel:
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=reg, maxIter=30)
    return Pipeline(stages=[*encoders(numeric, categorical, True), lr]).fit(balanced(df, label))


def fit_trees(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], rounds: int = 10, depth: int = 3, label: str = "label", step: float = 0.1, share: float = 1.0) -> PipelineModel:
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=share, seed=17)
    return Pipeline(stages=[*encoders(numeric, categorical, False), gbt]).fit(df)


def predict(model: PipelineModel | Boosted, df: DataFrame, keep: Sequence[str], name: str = "score") -> DataFrame:
    if isinstance(model, Boosted):
        return model.predict(df, keep, name)
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias(name))


def platt(df: DataFrame, score: str = "score", label: str = "label") -> tuple[float, float]:
    """Slope and intercept of the label on the score's logit, hardly regularised."""
    x = VectorAssembler(inputCols=["l"], outputCol="v").transform(df.select(logit(F.col(score)).alias("l"), F.col(label).cast("double").alias("y")))
    m = LogisticRegression(featuresCol="v", labelCol="y", regParam=0.0, standardization=False, maxIter=50).fit(x)
    return float(m.coefficients[0]), float(m.intercept)


def calibrator(df: DataFrame, score: str = "score", label: str = "label", tolerance: float = 0.01) -> tuple[str, DataFrame, Callable[[DataFrame], DataFrame]]:
    """(the chosen method, figures of both, a function that replaces the score by the calibrated one).

    Sigmoid unless isotonic's Brier score on the fitting rows is smaller by more than the tolerance.
    """
    a, b = platt(df, score, label)
    knots = isotonic_knots(isotonic_fit(df, [], score, label), score)

    def sigmoid(x: DataFrame) -> DataFrame:
        return x.withColumn(score, expit(a * logit(F.col(score)) + b))

    def stepped(x: DataFrame) -> DataFrame:
        return isotonic_predict(x, knots, score)

    ways = {"sigmoid": sigmoid, "isotonic": stepped}
    both = None
    for name, way in ways.items():
        one = way(df.select(score, label)).select(score, label, F.lit(name).alias("method"))
        both = one if both is None else both.unionByName(one)
    figures = metrics.losses(both, ["method"], score, label).join(metrics.expected_calibration_error(both, ["method"], score=score, label=label), "method").select("method", "brier", "ece")
    brier = {r["method"]: (r["brier"], r["ece"]) for r in figures.collect()}
    chosen = "sigmoid" if brier["sigmoid"][0] <= brier["isotonic"][0] * (1 + tolerance) else min(brier, key=brier.get)
    return chosen, figures, ways[chosen]


def walk_forward(df: DataFrame, fit, keep: Sequence[str], tests: Sequence[int], period: str = "period") -> DataFrame:
    """Scores of each test period t by the model of the periods up to t - 2, calibrated on t - 1; ``method`` says how."""
    out = None
    for t in tests:
        model = fit(df.where(F.col(period) <= t - 2))
        name, _, calibrated = calibrator(cut(predict(model, df.where(F.col(period) == t - 1), keep)))
        s = calibrated(predict(model, df.where(F.col(period) == t), keep)).withColumn("method", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


def save(model: PipelineModel, path: str, manifest: dict) -> DataFrame:
    """Write a fitted model and its manifest, with a digest of the model's parameters, to a shared folder; the manifest as a row."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    row = {**manifest, "stages": [type(s).__name__ for s in model.stages], "digest": digest(model)}
    spark.createDataFrame([(json.dumps(row, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return spark.read.text(f"{path}/manifest").withColumnRenamed("value", "manifest")


def load(path: str) -> tuple[PipelineModel, dict]:
    """The model and its manifest; a model that is not the one of the manifest is an error."""
    manifest = json.loads(SparkSession.active().read.text(f"{path}/manifest").first()[0])
    model = PipelineModel.load(f"{path}/model")
    if digest(model) != manifest["digest"]:
        raise ValueError(f"the model in {path} is not that of its manifest")
    return model, manifest


def digest(model: PipelineModel) -> str:
    """SHA-256 of what a fitted pipeline has learned: coefficients, trees, categories, centres."""
    known = []
    for s in model.stages:
        for name in ("coefficientMatrix", "interceptVector", "toDebugString", "labelsArray", "categorySizes", "mean", "std"):
            if hasattr(s, name):
                text = str(getattr(s, name))
                known.append(f"{type(s).__name__}.{name}=" + (text.partition("\n")[2] if name == "toDebugString" else text))
        if hasattr(s, "surrogateDF"):
            known.append(str([tuple(r) for r in s.surrogateDF.collect()]))
    return hashlib.sha256("\n".join(known).encode()).hexdigest()


def rolling(df: DataFrame, fit, keep: Sequence[str], folds: Sequence[tuple[int, int]] = ROLLING, period: str = "period") -> DataFrame:
    """Scores of each test period by the model fitted on the periods before it."""
    out = None
    for last, test in folds:
        model = fit(df.where(F.col(period) <= last))
        s = predict(model, df.where(F.col(period) == test), keep)
        out = s if out is None else out.unionByName(s)
    return out


def fold_metrics(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    steps = metrics.score_steps(scores, by)
    return metrics.average_precision(steps, by).join(metrics.auroc(steps, by), list(by))


def permuted(df: DataFrame, column: str, key: str, seed: str, by: Sequence[str]) -> DataFrame:
    """df with the column's values dealt anew within groups: the row at each place of one random order gets the value at that place of another.

    Places are ranks of hash-uniform numbers, taken in two steps as queues are, so no task orders a group.
    """
    place = lambda name: ranked(df.withColumn("draw_", uniform(f"{seed}|{name}", F.lit(column), key)), by, "draw_", key)
    a = place("to").drop("draw_", "group_size")
    b = place("from").select(*by, F.col(column).alias("dealt_"), "rank")
    return a.join(b, [*by, "rank"]).withColumn(column, F.col("dealt_")).select(*df.columns)


def importance(model: PipelineModel, df: DataFrame, columns: Sequence[str], key: str = "pos", by: Sequence[str] = ("period",), seed: str = "perm") -> DataFrame:
    """Loss of average precision when a column is permuted, for each column: one scoring of the unpermuted and permuted rows together."""
    arms = df.withColumn("arm", F.lit("none"))
    for c in columns:
        arms = arms.unionByName(permuted(df, c, key, seed, by).withColumn("arm", F.lit(c)))
    ap = metrics.average_precision(metrics.score_steps(predict(model, arms, ["arm", "label"]), ["arm"]), ["arm"])
    base = ap.where("arm = 'none'").select(F.col("average_precision").alias("base"))
    return ap.where("arm <> 'none'").crossJoin(F.broadcast(base)).select(F.col("arm").alias("feature"), F.round(F.col("base") - F.col("average_precision"), 6).alias("loss"))


def dependence(model: PipelineModel, df: DataFrame, column: str, points: int = 5) -> DataFrame:
    """Mean score with the column held at each of a few quantiles."""
    q = exact_quantiles(df, [], column, [(i + 0.5) / points for i in range(points)])
    grid = q.select(F.posexplode(F.array(*(f"q{i}" for i in range(points)))).alias("point", "held"))
    x = df.crossJoin(F.broadcast(grid)).withColumn(column, F.col("held").cast("double"))
    return predict(model, x, ["point", "held"]).groupBy("point", "held").agg(F.round(F.avg("score"), 6).alias("mean_score"))


def reasons(model: PipelineModel, df: DataFrame, numeric: Sequence[str], key: str = "pos", top: int = 3) -> DataFrame:
    """The numeric features that raise a linear model's score most, row by row: coefficient times standardised value, positive ones, the first three."""
    scaled = model.stages[-2].transform(_through(model, df))
    values = vector_to_array("numeric_s")
    w = [float(c) for c in model.stages[-1].coefficients.toArray()[: len(numeric)]]
    parts = F.array(*(F.struct((-F.lit(w[i]) * values[i]).alias("v"), F.lit(c).alias("name")) for i, c in enumerate(numeric)))
    best = F.slice(F.array_sort(F.filter(parts, lambda p: p["v"] < 0)), 1, top)
    return scaled.select(key, F.array_join(F.transform(best, lambda p: p["name"]), ", ").alias("reasons"))


def _through(model: PipelineModel, df: DataFrame) -> DataFrame:
    for stage in model.stages[:-2]:
        df = stage.transform(df)
    return df


def tune(df: DataFrame, fits: dict[str, object], folds: Sequence[tuple[int, int]] = ROLLING) -> DataFrame:
    """Settings (name: fit function) by their average precision over rolling folds: mean, worst and mean + 0.10 * worst."""
    out = None
    with ThreadPoolExecutor(TOGETHER) as pool:
        fitted = pool.map(lambda fit: rolling(df, fit, ["period", "label"], folds), fits.values())
        for name, s in zip(fits, fitted, strict=True):
            s = s.withColumn("setting", F.lit(name))
            out = s if out is None else out.unionByName(s)
    by_fold = metrics.average_precision(metrics.score_steps(out, ["setting", "period"]), ["setting", "period"])
    m = by_fold.groupBy("setting").agg(F.avg("average_precision").alias("mean"), F.min("average_precision").alias("worst"))
    return m.select("setting", *(F.round(c, 6).alias(c) for c in ("mean", "worst")), F.round(F.col("mean") + 0.10 * F.col("worst"), 6).alias("objective"))


def contributions(model: PipelineModel, df: DataFrame, numeric: Sequence[str], top: int = 15) -> DataFrame:
    """Mean absolute contribution of each numeric feature of a linear model: |coefficient| times the mean absolute standardised value."""
    scaled = model.stages[-2].transform(_through(model, df)).select(vector_to_array("numeric_s").alias("v"))
    w = [float(c) for c in model.stages[-1].coefficients.toArray()[: len(numeric)]]
    sums = scaled.agg(*(F.avg(F.abs(F.col("v")[i]) * abs(w[i])).alias(c) for i, c in enumerate(numeric)))
    rows = ", ".join(f"'{c}', `{c}`" for c in numeric)
    return sums.select(F.expr(f"stack({len(numeric)}, {rows}) as (feature, mean_contribution)")).withColumn("mean_contribution", F.round("mean_contribution", 6)).orderBy(F.desc("mean_contribution"), "feature").limit(top)


def variants(model: PipelineModel, frames: dict[str, DataFrame], keep: Sequence[str] = ("label",)) -> DataFrame:
    """A frozen model on several evidence sources: ranking and loss by source."""
    out = None
    for name, df in frames.items():
        s = predict(model, df, keep).withColumn("evidence_source", F.lit(name))
        out = s if out is None else out.unionByName(s)
    by = ["evidence_source"]
    m = fold_metrics(out, by).join(metrics.losses(out, by).select(*by, "prevalence", "brier"), by)
    return m.select(*by, *(F.round(c, 6).alias(c) for c in ("average_precision", "auroc", "prevalence", "brier")))

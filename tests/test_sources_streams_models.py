"""File sources and sinks, streams against their batch forms, models."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskloom.operators import learn
from riskloom.plans.models import CATEGORICAL, NUMERIC, _data, _logistic
from riskloom.sources import files
from riskloom.sources.tables import table
from riskloom.streaming import velocity as v


def test_csv_contract(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    path = str(tmp_path / "c")
    assert files.write_csv(df, path) == 2
    assert files.csv_header(spark, path) == ["k", "v"]
    assert files.read_csv(spark, path, df.schema).count() == 2
    with pytest.raises(ValueError):
        files.read_csv(spark, path, spark.createDataFrame([], "v string, k int").schema)


def test_parquet_partitions_are_replaced_by_key(spark, tmp_path):
    path = str(tmp_path / "p")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "v int, m string")
    files.write_parquet(a, path, ["m"])
    files.replace_partitions(spark.createDataFrame([(9, "y")], "v int, m string"), path, ["m"])
    assert {tuple(r) for r in spark.read.parquet(path).select("v", "m").collect()} == {(1, "x"), (9, "y")}


def test_json_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 2.0)], "b int, a string, t double")
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":null,"b":1,"t":2.0}'
    assert files.read_json(spark, str(tmp_path / "j")).count() == 1
    assert {r["status"] for r in files.read_back(df, df, "b", "t").collect()} == {"pass"}
    assert {r["status"] for r in files.read_back(df, df.limit(0), "b", "t").collect()} == {"fail"}


def test_migrations_run_once_and_are_immutable(spark):
    scripts = [("001", "create or replace temp view m1 as select 1 as x; create or replace temp view m2 as select * from m1")]
    reg = files.migrate(spark, None, scripts)
    assert files.migrate(spark, reg, scripts).collect() == reg.collect() and spark.table("m2").count() == 1
    with pytest.raises(ValueError):
        files.migrate(spark, reg, [("001", "select 2")])


@pytest.fixture(scope="module")
def events(spark, sf, tmp_path_factory):
    """The events as a folder of files in time order, and its schema."""
    path = str(tmp_path_factory.mktemp("events") / "e")
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return path, spark.read.parquet(path).schema


def drained(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


@pytest.mark.parametrize("f", [v.velocity, v.daily_arrivals])
def test_stream_equals_batch(spark, events, f):
    path, schema = events
    want = {tuple(r) for r in f(spark.read.parquet(path)).collect()}
    got = drained(f(v.stream(spark, path, schema)), f"s_{f.__name__}", "complete")
    assert {tuple(r) for r in got.collect()} == want


def test_idempotent_sink(spark, events, tmp_path):
    path, schema = events
    for _ in range(2):
        v.write_once(v.stream(spark, path, schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(path).count()


def test_pairs_are_seen_when_the_later_record_arrives(spark, events):
    path, schema = events
    got = drained(v.pair_arrivals(v.stream(spark, path, schema, files=1), "user_id", "6 HOURS", late="40 days"), "s_pairs", "append")
    want = {tuple(r) for r in v.pair_arrivals(spark.read.parquet(path), "user_id", "6 HOURS").collect()}
    assert want and {tuple(r) for r in got.collect()} == want


def test_labels_are_given_out_when_they_have_matured(spark, tmp_path):
    at = lambda day: f"timestamp'2024-01-{day:02d} 00:00:00'"
    schema = "id long, ts timestamp"
    for name, rows in {"a": [(1, 1), (2, 2), (3, 20), (4, 28)], "o": [(1, 3), (2, 9), (3, 21), (9, 29)]}.items():
        spark.sql(" UNION ALL ".join(f"SELECT {i}L AS id, {at(d)} AS ts" for i, d in rows)).coalesce(1).write.parquet(str(tmp_path / name))
    sides = lambda read: [read(str(tmp_path / n)) for n in "ao"]
    whole = {(r["id"], r["label"]) for r in v.matured(*sides(spark.read.schema(schema).parquet), "id", "5 DAYS").collect()}
    assert whole == {(1, 1), (2, 0), (3, 1), (4, 0)}
    # On the stream the last application has not matured yet: its horizon lies beyond the watermark.
    got = drained(v.matured(*sides(spark.readStream.schema(schema).parquet), "id", "5 DAYS", late="1 hour"), "s_mature", "append")
    assert {(r["id"], r["label"]) for r in got.collect()} == whole - {(4, 0)}


def test_jdbc_reads_in_ranges_and_appends(spark):
    """Against the engine's own embedded database."""
    url, driver = "jdbc:derby:memory:risk;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.range(1000).selectExpr("cast(id as int) as k", "cast(id * 2 as double) as v")
    df.limit(0).write.jdbc(url, "t", mode="overwrite", properties=driver)
    files.write_jdbc(df, url, "t", batch=100, **driver)
    files.write_jdbc(df.selectExpr("k + 1000 as k", "v"), url, "t", **driver)
    got = files.read_jdbc(spark, url, "t", "k", (0, 2000), 5, **driver)
    assert got.rdd.getNumPartitions() == 5
    assert {(r["K"], r["V"]) for r in got.toDF("K", "V").collect()} == {(i, 2.0 * (i % 1000)) for i in range(2000)}


def test_model_files(spark, sf, tmp_path):
    d = _data(spark, sf)
    for fit, name in ((_logistic, "linear"), (lambda x: learn.fit_trees(x, NUMERIC, CATEGORICAL, rounds=2), "trees")):
        m = fit(d.where("period <= 3"))
        path = f"file://{tmp_path}/{name}"
        row = learn.save(m, path, {"model_version": name, "code_sha": "c0de"}).collect()
        again, manifest = learn.load(path)
        assert len(row) == 1 and manifest["model_version"] == name and manifest["stages"][-1].endswith("Model")
        x = d.where("period = 7")
        score = lambda k: {r["pos"]: r["score"] for r in learn.predict(k, x, ["pos"]).collect()}
        assert score(m) == score(again)
    learn.fit_logistic(d.where("period <= 4"), NUMERIC, CATEGORICAL).write().overwrite().save(f"{tmp_path}/linear/model")
    with pytest.raises(ValueError, match="not that of its manifest"):
        learn.load(f"file://{tmp_path}/linear")


def test_linear_scores_reasons_and_contributions_follow_from_coefficients(spark, sf):
    import math

    d = _data(spark, sf)
    m = _logistic(d.where("period <= 5"))
    test = d.where("period = 7").where("avg_discount is not null")
    lr, scaler, indexers = m.stages[-1], next(s for s in m.stages if type(s).__name__ == "StandardScalerModel"), [s for s in m.stages if type(s).__name__ == "StringIndexerModel"]
    w, n = lr.coefficients.toArray(), len(NUMERIC)
    sizes = [len(x) for s in indexers for x in s.labelsArray]
    scores = {r["pos"]: r["score"] for r in learn.predict(m, test, ["pos"]).collect()}
    codes = {r["pos"]: r["reasons"] for r in learn.reasons(m, test, NUMERIC).collect()}
    total = [0.0] * n
    rows = test.collect()
    for r in rows:
        z = [(r[c] - scaler.mean[i]) / scaler.std[i] for i, c in enumerate(NUMERIC)]
        logit, at = lr.intercept + sum(a * b for a, b in zip(w, z)), n
        for s in indexers:
            for column, labels in zip(s.getInputCols(), s.labelsArray):
                logit += w[at + labels.index(r[column])] if at + labels.index(r[column]) < at + len(labels) else 0.0
                at += len(labels)
        assert scores[r["pos"]] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9)
        parts = sorted(((-w[i] * z[i], c) for i, c in enumerate(NUMERIC) if w[i] * z[i] > 0))[:3]
        assert codes[r["pos"]] == ", ".join(c for _, c in parts)
        total = [t + abs(w[i] * z[i]) for i, t in enumerate(total)]
    assert sizes and {r["feature"]: r["mean_contribution"] for r in learn.contributions(m, test, NUMERIC).collect()} == {c: pytest.approx(total[i] / len(rows), abs=1e-6) for i, c in enumerate(NUMERIC)}


def test_walk_forward_is_calibrated_on_the_period_before(spark, sf):
    """The calibrated fold is the fitted model's scores put through the calibrator that the period before gives."""
    d = _data(spark, sf)
    got = {r["pos"]: r["score"] for r in learn.walk_forward(d, _logistic, ["pos", "period", "label"], [4]).collect()}
    m = _logistic(d.where("period <= 2"))
    name, figures, calibrated = learn.calibrator(learn.predict(m, d.where("period = 3"), ["pos", "label"]))
    want = {r["pos"]: r["score"] for r in calibrated(learn.predict(m, d.where("period = 4"), ["pos", "label"])).collect()}
    raw = {r["pos"]: r["score"] for r in learn.predict(m, d.where("period = 4"), ["pos"]).collect()}
    assert got == pytest.approx(want) and want != raw
    brier = {r["method"]: r["brier"] for r in figures.collect()}
    assert name == ("sigmoid" if brier["sigmoid"] <= brier["isotonic"] * 1.01 else "isotonic")


def test_models(spark, sf):
    d = _data(spark, sf).cache()
    m = _logistic(d.where("period <= 5"))
    s = learn.predict(m, d.where("period = 7"), ["pos", "label"])
    assert s.where("score < 0 or score > 1 or score is null").isEmpty() and s.count() == d.where("period = 7").count()
    imp = learn.importance(m, d.where("period = 7"), ["challenger", "channel"])
    assert {r["feature"] for r in imp.collect()} == {"challenger", "channel"}
    pdp = learn.dependence(m, d.where("period = 7"), "challenger").collect()
    assert len(pdp) == 5 and all(0 < r["mean_score"] < 1 for r in pdp)
    got = learn.reasons(m, d.where("period = 7"), NUMERIC).collect()
    assert all(set(filter(None, r["reasons"].split(", "))) <= set(NUMERIC) and r["reasons"].count(",") <= 2 for r in got)
    mixed = learn.permuted(d, "challenger", "pos", "s", ["period"])
    assert mixed.agg(F.round(F.sum("challenger"), 6)).first() == d.agg(F.round(F.sum("challenger"), 6)).first()
    assert learn.fit_trees(d.where("period <= 3"), NUMERIC, CATEGORICAL, rounds=2).transform(d.limit(5)).count() == 5


def test_search_judges_at_least_six_settings_on_all_folds(spark, sf, monkeypatch):
    from riskloom.plans import QUERIES

    seen = []
    monkeypatch.setattr(learn, "rolling", lambda df, fit, keep, folds=learn.ROLLING: seen.append(tuple(folds)) or df.where("period between 3 and 5").selectExpr(*keep, "challenger as score"))
    got = QUERIES["hyperparameter_search"](spark, sf).collect()
    assert len(got) == len(seen) >= 6 and set(seen) == {((2, 3), (3, 4), (4, 5))}


def test_calibrators_recover_a_known_line(spark):
    from riskloom.functions.scalars import expit, logit, uniform

    p = spark.range(4000).select(uniform("p", F.col("id")).alias("score"), uniform("y", F.col("id")).alias("u"))
    df = p.select("score", (F.col("u") < expit(0.5 * logit(F.col("score")) - 0.3)).cast("int").alias("label"))
    a, b = learn.platt(df)
    assert abs(a - 0.5) < 0.1 and abs(b + 0.3) < 0.15
    knots = learn.isotonic_knots(learn.isotonic_fit(df))
    out = [r["fit"] for r in learn.isotonic_predict(df.withColumn("fit", F.col("score")), knots, "fit").orderBy("score").collect()]
    assert out == sorted(out) and 0 <= out[0] and out[-1] <= 1

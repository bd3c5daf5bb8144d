"""Contract rules one by one, and tables of the extract through their evidence documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import lineage
from riskloom.operators import contract, governance, linking
from riskloom.plans import QUERIES, links
from riskloom.plans.governance import extract_table
from riskloom.sources import tables


def test_rules_on_odd_values(spark):
    rows = [(1, 0.5, "low", "x" * 8, ["r"], 0), (2, None, None, None, None, None), (3, float("nan"), "odd", "short", [], 2), (4, 1.0, "low", "x" * 128, [], 0), (5, -0.1, "low", "x" * 129, ["r"], 3), (1, 0.5, "low", "x" * 8, ["r"], 0)]
    df = spark.createDataFrame(rows, "id int, p double, band string, name string, why array<string>, over int")
    rules = [
        contract.required("p"), contract.between("p", 0, 1), contract.between("p", 0, 1, above=True), contract.one_of("band", ["low"]), contract.text("name", 8, 128),
        contract.holds("reasons", (F.col("over") <= 0) | (F.size("why") > 0), F.col("over")),
    ]
    got = sorted((r["id"], r["rule"], r["value"]) for r in contract.violations(df, ["id"], rules).collect() if r["id"] != 2)
    assert got == sorted([(3, "p in [0, 1]", "NaN"), (3, "p in (0, 1]", "NaN"), (5, "p in [0, 1]", "-0.1"), (5, "p in (0, 1]", "-0.1"), (3, "band is one of low", "odd"), (3, "name has 8 to 128 characters", "short"), (5, "name has 8 to 128 characters", "x" * 129), (3, "reasons", "2")])
    assert sorted(r["rule"] for r in contract.violations(df.where("id = 2"), ["id"], rules).collect()) == ["p is required", "reasons"]
    counts = {r["rule"]: (r["rows"], r["broken"]) for r in contract.summary(df, rules).collect()}
    assert counts["p is required"] == (6, 1) and counts["band is one of low"] == (6, 1)
    empty = contract.summary(df.limit(0), rules).collect()
    assert len(empty) == len(rules) and all((r["rows"], r["broken"]) == (0, 0) for r in empty)
    assert contract.forbidden(df, ["id", "P", "band", "name", "why", "score"]) == ["over", "-score"]


def test_history_tells_what_replaced_what(spark):
    rows = [("a", "1", "draft"), ("a", "2", "approved"), ("a", "3", "approved"), ("b", "1", "draft"), (None, "1", "draft")]
    got = governance.history(spark.createDataFrame(rows, "model_version string, run string, approval_state string"), "run").collect()
    assert sorted((r["model_version"], r["run"], r["replaced_by"], r["current"], r["changed"]) for r in got) == [("a", "1", "2", False, False), ("a", "2", "3", False, True), ("a", "3", None, True, False), ("b", "1", None, True, False)]


def test_documents_give_back_every_row(spark, sf):
    for table, source in (("fact_model_metric", "extract_model_metrics"), ("fact_capacity", "capacity_sweep_wilson"), ("dim_evidence_source", "extract_sources")):
        want = QUERIES[source](spark, sf)
        got = extract_table(spark, sf, table)
        assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_extract_joins_applications_once(spark, sf, monkeypatch):
    joined, linked, fixtures = [], [], []
    for module, name, seen in ((tables, "_joined", joined), (links, "_measured", linked), (linking, "fixture", fixtures)):
        f = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, f=f, seen=seen, **b: (seen.append(a), f(*a, **b))[1])
    QUERIES["star_extract"](spark, sf)
    assert len(joined) == len(linked) == len(fixtures) == 1
    assert QUERIES["apps_base"](spark, sf).count() > 0 and len(joined) == 2  # nothing is kept beyond the call


def test_steps_are_kept_inside_sharing_only(spark):
    made = []
    step = lambda key: lineage.once(key, lambda: (made.append(key), spark.range(3))[1])

    def both(a, b):
        return step(a).count() + step(b).count()

    assert both(("x", 1), ("x", 1)) == 6 and len(made) == 2
    assert lineage.sharing(both)(("x", 1), ("x", 1)) == 6 and len(made) == 3
    assert lineage.sharing(both)(("x", 1), ("x", 2)) == 6 and len(made) == 5
    assert lineage.sharing(lambda: lineage.sharing(both)(("y",), ("y",)) + step(("y",)).count())() == 9 and len(made) == 6


def test_run_context_joins_applications_once(spark, sf, monkeypatch):
    joined = []
    f = tables._joined
    monkeypatch.setattr(tables, "_joined", lambda *a, **b: (joined.append(a), f(*a, **b))[1])
    assert QUERIES["extract_run_context"](spark, sf).count() > 0 and len(joined) == 1

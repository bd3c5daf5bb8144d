"""Boosted trees on cells against the engine's, and their draws."""

from __future__ import annotations

import numpy as np
import pytest

from riskloom.operators import boost, learn
from riskloom.plans.models import CATEGORICAL, NUMERIC, _data


@pytest.mark.parametrize("settings", [{"rounds": 4, "depth": 3}, {"rounds": 3, "depth": 5, "step": 0.05}])
def test_cells_give_the_trees_of_the_engine(spark, sf, settings):
    """Up to 10,000 rows the engine takes edges from all rows, so scores of those rows are its scores; others may lie between two edges that part them equally well."""
    train = test = _data(spark, sf).where("period <= 4")
    want = {r["pos"]: r["score"] for r in learn.predict(learn.fit_trees(train, NUMERIC, CATEGORICAL, **settings), test, ["pos"]).collect()}
    with boost.Trees(NUMERIC, CATEGORICAL) as fit:
        got = {r["pos"]: r["score"] for r in learn.predict(fit(train, **settings), test, ["pos"]).collect()}
    assert len(set(want.values())) > 5 and got == pytest.approx(want, abs=1e-6)


def test_rows_are_binned_once_and_count_as_often_as_they_occur(spark, sf):
    """Four copies of every row: as many cells, the same trees, also where rows lie in other partitions."""
    rows = _data(spark, sf).drop("pos")
    d = rows.where("period <= 4")
    more = d.crossJoin(spark.range(4)).drop("id").repartition(7)
    with boost.Trees(NUMERIC, CATEGORICAL) as fit:
        one = fit(d, rounds=3)
        fit(rows.where("period <= 4"), rounds=2, depth=2)
        assert len(fit.kept) == 1
        four = fit(more, rounds=3)
        assert len(fit.kept) == 2 and fit.kept[0][1].count == fit.kept[1][1].count
        a, b = (sorted(r["score"] for r in learn.predict(m, d, ["label"]).collect()) for m in (one, four))
        again, dealt = (sorted(r["score"] for r in learn.predict(fit(x, rounds=3, share=0.7), d, ["label"]).collect()) for x in (d, d.repartition(5)))
    assert a == pytest.approx(b, abs=1e-9) and again == dealt != a


def test_draws_are_binomial():
    u = boost.uniform(np.arange(40_000), 17, 3, 0)
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.002
    for n, p in ((0, 0.5), (1, 0.8), (7, 0.8), (5_000, 0.53)):
        k = boost.binomial(np.full(len(u), n), p, u)
        assert k.min() >= 0 and k.max() <= n and k.mean() == pytest.approx(n * p, rel=0.02) and k.var() == pytest.approx(n * p * (1 - p), rel=0.05)

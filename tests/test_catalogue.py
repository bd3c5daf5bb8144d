"""Every query with an oracle gives DuckDB's rows on the smallest tables; the others run."""

from __future__ import annotations

import math

import duckdb
import pytest

from riskloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Slow model fits, which test_models covers.
MODELS = {n for n, f in plans.QUERIES.items() if f.__module__.endswith(".models")}


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - MODELS))
def test_query_matches_sql(spark, sf, con, name):
    df = plans.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) or "" for c in columns) for r in df.collect())
    cur = con.execute(plans.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(norm(r[i]) or "" for i in at) for r in cur.fetchall())


def test_models_alone_have_no_oracle():
    assert set(plans.QUERIES) - set(plans.SQL) == MODELS


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(plans.SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_are_pruned_and_filters_pushed(spark, sf):
    plan = plans.QUERIES["queue_rank_cut"](spark, sf)._jdf.queryExecution().toString()
    assert "o_orderstatus" not in plan.split("Physical Plan")[1] and "PushedFilters: [IsNotNull(l_returnflag)" in plan or "EqualTo(l_returnflag,R)" in plan

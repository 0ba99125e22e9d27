"""Each query gives the rows of its oracle; see also the plans that are wanted."""

import math
import os

import duckdb
import pytest

from silt import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def shown(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return str(x)
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    return x.isoformat(" ") if hasattr(x, "isoformat") else f"{float(x):.6g}" if not isinstance(x, (list, dict, tuple)) else str(x)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) > 100


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    c = duck.execute(ORACLES[name])
    names = [d[0] for d in c.description]
    assert sorted(names) == sorted(df.columns)
    assert table(df.collect(), df.columns) == table(c.fetchall(), names)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(QUERIES["where_eq"](spark, SF))
    assert "EqualTo(event_type,click)" in p and "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in p


def test_asof_join_shuffles_once(spark):
    p = plan(QUERIES["asof_inner"](spark, SF))
    assert "Join" not in p and p.count("Exchange hashpartitioning(user_id") <= 3


def test_grok_and_casts_stay_in_the_jvm(spark):
    for name in ("grok_url", "int_cast", "json_int", "regexp_group", "row_json"):
        assert "Python" not in plan(QUERIES[name](spark, SF))

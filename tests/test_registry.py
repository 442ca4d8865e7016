"""Every registered query runs on the small tables and equals its SQL."""

import os

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_DIR
from tools.check_oracle import TABLES, canonical

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def test_names_match():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 100


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    if name not in ORACLE:
        assert got.count() > 0
        return
    a, b = canonical(got.toPandas()), canonical(duck.execute(ORACLE[name]).df())
    assert list(a.columns) == list(b.columns)
    assert a.equals(b)


@pytest.mark.parametrize("name", ["f2_fuse_dempster", "g1_predict", "score_by_status", "j5_compute_metrics", "k1_class_support", "e2_activate_lineitem"])
def test_plans_have_no_cross_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInArrow", "MapInPandas"):
        assert word not in plan

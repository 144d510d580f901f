"""Every query that has SQL, against DuckDB on the smallest tables."""

import datetime
import glob
import importlib
import os

import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"
MODULES = [importlib.import_module(f"signalloom.plans.{m}") for m in ("ranking", "telemetry", "outcomes", "jobs", "feeds", "streams", "fields", "lookups")]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    r = con.execute(SQL[name])
    theirs = [d[0] for d in r.description]
    assert sorted(theirs) == cols
    want = sorted((tuple(norm(row[theirs.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
    got = sorted((tuple(norm(row[c]) for c in cols) for row in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.queries())


def test_filter_reaches_the_scan(spark):
    plan = QUERIES["findings_by_urgency"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(urgency,high)" in plan
    assert "summary" not in plan.split("ReadSchema")[1]

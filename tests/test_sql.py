"""Every query that has SQL, against DuckDB on the same tables."""

import glob
import os

import pytest

from trawl import plans


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def compare(spark, data, run, sql):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = run(spark, data)
    result = c.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted(repr(tuple(plain(r[n]) for n in order)) for r in df.collect())
    theirs = sorted(repr(tuple(plain(r[names.index(n)]) for n in order)) for r in result.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_sql(spark, data, name):
    compare(spark, data, plans.queries()[name], plans.oracle_sql()[name])


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.queries()["search_smart"](spark, data).count() > 0


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, data, name):
    assert plans.queries()[name](spark, data).columns


def test_narrow_scans(spark, data):
    """Status reads no texts and no vectors."""
    plan = plans.queries()["status_counts"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan and "ReadSchema" in plan
    plan = plans.queries()["filter_kind_size"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(size" in plan

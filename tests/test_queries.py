"""Every query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from glosstream.plans import checked, forms, lookup, more, places, units, workflow  # noqa: F401
from glosstream.plans.relational import QUERIES, entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query(spark, duck, name):
    run, sql = QUERIES[name]
    df = run(spark, FOLDER)
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_query_without_sql(spark, name):
    assert QUERIES[name][0](spark, FOLDER).count() > 0


def test_entry(spark):
    got = {r["label"]: r["paragraphs"] for r in entry(spark, FOLDER).collect()}
    assert got and set(got) <= {"match", "plain"}


def test_no_driver_side_collect_in_queries():
    """Operators that build plans do not pull tables to the driver."""
    import inspect

    from glosstream.operators import audit, context, export, progress, route, stats, upsert

    for module in (audit, context, export, progress, route, stats, upsert):
        assert ".collect()" not in inspect.getsource(module) and "toPandas" not in inspect.getsource(module)

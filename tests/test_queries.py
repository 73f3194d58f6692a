"""Every registered estimator query against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__
from foldstat import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("lineitem", "events", "orders"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, db, name):
    df = queries.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    sql = queries.oracle_sql().get(name)
    if not sql:
        return
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda rs: sorted((tuple(r) for r in rs), key=lambda r: [str(x) if isinstance(x, str) else f"{x:030.6f}" for x in r])
    got, want = key([[r[n] for n in names] for r in rows]), key(found.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or not isinstance(y, str) and x == pytest.approx(y, rel=1e-6, abs=2e-4 if abs(y) > 1 else 1e-6), name


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert [r.param for r in __spark_entry__.entry(spark).collect()] == ["const", "l_quantity"]

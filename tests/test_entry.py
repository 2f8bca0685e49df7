"""Driver contract and the oracle check on the smallest scale factor."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"grid", "year", "week", "risk", "occurrence"} <= set(df.columns)


def test_every_query_has_callable_and_known_oracle():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80 and len(o) >= 60


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return f"{round(v, 6) + 0.0:.6f}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(ocols)
    so = sorted(range(len(sdf.columns)), key=lambda i: sdf.columns[i])
    oo = sorted(range(len(ocols)), key=lambda i: ocols[i])
    a = sorted(tuple(_norm(r[i]) for i in so) for r in sdf.collect())
    b = sorted(tuple(_norm(r[i]) for i in oo) for r in res.fetchall())
    assert a == b

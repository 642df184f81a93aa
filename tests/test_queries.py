"""Every query of the reference's operators against DuckDB."""

import os

import duckdb
import pytest

from cadenza.plans.registry import QUERIES, SQL

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return c


def cell(v):
    if v is None or v != v:
        return None
    return f"{v:.6g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, D)
    cols = sorted(got.columns)
    want = duck.execute(SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    a = sorted((tuple(cell(r[c]) for c in cols) for r in got.collect()), key=str)
    b = sorted((tuple(cell(r[i]) for i in order) for r in want.fetchall()), key=str)
    assert a == b

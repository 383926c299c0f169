"""Every query of the library proper against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from larkspan.plans import catalog


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return c


def norm(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool):
        return str(x)
    try:
        return f"{float(x):.6g}"
    except (TypeError, ValueError):
        return str(x)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, small, con, name):
    mine = catalog.QUERIES[name](spark, small)
    ref = con.sql(catalog.SQL[name])
    columns = sorted(mine.columns)
    assert columns == sorted(ref.columns)
    at = [ref.columns.index(c) for c in columns]
    a = sorted(tuple(norm(v) for v in r) for r in mine.select(*[f"`{c}`" for c in columns]).collect())
    b = sorted(tuple(norm(r[i]) for i in at) for r in ref.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_without_sql(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0

"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest
from foliant.plans import catalogue, catalogue_more  # noqa: F401

PATH = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(PATH):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{PATH}/{name}'")
    return c


def plain(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) and not math.isnan(x) else x for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_like_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, PATH)
    want = con.sql(catalogue.ORACLE[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert plain(got.select(*names).collect()) == plain(want.select(*[duckdb.ColumnExpression(c) for c in names]).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, PATH).count() > 0

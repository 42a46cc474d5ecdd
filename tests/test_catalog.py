"""Every catalog query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from quillframe.catalog import CATALOG

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", CATALOG)
def test_query(spark, duck, name):
    query, sql = CATALOG[name]
    df = query(spark, SF)
    expected = duck.sql(sql)
    assert sorted(df.columns) == sorted(expected.columns)
    at = [expected.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in expected.fetchall())

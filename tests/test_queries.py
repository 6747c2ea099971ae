"""Every registered query against its DuckDB form on the smallest tables."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from refract.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert df.count() > 0
        return
    r = duck.sql(ORACLES[name])
    columns = sorted(r.columns)
    assert columns == sorted(df.columns)
    at = [r.columns.index(c) for c in columns]
    want = [tuple(plain(t[i]) for i in at) for t in r.fetchall()]
    got = [tuple(plain(t[c]) for c in columns) for t in df.collect()]
    assert in_order(got) == in_order(want)

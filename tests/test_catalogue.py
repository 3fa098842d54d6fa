"""Every query with SQL gives the rows that DuckDB gives, at the smallest scale."""

import math
import os

import duckdb
import pytest

from cairn.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cursor = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    ours = [tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()]
    at = [columns.index(c) for c in sorted(columns)]
    theirs = [tuple(plain(r[k]) for k in at) for r in cursor.fetchall()]
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)

"""Every registered engine query that SQL can express, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from rivulet.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_oracle(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(registry.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=_key)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=_key)
    assert len(got) == len(want) > 0
    assert all(_same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_oracle_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_coordinates_come_back(spark):
    assert registry.QUERIES["coordinate_shift"](spark, SF).agg({"error_m": "max"}).head()[0] < 0.1

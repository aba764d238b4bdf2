"""Every registered query outside the optional subpackage against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from factlens.bindings import TABLES
from factlens.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def shown(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(round(value, 6))
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    rows = sorted(tuple(shown(r[c]) for c in sorted(found.columns)) for r in found.collect())
    if name in ORACLE:
        want = duck.execute(ORACLE[name])
        columns = [d[0] for d in want.description]
        order = sorted(range(len(columns)), key=columns.__getitem__)
        assert [columns[k] for k in order] == sorted(found.columns)
        assert rows == sorted(tuple(shown(r[k]) for k in order) for r in want.fetchall())


def test_registration():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 70

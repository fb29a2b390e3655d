"""Every query against its SQL twin, on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from homescore.plans.oracle import ORACLE
from homescore.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "customer events lineitem nation orders part region supplier".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def order(row):
    return tuple((v is None, str(type(v)), v) for v in row)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=order)
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=order)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=1e-9)) for x, y in zip(a, b)), (a, b)

"""Queries against their SQL on the smallest driver tables."""

import os

import duckdb
import pytest

from homescore.llm.queries import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "conversations"):
        duck.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(cursor.fetchall())

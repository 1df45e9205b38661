"""Every query that SQL can express, against its SQL over whole tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from haberdash.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    made = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "embeddings", "labels"):
        path = f"{FOLDER}/{name}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return made


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, connection, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    relation = connection.sql(ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    expected = sorted(relation.select(*columns).fetchall(), key=repr)
    assert sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr) == expected


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))

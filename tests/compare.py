"""Compare a Spark result with its SQL check, column by column and row by row."""

from __future__ import annotations

import duckdb

TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_TYPES = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    return connection


def _sortable(row: tuple) -> tuple:
    return tuple((False,) if value is None else (True, value) for value in row)


def spark_side(frame) -> tuple[dict[str, str], list[tuple]]:
    names = sorted(frame.columns)
    kinds = {
        f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
        for f in frame.schema.fields
    }
    return {n: kinds[n] for n in names}, [tuple(r) for r in frame.select(*names).collect()]


def sql_side(connection, sql: str) -> tuple[dict[str, str], list[tuple]]:
    relation = connection.sql(sql)
    names = sorted(relation.columns)
    kinds = dict(zip(relation.columns, (str(t) for t in relation.types)))
    return {n: kinds[n] for n in names}, relation.select(*names).fetchall()


def differences(frame, connection, sql: str) -> list[str]:
    """Empty when types and rows (in any order) agree."""
    left_types, left = spark_side(frame)
    right_types, right = sql_side(connection, sql)
    found = [
        f"{n}: {left_types.get(n)} against {right_types.get(n)}"
        for n in sorted({*left_types, *right_types})
        if left_types.get(n) != right_types.get(n)
    ]
    left, right = sorted(left, key=_sortable), sorted(right, key=_sortable)
    if len(left) != len(right):
        found.append(f"{len(left)} rows against {len(right)}")
    for a, b in zip(left, right):
        if a != b:
            found.append(f"{dict(zip(left_types, a))} against {dict(zip(right_types, b))}")
            break
    return found

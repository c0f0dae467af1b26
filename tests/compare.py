"""Compare a Spark result with DuckDB rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(value):
    if value is None:
        return ""
    if isinstance(value, decimal.Decimal):
        return format(value.normalize(), "f")
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when names, types and the multiset of rows agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(set(df.columns) ^ set(names))}"]
    found = []
    for name, kind in df.dtypes:
        if TYPES.get(kind) != types[name]:
            found.append(f"type of {name}: {kind} against {types[name]}")
    order = sorted(names)
    mine = sorted(tuple(_cell(r[n]) for n in order) for r in df.collect())
    position = {n: i for i, n in enumerate(names)}
    theirs = sorted(tuple(_cell(r[position[n]]) for n in order) for r in expected)
    if mine != theirs:
        only_mine = [r for r in mine if r not in set(theirs)][:2]
        only_theirs = [r for r in theirs if r not in set(mine)][:2]
        found.append(f"{len(mine)} rows against {len(theirs)}; {order}; spark only {only_mine}; sql only {only_theirs}")
    if not mine:
        found.append("no rows")
    return found

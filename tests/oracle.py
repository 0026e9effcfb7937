"""Compares registered queries with their SQL on one data folder."""

import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return repr(value + 0.0) if isinstance(value, float) else str(value)


def rows(columns: list[str], values) -> list[tuple]:
    return sorted(tuple(_plain(v[c]) for c in columns) for v in values)


def same(spark, con, query, sql: str, folder: str) -> None:
    df = query(spark, folder)
    columns = sorted(df.columns)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    wanted = rows(columns, [dict(zip(names, r)) for r in cursor.fetchall()])
    got = rows(columns, [r.asDict() for r in df.collect()])
    assert got == wanted

"""Spark results against DuckDB on the same tables."""

from __future__ import annotations

import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        p = os.path.join(folder, f)
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x: object) -> str:
        return repr(round(float(x), 6)) if isinstance(x, float) else str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def same(df, connection: duckdb.DuckDBPyConnection, sql: str) -> None:
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = connection.execute(sql)
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == canonical(columns, cur.fetchall())
